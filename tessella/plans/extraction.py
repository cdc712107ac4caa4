"""From extraction results to what is taken over: parties, products, territories, evidence, and checks with a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from .corpus import P2_SQL, _flattened
from .rights import LEGAL_RIGHTS, MODES

# Groups of countries (a small dimension).
GROUPS = {"APAC": ("AU", "CN", "HK", "ID", "JP", "KR", "MY", "PH", "SG", "TH", "TW", "VN"), "ASIA": ("CN", "HK", "JP", "KR", "TW"), "EU": ("DE", "FR")}
CODES = tuple(r[0] for r in LEGAL_RIGHTS), tuple(r[0] for r in MODES)
#: Confidence below which a result is looked at by a person, and below which it is in doubt.
DOUBT, LOOK = 0.70, 0.85


def _rows(f: nested.Flattened, array: str, /, **columns: str) -> DataFrame:
    """The table of an array with these fields, null where no record has them."""
    t = f.table(array)
    return t.select(F.col("record_id").alias("tmpid"), "row_key", "parent_key", "child_path", "ordinal", *[(F.col(c).cast(kind) if c in t.columns else F.lit(None).cast(kind)).alias(c) for c, kind in columns.items()])


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def contract_parties(spark, sf):
    """Per result the first grantor and grantee by role, and amount and currency of the first payment (amounts that are no number are left out)."""
    f = _flattened(spark, sf)
    p = _rows(f, "parties", role="string", name="string")
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("name")), F.when(F.col("role") == role, F.col("ordinal")))
    names = p.groupBy("tmpid").agg(first("GRANTOR").alias("grantor"), first("GRANTEE").alias("grantee"), F.count("*").alias("parties"))
    pay = _rows(f, "payments", amount="string", currency="string").groupBy("tmpid").agg(F.min(F.struct("ordinal", F.expr("try_cast(amount AS decimal(18,2))").alias("amount"), "currency")).alias("m"))
    both = names.join(pay.select("tmpid", "m.amount", "m.currency"), "tmpid", "full")
    return both.select("tmpid", _text("grantor").alias("grantor"), _text("grantee").alias("grantee"), F.coalesce("parties", F.lit(0)).cast("long").alias("parties"), _text(F.col("amount").cast("string")).alias("amount"), _text("currency").alias("currency"))


def grant_products(spark, sf):
    """Each legal right with each mode of a grant, once, and whether both codes are known."""
    g = _rows(_flattened(spark, sf), "rights_grants", legal_right_values="array<string>", exploitation_mode_values="array<string>")
    each = g.select("tmpid", "child_path", F.explode("legal_right_values").alias("legal_right"), "exploitation_mode_values").select("tmpid", "child_path", "legal_right", F.explode("exploitation_mode_values").alias("mode"))
    return each.filter("legal_right IS NOT NULL AND mode IS NOT NULL").distinct().withColumn("known", F.col("legal_right").isin(*CODES[0]) & F.col("mode").isin(*CODES[1]))


def unmapped_codes(spark, sf):
    """Codes that no axis knows, or known ones, with the grants that use them."""
    g = _rows(_flattened(spark, sf), "rights_grants", legal_right_values="array<string>", exploitation_mode_values="array<string>", exclusivity_value="string")
    pairs = [("legal_right", "legal_right_values", CODES[0]), ("exploitation_mode", "exploitation_mode_values", CODES[1])]
    parts = [g.select(F.lit(n).alias("axis"), "row_key", F.explode(c).alias("code")).withColumn("known", F.col("code").isin(*codes)) for n, c, codes in pairs]
    parts.append(g.select(F.lit("exclusivity").alias("axis"), "row_key", F.col("exclusivity_value").alias("code")).withColumn("known", F.col("code").isin("EXCLUSIVE", "NON_EXCLUSIVE")))
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).filter("code IS NOT NULL").distinct()
    return every.groupBy("axis", "code", "known").agg(F.count("*").alias("grants"))


def effective_territories(spark, sf):
    """Countries of each grant: its values by the definitions beside them, else by the groups of countries, else as they
    stand, less what is excluded; sorted, and what is no code of a country apart."""
    f = _flattened(spark, sf)
    g = _rows(f, "rights_grants", territory_values="array<string>", territory_excluded_values="array<string>")
    terms = _rows(f, "definitions", term="string", members="array<string>").filter("term IS NOT NULL AND members IS NOT NULL").groupBy(F.col("parent_key").alias("row_key"), F.col("term").alias("code")).agg(F.min_by("members", "ordinal").alias("own"))
    groups = F.broadcast(spark.createDataFrame([(k, list(v)) for k, v in GROUPS.items()], "code string, members array<string>"))

    def members(column: str) -> DataFrame:
        each = g.select("row_key", F.explode(column).alias("code")).filter("code IS NOT NULL")
        named = each.join(terms, ["row_key", "code"], "left").join(groups, "code", "left")
        return named.select("row_key", F.explode(F.coalesce("own", "members", F.array("code"))).alias("country")).distinct()

    kept = members("territory_values").join(members("territory_excluded_values"), ["row_key", "country"], "left_anti")
    code = F.col("country").rlike("^[A-Z]{2}$")
    lists = kept.groupBy("row_key").agg(F.array_join(F.sort_array(F.collect_list(F.when(code, F.col("country")))), ",").alias("countries"), F.array_join(F.sort_array(F.collect_list(F.when(~code, F.col("country")))), ",").alias("unknown"))
    return g.join(lists, "row_key", "left").select("tmpid", "child_path", _text("countries").alias("countries"), _text("unknown").alias("unknown"))


def _targets(f: nested.Flattened) -> DataFrame:
    """Targets of evidence with the reference and the place of their evidence."""
    e = _rows(f, "evidence", evidence_ref="string").select(F.col("row_key").alias("parent_key"), "evidence_ref", F.col("child_path").alias("evidence_path"))
    return _rows(f, "targets", target_ref="string", field="string").join(e, "parent_key")


def evidence_index(spark, sf):
    """What speaks for each field of each grant: the references of its evidence, in order."""
    t = _targets(_flattened(spark, sf)).filter("target_ref IS NOT NULL AND field IS NOT NULL AND evidence_ref IS NOT NULL")
    return t.groupBy("tmpid", "target_ref", "field").agg(F.array_join(F.sort_array(F.collect_set("evidence_ref")), ",").alias("evidence"))


def dangling_targets(spark, sf):
    """Per result its targets and how many name neither a grant nor a payment of it."""
    f = _flattened(spark, sf)
    known = _rows(f, "rights_grants", grant_ref="string").select("tmpid", F.col("grant_ref").alias("target_ref")).unionAll(_rows(f, "payments", payment_ref="string").select("tmpid", F.col("payment_ref").alias("target_ref"))).filter("target_ref IS NOT NULL").distinct()
    t = _targets(f).join(known.withColumn("found", F.lit(1)), ["tmpid", "target_ref"], "left")
    return t.groupBy("tmpid").agg(F.count("*").alias("targets"), F.count_if(F.col("found").isNull()).alias("dangling"))


FIELDS = {"legal_right": "legal_right_raw_expression", "exclusivity": "exclusivity_raw_expression"}


def field_evidence(spark, sf):
    """Where each field of a grant is taken from: the evidence that names it, else the expression that stands with it, else nothing."""
    f = _flattened(spark, sf)
    g = _rows(f, "rights_grants", grant_ref="string", **dict.fromkeys(FIELDS.values(), "string"))
    each = g.select("tmpid", "child_path", "grant_ref", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("raw")) for k, c in FIELDS.items()])).alias("x")).select("tmpid", "child_path", "grant_ref", "x.*")
    named = _targets(f).filter("evidence_ref IS NOT NULL").groupBy("tmpid", F.col("target_ref").alias("grant_ref"), "field").agg(F.min("evidence_ref").alias("ref"))
    both = each.join(named, ["tmpid", "grant_ref", "field"], "left")
    source = F.when(F.col("ref").isNotNull(), "evidence").when(F.col("raw") != "", "expression").otherwise("none")
    return both.select("tmpid", "child_path", "field", source.alias("source"), F.coalesce("ref", F.nullif("raw", F.lit("")), F.lit("")).alias("text"))


def result_validation(spark, sf):
    """Per result: grants, periods that end before they start, dangling targets, evidence without text, and a confidence
    (0.6 evidence, 0.2 references, 0.2 periods) with the colour it leads to."""
    f = _flattened(spark, sf)
    g = _rows(f, "rights_grants", license_period_start="string", license_period_end="string")
    bad = F.coalesce(F.expr("try_cast(license_period_start AS date) >= try_cast(license_period_end AS date)"), F.lit(False))
    grants = g.groupBy("tmpid").agg(F.count("*").alias("grants"), F.count_if(bad).alias("reversed"))
    ev = _rows(f, "evidence", text="string", evidence_ref="string").groupBy("tmpid").agg(F.count("*").alias("evidence"), F.count_if(F.length(F.trim(_text("text"))) > 0).alias("quoted"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(1.0))
    every = grants.join(ev, "tmpid", "full").join(dangling_targets(spark, sf), "tmpid", "full").na.fill(0)
    score = F.round(0.6 * share("quoted", "evidence") + 0.2 * (1 - F.when(F.col("targets") > 0, F.col("dangling") / F.col("targets")).otherwise(F.lit(0.0))) + 0.2 * (1 - F.when(F.col("grants") > 0, F.col("reversed") / F.col("grants")).otherwise(F.lit(0.0))), 3)
    colour = F.when(F.col("confidence") < DOUBT, "RED").when(F.col("confidence") < LOOK, "YELLOW").otherwise("GREEN")
    return every.select("tmpid", "grants", "reversed", "evidence", "quoted", "targets", "dangling", score.alias("confidence")).withColumn("colour", colour)


def _at(f: nested.Flattened, *places: str) -> Column:
    """The first value at one of the places of the record (dots between fields) that the merged schema has."""
    found = []
    for place in places:
        t, c = f.schema, F.col("rec")
        for name in place.split("."):
            if not isinstance(t, nested.T.StructType) or name not in t.names:
                break
            c, t = c.getField(name), t[name].dataType
        else:
            found.append(c.cast("string"))
    return F.coalesce(*found, F.lit(""))


def compact_contracts(spark, sf):
    """The compact form of each result: title, day and language of the contract, its parties in order and its number of grants, as JSON."""
    f = _flattened(spark, sf)
    head = f.typed.select(
        F.col("record_id").alias("tmpid"), _at(f, "raw.contract.contract_title.value", "contract.contract_title.value").alias("title"),
        _at(f, "raw.contract.agreement_date.value", "contract.agreement_date.value").alias("agreed"), _at(f, "raw.document.language", "document.language").alias("language"),
    )
    p = _rows(f, "parties", role="string", name="string").groupBy("tmpid").agg(F.sort_array(F.collect_list(F.struct("ordinal", _text("role").alias("role"), _text("name").alias("name")))).alias("p"))
    g = _rows(f, "rights_grants").groupBy("tmpid").agg(F.count("*").alias("grants"))
    rows = head.join(p, "tmpid", "left").join(g, "tmpid", "left")
    parties = F.transform(F.coalesce("p", F.array().cast("array<struct<ordinal:int,role:string,name:string>>")), lambda x: F.struct(x["role"].alias("role"), x["name"].alias("name")))
    whole = F.struct("title", "agreed", "language", parties.alias("parties"), F.coalesce("grants", F.lit(0)).alias("grants"))
    return rows.select("tmpid", F.to_json(whole).alias("compact"))


def queries() -> dict:
    return {f.__name__: f for f in (compact_contracts, contract_parties, grant_products, unmapped_codes, effective_territories, evidence_index, dangling_targets, field_evidence, result_validation)}


_CAMEL = {"rightsGrants": "rights_grants", "legalRight": "legal_right", "exploitationMode": "exploitation_mode", "excludedValues": "excluded_values", "grantRef": "grant_ref", "paymentRef": "payment_ref", "evidenceRef": "evidence_ref", "targetRef": "target_ref", "licensePeriod": "license_period", "rawExpression": "raw_expression", "scopeModifiers": "scope_modifiers"}


def _snake_sql() -> str:
    out = "j"
    for a, b in _CAMEL.items():
        out = f"""replace({out}, '"{a}"', '"{b}"')"""
    return out


_NAMES = "|".join(nested.ARRAY_FIELDS)
_OBJ = P2_SQL[: P2_SQL.index("object AS (")] + f"""rec AS (SELECT tmpid, {_snake_sql()}::JSON AS j FROM record WHERE json_valid(j)),
node AS (SELECT r.tmpid, t.value AS v, string_split(t.fullkey[3:], '.') AS steps FROM rec r, json_tree(r.j) AS t WHERE t.type = 'OBJECT' AND t.fullkey <> '$'),
named AS (SELECT tmpid, v, regexp_replace(steps[-1], '\\[.*', '') AS name, list_transform(list_filter(steps, LAMBDA x: regexp_matches(x, '^({_NAMES})(\\[|$)')), LAMBDA x: CASE WHEN x LIKE '%]' THEN x ELSE x || '[0]' END) AS steps
  FROM node WHERE regexp_matches(steps[-1], '^({_NAMES})(\\[[0-9]+\\])?$')),
o AS (SELECT DISTINCT tmpid, v, name, array_to_string(steps, '/') AS child_path, array_to_string(steps[:-2], '/') AS parent_path, regexp_extract(steps[-1], '([0-9]+)', 1)::INT AS ordinal FROM named),
g AS (SELECT tmpid, child_path, v, v->>'$.grant_ref' AS grant_ref FROM o WHERE name = 'rights_grants'),
tg AS (SELECT t.tmpid, t.v->>'$.target_ref' AS target_ref, t.v->>'$.field' AS field, e.v->>'$.evidence_ref' AS evidence_ref FROM o t JOIN o e ON t.tmpid = e.tmpid AND t.parent_path = e.child_path WHERE t.name = 'targets' AND e.name = 'evidence'),
kn AS (SELECT DISTINCT tmpid, grant_ref AS target_ref FROM g WHERE grant_ref IS NOT NULL UNION SELECT DISTINCT tmpid, v->>'$.payment_ref' FROM o WHERE name = 'payments' AND v->>'$.payment_ref' IS NOT NULL),
dg AS (SELECT t.tmpid, count(*) AS targets, count_if(k.target_ref IS NULL)::BIGINT AS dangling FROM tg t LEFT JOIN kn k ON k.tmpid = t.tmpid AND k.target_ref = t.target_ref GROUP BY t.tmpid)"""
_LIST = lambda path: f"CASE WHEN json_type(json_extract(v, '{path}')) = 'ARRAY' THEN json_extract_string(v, '{path}[*]') ELSE []::VARCHAR[] END"
_TERR = _OBJ + f""", df AS (SELECT tmpid, parent_path AS child_path, v->>'$.term' AS code, arg_min(json_extract_string(v, '$.members[*]'), ordinal) AS own FROM o WHERE name = 'definitions' AND v->>'$.term' IS NOT NULL AND json_type(json_extract(v, '$.members')) = 'ARRAY' GROUP BY ALL),
gr AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {list(v)})" for k, v in GROUPS.items())}) t(code, members)),
va AS (SELECT tmpid, child_path, 'in' AS side, unnest({_LIST('$.territory.values')}) AS code FROM g UNION ALL SELECT tmpid, child_path, 'out', unnest({_LIST('$.territory.excluded_values')}) FROM g),
me AS (SELECT DISTINCT va.tmpid, va.child_path, side, unnest(coalesce(df.own, gr.members, [va.code])) AS country FROM va LEFT JOIN df ON df.tmpid = va.tmpid AND df.child_path = va.child_path AND df.code = va.code LEFT JOIN gr ON gr.code = va.code WHERE va.code IS NOT NULL),
ke AS (SELECT tmpid, child_path, country FROM me WHERE side = 'in' EXCEPT SELECT tmpid, child_path, country FROM me WHERE side = 'out'),
ls AS (SELECT tmpid, child_path, coalesce(string_agg(country, ',' ORDER BY country) FILTER (regexp_matches(country, '^[A-Z][A-Z]$')), '') AS countries, coalesce(string_agg(country, ',' ORDER BY country) FILTER (NOT regexp_matches(country, '^[A-Z][A-Z]$')), '') AS unknown FROM ke GROUP BY ALL)
SELECT g.tmpid, g.child_path, coalesce(countries, '') AS countries, coalesce(unknown, '') AS unknown FROM g LEFT JOIN ls ON ls.tmpid = g.tmpid AND ls.child_path = g.child_path"""


def oracle_sql() -> dict[str, str]:
    known = lambda c, codes: f"{c} IN {codes}"
    return {
        "compact_contracts": _OBJ + """, p AS (SELECT tmpid, list({'role': coalesce(v->>'$.role', ''), 'name': coalesce(v->>'$.name', '')} ORDER BY ordinal) AS p FROM o WHERE name = 'parties' GROUP BY tmpid), n AS (SELECT tmpid, count(*) AS grants FROM g GROUP BY tmpid),
hd AS (SELECT tmpid, coalesce(j->>'$.raw.contract.contract_title.value', j->>'$.raw.contract.contractTitle.value', j->>'$.contract.contract_title.value', j->>'$.contract.contractTitle.value', '') AS title,
  coalesce(j->>'$.raw.contract.agreement_date.value', j->>'$.raw.contract.agreementDate.value', j->>'$.contract.agreement_date.value', j->>'$.contract.agreementDate.value', '') AS agreed, coalesce(j->>'$.raw.document.language', j->>'$.document.language', '') AS language FROM rec)
SELECT tmpid, to_json({'title': title, 'agreed': agreed, 'language': language, 'parties': coalesce(p, []), 'grants': coalesce(grants, 0)})::VARCHAR AS compact FROM hd LEFT JOIN p USING (tmpid) LEFT JOIN n USING (tmpid)""",
        "contract_parties": _OBJ + """, n AS (SELECT tmpid, arg_min(v->>'$.name', ordinal) FILTER (v->>'$.role' = 'GRANTOR') AS grantor, arg_min(v->>'$.name', ordinal) FILTER (v->>'$.role' = 'GRANTEE') AS grantee, count(*) AS parties FROM o WHERE name = 'parties' GROUP BY tmpid),
p AS (SELECT tmpid, min({'ordinal': ordinal, 'amount': try_cast(v->>'$.amount' AS DECIMAL(18,2)), 'currency': v->>'$.currency'}) AS m FROM o WHERE name = 'payments' GROUP BY tmpid)
SELECT tmpid, coalesce(grantor, '') AS grantor, coalesce(grantee, '') AS grantee, coalesce(parties, 0) AS parties, coalesce(m.amount::VARCHAR, '') AS amount, coalesce(m.currency, '') AS currency FROM n FULL JOIN p USING (tmpid)""",
        "grant_products": _OBJ + f""", a AS (SELECT tmpid, child_path, v, unnest({_LIST('$.legal_right.values')}) AS legal_right FROM g), b AS (SELECT tmpid, child_path, legal_right, unnest({_LIST('$.exploitation_mode.values')}) AS mode FROM a)
SELECT DISTINCT *, {known('legal_right', CODES[0])} AND {known('mode', CODES[1])} AS known FROM b WHERE legal_right IS NOT NULL AND mode IS NOT NULL""",
        "unmapped_codes": _OBJ + f""", u AS (SELECT 'legal_right' AS axis, tmpid, child_path, unnest({_LIST('$.legal_right.values')}) AS code FROM g UNION SELECT 'exploitation_mode', tmpid, child_path, unnest({_LIST('$.exploitation_mode.values')}) FROM g
UNION SELECT 'exclusivity', tmpid, child_path, v->>'$.exclusivity.value' FROM g)
SELECT axis, code, CASE axis WHEN 'legal_right' THEN {known('code', CODES[0])} WHEN 'exploitation_mode' THEN {known('code', CODES[1])} ELSE code IN ('EXCLUSIVE', 'NON_EXCLUSIVE') END AS known, count(*) AS grants FROM u WHERE code IS NOT NULL GROUP BY ALL""",
        "effective_territories": _TERR,
        "evidence_index": _OBJ + " SELECT tmpid, target_ref, field, string_agg(DISTINCT evidence_ref, ',' ORDER BY evidence_ref) AS evidence FROM tg WHERE target_ref IS NOT NULL AND field IS NOT NULL AND evidence_ref IS NOT NULL GROUP BY ALL",
        "dangling_targets": _OBJ + " SELECT * FROM dg",
        "field_evidence": _OBJ + """, e AS (SELECT tmpid, child_path, grant_ref, unnest(['legal_right', 'exclusivity']) AS field, unnest([v->>'$.legal_right.raw_expression', v->>'$.exclusivity.raw_expression']) AS raw FROM g),
n AS (SELECT tmpid, target_ref AS grant_ref, field, min(evidence_ref) AS ref FROM tg WHERE evidence_ref IS NOT NULL GROUP BY ALL)
SELECT e.tmpid, e.child_path, e.field, CASE WHEN ref IS NOT NULL THEN 'evidence' WHEN raw <> '' THEN 'expression' ELSE 'none' END AS source, coalesce(ref, nullif(raw, ''), '') AS text FROM e LEFT JOIN n ON n.tmpid = e.tmpid AND n.grant_ref = e.grant_ref AND n.field = e.field""",
        "result_validation": _OBJ + f""", gg AS (SELECT tmpid, count(*) AS grants, count_if(coalesce(try_cast(v->>'$.license_period.start' AS DATE) >= try_cast(v->>'$.license_period.end' AS DATE), false))::BIGINT AS reversed FROM g GROUP BY tmpid),
ev AS (SELECT tmpid, count(*) AS evidence, count_if(length(trim(coalesce(v->>'$.text', ''))) > 0)::BIGINT AS quoted FROM o WHERE name = 'evidence' GROUP BY tmpid),
al AS (SELECT tmpid, coalesce(grants, 0) AS grants, coalesce(reversed, 0) AS reversed, coalesce(evidence, 0) AS evidence, coalesce(quoted, 0) AS quoted, coalesce(targets, 0) AS targets, coalesce(dangling, 0) AS dangling FROM gg FULL JOIN ev USING (tmpid) FULL JOIN dg USING (tmpid)),
sc AS (SELECT *, round(0.6::DOUBLE * CASE WHEN evidence > 0 THEN quoted / evidence ELSE 1 END + 0.2::DOUBLE * (1 - CASE WHEN targets > 0 THEN dangling / targets ELSE 0 END) + 0.2::DOUBLE * (1 - CASE WHEN grants > 0 THEN reversed / grants ELSE 0 END), 3) AS confidence FROM al)
SELECT *, CASE WHEN confidence < {DOUBT} THEN 'RED' WHEN confidence < {LOOK} THEN 'YELLOW' ELSE 'GREEN' END AS colour FROM sc""",
    }
