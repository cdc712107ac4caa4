"""Conflicts between the grants of rights_grant: pairs, layers, reasons, reports, and checks of their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges
from ..operators.intervals import spelled
from ..sources.tables import table
from .rights import AXES_SQL, LEGAL_RIGHTS, MODES, axis

#: Days since 1970 that stand for the open ends of a period.
FIRST, LAST = -1_000_000, 10_000_000
# The layer that stops a pair of grants, and the reason a user is told.
LAYERS = (("no_exclusive_overlap", "EXCLUSIVE_OVERLAP"), ("no_exclusivity_conflict", "EXCLUSIVITY_MISMATCH"))
EVIDENCE_KEYS = ("legal_right", "exploitation_mode", "territory", "period", "exclusivity")


def _day(text: Column, absent: int) -> Column:
    days = F.datediff(text.try_cast("date"), F.lit("1970-01-01").cast("date"))
    return F.when(text == "", absent).when(text == "infinity", LAST).when(text == "-infinity", FIRST).otherwise(days)


def grants(spark: SparkSession, sf: str) -> DataFrame:
    """Grants with their spans on both axes and their period as days [lo, hi); those without a period, territory or exclusivity are left out."""
    t = table(spark, sf, "rights_grant", "id", "contract_id", "contract_history_id", "content_asset_id", "territory", "legal_right", "exploitation_mode", "period", "exclusivity", "status")
    p = F.regexp_replace("period", '[" ]', "")
    a, z = (F.split(F.substring(p, F.lit(2), F.length(p) - 2), ",").getItem(i) for i in (0, 1))
    lo = _day(a, FIRST) + F.when((p.startswith("(")) & ~a.isin("", "infinity", "-infinity"), 1).otherwise(0)
    hi = _day(z, LAST) + F.when((p.endswith("]")) & ~z.isin("", "infinity", "-infinity"), 1).otherwise(0)
    t = t.filter("period LIKE '%,%' AND territory IS NOT NULL AND exclusivity IS NOT NULL").select(
        "id", "contract_id", "contract_history_id", "content_asset_id", F.upper(F.trim("territory")).alias("territory"), "legal_right", "exploitation_mode",
        F.regexp_replace(F.lower(spelled(F.col("exclusivity"))), r"[\s_-]+", "_").alias("exclusivity"), "status", lo.alias("lo"), hi.alias("hi"),
    ).filter("lo < hi").distinct()
    ax = lambda rows, c, k: F.broadcast(axis(spark, rows).select(F.col("code").alias(c), F.col("lo").alias(f"{k}_lo"), F.col("hi").alias(f"{k}_hi")))
    return t.join(ax(LEGAL_RIGHTS, "legal_right", "l"), "legal_right").join(ax(MODES, "exploitation_mode", "m"), "exploitation_mode")


def _meeting(g: DataFrame) -> DataFrame:
    """Pairs a, b of active grants of two contracts that meet on both axes and in time, not both non-exclusive."""
    inside = lambda x, y: (F.col(f"a.{x}_lo") < F.col(f"b.{x}_hi")) & (F.col(f"b.{x}_lo") < F.col(f"a.{x}_hi"))
    free = (F.col("a.exclusivity") == "non_exclusive") & (F.col("b.exclusivity") == "non_exclusive")
    return ranges.day_overlap_join(g, g, ["content_asset_id", "territory"], extra=(F.col("a.contract_id") != F.col("b.contract_id")) & inside("l", "l") & inside("m", "m") & ~free)


def _day_text(c: Column, open_: tuple[str, str] = ("", "")) -> Column:
    return F.when(c <= FIRST, open_[0]).when(c >= LAST, open_[1]).otherwise(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), c), "yyyy-MM-dd"))


def _common() -> Column:
    """The common part of the periods as text; an open end is left empty."""
    lo, hi = F.greatest("a.lo", "b.lo"), F.least("a.hi", "b.hi")
    return F.concat(F.when(lo <= FIRST, "(").otherwise("["), _day_text(lo), F.lit(","), _day_text(hi), F.lit(")"))


def _relation(code: str, k: str) -> Column:
    holds = lambda x, y: (F.col(f"{x}.{k}_lo") <= F.col(f"{y}.{k}_lo")) & (F.col(f"{y}.{k}_hi") <= F.col(f"{x}.{k}_hi"))
    return F.when(F.col(f"a.{code}") == F.col(f"b.{code}"), "same").when(holds("b", "a"), "existing_is_broader").when(holds("a", "b"), "incoming_is_broader").otherwise("overlap")


def _layer() -> Column:
    both = (F.col("a.exclusivity") != "non_exclusive") & (F.col("b.exclusivity") != "non_exclusive")
    return F.when(both, LAYERS[0][0]).otherwise(LAYERS[1][0])


def grant_conflicts(spark, sf):
    """Each pair of conflicting grants once, the smaller contract as the existing one: the common period, how the axes
    relate, the layer that stops the pair and the reason for it."""
    active = grants(spark, sf).filter("status = 'active'")
    pairs = _meeting(active).filter("a.contract_id > b.contract_id").select(
        F.col("a.id").alias("incoming_id"), F.col("b.id").alias("existing_id"), F.col("a.content_asset_id").alias("content_asset_id"), F.col("a.territory").alias("territory"),
        _common().alias("overlap_period"), _relation("legal_right", "l").alias("legal_right_relation"), _relation("exploitation_mode", "m").alias("exploitation_mode_relation"), _layer().alias("blocking_layer"),
    )
    reasons = F.broadcast(spark.createDataFrame(list(LAYERS), "blocking_layer string, reason string"))
    return pairs.join(reasons, "blocking_layer", "left")


def conflicts_by_layer(spark, sf):
    """Conflicts counted by asset and layer."""
    return grant_conflicts(spark, sf).groupBy("content_asset_id", "blocking_layer").agg(F.count("*").alias("pairs"), F.countDistinct("incoming_id").alias("incoming"))


def conflict_reports(spark, sf):
    """Per generation of a contract its report: every conflict of its grants with those of other contracts, as JSON in the order of the ids."""
    active = grants(spark, sf).filter("status = 'active'")
    incoming = F.struct(F.col("a.legal_right").alias("legal_right"), F.col("a.exploitation_mode").alias("exploitation_mode"), F.col("a.territory").alias("territory"), F.col("a.exclusivity").alias("exclusivity"))
    entry = F.struct(
        incoming.alias("incoming"), F.col("b.id").alias("existing_grant_id"), F.col("b.contract_id").alias("existing_contract_id"), _common().alias("overlap_period"),
        _relation("legal_right", "l").alias("legal_right_relation"), _relation("exploitation_mode", "m").alias("exploitation_mode_relation"), _layer().alias("blocking_layer"),
    )
    rows = _meeting(active).select(F.col("a.contract_history_id").alias("contract_history_id"), F.struct(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.to_json(entry).alias("e")).alias("r"))
    whole = rows.groupBy("contract_history_id").agg(F.count("*").alias("conflicts"), F.sort_array(F.collect_list("r")).alias("r"))
    return whole.select("contract_history_id", "conflicts", F.concat(F.lit('{"conflicts":['), F.array_join(F.transform("r", lambda x: x["e"]), ","), F.lit("]}")).alias("report"))


def batch_overlaps(spark, sf):
    """Grants of one generation that overlap each other: same asset and territory, both axes and the period meet."""
    g = grants(spark, sf).filter("contract_history_id IS NOT NULL")
    inside = lambda x: (F.col(f"a.{x}_lo") < F.col(f"b.{x}_hi")) & (F.col(f"b.{x}_lo") < F.col(f"a.{x}_hi"))
    met = ranges.day_overlap_join(g, g, ["contract_history_id", "content_asset_id", "territory"], extra=(F.col("a.id") < F.col("b.id")) & inside("l") & inside("m"))
    return met.select(F.col("a.contract_history_id").alias("contract_history_id"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), _common().alias("overlap_period"))


def evidence_validity(spark, sf):
    """Per required key how many grants have evidence for it that holds: an object with a quote that is not blank, or an array of such only."""
    g = table(spark, sf, "rights_grant", "id", "evidence").distinct()
    parts = []
    for k in EVIDENCE_KEYS:
        own = F.get_json_object("evidence", f"$.{k}")
        one = lambda e: F.coalesce(F.trim(F.get_json_object(e, "$.quote")) != "", F.lit(False))
        items = F.from_json(own, "array<string>")
        good = F.when(own.startswith("["), F.forall(items, one)).when(own.startswith("{"), one(own)).otherwise(False)
        parts.append(F.struct(F.lit(k).alias("key"), F.coalesce(good, F.lit(False)).alias("valid"), F.coalesce(F.when(own.startswith("["), F.size(items)).when(own.startswith("{"), 1), F.lit(0)).alias("entries")))
    each = g.select("id", F.explode(F.array(*parts)).alias("e")).select("id", "e.*")
    return each.groupBy("key", "valid").agg(F.count("*").alias("grants"), F.sum("entries").alias("entries"))


def grant_checks(spark, sf):
    """Rules of a grant and how many rows break each: empty period, termination without its fields or the reverse, unknown axis codes, missing keys of evidence."""
    g = table(spark, sf, "rights_grant", "id", "status", "period", "terminated_at", "terminated_reason", "legal_right", "exploitation_mode", "territory", "exclusivity", "evidence").distinct()
    ended = F.col("terminated_at").isNotNull()
    rules = {
        "period_missing": F.coalesce(F.trim("period") == "", F.lit(True)) | (F.lower(F.trim(F.coalesce("period", F.lit("")))) == "empty"),
        "terminated_without_date": (F.col("status") == "terminated") & ~ended,
        "terminated_without_reason": (F.col("status") == "terminated") & F.col("terminated_reason").isNull(),
        "active_with_date": (F.col("status") == "active") & ended,
        "legal_right_unknown": ~F.coalesce(F.col("legal_right").isin([r[0] for r in LEGAL_RIGHTS]), F.lit(False)),
        "mode_unknown": ~F.coalesce(F.col("exploitation_mode").isin([r[0] for r in MODES]), F.lit(False)),
        "territory_not_normal": ~F.coalesce(F.col("territory").rlike("^[A-Z]{2}$"), F.lit(False)),
        "exclusivity_not_normal": ~F.coalesce(F.col("exclusivity").isin("exclusive", "sole", "non_exclusive"), F.lit(False)),
        "evidence_missing": F.col("evidence").isNull(),
    }
    flags = g.agg(*[F.sum(rule.cast("int")).cast("long").alias(name) for name, rule in rules.items()])
    return flags.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "rows"))


def territory_timeline(spark, sf):
    """Per asset and territory: first and last day held, and where in that stretch (per mille) each bounded grant begins and ends."""
    g = grants(spark, sf).filter(f"status = 'active' AND lo > {FIRST} AND hi < {LAST}")
    ends = g.groupBy("content_asset_id", "territory").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    place = lambda c: F.floor((F.col(c) - F.col("first")) * 1000 / (F.col("last") - F.col("first"))).cast("long")
    return g.join(ends, ["content_asset_id", "territory"]).select("id", "content_asset_id", "territory", _day_text(F.col("first")).alias("first_day"), _day_text(F.col("last")).alias("last_day"), place("lo").alias("from_permille"), place("hi").alias("to_permille")).distinct()


def queries() -> dict:
    return {f.__name__: f for f in (grant_conflicts, conflicts_by_layer, conflict_reports, batch_overlaps, evidence_validity, grant_checks, territory_timeline)}


_G = f"""WITH {AXES_SQL},
g0 AS (SELECT DISTINCT id, contract_id, contract_history_id, content_asset_id, upper(trim(territory)) AS territory, legal_right, exploitation_mode, status,
         regexp_replace(lower(trim(exclusivity)), '[\\s_-]+', '_', 'g') AS exclusivity, regexp_replace(period, '[" ]', '', 'g') AS p
  FROM rights_grant WHERE territory IS NOT NULL AND exclusivity IS NOT NULL AND period LIKE '%,%'),
g1 AS (SELECT *, split_part(p[2:-2], ',', 1) AS a, split_part(p[2:-2], ',', 2) AS z FROM g0),
g AS (SELECT DISTINCT id, contract_id, contract_history_id, content_asset_id, territory, legal_right, exploitation_mode, status, exclusivity,
        l.lo AS l_lo, l.hi AS l_hi, m.lo AS m_lo, m.hi AS m_hi,
        CASE WHEN a IN ('', '-infinity') THEN {FIRST} WHEN a = 'infinity' THEN {LAST} ELSE datediff('day', DATE '1970-01-01', a::DATE) + (p[1] = '(')::INT END AS lo,
        CASE WHEN z IN ('', 'infinity') THEN {LAST} WHEN z = '-infinity' THEN {FIRST} ELSE datediff('day', DATE '1970-01-01', z::DATE) + (p[-1] = ']')::INT END AS hi
  FROM g1 JOIN lr l ON l.code = legal_right JOIN em m ON m.code = exploitation_mode),
h AS (SELECT * FROM g WHERE lo < hi)"""


def _text_sql(c: str) -> str:
    return f"CASE WHEN {c} <= {FIRST} OR {c} >= {LAST} THEN '' ELSE strftime(DATE '1970-01-01' + ({c})::INT, '%Y-%m-%d') END"


_LO, _HI = "greatest(a.lo, b.lo)", "least(a.hi, b.hi)"
_COMMON = f"CASE WHEN {_LO} <= {FIRST} THEN '(' ELSE '[' END || {_text_sql(_LO)} || ',' || {_text_sql(_HI)} || ')'"
_REL = lambda c, k: (
    f"CASE WHEN a.{c} = b.{c} THEN 'same' WHEN b.{k}_lo <= a.{k}_lo AND a.{k}_hi <= b.{k}_hi THEN 'existing_is_broader' WHEN a.{k}_lo <= b.{k}_lo AND b.{k}_hi <= a.{k}_hi THEN 'incoming_is_broader' ELSE 'overlap' END"
)
_MEET = f""", pair AS (SELECT a.id AS incoming_id, b.id AS existing_id, a.contract_id AS ca, b.contract_id AS cb, a.contract_history_id, a.content_asset_id, a.territory, a.legal_right, a.exploitation_mode, a.exclusivity,
  {_COMMON} AS overlap_period, {_REL('legal_right', 'l')} AS legal_right_relation, {_REL('exploitation_mode', 'm')} AS exploitation_mode_relation,
  CASE WHEN a.exclusivity <> 'non_exclusive' AND b.exclusivity <> 'non_exclusive' THEN 'no_exclusive_overlap' ELSE 'no_exclusivity_conflict' END AS blocking_layer
  FROM h a JOIN h b ON a.content_asset_id = b.content_asset_id AND a.territory = b.territory AND a.contract_id <> b.contract_id AND a.l_lo < b.l_hi AND b.l_lo < a.l_hi AND a.m_lo < b.m_hi AND b.m_lo < a.m_hi
  AND a.lo < b.hi AND b.lo < a.hi WHERE a.status = 'active' AND b.status = 'active' AND NOT (a.exclusivity = 'non_exclusive' AND b.exclusivity = 'non_exclusive'))"""
_FOUND = _G + _MEET + """, c AS (SELECT incoming_id, existing_id, content_asset_id, territory, overlap_period, legal_right_relation, exploitation_mode_relation, blocking_layer,
  CASE blocking_layer WHEN 'no_exclusive_overlap' THEN 'EXCLUSIVE_OVERLAP' ELSE 'EXCLUSIVITY_MISMATCH' END AS reason FROM pair WHERE ca > cb)"""


def oracle_sql() -> dict[str, str]:
    e = "json_extract(evidence, '$.' || k)"
    good = "json_type(%s) = 'OBJECT' AND trim(coalesce(json_extract_string(%s, '$.quote'), '')) <> ''"
    return {
        "grant_conflicts": _FOUND + " SELECT * FROM c",
        "conflicts_by_layer": _FOUND + " SELECT content_asset_id, blocking_layer, count(*) AS pairs, count(DISTINCT incoming_id) AS incoming FROM c GROUP BY ALL",
        "conflict_reports": _G + _MEET + """ SELECT contract_history_id, count(*) AS conflicts, '{"conflicts":[' || string_agg(to_json({'incoming': {'legal_right': legal_right, 'exploitation_mode': exploitation_mode, 'territory': territory, 'exclusivity': exclusivity},
  'existing_grant_id': existing_id, 'existing_contract_id': cb, 'overlap_period': overlap_period, 'legal_right_relation': legal_right_relation, 'exploitation_mode_relation': exploitation_mode_relation, 'blocking_layer': blocking_layer})::VARCHAR, ',' ORDER BY incoming_id, existing_id) || ']}' AS report
FROM pair GROUP BY contract_history_id""",
        "batch_overlaps": _G + f""" SELECT a.contract_history_id, a.id AS id_a, b.id AS id_b, {_COMMON} AS overlap_period FROM h a JOIN h b ON a.contract_history_id = b.contract_history_id AND a.content_asset_id = b.content_asset_id
  AND a.territory = b.territory AND a.id < b.id AND a.l_lo < b.l_hi AND b.l_lo < a.l_hi AND a.m_lo < b.m_hi AND b.m_lo < a.m_hi AND a.lo < b.hi AND b.lo < a.hi""",
        "evidence_validity": f"""WITH g AS (SELECT DISTINCT id, evidence::JSON AS evidence FROM rights_grant), k AS (SELECT unnest({list(EVIDENCE_KEYS)}) AS k),
x AS (SELECT k, {e} AS e FROM g, k),
y AS (SELECT k, CASE json_type(e) WHEN 'ARRAY' THEN len(list_filter(e::JSON[], LAMBDA q: NOT ({good % ('q', 'q')}))) = 0 WHEN 'OBJECT' THEN {good % ('e', 'e')} ELSE false END AS valid,
  CASE json_type(e) WHEN 'ARRAY' THEN json_array_length(e) WHEN 'OBJECT' THEN 1 ELSE 0 END AS entries FROM x)
SELECT k AS key, coalesce(valid, false) AS valid, count(*) AS grants, sum(coalesce(entries, 0))::BIGINT AS entries FROM y GROUP BY ALL""",
        "grant_checks": f"""WITH g AS (SELECT DISTINCT id, status, period, terminated_at, terminated_reason, legal_right, exploitation_mode, territory, exclusivity, evidence FROM rights_grant)
SELECT unnest(['period_missing', 'terminated_without_date', 'terminated_without_reason', 'active_with_date', 'legal_right_unknown', 'mode_unknown', 'territory_not_normal', 'exclusivity_not_normal', 'evidence_missing']) AS rule,
 unnest([count_if(period IS NULL OR trim(period) = '' OR lower(trim(period)) = 'empty'), count_if(status = 'terminated' AND terminated_at IS NULL), count_if(status = 'terminated' AND terminated_reason IS NULL),
  count_if(status = 'active' AND terminated_at IS NOT NULL), count_if(NOT coalesce(legal_right IN {tuple(r[0] for r in LEGAL_RIGHTS)}, false)), count_if(NOT coalesce(exploitation_mode IN {tuple(r[0] for r in MODES)}, false)),
  count_if(NOT coalesce(regexp_matches(territory, '^[A-Z][A-Z]$'), false)), count_if(NOT coalesce(exclusivity IN ('exclusive', 'sole', 'non_exclusive'), false)), count_if(evidence IS NULL)])::BIGINT AS rows FROM g""",
        "territory_timeline": _G + f""", b AS (SELECT * FROM h WHERE status = 'active' AND lo > {FIRST} AND hi < {LAST}), e AS (SELECT content_asset_id, territory, min(lo) AS first, max(hi) AS last FROM b GROUP BY ALL)
SELECT DISTINCT id, content_asset_id, territory, {_text_sql('first')} AS first_day, {_text_sql('last')} AS last_day, floor((lo - first) * 1000 / (last - first))::BIGINT AS from_permille, floor((hi - first) * 1000 / (last - first))::BIGINT AS to_permille
FROM b JOIN e USING (content_asset_id, territory)""",
    }
