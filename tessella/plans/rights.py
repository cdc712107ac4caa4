"""Queries over grants of rights: interval joins, hierarchies, version chains, checks, grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ranges
from ..operators import relational as R
from ..sources.tables import register, table

# Nested-set places of the two axes (code, parent, left, right).
LEGAL_RIGHTS = (
    ("PUBLIC_TRANSMISSION", None, 1, 6), ("BROADCAST", "PUBLIC_TRANSMISSION", 2, 3), ("TRANSMISSION", "PUBLIC_TRANSMISSION", 4, 5), ("PUBLIC_PERFORMANCE", None, 7, 8),
    ("DISTRIBUTION", None, 9, 10), ("REPRODUCTION", None, 11, 12), ("DERIVATIVE_WORK_CREATION", None, 13, 14),
)
MODES = (
    ("VOD", None, 1, 8), ("SVOD", "VOD", 2, 3), ("AVOD", "VOD", 4, 5), ("TVOD", "VOD", 6, 7), ("TV_LINEAR", None, 9, 10), ("THEATRICAL", None, 11, 12), ("AUDIO_STREAMING", None, 13, 14),
)


def _values(rows: tuple) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def axis(spark: SparkSession, rows: tuple) -> DataFrame:
    """An axis with its spans [lo, hi)."""
    df = spark.createDataFrame(list(rows), "code string, parent_code string, lft int, rgt int")
    return df.withColumn("lo", F.col("lft")).withColumn("hi", F.col("rgt") + 1)


AXES_SQL = f"""lr AS (SELECT row_number() OVER (ORDER BY lft) - 1 AS n, *, lft AS lo, rgt + 1 AS hi FROM (VALUES {_values(LEGAL_RIGHTS)}) t(code, parent_code, lft, rgt)),
em AS (SELECT row_number() OVER (ORDER BY lft) - 1 AS n, *, lft AS lo, rgt + 1 AS hi FROM (VALUES {_values(MODES)}) t(code, parent_code, lft, rgt))"""

GRANTS_SQL = f"""WITH {AXES_SQL},
g AS (SELECT DISTINCT l_orderkey AS contract_id, l_partkey % 50 AS asset_id, l_suppkey % 16 AS territory, l.code AS legal_right, m.code AS mode,
  l.lo AS l_lo, l.hi AS l_hi, m.lo AS m_lo, m.hi AS m_hi, CAST(l_shipdate AS DATE) AS p_lo, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS p_hi,
  CASE l_returnflag WHEN 'A' THEN 'exclusive' WHEN 'R' THEN 'sole' ELSE 'non_exclusive' END AS exclusivity, l_linestatus = 'O' AS active
  FROM lineitem JOIN lr l ON l.n = l_linenumber % 7 JOIN em m ON m.n = l_suppkey % 7)"""


def grants(spark: SparkSession, sf: str) -> DataFrame:
    """Grants as derived from line items: keys, two axes with spans, a half-open period, exclusivity."""
    ax = lambda rows, p: axis(spark, rows).withColumn("n", F.row_number().over(W.orderBy("lft")) - 1).select("n", F.col("code").alias("legal_right" if p == "l" else "mode"), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"))
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    li = li.join(F.broadcast(ax(LEGAL_RIGHTS, "l").withColumnRenamed("n", "nl")), F.col("nl") == F.col("l_linenumber") % 7)
    li = li.join(F.broadcast(ax(MODES, "m").withColumnRenamed("n", "nm")), F.col("nm") == F.col("l_suppkey") % 7)
    day = F.col("l_shipdate").cast("date")
    return li.select(
        F.col("l_orderkey").alias("contract_id"), (F.col("l_partkey") % 50).alias("asset_id"), (F.col("l_suppkey") % 16).alias("territory"), "legal_right", "mode", "l_lo", "l_hi", "m_lo", "m_hi",
        day.alias("p_lo"), F.date_add(day, F.col("l_quantity").cast("int")).alias("p_hi"),
        F.when(F.col("l_returnflag") == "A", "exclusive").when(F.col("l_returnflag") == "R", "sole").otherwise("non_exclusive").alias("exclusivity"), (F.col("l_linestatus") == "O").alias("active"),
    ).distinct()


def _meeting(spark: SparkSession, sf: str) -> DataFrame:
    g = grants(spark, sf).filter("active")
    extra = (
        (F.col("a.contract_id") < F.col("b.contract_id")) & (F.col("a.l_lo") < F.col("b.l_hi")) & (F.col("b.l_lo") < F.col("a.l_hi")) & (F.col("a.m_lo") < F.col("b.m_hi")) & (F.col("b.m_lo") < F.col("a.m_hi"))
    )
    return ranges.overlap_join(g, g, ["asset_id", "territory"], extra=extra)


_MEETING_SQL = GRANTS_SQL + """, p AS (SELECT a.contract_id AS ca, b.contract_id AS cb, a.asset_id, a.territory, a.exclusivity AS ea, b.exclusivity AS eb, a.legal_right AS la, b.legal_right AS lb, a.mode AS ma, b.mode AS mb,
  a.l_lo AS al, a.l_hi AS ah, b.l_lo AS bl, b.l_hi AS bh, greatest(a.p_lo, b.p_lo) AS lo, least(a.p_hi, b.p_hi) AS hi
  FROM g a JOIN g b ON a.asset_id = b.asset_id AND a.territory = b.territory AND a.contract_id < b.contract_id AND a.l_lo < b.l_hi AND b.l_lo < a.l_hi AND a.m_lo < b.m_hi AND b.m_lo < a.m_hi
  AND a.p_lo < b.p_hi AND b.p_lo < a.p_hi AND a.p_lo < a.p_hi AND b.p_lo < b.p_hi WHERE a.active AND b.active)"""


def conflict_pairs(spark, sf):
    """Pairs of grants of different contracts that meet on both axes and in time, not both non-exclusive, with the common period."""
    both = (F.col("a.exclusivity") == "non_exclusive") & (F.col("b.exclusivity") == "non_exclusive")
    return _meeting(spark, sf).filter(~both).select(
        F.col("a.contract_id").alias("contract_a"), F.col("b.contract_id").alias("contract_b"), "a.asset_id", "a.territory", F.col("a.legal_right").alias("right_a"), F.col("b.legal_right").alias("right_b"),
        F.col("a.mode").alias("mode_a"), F.col("b.mode").alias("mode_b"), ranges.intersection_text("a.p_lo", "a.p_hi", "b.p_lo", "b.p_hi").alias("common"),
    ).distinct()


def axis_relation(spark, sf):
    rel = ranges.relation("a.l_lo", "a.l_hi", "b.l_lo", "b.l_hi")
    return _meeting(spark, sf).groupBy(rel.alias("relation")).agg(F.count("*").alias("pairs"))


def xor_exclusivity(spark, sf):
    x = (F.col("a.exclusivity") == "non_exclusive") != (F.col("b.exclusivity") == "non_exclusive")
    return _meeting(spark, sf).filter(x).groupBy("a.asset_id", "a.territory").agg(F.count("*").alias("pairs"))


def internal_overlap_first(spark, sf):
    """Of each contract the first two of its own grants (by period) that overlap in one asset."""
    w = W.partitionBy("contract_id").orderBy("p_lo", "p_hi", "asset_id", "territory", "legal_right", "mode", "exclusivity", F.col("active").cast("int"))
    g = grants(spark, sf).withColumn("pos", F.row_number().over(w))
    pairs = ranges.overlap_join(g, g, ["contract_id", "asset_id"], extra=F.col("a.pos") < F.col("b.pos"))
    return pairs.groupBy(F.col("a.contract_id").alias("contract_id")).agg(F.min(F.struct(F.col("a.pos").alias("i"), F.col("b.pos").alias("j"))).alias("m")).select("contract_id", "m.i", "m.j")


def _dims(spark):
    return axis(spark, LEGAL_RIGHTS).withColumn("axis", F.lit("legal_right")).unionByName(axis(spark, MODES).withColumn("axis", F.lit("mode")))


def taxonomy_closure(spark, sf):
    return R.ancestors(_dims(spark))


#: Codes that break the rules of an axis, so that the check is seen to find them: (axis, code, parent, lo, hi).
BROKEN = (("mode", "OUTSIDE", "VOD", 20, 22), ("mode", "CROSSING", None, 6, 12), ("legal_right", "STRAY", "DISTRIBUTION", 2, 3))


def taxonomy_check(spark, sf):
    """Both axes and some broken codes: children outside their parent's span, spans that overlap without one holding the
    other, and spans that hold another without being its ancestor."""
    d = _dims(spark).select("axis", "code", "parent_code", "lo", "hi").unionByName(spark.createDataFrame(list(BROKEN), "axis string, code string, parent_code string, lo int, hi int"))
    a, b = d.alias("a"), d.alias("b")
    outside = a.join(b, (F.col("a.axis") == F.col("b.axis")) & (F.col("a.parent_code") == F.col("b.code"))).filter(~ranges.contains("b.lo", "b.hi", "a.lo", "a.hi"))
    crossing = a.join(b, (F.col("a.axis") == F.col("b.axis")) & (F.col("a.code") < F.col("b.code"))).filter(
        ranges.overlaps("a.lo", "a.hi", "b.lo", "b.hi") & ~ranges.contains("a.lo", "a.hi", "b.lo", "b.hi") & ~ranges.contains("b.lo", "b.hi", "a.lo", "a.hi")
    )
    above = R.ancestors(d.select("code", "parent_code"))
    held = a.join(b, (F.col("a.axis") == F.col("b.axis")) & (F.col("a.code") != F.col("b.code"))).filter(ranges.contains("b.lo", "b.hi", "a.lo", "a.hi"))
    stray = held.join(above, (above["code"] == F.col("a.code")) & (above["ancestor"] == F.col("b.code")), "left_anti")
    pick = lambda df, n: df.select(F.col("a.code").alias("code"), F.col("b.code").alias("other"), F.lit(n).alias("rule"))
    return pick(outside, "outside_parent").unionByName(pick(crossing, "crossing")).unionByName(pick(stray, "no_ancestor"))


def taxonomy_preorder(spark, sf):
    """The codes of both axes as they are listed: by axis, from the top down, with their depth and number of codes below."""
    d = _dims(spark)
    depth = R.ancestors(d.select("code", "parent_code")).groupBy("code").agg(F.max("distance").alias("depth"))
    return d.join(depth, "code", "left").select("axis", "code", F.coalesce("depth", F.lit(0)).alias("depth"), ((F.col("rgt") - F.col("lft") - 1) / 2).cast("int").alias("below"), "lft").orderBy("axis", "lft")


def group_expand(spark, sf):
    """Lists of codes with groups in them (a region stands for its nations, in the order of their keys); what is no group
    stands for itself. Order is kept and each code comes once."""
    n, r = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey"), table(spark, sf, "region", "r_regionkey", "r_name")
    members = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("code")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    lists = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.posexplode(F.array(F.lit("ATLANTIS"), F.col("n_name"), F.col("r_name"), F.lit("ATLANTIS"))).alias("pos", "code"))
    named = lists.join(F.broadcast(members), "code", "left").select("n_nationkey", "pos", F.posexplode(F.coalesce(F.transform("m", lambda x: x["n_name"]), F.array("code"))).alias("k", "name"))
    once = named.groupBy("n_nationkey", "name").agg(F.min(F.struct("pos", "k")).alias("at"))
    return once.groupBy("n_nationkey").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("l")).select("n_nationkey", F.array_join(F.transform("l", lambda x: x["name"]), ",").alias("names"))


def set_difference(spark, sf):
    """Territories of an asset without those that are excluded (only sole grants there)."""
    g = grants(spark, sf).groupBy("asset_id").agg(F.collect_set("territory").alias("t"), F.collect_set(F.when(F.col("exclusivity") == "sole", F.col("territory"))).alias("x"))
    other = grants(spark, sf).filter("exclusivity <> 'sole'").groupBy("asset_id").agg(F.collect_set("territory").alias("o"))
    return g.join(other, "asset_id").select("asset_id", F.size("t").alias("n"), F.array_join(F.transform(F.array_sort(F.array_except("t", F.array_except("x", "o"))), lambda x: x.cast("string")), ",").alias("kept"))


def period_summary(spark, sf):
    return grants(spark, sf).filter("active").groupBy("contract_id").agg(
        F.min("p_lo").cast("string").alias("first_day"), ranges.half_open_to_inclusive(F.max("p_hi")).cast("string").alias("last_day"), F.count("*").alias("grants")
    )


def latest_version(spark, sf):
    h = table(spark, sf, "contract_history", "id", "contract_id", "version", "file_name").distinct()
    return h.groupBy("contract_id").agg(F.max_by(F.struct("id", "version", "file_name"), F.struct("version", "id")).alias("m"), (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version")).select("contract_id", "m.id", "m.version", "m.file_name", "next_version")


def lineage_diff(spark, sf):
    """Columns that changed from one version of a contract to the next."""
    h = table(spark, sf, "contract_history", "id", "contract_id", "version", "document_kind", "status", "mime_type").distinct()
    w = W.partitionBy("contract_id").orderBy("version", "id")
    cols = ["document_kind", "status", "mime_type"]
    changed = [F.when(~F.lag(c).over(w).eqNullSafe(F.col(c)), F.lit(c)) for c in cols]
    out = h.select("id", "contract_id", "version", F.lag("id").over(w).alias("previous"), F.concat_ws(",", *changed).alias("changed"))
    return out.filter(F.col("previous").isNotNull())


def lineage_inherit(spark, sf):
    """Lineage of grants from an earlier one with the same natural key, if there is exactly one."""
    g = table(spark, sf, "rights_grant", "id", "contract_id", "content_asset_id", "legal_right", "exploitation_mode", "lineage_id", "status").distinct()
    key = ["contract_id", "content_asset_id", "legal_right", "exploitation_mode"]
    old = g.filter("status = 'terminated'").groupBy(*key).agg(F.min(F.coalesce("lineage_id", "id")).alias("inherited"), F.count("*").alias("n"))
    return g.filter("status = 'active'").join(old, key, "left").select("id", F.coalesce(F.when(F.col("n") == 1, F.col("inherited")), F.col("lineage_id"), F.col("id")).alias("lineage"))


def contract_page(spark, sf):
    """Second page of 20 contracts with their latest file, number of active grants and the total."""
    c = table(spark, sf, "contract", "id", "title", "created_at").distinct().groupBy("id").agg(F.max("title").alias("title"), F.max("created_at").alias("created_at"))
    h = latest_version(spark, sf).select(F.col("contract_id").alias("id"), "file_name")
    g = table(spark, sf, "rights_grant", "id", "contract_id", "status").filter("status = 'active'").select(F.col("contract_id"), "id").distinct().groupBy(F.col("contract_id").alias("id")).agg(F.count("*").alias("grants"))
    total = c.agg(F.count("*").alias("total"))
    rows = c.join(h, "id", "left").join(g, "id", "left").crossJoin(F.broadcast(total))
    rows = R.page(rows, 2, 20, F.desc("created_at"), F.col("id"))
    return rows.select("id", F.coalesce("title", "file_name", F.lit("")).alias("title"), F.coalesce("grants", F.lit(0)).alias("grants"), "total")


def heterogeneous_union(spark, sf):
    c = table(spark, sf, "contract", "id", "status").distinct().select(F.lit("contract").alias("kind"), F.col("id"), F.col("status").alias("state"))
    h = table(spark, sf, "contract_history", "id", "status", "version").distinct().select(F.lit("history").alias("kind"), F.col("id"), F.col("status").alias("state"), "version")
    return c.unionByName(h, allowMissingColumns=True).groupBy("kind", "state").agg(F.count("*").alias("n"), F.coalesce(F.max("version"), F.lit(0)).alias("max_version"))


def referential_violations(spark, sf):
    """Per reference of a grant: rows that have it, and rows whose target is missing."""
    g = table(spark, sf, "rights_grant", "id", "contract_id", "content_asset_id", "contract_history_id", "lineage_id").distinct()
    parts = [("contract_id", "contract", "id"), ("content_asset_id", "content_asset", "id"), ("contract_history_id", "contract_history", "id"), ("lineage_id", "rights_grant", "id")]
    found = []
    for c, t, k in parts:
        there = g.filter(F.col(c).isNotNull()).select(c).join(table(spark, sf, t, k).select(F.col(k).alias(c), F.lit(1).alias("is")).distinct(), c, "left")
        found.append(there.agg(F.count("*").alias("rows"), F.count_if(F.col("is").isNull()).alias("dangling")).select(F.lit(c).alias("reference"), "rows", "dangling"))
    return found[0].unionAll(found[1]).unionAll(found[2]).unionAll(found[3])


def check_violations(spark, sf):
    a = table(spark, sf, "content_asset")
    return R.violations(a, "id", {
        "season_number": (F.col("scope_type") != "SEASON") | F.col("season_no").isNotNull(), "episode_number": (F.col("scope_type") != "EPISODE") | F.col("episode_no").isNotNull(),
        "no_number": (F.col("scope_type") != "SERIES_ALL") | (F.col("season_no").isNull() & F.col("episode_no").isNull()), "label": F.col("label").isNotNull(),
    })


def confirmed_grants(spark, sf):
    """Active grants of signed contracts, per asset."""
    g = table(spark, sf, "rights_grant", "id", "contract_id", "content_asset_id", "status").filter("status = 'active'").select("id", "contract_id", "content_asset_id").distinct()
    signed = table(spark, sf, "contract", "id", "status").filter("status = 'signed'").select(F.col("id").alias("contract_id"))
    return g.join(signed, "contract_id", "left_semi").groupBy("content_asset_id").agg(F.count("*").alias("grants"), F.countDistinct("contract_id").alias("contracts"))


def unsigned_grants(spark, sf):
    g = table(spark, sf, "rights_grant", "id", "contract_id", "status").filter("status = 'active'").select("id", "contract_id").distinct()
    signed = table(spark, sf, "contract", "id", "status").filter("status = 'signed'").select(F.col("id").alias("contract_id"))
    return g.join(signed, "contract_id", "left_anti").select("id")


def distinct_on_best(spark, sf):
    """The dearest part of each brand (ties: the smaller key)."""
    p = table(spark, sf, "part", "p_partkey", "p_brand", "p_retailprice")
    return R.keep_latest(p, ["p_brand"], F.desc("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_partkey")


def group_counts(spark, sf):
    li = table(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_quantity")
    return li.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.sum("l_quantity").cast("long").alias("quantity"), F.bool_and(F.col("l_quantity") > 1).cast("int").alias("all_many"))


def json_report(spark, sf):
    """Per contract the versions as ordered JSON."""
    h = table(spark, sf, "contract_history", "contract_id", "version", "document_kind").distinct()
    rows = h.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("version", F.col("document_kind").alias("kind")))).alias("v"))
    return rows.select("contract_id", F.to_json("v").alias("report"))


def rollup_cube(spark, sf):
    li = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return li.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.grouping_id().cast("int").alias("level")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("line"), "quantity", "level")


def grouping_sets(spark, sf):
    register(spark, sf, "orders")
    return spark.sql("SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


def intersect_except(spark, sf):
    """Customers with both finished and open orders, but none of the first priority."""
    o = table(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    of = lambda cond: o.filter(cond).select("o_custkey").distinct()
    return of("o_orderstatus = 'F'").intersect(of("o_orderstatus = 'O'")).exceptAll(of("o_orderpriority LIKE '1%'"))


def approx_distinct(spark, sf):
    return table(spark, sf, "lineitem", "l_partkey", "l_quantity").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))


def filtered_search(spark, sf):
    g = table(spark, sf, "rights_grant", "id", "contract_id", "legal_right", "exploitation_mode", "status").distinct()
    hit = R.dynamic_filter(g, legal_right=["TRANSMISSION", "BROADCAST"], exploitation_mode=["SVOD", "AVOD", "TV_LINEAR"], status="active", contract_id=None)
    lang = table(spark, sf, "contract", F.col("id").alias("contract_id"), "lang").groupBy("contract_id").agg(F.max("lang").alias("lang"))
    return hit.join(lang, "contract_id").filter(~F.col("lang").eqNullSafe(F.lit("ko"))).select("id", "contract_id", F.coalesce("lang", F.lit("?")).alias("lang"))


def tag_sets(spark, sf):
    g = table(spark, sf, "rights_grant", "contract_id", "legal_right", "exploitation_mode").filter("contract_id IS NOT NULL")
    tags = g.select("contract_id", F.explode(F.array("legal_right", "exploitation_mode")).alias("tag")).filter("tag IS NOT NULL")
    return tags.groupBy("contract_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def upsert_latest(spark, sf):
    """The latest result of every job (ties: the greater text)."""
    r = table(spark, sf, "extract_result", "tmpid", "payload", "created_at")
    return R.latest_by(r, ["tmpid"], "created_at", "payload").select("tmpid", F.coalesce(F.length("payload"), F.lit(0)).alias("size"))


def round_robin(spark, sf):
    c = table(spark, sf, "contract", "id", "lang").groupBy("id").agg(F.max("lang").alias("lang"))
    w = W.partitionBy("lang").orderBy("id")
    return c.withColumn("turn", F.row_number().over(w)).select("id", F.coalesce("lang", F.lit("?")).alias("lang"), "turn")


def queue_position(spark, sf):
    """Jobs waiting before each job of one user (in place of a queue: error events)."""
    e = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type").filter("event_type = 'error'")
    return e.withColumn("before", F.rank().over(W.partitionBy("user_id").orderBy("ts")) - 1).select("event_id", "before")


def claim_next(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts", "event_type", "value")
    free = e.filter((F.col("event_type") == "error") | ((F.col("event_type") == "click") & (F.col("value") < 1)))
    return free.orderBy("ts", "event_id").limit(1).select("event_id", F.expr("CAST(ts + INTERVAL 600 SECONDS AS STRING)").substr(1, 19).alias("lease"))


def cdc_diff(spark, sf):
    """Changes between two snapshots of the orders."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    old = o.filter("o_orderdate < TIMESTAMP_NTZ'1998-01-01'").select("o_orderkey", "o_orderstatus")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("X")).otherwise(F.col("o_orderstatus"))
    new = o.filter("o_orderdate >= TIMESTAMP_NTZ'1993-01-01'").select("o_orderkey", urgent.alias("o_orderstatus"))
    return R.snapshot_diff(old, new, ["o_orderkey"])


def changelog_batch(spark, sf):
    """The next 50 unprocessed changes in order."""
    c = table(spark, sf, "change_log", "id", "op", "processed_at").filter("processed_at IS NULL AND op IS NOT NULL")
    return c.groupBy("id").agg(F.upper(F.trim(F.min("op"))).alias("op")).orderBy("id").limit(50)


def patched_contracts(spark, sf):
    c = table(spark, sf, "contract", "id", "title", "grantor", "lang").groupBy("id").agg(F.max("title").alias("title"), F.max("grantor").alias("grantor"), F.max("lang").alias("lang"))
    p = c.filter("lang = 'ja'").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("title"))
    return R.patch(c, p, ["id"]).select("id", F.coalesce("title", F.lit("")).alias("title"), "grantor")


def json_access(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"), F.max(k).alias("most"))


def json_array_explode(spark, sf):
    e = table(spark, sf, "events", "event_id", "props").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    text = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.col("k") % 3), lambda i: F.concat(F.lit('{"i":'), i.cast("string"), F.lit("}"))), ","), F.lit("]"))
    return e.select("event_id", F.inline(F.from_json(text, "array<struct<i:int>>"))).groupBy("i").agg(F.count("*").alias("n"))


def evidence_keys(spark, sf):
    """How many grants have evidence with each key."""
    g = table(spark, sf, "rights_grant", "id", "evidence").distinct()
    return g.select("id", F.explode(F.json_object_keys("evidence")).alias("field")).groupBy("field").agg(F.countDistinct("id").alias("n"))


def window_counts(spark, sf):
    e = table(spark, sf, "events", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def session_counts(spark, sf):
    e = table(spark, sf, "events", "ts", "user_id").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def asset_counts_by_ip(spark, sf):
    a = table(spark, sf, "content_asset")
    return a.groupBy("ip_id").agg(F.count("*").alias("assets"), F.count("season_no").alias("with_season"), F.count_if(F.col("scope_type") == "SERIES_ALL").alias("series"))


def default_assets(spark, sf):
    """Works that have no asset for the whole series and so need one."""
    a = table(spark, sf, "content_asset", "ip_id", "scope_type")
    return a.select("ip_id").distinct().join(a.filter("scope_type = 'SERIES_ALL'").select("ip_id"), "ip_id", "left_anti").select("ip_id", F.lit("SERIES_ALL").alias("scope_type"))


def asset_scope_containment(spark, sf):
    """Assets of one work of which one holds the other: series over season over episode."""
    a = table(spark, sf, "content_asset", "id", "ip_id", "scope_type", "season_no", "episode_no")
    x, y = a.alias("x"), a.alias("y")
    whole = (F.col("x.scope_type") == "SERIES_ALL") & (F.col("y.scope_type") != "SERIES_ALL")
    season = (F.col("x.scope_type") == "SEASON") & (F.col("y.scope_type") == "EPISODE") & (F.col("x.season_no") == F.col("y.season_no"))
    return x.join(y, F.col("x.ip_id") == F.col("y.ip_id")).filter(whole | season).select(F.col("x.id").alias("outer_id"), F.col("y.id").alias("inner_id"))


SQL = {
    "conflict_pairs": _MEETING_SQL + " SELECT DISTINCT ca AS contract_a, cb AS contract_b, asset_id, territory, la AS right_a, lb AS right_b, ma AS mode_a, mb AS mode_b, '[' || lo || ',' || hi || ')' AS common FROM p WHERE NOT (ea = 'non_exclusive' AND eb = 'non_exclusive')",
    "axis_relation": _MEETING_SQL + " SELECT CASE WHEN al = bl AND ah = bh THEN 'same' WHEN al <= bl AND bh <= ah THEN 'a_broader' WHEN bl <= al AND ah <= bh THEN 'b_broader' ELSE 'overlap' END AS relation, count(*) AS pairs FROM p GROUP BY 1",
    "xor_exclusivity": _MEETING_SQL + " SELECT asset_id, territory, count(*) AS pairs FROM p WHERE (ea = 'non_exclusive') <> (eb = 'non_exclusive') GROUP BY ALL",
    "internal_overlap_first": GRANTS_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY p_lo, p_hi, asset_id, territory, legal_right, mode, exclusivity, active::INT) AS pos FROM g),
      m AS (SELECT a.contract_id, min({'i': a.pos, 'j': b.pos}) AS m FROM n a JOIN n b ON a.contract_id = b.contract_id AND a.asset_id = b.asset_id AND a.pos < b.pos AND a.p_lo < b.p_hi AND b.p_lo < a.p_hi GROUP BY 1)
      SELECT contract_id, m.i AS i, m.j AS j FROM m""",
    "taxonomy_closure": f"WITH RECURSIVE {AXES_SQL}, d AS (SELECT code, parent_code FROM lr UNION ALL SELECT code, parent_code FROM em), up AS (SELECT code, parent_code AS ancestor, 1 AS distance FROM d WHERE parent_code IS NOT NULL UNION ALL SELECT u.code, d.parent_code, u.distance + 1 FROM up u JOIN d ON d.code = u.ancestor WHERE d.parent_code IS NOT NULL) SELECT * FROM up",
    "taxonomy_check": f"""WITH RECURSIVE {AXES_SQL}, d AS (SELECT 'legal_right' AS axis, code, parent_code, lo, hi FROM lr UNION ALL SELECT 'mode', code, parent_code, lo, hi FROM em UNION ALL SELECT * FROM (VALUES {_values(BROKEN)}) t(axis, code, parent_code, lo, hi)),
      up AS (SELECT code, parent_code AS ancestor FROM d WHERE parent_code IS NOT NULL UNION ALL SELECT u.code, d.parent_code FROM up u JOIN d ON d.code = u.ancestor WHERE d.parent_code IS NOT NULL)
      SELECT a.code, b.code AS other, 'outside_parent' AS rule FROM d a JOIN d b ON a.axis = b.axis AND a.parent_code = b.code WHERE NOT (b.lo <= a.lo AND a.hi <= b.hi)
      UNION ALL SELECT a.code, b.code, 'crossing' FROM d a JOIN d b ON a.axis = b.axis AND a.code < b.code WHERE a.lo < b.hi AND b.lo < a.hi AND NOT (a.lo <= b.lo AND b.hi <= a.hi) AND NOT (b.lo <= a.lo AND a.hi <= b.hi)
      UNION ALL SELECT a.code, b.code, 'no_ancestor' FROM d a JOIN d b ON a.axis = b.axis AND a.code <> b.code WHERE b.lo <= a.lo AND a.hi <= b.hi AND NOT EXISTS (SELECT 1 FROM up WHERE up.code = a.code AND up.ancestor = b.code)""",
    "group_expand": """WITH l AS (SELECT n_nationkey, unnest(['ATLANTIS', n_name, r_name, 'ATLANTIS']) AS code, unnest([0, 1, 2, 3]) AS pos FROM nation JOIN region ON n_regionkey = r_regionkey),
      m AS (SELECT r_name AS code, n_name AS name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey),
      x AS (SELECT l.n_nationkey, coalesce(m.name, l.code) AS name, min({'pos': pos, 'k': coalesce(k, 1)}) AS place FROM l LEFT JOIN m USING (code) GROUP BY ALL)
      SELECT n_nationkey, string_agg(name, ',' ORDER BY place) AS names FROM x GROUP BY 1""",
    "taxonomy_preorder": f"""WITH RECURSIVE {AXES_SQL}, d AS (SELECT 'legal_right' AS axis, code, parent_code, lft, rgt FROM lr UNION ALL SELECT 'mode', code, parent_code, lft, rgt FROM em),
      up AS (SELECT code, parent_code AS ancestor FROM d WHERE parent_code IS NOT NULL UNION ALL SELECT u.code, d.parent_code FROM up u JOIN d ON d.code = u.ancestor WHERE d.parent_code IS NOT NULL)
      SELECT axis, code, (SELECT count(*) FROM up WHERE up.code = d.code)::INT AS depth, ((rgt - lft - 1) // 2)::INT AS below, lft FROM d""",
    "set_difference": GRANTS_SQL + ", t AS (SELECT asset_id, territory, bool_or(exclusivity <> 'sole') AS keep FROM g GROUP BY ALL) SELECT asset_id, count(*)::INT AS n, string_agg(territory::VARCHAR, ',' ORDER BY territory) FILTER (keep) AS kept FROM t GROUP BY 1",
    "period_summary": GRANTS_SQL + " SELECT contract_id, min(p_lo)::VARCHAR AS first_day, (max(p_hi) - 1)::VARCHAR AS last_day, count(*) AS grants FROM g WHERE active GROUP BY 1",
    "latest_version": "WITH h AS (SELECT DISTINCT id, contract_id, version, file_name FROM contract_history), r AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY version DESC, id DESC) AS rn FROM h) SELECT contract_id, id, version, file_name, version + 1 AS next_version FROM r WHERE rn = 1",
    "lineage_diff": """WITH h AS (SELECT DISTINCT id, contract_id, version, document_kind, status, mime_type FROM contract_history),
      l AS (SELECT *, lag(id) OVER w AS previous, lag(document_kind) OVER w AS d0, lag(status) OVER w AS s0, lag(mime_type) OVER w AS m0 FROM h WINDOW w AS (PARTITION BY contract_id ORDER BY version, id))
      SELECT id, contract_id, version, previous, concat_ws(',', CASE WHEN d0 IS DISTINCT FROM document_kind THEN 'document_kind' END, CASE WHEN s0 IS DISTINCT FROM status THEN 'status' END, CASE WHEN m0 IS DISTINCT FROM mime_type THEN 'mime_type' END) AS changed FROM l WHERE previous IS NOT NULL""",
    "lineage_inherit": """WITH g AS (SELECT DISTINCT id, contract_id, content_asset_id, legal_right, exploitation_mode, lineage_id, status FROM rights_grant),
      o AS (SELECT contract_id, content_asset_id, legal_right, exploitation_mode, min(coalesce(lineage_id, id)) AS inherited, count(*) AS n FROM g WHERE status = 'terminated' GROUP BY ALL)
      SELECT g.id, coalesce(CASE WHEN n = 1 THEN inherited END, lineage_id, g.id) AS lineage FROM g LEFT JOIN o USING (contract_id, content_asset_id, legal_right, exploitation_mode) WHERE status = 'active'""",
    "contract_page": """WITH c AS (SELECT id, max(title) AS title, max(created_at) AS created_at FROM contract GROUP BY 1), h AS (SELECT contract_id, arg_max(file_name, version::BIGINT * 1000000000 + id) AS file_name FROM contract_history GROUP BY 1),
      g AS (SELECT contract_id, count(DISTINCT id) AS grants FROM rights_grant WHERE status = 'active' GROUP BY 1)
      SELECT c.id, coalesce(title, file_name, '') AS title, coalesce(grants, 0) AS grants, (SELECT count(*) FROM c) AS total FROM c LEFT JOIN h ON h.contract_id = c.id LEFT JOIN g ON g.contract_id = c.id ORDER BY created_at DESC, c.id LIMIT 20 OFFSET 20""",
    "heterogeneous_union": "SELECT 'contract' AS kind, status AS state, count(DISTINCT id) AS n, 0 AS max_version FROM contract GROUP BY 2 UNION ALL SELECT 'history', status, count(DISTINCT id), max(version) FROM contract_history GROUP BY 2",
    "referential_violations": "WITH g AS (SELECT DISTINCT id, contract_id, content_asset_id, contract_history_id, lineage_id FROM rights_grant) " + " UNION ALL ".join(f"SELECT '{c}' AS reference, count(*) AS rows, count_if(NOT EXISTS (SELECT 1 FROM {t} t WHERE t.id = g.{c}))::BIGINT AS dangling FROM g WHERE {c} IS NOT NULL" for c, t in (('contract_id', 'contract'), ('content_asset_id', 'content_asset'), ('contract_history_id', 'contract_history'), ('lineage_id', 'rights_grant'))),
    "check_violations": "SELECT id, 'season_number' AS rule FROM content_asset WHERE scope_type = 'SEASON' AND season_no IS NULL UNION ALL SELECT id, 'episode_number' FROM content_asset WHERE scope_type = 'EPISODE' AND episode_no IS NULL UNION ALL SELECT id, 'no_number' FROM content_asset WHERE scope_type = 'SERIES_ALL' AND NOT (season_no IS NULL AND episode_no IS NULL) UNION ALL SELECT id, 'label' FROM content_asset WHERE label IS NULL",
    "confirmed_grants": "SELECT content_asset_id, count(*) AS grants, count(DISTINCT contract_id) AS contracts FROM (SELECT DISTINCT id, contract_id, content_asset_id FROM rights_grant WHERE status = 'active') g WHERE contract_id IN (SELECT id FROM contract WHERE status = 'signed') GROUP BY 1",
    "unsigned_grants": "SELECT DISTINCT id FROM rights_grant g WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM contract c WHERE c.id = g.contract_id AND c.status = 'signed')",
    "distinct_on_best": "SELECT DISTINCT ON (p_brand) p_brand, p_partkey FROM part ORDER BY p_brand, p_retailprice DESC, p_partkey",
    "group_counts": "SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS orders, sum(l_quantity)::BIGINT AS quantity, bool_and(l_quantity > 1)::INT AS all_many FROM lineitem GROUP BY 1",
    "json_report": """SELECT contract_id, '[' || string_agg('{"version":' || version || ',"kind":"' || document_kind || '"}', ',' ORDER BY version, document_kind) || ']' AS report FROM (SELECT DISTINCT contract_id, version, document_kind FROM contract_history) GROUP BY 1""",
    "rollup_cube": "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS line, sum(l_quantity)::BIGINT AS quantity, grouping_id(l_returnflag, l_linestatus)::INT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "intersect_except": "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'",
    "filtered_search": "WITH l AS (SELECT id AS contract_id, max(lang) AS lang FROM contract GROUP BY 1) SELECT DISTINCT g.id, g.contract_id, coalesce(lang, '?') AS lang FROM rights_grant g JOIN l USING (contract_id) WHERE legal_right IN ('TRANSMISSION', 'BROADCAST') AND exploitation_mode IN ('SVOD', 'AVOD', 'TV_LINEAR') AND status = 'active' AND lang IS DISTINCT FROM 'ko'",
    "tag_sets": "SELECT contract_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT contract_id, unnest([legal_right, exploitation_mode]) AS tag FROM rights_grant WHERE contract_id IS NOT NULL) WHERE tag IS NOT NULL GROUP BY 1",
    "upsert_latest": "SELECT tmpid, coalesce(length(payload), 0)::INT AS size FROM (SELECT *, row_number() OVER (PARTITION BY tmpid ORDER BY created_at DESC, payload DESC NULLS LAST) AS rn FROM extract_result) WHERE rn = 1",
    "round_robin": "WITH c AS (SELECT id, max(lang) AS lang FROM contract GROUP BY 1) SELECT id, coalesce(lang, '?') AS lang, turn::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id) AS turn FROM c)",
    "queue_position": "SELECT event_id, (rank() OVER (PARTITION BY user_id ORDER BY ts) - 1)::INT AS before FROM events WHERE event_type = 'error'",
    "claim_next": "SELECT event_id, strftime(ts + INTERVAL 600 SECONDS, '%Y-%m-%d %H:%M:%S') AS lease FROM events WHERE event_type = 'error' OR (event_type = 'click' AND value < 1) ORDER BY ts, event_id LIMIT 1",
    "cdc_diff": """WITH o AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), n AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01')
      SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'I' WHEN n.o_orderkey IS NULL THEN 'D' ELSE 'U' END AS op FROM o FULL JOIN n USING (o_orderkey) WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus""",
    "changelog_batch": "SELECT id, upper(trim(min(op))) AS op FROM change_log WHERE processed_at IS NULL AND op IS NOT NULL GROUP BY 1 ORDER BY id LIMIT 50",
    "patched_contracts": "SELECT id, CASE WHEN max(lang) = 'ja' THEN 'new ' || id ELSE coalesce(max(title), '') END AS title, max(grantor) AS grantor FROM contract GROUP BY id",
    "json_access": "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(props->>'$.k') AS n, max((props->>'$.k')::BIGINT) AS most FROM events GROUP BY 1",
    "json_array_explode": "SELECT i::INT AS i, count(*) AS n FROM (SELECT unnest(range(0, (props->>'$.k')::INT % 3 + 1)) AS i FROM events) GROUP BY 1",
    "evidence_keys": "SELECT field, count(DISTINCT id) AS n FROM (SELECT id, unnest(json_keys(CASE WHEN json_valid(evidence) THEN evidence END)) AS field FROM rights_grant) GROUP BY 1",
    "window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_counts": "WITH s AS (SELECT user_id, ts, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTES)::INT AS new FROM events), n AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM s), c AS (SELECT user_id, s, count(*) AS n FROM n GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1",
    "asset_counts_by_ip": "SELECT ip_id, count(*) AS assets, count(season_no) AS with_season, count(*) FILTER (scope_type = 'SERIES_ALL') AS series FROM content_asset GROUP BY 1",
    "default_assets": "SELECT DISTINCT ip_id, 'SERIES_ALL' AS scope_type FROM content_asset a WHERE NOT EXISTS (SELECT 1 FROM content_asset b WHERE b.ip_id = a.ip_id AND b.scope_type = 'SERIES_ALL')",
    "asset_scope_containment": "SELECT x.id AS outer_id, y.id AS inner_id FROM content_asset x JOIN content_asset y ON x.ip_id = y.ip_id WHERE (x.scope_type = 'SERIES_ALL' AND y.scope_type <> 'SERIES_ALL') OR (x.scope_type = 'SEASON' AND y.scope_type = 'EPISODE' AND x.season_no = y.season_no)",
}

NAMES = (*SQL, "approx_distinct")


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
