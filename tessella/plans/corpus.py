"""Queries of the general data-pipeline problems: nested records, change feeds, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, intervals, nested
from ..sources.tables import table


def _flattened(spark: SparkSession, sf: str) -> nested.Flattened:
    return nested.flatten(table(spark, sf, "extract_result", "tmpid", "payload", "created_at"), "tmpid", "payload", "created_at")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _flattened(spark, sf).links().withColumnRenamed("record_id", "tmpid")


def p2_grants(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of rights_grants."""
    return _flattened(spark, sf).table("rights_grants").withColumnRenamed("record_id", "tmpid")


def p2_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every object of every array: its table, keys, place and fields."""
    return _flattened(spark, sf).tables().withColumnRenamed("record_id", "tmpid")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_state(spark, sf).select("table_name", "row_id", "id")


def p3_state(spark: SparkSession, sf: str) -> DataFrame:
    """The rows with the columns their changes left."""
    return changes.publish(table(spark, sf, "change_log", "id", "table_name", "row_id", "op", "row_image"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.exclusivity_periods(
        table(spark, sf, "rights_grant", "contract_id", "content_asset_id", "territory", "exclusivity", "period", "status")
    )


P2_SQL = r"""
WITH RECURSIVE latest AS (
  SELECT tmpid, arg_max(coalesce(payload, ''), (created_at, coalesce(payload, ''))) AS p FROM extract_result WHERE tmpid IS NOT NULL GROUP BY tmpid),
opened AS (
  SELECT tmpid, trim(p, E' \n\r\t﻿') AS p FROM latest
  UNION ALL
  SELECT tmpid, trim(json_extract_string(p, '$'), E' \n\r\t﻿') FROM opened WHERE p LIKE '"%' AND json_valid(p) AND json_type(p) = 'VARCHAR'),
record AS (SELECT tmpid, regexp_extract(p, '\{.*\}', 0, 's') AS j FROM opened WHERE NOT starts_with(p, '"')),
object AS (
  SELECT tmpid, list_transform(string_split(fullkey[3:], '.'), LAMBDA x: lower(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '-', '_', 'g'))) AS steps
  FROM (SELECT * FROM record WHERE json_valid(j)) AS r, json_tree(r.j::JSON) AS t WHERE t.type = 'OBJECT' AND fullkey <> '$'),
named AS (SELECT tmpid, steps[-1] AS own, list_filter(steps, LAMBDA x: regexp_matches(x, '^(NAMES)(\[|$)')) AS steps FROM object),
placed AS (
  SELECT DISTINCT tmpid, list_transform(steps, LAMBDA x: CASE WHEN x LIKE '%]' THEN x ELSE x || '[0]' END) AS steps FROM named
  WHERE regexp_matches(own, '^(NAMES)(\[|$)') AND NOT contains(own, ']['))
SELECT tmpid, CASE WHEN len(steps) = 1 THEN '$' ELSE array_to_string(steps[:-2], '/') END AS parent_path, array_to_string(steps, '/') AS child_path FROM placed
""".replace("NAMES", "|".join(nested.ARRAY_FIELDS))

P3_SQL = r"""
WITH v AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(table_name), '[\s"]+', '', 'g'), '^.*\.', '') AS table_name,
                  row_id, id, upper(trim(op)) AS op
           FROM change_log WHERE row_id IS NOT NULL AND upper(trim(op)) IN ('I', 'U', 'D')),
b AS (SELECT table_name, row_id, max(id) AS bid, arg_max(op, id) AS bop FROM v WHERE op <> 'U' GROUP BY ALL)
SELECT b.table_name, b.row_id, greatest(b.bid, coalesce(max(v.id), b.bid)) AS id
FROM b LEFT JOIN v ON v.table_name = b.table_name AND v.row_id = b.row_id AND v.op = 'U'
WHERE b.bop = 'I' GROUP BY b.table_name, b.row_id, b.bid
"""

P3_STATE_SQL = r"""
WITH v AS (SELECT regexp_replace(regexp_replace(lower(table_name), '[\s"]+', '', 'g'), '^.*\.', '') AS table_name,
                  row_id, id, upper(trim(op)) AS op, CASE WHEN json_valid(row_image) THEN row_image::JSON END AS j
           FROM change_log WHERE row_id IS NOT NULL AND upper(trim(op)) IN ('I', 'U', 'D')),
b AS (SELECT table_name, row_id, max(id) AS bid, arg_max(op, id) AS bop FROM v WHERE op <> 'U' GROUP BY ALL),
live AS (SELECT table_name, row_id, bid FROM b WHERE bop = 'I'),
done AS (SELECT l.table_name, l.row_id, max(v.id) AS id FROM live l JOIN v ON v.table_name = l.table_name AND v.row_id = l.row_id AND v.id >= l.bid GROUP BY ALL),
cell AS (SELECT v.table_name, v.row_id, v.id, unnest(json_keys(v.j)) AS k, v.j FROM live l JOIN v ON v.table_name = l.table_name AND v.row_id = l.row_id AND v.id >= l.bid WHERE json_type(v.j) = 'OBJECT'),
val AS (SELECT table_name, row_id, k, max({'id': id, 'v': coalesce(json_extract(j, '/' || k)::VARCHAR, 'null')}) AS m FROM cell GROUP BY ALL),
image AS (SELECT table_name, row_id, '{' || string_agg(to_json(k)::VARCHAR || ':' || m.v, ',' ORDER BY k) || '}' AS row_image FROM val GROUP BY ALL)
SELECT d.table_name, d.row_id, d.id, coalesce(i.row_image, '{}') AS row_image FROM done d LEFT JOIN image i USING (table_name, row_id)
"""

P4_SQL = r"""
WITH g AS (
  SELECT contract_id, content_asset_id, upper(trim(territory)) AS territory,
         regexp_replace(lower(trim(exclusivity)), '[\s_-]+', '_', 'g') AS exclusivity, replace(replace(period, '"', ''), ' ', '') AS p
  FROM rights_grant WHERE status = 'active' AND territory IS NOT NULL AND exclusivity IS NOT NULL AND period LIKE '%,%'),
s AS (SELECT *, p[1] AS ob, p[-1] AS cb, split_part(p[2:-2], ',', 1) AS a, split_part(p[2:-2], ',', 2) AS z FROM g),
d AS (SELECT DISTINCT contract_id, content_asset_id, territory, exclusivity,
        CASE WHEN a IN ('', '-infinity') THEN -1000000 WHEN a = 'infinity' THEN 10000000 ELSE datediff('day', DATE '1970-01-01', a::DATE) + (ob = '(')::INT END AS lo,
        CASE WHEN z IN ('', 'infinity') THEN 10000000 WHEN z = '-infinity' THEN -1000000 ELSE datediff('day', DATE '1970-01-01', z::DATE) + (cb = ']')::INT END AS hi FROM s),
o AS (SELECT *, max(hi) OVER (PARTITION BY contract_id, content_asset_id, territory, exclusivity ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM d WHERE lo < hi),
i AS (SELECT *, sum((before IS NULL OR lo > before)::INT) OVER (PARTITION BY contract_id, content_asset_id, territory, exclusivity ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS n FROM o),
m AS (SELECT contract_id, content_asset_id, territory, exclusivity, n, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY ALL),
x AS (SELECT contract_id, content_asset_id, territory, exclusivity, 'period' AS kind, lo, hi FROM m
      UNION ALL
      SELECT contract_id, content_asset_id, territory, exclusivity, 'gap',
             hi, lead(lo) OVER (PARTITION BY contract_id, content_asset_id, territory, exclusivity ORDER BY lo) FROM m)
SELECT contract_id, content_asset_id, territory, exclusivity, kind,
       CASE WHEN lo = -1000000 THEN '-infinity' WHEN lo = 10000000 THEN 'infinity' ELSE strftime(DATE '1970-01-01' + lo::INT, '%Y-%m-%d') END AS lo,
       CASE WHEN hi = -1000000 THEN '-infinity' WHEN hi = 10000000 THEN 'infinity' ELSE strftime(DATE '1970-01-01' + hi::INT, '%Y-%m-%d') END AS hi
FROM x WHERE hi IS NOT NULL
"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_grants": p2_grants, "p2_tables": p2_tables, "p3_found": p3_found, "p3_state": p3_state, "p4_found": p4_found}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p3_found": P3_SQL, "p3_state": P3_STATE_SQL, "p4_found": P4_SQL}
