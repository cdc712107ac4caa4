"""Relational operators that recur in the queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by the order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, that with the greatest values of `order` (nulls are least). Aggregated before the shuffle, so a key may have any number of rows."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__m"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__m.{c}").alias(c) for c in df.columns])


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `base` with the same key."""
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def patch(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null columns of `changes` override those of `base`."""
    also = [c for c in changes.columns if c not in keys and c in base.columns]
    joined = base.alias("b").join(changes.alias("p"), keys, "left")
    return joined.select(*keys, *[F.coalesce(F.col(f"p.{c}"), F.col(f"b.{c}")).alias(c) if c in also else F.col(f"b.{c}") for c in base.columns if c not in keys])


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and op (I, U, D) that lead from one snapshot to the other."""
    rest = [c for c in new.columns if c not in keys]
    digest = lambda df, n: df.select(*keys, F.struct(*rest).alias(n), F.lit(1).alias(f"{n}_is"))
    both = digest(old, "o").join(digest(new, "n"), keys, "full_outer")
    op = F.when(F.col("o_is").isNull(), "I").when(F.col("n_is").isNull(), "D").when(~F.col("o").eqNullSafe(F.col("n")), "U")
    return both.withColumn("op", op).filter(F.col("op").isNotNull()).select(*keys, "op")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule of every row that breaks a rule (a rule that is null is not broken)."""
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()])
    return df.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def dangling(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target."""
    return df.filter(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)), column, "left_anti")


def dynamic_filter(df: DataFrame, **wanted) -> DataFrame:
    """Conjunction of the conditions given: a list means one of, a value means equal, None means no condition."""
    conds = [F.col(c).isin(v) if isinstance(v, list | tuple | set) else F.col(c) == v for c, v in wanted.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def islands(df: DataFrame, keys: list[str], order: str, starts: Column, name: str) -> DataFrame:
    """Number the stretches that begin where `starts` holds, from 0 before the first."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(w))


def ancestors(dim: DataFrame, code: str = "code", parent: str = "parent_code") -> DataFrame:
    """code, ancestor, distance of a small hierarchy given by parents. A cycle, or more levels than Spark's recursion allows (100), is an error."""
    spark = dim.sparkSession
    dim.select(F.col(code).alias("code"), F.col(parent).alias("parent_code")).createOrReplaceTempView("__dim")
    return spark.sql(
        """WITH RECURSIVE up(code, ancestor, distance) AS (
            SELECT code, parent_code, 1 FROM __dim WHERE parent_code IS NOT NULL
            UNION ALL SELECT u.code, d.parent_code, u.distance + 1 FROM up u JOIN __dim d ON d.code = u.ancestor
            WHERE d.parent_code IS NOT NULL)
        SELECT code, ancestor, distance FROM up"""
    )
