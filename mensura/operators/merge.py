"""First-come merges, claims and conflicts, overrides, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """For each key the values of the row that comes first; combined before it is shuffled."""
    return rows.groupBy(*key).agg(F.min(F.struct(*dict.fromkeys([*order, *values]))).alias("_first")).select(*key, *[F.col(f"_first.{v}").alias(v) for v in values])


def disputed(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Keys with more than one value: the first value and the number of values. Null values are none; a null in the order
    comes last. What ``order`` leaves open goes by the value."""
    place = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))], value)
    first = F.min(F.when(F.col(value).isNotNull(), place)).alias("_first")
    out = rows.groupBy(*key).agg(first, F.count_distinct(value).alias("n_claims")).where("n_claims > 1")
    return out.select(*key, F.col(f"_first.{value}").alias("kept"), "n_claims")


def against_first_claim(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``reference``, the first non-null value of each row's key; later claims are compared with it alone."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("reference", F.first(value, ignorenulls=True).over(w))


def overridden(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Severities after overrides: ``rules`` (marker, severity) match a row's rule before its code; ``off`` drops the row.
    Rules are a user's settings, a handful of rows."""
    by_rule = F.broadcast(rules.select(F.col("marker").alias("rule"), F.col("severity").alias("_by_rule")))
    by_code = F.broadcast(rules.select(F.col("marker").alias("code"), F.col("severity").alias("_by_code")))
    out = rows.join(by_rule, "rule", "left").join(by_code, "code", "left")
    out = out.withColumn("severity", F.coalesce("_by_rule", "_by_code", "severity")).drop("_by_rule", "_by_code")
    return out.where("severity <> 'off'")


def capped(rows: DataFrame, pinned: str, order: str, cap: int) -> DataFrame:
    """At most ``cap`` rows, the last in order, but every pinned one; in order."""
    n_pinned = rows.where(pinned).count()
    return rows.orderBy(F.col(pinned).desc(), F.col(order).desc()).limit(max(cap, n_pinned)).orderBy(order)


def latest(rows: DataFrame, key: list[str], version: str, values: list[str]) -> DataFrame:
    """The newest version of each key."""
    return rows.groupBy(*key).agg(F.max(F.struct(version, *values)).alias("_last")).select(*key, *[F.col(f"_last.{v}").alias(v) for v in (version, *values)])


def in_both(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``a`` whose key ``b`` has, too."""
    return a.join(b.select(*key).distinct(), key, "left_semi").select(*a.columns)


def in_one(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one of the two has, with ``side``, left or right."""
    own = lambda x, y, side: x.select(*key).distinct().join(y.select(*key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return own(a, b, "left").unionByName(own(b, a, "right"))
