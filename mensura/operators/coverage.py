"""Line tiers and coverage figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("green", "blue", "yellow", "red")


def rank(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier) - 1


def worst_by_line(spans: DataFrame, key: list[str], start: str = "start", end: str = "end", tier: str = "tier") -> DataFrame:
    """The worst tier of each line that a span covers."""
    on = spans.select(*key, F.explode(F.sequence(start, end)).alias("line"), rank(F.col(tier)).alias("_rank"))
    worst = on.groupBy(*key, "line").agg(F.max("_rank").alias("_rank"))
    return worst.select(*key, "line", F.get(F.array(*map(F.lit, TIERS)), F.col("_rank").cast("int")).alias("tier"))


def figures(status: DataFrame, key: list[str], total: str | None = None) -> DataFrame:
    """Counts by tier and the share of green lines among green, yellow and red ones, for each key and over all (null keys)."""
    out = status.groupingSets([[F.col(k) for k in key], []], *[F.col(k) for k in key]).agg(
        *[F.count_if(F.col("tier") == t).alias(name) for t, name in (("green", "ok"), ("yellow", "warn"), ("red", "fire"), ("blue", "unparsed"))]
    )
    seen = F.col("ok") + F.col("warn") + F.col("fire")
    return out.withColumn("pct", F.when(seen == 0, F.lit(0.0)).otherwise(F.bround(F.col("ok") / seen * 100, 1)))


def code_counts(diagnostics: DataFrame, key: list[str]) -> DataFrame:
    """Findings about units that don't go together (H) and about annotations (U), for each key."""
    return diagnostics.groupBy(*key).agg(F.count_if(F.col("code").startswith("H")).alias("n_h"), F.count_if(F.col("code").startswith("U")).alias("n_u"))
