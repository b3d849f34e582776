"""Results kept by content: hits, what changed, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_by_cache(rows: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, rows to compute)."""
    return rows.join(cache, key), rows.join(cache.select(key), key, "left_anti")


def dirty(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(dependent, reason): dependents (dependent, module, digest) of which a module's digest changed or that miss it; a
    missing one counts before a changed one."""
    j = stored.join(current.withColumnRenamed("digest", "_now"), "module", "left")
    why = F.when(F.col("_now").isNull(), "absent").when(F.col("_now") != F.coalesce("digest", F.lit("")), "changed")
    return j.select("dependent", why.alias("reason")).where("reason is not null").groupBy("dependent").agg(F.min("reason").alias("reason"))


def digests(rows: DataFrame, key: list[str], item: Column) -> DataFrame:
    """(key, digest): a digest of each key's items in whatever order: the number of items and the sums of two halves of each
    one's SHA-256, put together before anything is shuffled. Null items count as empty."""
    h = F.sha2(F.coalesce(item, F.lit("")).cast("binary"), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
    out = rows.groupBy(*key).agg(F.count("*").alias("_n"), part(1).alias("_x"), part(16).alias("_y"))
    return out.select(*key, F.sha2(F.concat_ws(":", "_n", "_x", "_y").cast("binary"), 256).alias("digest"))


def prune(rows: DataFrame, age: str, size: str, most: int, width: int = 1 << 16) -> DataFrame:
    """The newest rows whose sizes sum to at most ``most``. ``age`` is a whole number, larger for newer rows. Sums are taken
    by ranges of ages first; only the ranges' sums are added up in one place."""
    part = F.expr(f"{age} div {width}")
    ranges = rows.groupBy(part.alias("_part")).agg(F.sum(size).alias("_sum"))
    before = ranges.select("_part", (F.sum("_sum").over(Window.orderBy(F.desc("_part"))) - F.col("_sum")).alias("_before")).where(F.col("_before") <= most)
    own = rows.withColumn("_part", part).join(before, "_part")
    held = F.sum(size).over(Window.partitionBy("_part").orderBy(F.desc(age))) + F.col("_before")
    return own.withColumn("_held", held).where(F.col("_held") <= most).drop("_part", "_before", "_held")
