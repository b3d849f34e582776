"""Annotations to the names they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .captures import islands

#: Types whose values have no dimension unless a unit is given.
PLAIN_TYPES = ("integer", "logical", "character")


def innermost(points: DataFrame, ranges: DataFrame, key: list[str], at: str, name: str) -> DataFrame:
    """For each point the name of the shortest range (start, end exclusive) around it, null outside all; points of one place
    are one. Places aren't negative.

    A range is cut into aligned cells whose sizes are powers of two, at most two of each size, and a point looks up the cell
    of each size that it lies in. So a point meets the ranges around it and no others."""
    top = ranges.agg(F.max("end")).first()[0] or 1
    size = max(1, int(top).bit_length())
    lo = lambda k: F.shiftright(F.col("start").cast("long") + F.shiftleft(F.lit(1).cast("long"), k) - 1, k)
    hi = lambda k: F.shiftright(F.col("end").cast("long"), k)
    cells = []
    for k in range(size + 1):
        open_ = lo(k) < hi(k)
        cells += [F.when(open_ & (lo(k) % 2 == 1), F.struct(F.lit(k).alias("size"), lo(k).alias("cell"))), F.when(open_ & (hi(k) % 2 == 1), F.struct(F.lit(k).alias("size"), (hi(k) - 1).alias("cell")))]
    cut = ranges.select(*key, "start", "end", F.col(name).alias("_name"), F.explode(F.array_distinct(F.array_compact(F.array(*cells)))).alias("c"))
    cut = cut.select(*key, "start", "end", "_name", "c.size", "c.cell")
    own = list(dict.fromkeys([*key, at]))
    places = points.select(*own).distinct()
    looked = places.select(*own, F.explode(F.sequence(F.lit(0), F.lit(size))).alias("size")).withColumn("cell", F.expr(f"shiftright(cast({at} as bigint), size)"))
    hit = looked.join(cut, [*key, "size", "cell"]).groupBy(*own).agg(F.min_by("_name", F.struct((F.col("end") - F.col("start")).alias("n"), F.col("start").alias("s"))).alias("_name"))
    rest = [c for c in points.columns if c not in own]
    return points.distinct().join(hit, own, "left").select(*own, *rest, F.col("_name").alias(name)).select(*points.columns, name)


def attach(annotations: DataFrame, declared: DataFrame, keep=lambda df: df) -> dict[str, DataFrame]:
    """Units of names, and what found none.

    annotations: path, kind (PRE or POST), line, col, unit_text; pre-blocks are runs of PRE lines.
    declared: path, decl_id, name, line_start, line_end, name_end_line, scope, enclosing_type, intrinsic_type.

    A POST annotation is about the names that end on its line in the declaration around it; a PRE block about the
    declaration right below it, if that is on one line. Gives ``units``, ``orphans``, ``multi_line`` (PRE over more lines),
    ``left_out`` (names on later lines of a declaration annotated on an earlier one), ``defaults``. Joins are merge joins:
    each side grows with the files, and Spark takes well compressed ones for small enough to go through the driver. ``keep``
    writes what several results are made of, so that none has all these joins in its plan, which takes the driver's memory, too.
    """
    post = annotations.where("kind = 'POST'")
    pre = islands(annotations.where("kind = 'PRE'"), ["path"], "line")
    spans = declared.select("path", "decl_id", "line_start", "line_end").distinct()
    at = post.alias("a").join(spans.hint("merge").alias("d"), [F.col("a.path") == F.col("d.path"), F.col("a.line").between(F.col("d.line_start"), F.col("d.line_end"))], "left")
    at = at.select("a.*", "decl_id", "line_start", "line_end")
    below = pre.alias("a").join(spans.hint("merge").alias("d"), [F.col("a.path") == F.col("d.path"), F.col("d.line_start") == F.col("a.block_end") + 1], "left").select("a.*", "decl_id", "line_start", "line_end")
    met = keep(at.unionByName(below.drop("block_end")))
    at, below = met.where("kind = 'POST'"), met.where("kind = 'PRE'")
    named = declared.select("path", "decl_id", "name", "name_end_line", "scope", "enclosing_type").hint("merge")
    by_post = at.where("decl_id is not null").join(named, ["path", "decl_id"]).where("name_end_line = line")
    by_pre = below.where("line_start = line_end").join(named, ["path", "decl_id"])
    hits = keep(by_post.unionByName(by_pre))
    units = hits.select("path", "scope", "enclosing_type", F.lower("name").alias("name"), "unit_text", "line", "col", "decl_id", F.lit("explicit").alias("origin"))
    orphans = met.where("decl_id is null").select("path", "line", "col", "unit_text")
    multi = below.where("line_start < line_end").select("path", "line", "col", "unit_text", "line_start", "line_end")
    anchor = hits.where("kind = 'POST' and line < line_end").groupBy("path", "decl_id").agg(F.max("line").alias("anchor"))
    owned = units.select("path", "decl_id", "name").distinct().hint("merge")
    left = declared.withColumn("name", F.lower("name")).join(anchor.hint("merge"), ["path", "decl_id"]).where("name_end_line > anchor").join(owned, ["path", "decl_id", "name"], "left_anti")
    left = left.groupBy("path", "decl_id", "anchor").agg(F.array_sort(F.collect_list("name")).alias("names"))
    plain = declared.where(F.col("intrinsic_type").isin(*PLAIN_TYPES)).select("path", "scope", "enclosing_type", F.lower("name").alias("name"), "line_start", "decl_id")
    plain = plain.join(owned, ["path", "decl_id", "name"], "left_anti")
    defaults = plain.select("path", "scope", "enclosing_type", "name", F.lit("1").alias("unit_text"), F.col("line_start").alias("line"), F.lit(0).alias("col"), "decl_id", F.lit("default").alias("origin"))
    return {"units": units, "orphans": orphans, "multi_line": multi, "left_out": left, "defaults": defaults}


def unannotated(used: DataFrame, annotated: DataFrame, key: list[str]) -> DataFrame:
    """What is used but has no unit."""
    return used.join(annotated.select(*key).distinct(), key, "left_anti")
