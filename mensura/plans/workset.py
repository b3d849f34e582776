"""The files that a check of some files needs: what they use and call, found by patterns over a whole tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import imports
from ..shared import keeper

MODULE = r"(?im)^[ \t]*module[ \t]+(?!procedure\b)([a-z]\w*)[ \t]*(?:!.*)?$"
USE = r"(?im)^[ \t]*use\b(?:[ \t]*,[ \t]*\w+[ \t]*::|[ \t]*::)?[ \t]*([a-z]\w*)"
ROUTINE = r"(?im)^[ \t]*(?:(?!end\b)[\w()*=, \t]*[ \t])?(?:subroutine|function)[ \t]+([a-z]\w*)"
CALL = r"(?im)\bcall[ \t]+([a-z]\w*)"


def index(sources: DataFrame) -> DataFrame:
    """(path, what, name): modules and routines that files define, modules that they use, routines that they call. The texts
    are looked through once, without a parser."""
    found = {"module": MODULE, "use": USE, "routine": ROUTINE, "call": CALL}
    some = [F.transform(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), F.lower)), lambda n: F.struct(F.lit(w).alias("what"), n.alias("name"))) for w, p in found.items()]
    return sources.select("path", F.explode(F.concat(*some)).alias("x")).select("path", "x.what", "x.name")


def steps(indexed: DataFrame) -> DataFrame:
    """(a, b): file a needs file b. A name that several files define is that of the first path."""
    first = lambda what: indexed.where(F.col("what") == what).groupBy("name").agg(F.min("path").alias("b"))
    used = indexed.where("what = 'use'").join(first("module"), "name")
    called = indexed.where("what = 'call'").join(first("routine"), "name")
    return used.unionByName(called).select(F.col("path").alias("a"), "b").where("a <> b").distinct()


def workset(sources: DataFrame, chosen: DataFrame) -> DataFrame:
    """The sources (of a whole tree) that a check of the chosen paths needs, with ``place``, the order to load them in."""
    keep = keeper(sources.sparkSession)
    edges = keep(steps(index(sources)))
    needed = imports.reachable(edges, chosen.select(F.col("path").alias("node")), keep)
    order = imports.load_order(edges, needed, keep).select(F.col("node").alias("path"), "place")
    return sources.join(order, "path")
