"""Imports: resolution against exports, reachability, load order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(uses: DataFrame, exports: DataFrame, external: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(imported, unresolved): uses (importer, module, local, remote) matched with exports (module, name, unit). Modules on
    the external list are neither."""
    if external:
        uses = uses.where(~F.lower("module").isin([e.lower() for e in external]))
    got = uses.join(exports.withColumnRenamed("name", "remote"), ["module", "remote"])
    missing = uses.join(exports.select("module").distinct(), "module", "left_anti")
    return got, missing


def with_locals(local: DataFrame, imported: DataFrame, key: list[str]) -> DataFrame:
    """Local names and the imported ones that none of them hides."""
    return local.unionByName(imported.join(local.select(*key), key, "left_anti").select(*local.columns))


def closure(edges: DataFrame, keep) -> DataFrame:
    """(a, b, depth): everything reachable from each node with the least number of steps, however many.

    A round knows all pairs of up to h steps and finds those of up to 2h: a shortest way of h to 2h steps begins with one of
    exactly h, so only these pairs are joined with all. The number of rounds grows with the logarithm of the longest way.
    ``keep`` writes a frame where it survives lost executors and gives it back."""
    found = keep(edges.select("a", "b").where("a <> b").distinct().withColumn("depth", F.lit(1)))
    reach = 1
    while True:
        last = found.where(F.col("depth") == reach)
        step = last.alias("x").join(found.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), (F.col("x.depth") + F.col("y.depth")).alias("depth"))
        new = step.where("a <> b").groupBy("a", "b").agg(F.min("depth").alias("depth")).join(found, ["a", "b"], "left_anti")
        new = keep(new)
        if new.isEmpty():
            return found
        both = keep(found.unionByName(new))
        keep.drop(found, new)
        found, reach = both, 2 * reach


def reachable(edges: DataFrame, start: DataFrame, keep) -> DataFrame:
    """(node): the start nodes and all that can be reached from them; a round follows the edges of the newest nodes alone."""
    found = new = keep(start.select("node").where("node is not null").distinct())
    while not new.isEmpty():
        step = edges.join(new.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct()
        new = keep(step.join(found, "node", "left_anti"))
        both = keep(found.unionByName(new))
        keep.drop(found)
        found = both
    return found


def surfaces(local: DataFrame, uses: DataFrame, access: DataFrame, keep) -> DataFrame:
    """(module, name, unit, origin): all that each module offers, its own names and those that it passes on.

    local: module, name, unit (null: none is known), every name declared in a module, hidden ones too.
    uses: importer, module, type (all, one, none), local, remote, line, the uses in modules' own scopes. A name that is
    renamed by a use of all is passed on under its new name alone.
    access: module, name (null: the module as a whole), type (hidden or shown).

    Names that a module declares win over what it imports, earlier uses over later ones. Each round passes on what was new
    in the one before, until nothing is, so that chains may be of any length and modules may use one another.
    """
    whole = access.where("name is null and type = 'hidden'").select("module").distinct().withColumn("_closed", F.lit(True))
    named = access.where("name is not null").groupBy("module", "name").agg(F.max(F.col("type") == "hidden").alias("_hidden"))

    def visible(df: DataFrame) -> DataFrame:
        out = df.join(named, ["module", "name"], "left").join(whole, "module", "left")
        return out.where(~F.coalesce("_hidden", F.coalesce("_closed", F.lit(False)))).drop("_hidden", "_closed")

    local = keep(local.select("module", "name", "unit").withColumn("origin", F.col("module")))
    one = uses.where("type = 'one'").select("importer", "module", F.col("local").alias("name"), "remote", "line")
    every = uses.where("type = 'all'").select("importer", "module", "line").distinct()
    renamed = one.select("importer", "module", "remote", "line").distinct()
    found = new = keep(visible(local))
    while not new.isEmpty():
        got = new.withColumnRenamed("name", "remote")
        by_all = every.join(got, "module").join(renamed, ["importer", "module", "remote", "line"], "left_anti").select("importer", F.col("remote").alias("name"), "unit", "origin", "line")
        by_one = one.join(got, ["module", "remote"]).select("importer", "name", "unit", "origin", "line")
        first = by_all.unionByName(by_one).groupBy(F.col("importer").alias("module"), "name").agg(F.min(F.struct("line", "unit", "origin")).alias("x")).select("module", "name", "x.unit", "x.origin")
        old, new = new, keep(visible(first.join(local, ["module", "name"], "left_anti")).join(found, ["module", "name"], "left_anti"))
        whole_now = keep(found.unionByName(new))
        if old is not found:
            keep.drop(old)
        keep.drop(found)
        found = whole_now
    return found


def levels(edges: DataFrame, nodes: DataFrame, keep) -> DataFrame:
    """(node, level): the longest path to a node that imports nothing; nodes of cycles, and what imports them, get null.
    a imports b. Each round writes the nodes with their levels so far and the edges whose target has none yet."""
    state = keep(nodes.select(F.col("node"), F.lit(None).cast("int").alias("level")))
    left = keep(edges.select("a", "b").where("a is not null and b is not null").join(nodes.select(F.col("node").alias("b")), "b", "left_semi"))
    level = 0
    while True:
        waiting = left.select(F.col("a").alias("node")).distinct().withColumn("_waits", F.lit(True))
        new = state.join(waiting, "node", "left").select("node", F.when(F.col("level").isNull() & F.col("_waits").isNull(), F.lit(level)).otherwise(F.col("level")).alias("level"))
        new = keep(new)
        ready = new.where(F.col("level") == level)
        keep.drop(state)
        state = new
        if ready.isEmpty():
            return state
        rest = keep(left.join(ready.select(F.col("node").alias("b")), "b", "left_anti"))
        keep.drop(left)
        left, level = rest, level + 1


def load_order(edges: DataFrame, nodes: DataFrame, keep) -> DataFrame:
    """(node, level, place): imports before importers, in order of level and name; cycles and what hangs on them come last,
    by name. Places are counted within levels first, so that no task sorts all nodes."""
    own = levels(edges, nodes, keep).withColumn("_key", F.coalesce("level", F.lit((1 << 31) - 1)))
    sizes = own.groupBy("_key").agg(F.count("*").alias("_n"))
    before = sizes.select("_key", (F.sum("_n").over(Window.orderBy("_key")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("node"))
    return own.join(before, "_key").select("node", "level", (F.col("_before") + nth).alias("place"))
