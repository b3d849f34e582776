"""The check of a set of sources: facts by one reading of each file, environments by joins, typing file by file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import attach as attaching
from ..operators import coverage, imports, merge
from ..operators.cache import split_by_cache
from ..shared import Keeper, keeper
from ..sources import fortran, preprocess
from ..settings import Settings
from ..units import Quantity, UnitFault
from .typing import SEVERITY, Environment, Signature, Typer

_TEXT, _INT = T.StringType(), T.IntegerType()
FACT = T.StructType(
    [T.StructField(n, _TEXT) for n in ("path", "fact", "name", "scope", "owner", "type", "a", "b")] + [T.StructField(n, _INT) for n in ("line", "col", "line_end", "name_line", "number")]
)
FOUND = T.StructType(
    [T.StructField(n, _TEXT) for n in ("path", "what")]
    + [T.StructField(n, _INT) for n in ("sl", "sc", "el", "ec")]
    + [T.StructField(n, _TEXT) for n in ("code", "rule", "message", "suggestion", "name", "scope", "kind", "unit", "factor")]
)


#: Rows of an Arrow batch; many small files share one.
BATCH_ROWS = 4096


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    kinds = {_TEXT: pa.string(), _INT: pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(cols, schema, strict=True)], names=schema.names)


def _batches(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, BATCH_ROWS)):
        yield _batch(some, schema)


def file_facts(path: str, text: str, settings: Settings) -> Iterator[tuple]:
    """What one file says, as rows of FACT."""
    src = fortran.read(text)
    notes = settings.comments(text, frozenset(d.first for d in src.declarations))

    def fact(kind, name=None, scope=None, owner=None, type=None, a=None, b=None, line=None, col=None, line_end=None, name_line=None, number=None):
        return path, kind, name, scope, owner, type, a, b, line, col, line_end, name_line, number

    yield fact("file", number=text.count("\n") + 1)
    for x in notes.annotations:
        yield fact("annotation", x.unit, type=x.kind, line=x.line, col=x.col, line_end=x.end_col)
    for line in notes.pre_lines:
        yield fact("pre_line", line=line)
    for i, d in enumerate(src.declarations):
        for n in d.names:
            key = (d.scope, n.name.lower())
            seen = "hidden" if key in src.hidden or (d.scope in src.private and key not in src.shown) else "shown"
            yield fact("name", n.name.lower(), d.scope, d.owner, d.type if d.intrinsic else f"type {d.type}", seen, None, d.first, n.col, d.last, n.line, i)
    for s in src.scopes:
        yield fact("scope", s.name, s.parent, type=s.kind, line=s.first, line_end=s.last)
        for i, a in enumerate(s.args):
            yield fact("argument", a, s.name, type=s.kind, number=i)
        if s.result:
            yield fact("argument", s.result, s.name, type="result", number=-1)
    for scope in sorted(s for s in src.private if s):
        yield fact("access", None, scope, type="hidden")
    for kind, names in (("hidden", src.hidden), ("shown", src.shown)):
        for scope, name in sorted((s or "", n) for s, n in names):
            yield fact("access", name, scope, type=kind)
    for u in src.uses:
        if u.only is None:
            yield fact("use", u.module, u.scope, line=u.line, type="all")
            pairs = u.renames
        else:
            pairs = u.only
            if not pairs:
                yield fact("use", u.module, u.scope, line=u.line, type="none")
        for local, remote in pairs:
            yield fact("use", u.module, u.scope, a=local, b=remote, line=u.line, type="one")
    called = {n.text.lower() for s in src.statements for root in s.nodes for n in root.walk() if n.kind == "call"}
    for c in sorted(called):
        yield fact("call", c)


def preprocessed(sources: DataFrame, settings: Settings, headers: DataFrame | None, keep) -> DataFrame:
    """Sources (path, text) after the preprocessor, and ``came``: the line that each line came from, null for texts that stay
    as they are. Preprocessed are texts that ``preprocess.needed`` names and that aren't edited; what they include, directly
    or not, is joined to them from ``headers`` (name, text)."""
    spark = sources.sparkSession
    edited = F.coalesce("edited", F.lit(False)) if "edited" in sources.columns else F.lit(False)
    rows = sources.select("path", "text", (F.col("text").rlike(r"(?m)^[ \t]*#") & F.col("path").rlike(r"\.F[^./]*$") & ~edited).alias("_todo"))
    if not (settings.defines or settings.includes or headers is not None):
        return rows.select("path", "text", F.lit(None).cast("array<int>").alias("came"))
    names = lambda df, key: df.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(preprocess.INCLUDE), F.lit(1)))).alias("b"))
    if headers is None:
        headers = spark.createDataFrame([], "name string, text string")
    direct = keep(names(rows.where("_todo"), "path"))
    inner = imports.closure(names(headers, "name").withColumnRenamed("name", "a"), keep).select(F.col("a").alias("b"), F.col("b").alias("c"))
    every = direct.unionByName(direct.join(inner, "b").select("path", F.col("c").alias("b"))).distinct()
    held = every.join(headers.select(F.col("name").alias("b"), F.col("text").alias("body")), "b").groupBy("path").agg(F.collect_list(F.struct("b", "body")).alias("held"))
    defines = dict(settings.defines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, text, todo, held in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if todo:
                    bodies = {x["b"]: x["body"] for x in held or ()}
                    out.append((path, *preprocess.expand(text, defines, bodies.get)))
                else:
                    out.append((path, text, None))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.int32())), strict=True)], names=["path", "text", "came"])

    return keep(rows.join(held.hint("merge"), "path", "left").select("path", "text", "_todo", "held").mapInArrow(run, "path string, text string, came array<int>"))


def at_source(df: DataFrame, came: DataFrame | None, *lines: str) -> DataFrame:
    """Line columns of preprocessed files as lines of the files themselves. came: path, line, source."""
    for line in lines if came is not None else ():
        df = df.join(came.withColumnRenamed("line", line).hint("merge"), ["path", line], "left").withColumn(line, F.coalesce("source", line)).drop("source")
    return df


def facts(sources: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield from _batches((row for path, text in files for row in file_facts(path, text or "", settings)), FACT)

    return sources.select("path", "text").mapInArrow(run, FACT)


def environment(own: list, imported: list, routines: list, settings: Settings) -> Environment:
    """A file's environment from its joined rows."""

    def _quantity(unit: str | None) -> Quantity | None:
        try:
            return None if unit is None else settings.read(unit)
        except UnitFault:
            return None

    env = Environment()
    for x in own:
        q = _quantity(x["unit_text"])
        if q is None:
            env.bad.append((x["line"], x["col"], x["col"] + len(x["unit_text"]), x["unit_text"]))
        elif x["owner"] is not None:
            env.fields[x["owner"], x["name"]] = q
        else:
            env.units[x["scope"], x["name"]] = q
    for x in imported:
        q = _quantity(x["unit_text"])
        if q is not None:
            env.imported[x["name"]] = q
    held: dict[str, list] = {}
    for x in routines:
        held.setdefault(x["routine"], []).append(x)
    for name, rows in held.items():
        rows.sort(key=lambda x: x["slot"])
        args = [(x["name"], _quantity(x["unit_text"])) for x in rows if x["slot"] >= 0]
        result = next((_quantity(x["unit_text"]) for x in rows if x["slot"] == -1), None)
        env.signatures[name] = Signature(args, result, any(x["slot"] == -2 for x in rows))
    return env


def file_findings(path: str, text: str, env: Environment, settings: Settings) -> Iterator[tuple]:
    """Typing of one file in its environment, as rows of FOUND."""
    src = fortran.read(text)
    notes = settings.comments(text, frozenset(d.first for d in src.declarations))
    typer = Typer(src, notes, env, settings.scale)
    typer.run(settings.read)
    for f in sorted(typer.found, key=lambda f: (f.sl, f.sc, f.code, f.message)):
        yield path, "finding", f.sl, f.sc, f.el, f.ec, f.code, f.rule, f.message, f.suggestion, None, None, None, None, None
    for p in typer.points:
        yield path, "point", p.line, p.col, p.line, p.col + len(p.name), None, None, None, None, p.name, p.scope, p.kind, p.unit, p.factor


def _cached(env: DataFrame, run, cache: str, settings: Settings) -> DataFrame:
    """Findings from the cache by a digest of each file's whole environment; those missing are made and added to it."""
    spark = env.sparkSession
    lists = [F.array_sort(c).alias(c) for c in ("own", "imported", "routines")]
    digest = F.sha2(F.to_json(F.struct(F.lit(settings.digest).alias("settings"), "path", "text", *lists)).cast("binary"), 256)
    env = env.withColumn("key", digest)
    keys = env.select("path", "key")
    try:
        old = spark.read.schema(T.StructType([T.StructField("key", _TEXT), *FOUND.fields])).parquet(cache)
        old.isEmpty()
    except AnalysisException:
        old = spark.createDataFrame([], T.StructType([T.StructField("key", _TEXT), *FOUND.fields]))
    _, fresh = split_by_cache(env, old.select("key").distinct().hint("merge"))
    made = fresh.drop("key").mapInArrow(run, FOUND)
    # a row for the file itself, so that files without findings are known, too
    mark = fresh.select("key", "path", F.lit("typed").alias("what"))
    for f in FOUND.fields[2:]:
        mark = mark.withColumn(f.name, F.lit(None).cast(f.dataType))
    made.join(keys.hint("merge"), "path").select("key", *FOUND.names).unionByName(mark).write.mode("append").parquet(cache)
    return spark.read.schema(old.schema).parquet(cache).join(keys.select("key").hint("merge"), "key", "left_semi").select(*FOUND.names)


@dataclass
class Checked:
    """Lazily joined results of a check. All frames have a ``path`` column. ``close`` removes what they are read from."""

    diagnostics: DataFrame  # path, sl, sc, el, ec, severity, code, rule, message, suggestion
    points: DataFrame  # path, line, col, name, scope, kind, unit, factor
    units: DataFrame  # path, scope, owner, name, unit_text, line, col, origin
    facts: DataFrame
    kept: Keeper | None = None

    def close(self) -> None:
        if self.kept is not None:
            self.kept.close()


def check(sources: DataFrame, settings: Settings | None = None, cache: str | None = None, headers: DataFrame | None = None) -> Checked:
    """Checks all sources (path, text) together. Routines are known across files; a name of several files is taken from the
    first path. Tables of all files are joined by merging, whatever their size on disk: well compressed ones would be
    broadcast, through the driver's memory. cache: a folder of earlier findings; a file is typed anew only if its text, what it gets from others or the
    settings have changed. headers: (name, text) of what preprocessed files may include; where lines are told they are those
    of the files before preprocessing."""
    spark, settings = sources.sparkSession, settings or Settings()
    keep = keeper(spark)
    sources = preprocessed(sources, settings, headers, keep)
    came = None
    if settings.defines or settings.includes or headers is not None:
        came = keep(sources.where("came is not null").select("path", F.posexplode("came").alias("line", "source")).select("path", (F.col("line") + 1).cast("int").alias("line"), "source"))
    all_facts = keep(facts(sources, settings))
    of = lambda kind: all_facts.where(F.col("fact") == kind)
    # PRE lines without a unit are part of a block, too
    notes = of("annotation").select("path", F.col("type").alias("kind"), "line", "col", F.col("name").alias("unit_text"))
    blank = of("pre_line").join(notes.hint("merge"), ["path", "line"], "left_anti").select("path", F.lit("PRE").alias("kind"), "line", F.lit(-1).alias("col"), F.lit("").alias("unit_text"))
    declared = of("name").select(
        "path", F.col("number").alias("decl_id"), "name", F.col("line").alias("line_start"), "line_end", F.col("name_line").alias("name_end_line"), "scope", F.col("owner").alias("enclosing_type"), F.col("type").alias("intrinsic_type")
    )
    got = attaching.attach(notes.unionByName(blank), declared, keep)
    real = lambda df: df.where("unit_text <> ''")
    units = keep(real(got["units"]).unionByName(got["defaults"]).withColumnRenamed("enclosing_type", "owner").drop("decl_id"))
    key = ["path", "scope", "owner", "name"]
    own = merge.first_wins(units, key, ["line", "col"], ["unit_text", "line", "col", "origin"])
    own = keep(own)
    plain = own.where("owner is null")
    # routines and their formals
    slots = of("argument").select("path", F.col("scope").alias("routine"), F.col("name").alias("arg"), F.col("number").alias("slot"))
    none = of("scope").where("type = 'subroutine'").select("path", F.col("name").alias("routine"), F.lit(None).cast("string").alias("arg"), F.lit(-2).alias("slot"))
    slots = slots.unionByName(none)
    first = slots.groupBy("routine").agg(F.min("path").alias("path"))
    slots = slots.join(first.hint("merge"), ["routine", "path"]).distinct()
    named = plain.select("path", F.col("scope").alias("routine"), F.col("name").alias("arg"), "unit_text")
    signatures = keep(slots.join(named.hint("merge"), ["path", "routine", "arg"], "left").select("routine", F.col("arg").alias("name"), "slot", "unit_text"))
    # module exports and imports
    modules = of("scope").where("type = 'module'").select("path", F.col("name").alias("module"))
    first_module = merge.first_wins(modules, ["module"], ["path"], ["path"])
    inside = of("name").where("owner is null").select("path", F.col("scope").alias("module"), "name").distinct().join(first_module.hint("merge"), ["path", "module"], "left_semi")
    with_unit = inside.join(plain.select("path", F.col("scope").alias("module"), "name", F.col("unit_text").alias("unit")).hint("merge"), ["path", "module", "name"], "left")
    uses = of("use").select("path", "scope", F.lower("name").alias("module"), "type", F.lower("a").alias("local"), F.lower("b").alias("remote"), "line")
    passed_on = uses.join(first_module.select("path", F.col("module").alias("scope")).hint("merge"), ["path", "scope"], "left_semi").withColumnRenamed("scope", "importer")
    access = of("access").join(first_module.select("path", F.col("module").alias("scope")).hint("merge"), ["path", "scope"], "left_semi").select(F.col("scope").alias("module"), "name", "type")
    exports = imports.surfaces(with_unit.drop("path"), passed_on.drop("path"), access, keep).where("unit is not null").select("module", "name", "unit")
    got_names, _ = imports.resolve(uses.where("type = 'one'").select(F.col("path").alias("importer"), "module", "local", "remote"), exports)
    one = got_names.select(F.col("importer").alias("path"), F.col("local").alias("name"), F.col("unit").alias("unit_text"))
    renamed = uses.where("type = 'one'").select("path", "module", F.col("remote").alias("name"))
    every = uses.where("type = 'all'").select("path", "module").distinct().join(exports, "module").join(renamed.hint("merge"), ["path", "module", "name"], "left_anti").select("path", "name", F.col("unit").alias("unit_text"))
    imported = one.unionByName(every).groupBy("path", "name").agg(F.min("unit_text").alias("unit_text"))
    # each file with its environment
    wanted = of("call").select("path", F.col("name").alias("routine")).unionByName(of("scope").where("type in ('function', 'subroutine')").select("path", F.col("name").alias("routine"))).distinct()
    listed = lambda df, name, *cols: df.groupBy("path").agg(F.collect_list(F.struct(*cols)).alias(name))
    lists = listed(own, "own", "scope", "owner", "name", "unit_text", "line", "col")
    lists = lists.join(listed(imported, "imported", "name", "unit_text"), "path", "full")
    lists = lists.join(listed(wanted.join(signatures, "routine"), "routines", "routine", "name", "slot", "unit_text"), "path", "full")
    env = sources.select("path", "text").join(lists.hint("merge"), "path", "left")  # the texts move once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            yield from _batches((row for path, text, a, b, c in files for row in file_findings(path, text or "", environment(a or [], b or [], c or [], settings), settings)), FOUND)

    env = env.select("path", "text", "own", "imported", "routines")
    if cache is None:
        found = keep(env.mapInArrow(run, FOUND))
    else:
        found = keep(_cached(keep(env), run, cache, settings))
    where = lambda df, code, sl, sc, el, ec, message: df.select(
        "path", sl.cast("int").alias("sl"), sc.cast("int").alias("sc"), el.cast("int").alias("el"), ec.cast("int").alias("ec"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("rule"), message.alias("message"), F.lit(None).cast("string").alias("suggestion")
    )
    spot = F.col("line"), F.col("col"), F.col("line"), F.col("col") + F.length("unit_text")
    outs = [found.where("what = 'finding'").select("path", "sl", "sc", "el", "ec", "code", "rule", "message", "suggestion")]
    outs.append(where(real(got["orphans"]), "U006", *spot, F.concat(F.lit("no declaration for the unit "), F.col("unit_text"))))
    outs.append(where(real(got["multi_line"]), "U024", *spot, F.lit("a unit above a declaration of several lines is about none of its names")))
    left = got["left_out"].withColumn("line", F.col("anchor"))
    outs.append(where(left, "U025", F.col("line"), F.lit(0), F.col("line"), F.lit(0), F.concat(F.lit("names on later lines have no unit: "), F.array_join("names", ", "))))
    shadow = real(notes).withColumn("symbol", F.explode(F.regexp_extract_all("unit_text", F.lit(r"\^\(?[^*/]*?([A-Za-z]+)"), F.lit(1))))
    known = F.array(*map(F.lit, settings.catalog.names()))
    outs.append(where(shadow.where(F.array_contains(known, F.col("symbol"))), "U026", *spot, F.concat(F.lit("an exponent has a unit's name: "), F.col("symbol"))))
    clash = units.where("origin = 'explicit'").join(own.select(*key, F.col("unit_text").alias("kept")).withColumnsRenamed({"path": "p", "scope": "s", "owner": "o", "name": "n"}).hint("merge"), F.expr("path = p and name = n and scope <=> s and owner <=> o and unit_text <> kept"))
    outs.append(where(clash, "U-conflict", *spot, F.concat_ws(" ", F.col("name"), F.lit("has the unit"), F.col("kept"), F.lit("already"))))
    lost = uses.join(of("scope").where("type in ('module', 'submodule')").select(F.col("name").alias("module")).distinct(), "module", "left_anti")
    lost = lost.where(~F.col("module").isin("iso_fortran_env", "iso_c_binding", "ieee_arithmetic", "ieee_exceptions", *[e.lower() for e in settings.external])).select("path", "module", "line").distinct()
    outs.append(where(lost, "U007", F.col("line"), F.lit(0), F.col("line"), F.lit(0), F.concat(F.lit("module isn't there: "), F.col("module"))))
    diagnostics = outs[0]
    for o in outs[1:]:
        diagnostics = diagnostics.unionByName(o)
    levels = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    diagnostics = diagnostics.withColumn("severity", F.element_at(levels, F.col("code")))
    if settings.severities:
        diagnostics = merge.overridden(diagnostics, spark.createDataFrame(list(settings.severities.items()), "marker string, severity string"))
    points = found.where("what = 'point'").select("path", F.col("sl").alias("line"), F.col("sc").alias("col"), "name", "scope", "kind", "unit", "factor")
    columns = diagnostics.columns
    diagnostics = at_source(diagnostics, came, "sl", "el").select(*columns)
    points, own = at_source(points, came, "line").select(*points.columns), at_source(own, came, "line").select(*own.columns)
    if came is not None:
        length = came.groupBy("path").agg(F.max("source").alias("source"))
        all_facts = at_source(all_facts, came, "line", "line_end", "name_line").join(length.hint("merge"), "path", "left")
        all_facts = all_facts.withColumn("number", F.when((F.col("fact") == "file") & F.col("source").isNotNull(), F.col("source")).otherwise(F.col("number"))).select(*FACT.names)
    return Checked(diagnostics, points, own, all_facts, keep)


def conflicts(points: DataFrame, scale: bool = False) -> DataFrame:
    """X001: claims of one name in one scope of a file that differ from the first claim in their unit, or, where scales
    count, in its factor. Adds ``reference`` and ``reference_factor``, those of the first claim."""
    claims = points.where("unit is not null and kind <> 'uses'")
    first = merge.first_wins(claims, ["path", "scope", "name"], ["line", "col"], ["unit", "factor"]).withColumnsRenamed({"unit": "reference", "factor": "reference_factor"})
    differs = F.col("unit") != F.col("reference")
    return claims.join(first.hint("merge"), ["path", "scope", "name"]).where(differs | (F.lit(scale) & (F.col("factor") != F.col("reference_factor"))))


#: Tiers of codes on a line; codes that aren't here leave a line as it is.
RED = ("H001", "H002", "H003", "H004", "H020", "H021", "H022", "H023", "S003", "U002")
YELLOW = ("H010", "S001", "S002", "U005", "U020")


def line_status(checked: Checked) -> DataFrame:
    """(path, line, tier): the worst of a line's findings, unread regions, units given (green) and names used."""
    tier = F.when(F.col("code").isin(*RED), "red").when(F.col("code").isin(*YELLOW), "yellow").when(F.col("code") == "P001", "blue")
    spans = checked.diagnostics.select("path", F.col("sl").alias("start"), F.greatest("sl", "el").alias("end"), tier.alias("tier")).where("tier is not null")
    marked = checked.units.where("origin = 'explicit'").select("path", F.col("line").alias("start"), F.col("line").alias("end"), F.lit("green").alias("tier"))
    used = checked.points.where("kind <> 'declares'").select("path", F.col("line").alias("start"), F.col("line").alias("end"), F.when(F.col("unit").isNull() & (F.col("kind") == "contributes"), "yellow").otherwise("green").alias("tier"))
    return coverage.worst_by_line(spans.unionByName(marked).unionByName(used), ["path"])


def coverage_figures(checked: Checked) -> DataFrame:
    """Counts by file and over all (null path), with the lines out of scope."""
    out = coverage.figures(line_status(checked), ["path"])
    size = checked.facts.where("fact = 'file'")
    total = size.groupingSets([[F.col("path")], []], F.col("path")).agg(F.sum("number").alias("total"))
    j = total.withColumnRenamed("path", "p").join(out.hint("merge"), F.expr("p <=> path"), "left")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("ok", "warn", "fire", "unparsed")]
    out = j.select(F.col("p").alias("path"), "total", *filled, F.coalesce("pct", F.lit(0.0)).alias("pct"))
    return out.withColumn("out", F.greatest(F.col("total") - F.col("ok") - F.col("warn") - F.col("fire") - F.col("unparsed"), F.lit(0)))


def summary(checked: Checked) -> DataFrame:
    return coverage.code_counts(checked.diagnostics, ["path"])
