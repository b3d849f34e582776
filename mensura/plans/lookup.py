"""Questions about one place or name in checked sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import imports
from ..settings import Settings
from ..shared import keeper
from ..sources import comments, fortran
from ..units import describe
from .check import Checked
from .typing import Environment, Typer

RANKS = ("green", "yellow", "red")


def definitions(checked: Checked, name: str, path: str) -> DataFrame:
    """Where a name is declared, as seen from a file: in it, or in modules that it uses, directly or by others."""
    facts = checked.facts
    uses = facts.where("fact = 'use'").select("path", F.col("name").alias("module")).distinct()
    owner = facts.where("fact = 'scope' and type = 'module'").select(F.col("name").alias("module"), F.col("path").alias("to"))
    steps = uses.join(owner, "module").select("path", "to").where("path <> to").distinct()
    keep = keeper(facts.sparkSession)
    start = facts.sparkSession.createDataFrame([(path,)], "node string")
    seen = imports.reachable(keep(steps.select(F.col("path").alias("a"), F.col("to").alias("b"))), start, keep).withColumnRenamed("node", "path")
    sites = facts.where(F.col("fact").isin("name", "scope"))
    found = in_reach(sites.select("path", "name", F.coalesce("name_line", "line").alias("line"), "col", "fact", "scope", "type"), name, seen)
    return found.drop("name").distinct().orderBy(F.col("path") != path, "path", "line")


def in_reach(sites: DataFrame, name: str | Column, reach: DataFrame) -> DataFrame:
    """The sites (path, name) of a name, in whatever case, in the files (path) that can be seen."""
    wanted = F.lower(F.lit(name)) if isinstance(name, str) else name
    return sites.where(F.lower("name") == wanted).join(reach.select("path").distinct(), "path", "left_semi")


def completions(prefix: str, line: str, col: int, settings: Settings | None = None) -> list[str]:
    """Unit names that go on from a prefix, if the place is inside an annotation that isn't closed yet."""
    at = comments.comment_start(line)
    head = line[:col]
    opened = max((head.rfind(p.opening) for p in comments.UNIT), default=-1)
    if at is None or opened < at or "}" in head[opened:]:
        return []
    return [n for n in (settings or Settings()).catalog.names() if n.startswith(prefix)]


def expression_tree(text: str, line: int, env: Environment, settings: Settings | None = None) -> list[dict]:
    """The expressions of a line's statements, outermost first: kind, text, span, unit and tiers of the node itself and of
    all of it."""
    settings = settings or Settings()
    src = fortran.read(text)
    notes = settings.comments(text, frozenset(d.first for d in src.declarations))
    typer = Typer(src, notes, env, settings.scale)
    typer.run(settings.read)
    inside = lambda f, n: (n.sl, n.sc) <= (f.sl, f.sc) and (f.el, f.ec) <= (n.el, n.ec)
    out: list[dict] = []

    def show(node, depth) -> int:
        unit = typer.units.get(id(node))
        own = 0 if unit is not None else 1
        for f in typer.found:
            if inside(f, node) and not any(inside(f, c) for c in node.children):
                own = max(own, 2 if f.code in ("H001", "H002", "H003", "H004", "H020", "H021", "H022", "H023", "S003") else 1)
        at = len(out)
        out.append({"depth": depth, "kind": node.kind, "text": node.text, "span": node.span, "unit": None if unit is None else describe(unit), "own": RANKS[own]})
        worst = max([own, *(show(c, depth + 1) for c in node.children)])
        out[at]["row"] = RANKS[worst]
        return worst

    for s in src.statements:
        if s.first <= line <= s.last:
            for n in s.nodes:
                show(n, 0)
    return out


def imports_panel(checked: Checked, path: str) -> DataFrame:
    """(module, name, remote, line): what a file's use clauses name one by one, and the clauses that bring all of a module."""
    uses = checked.facts.where((F.col("fact") == "use") & (F.col("path") == path))
    return uses.select(F.col("name").alias("module"), F.col("a").alias("name"), F.col("b").alias("remote"), F.col("type"), "line").orderBy("line", "name")


def panel(checked: Checked, path: str) -> DataFrame:
    """(scope, name, unit_text, origin, line): the names of a file with their units, scope by scope; those without a unit,
    too."""
    units = checked.units.where((F.col("path") == path) & F.col("owner").isNull()).select("scope", "name", "unit_text", "origin")
    names = checked.facts.where((F.col("fact") == "name") & (F.col("path") == path) & F.col("owner").isNull()).select("scope", "name", F.col("name_line").alias("line")).distinct()
    return names.alias("n").join(units.alias("u"), F.expr("n.scope <=> u.scope and n.name = u.name"), "left").select("n.scope", "n.name", "unit_text", "origin", "line").orderBy("scope", "line", "name")


def inlays(checked: Checked, path: str, first: int, last: int) -> DataFrame:
    """(line, col, label): the units to show behind names that lines use or set."""
    own = checked.points.where((F.col("path") == path) & F.col("line").between(first, last) & (F.col("kind") != "declares") & F.col("unit").isNotNull())
    return own.select("line", (F.col("col") + F.length("name")).alias("col"), F.concat(F.lit("["), "unit", F.lit("]")).alias("label")).distinct().orderBy("line", "col")


def code_actions(checked: Checked, path: str, line: int) -> DataFrame:
    """(code, title, insert): what would settle a line's findings: the spelling that was meant, or an annotation by what other
    places say of a name."""
    own = checked.diagnostics.where((F.col("path") == path) & (F.col("sl") == line))
    meant = own.where("suggestion is not null").select("code", F.concat(F.lit("write "), "suggestion").alias("title"), F.col("suggestion").alias("insert"))
    bare = own.where("code = 'U005'").select("code", "path", F.col("sl").alias("line"))
    names = checked.facts.where("fact = 'name'").select("path", F.col("name_line").alias("line"), "name")
    said = checked.points.where("unit is not null and kind in ('contributes', 'requires')").groupBy("path", "name").agg(F.min(F.struct("line", "unit")).alias("first"))
    guessed = bare.join(names, ["path", "line"]).join(said, ["path", "name"]).select(
        "code", F.concat(F.lit("give "), "name", F.lit(" the unit "), "first.unit").alias("title"), F.concat(F.lit("!< @unit{"), "first.unit", F.lit("}")).alias("insert")
    )
    return meant.unionByName(guessed)


def hover(checked: Checked, path: str, line: int, col: int) -> DataFrame:
    """What is said at a place: the occurrences whose name covers it."""
    p = checked.points.where((F.col("path") == path) & (F.col("line") == line) & (F.col("col") <= col) & (F.col("col") + F.length("name") > col))
    return p.orderBy(F.length("name"))
