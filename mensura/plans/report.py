"""Reports for people and tools. What can be long is fetched a partition at a time and handed on line by line."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .check import Checked, conflicts, coverage_figures, summary

KINDS = ("declares", "contributes", "requires", "uses")


def diagnostics_lines(checked: Checked, trace: bool = False) -> Iterator[str]:
    """Findings as lines of text; with ``trace`` the rule that decided stands behind each."""
    for r in checked.diagnostics.orderBy("path", "sl", "sc", "code", "message").toLocalIterator():
        line = f"{r['path']}:{r['sl']}:{r['sc'] + 1}: {r['severity']} {r['code']}: {r['message']}"
        yield line + (f" (did you mean {r['suggestion']}?)" if r["suggestion"] else "") + (f" [{r['rule']}]" if trace and r["rule"] else "")


def exit_code(checked: Checked) -> int:
    """1 if there is an error, else 0."""
    return int(not checked.diagnostics.where("severity = 'error'").limit(1).isEmpty())


def histogram(checked: Checked) -> DataFrame:
    """(code, severity, n)."""
    return checked.diagnostics.groupBy("code", "severity").agg(F.count("*").alias("n"))


def summary_lines(checked: Checked) -> Iterator[str]:
    for r in summary(checked).orderBy("path").toLocalIterator():
        yield f"{r['path']}: {r['n_h']} H, {r['n_u']} U"


def coverage_json(checked: Checked) -> Iterator[str]:
    """One JSON object in pieces: the total, then a line for each file."""
    figures = coverage_figures(checked)
    total = figures.where("path is null").first()
    yield '{"total": ' + json.dumps(total.asDict() if total else None) + ', "files": ['
    first = True
    for r in figures.where("path is not null").orderBy("path").toLocalIterator():
        yield ("" if first else ",") + json.dumps(r.asDict())
        first = False
    yield "]}"


def interactions(checked: Checked, name: str, path: str | None = None, scope: str | None = None, scale: bool = False) -> tuple[DataFrame, DataFrame]:
    """All that is said about a name, by kind and place, and the claims that disagree with the first of their scope."""
    own = checked.points.where(F.col("name") == name.lower())
    own = own.where(F.col("path") == path) if path else own
    own = own.where(F.col("scope") == scope) if scope else own
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return own.orderBy(rank, "path", "line", "col"), conflicts(own, scale)


def _scaled(unit: str | None, factor: str | None) -> str:
    return "?" if unit is None else unit if factor in (None, "1") else f"{factor} {unit}"


def interactions_lines(checked: Checked, name: str, path: str | None = None, scope: str | None = None, scale: bool = False) -> Iterator[str]:
    points, clashes = interactions(checked, name, path, scope, scale)
    last = None
    for r in points.toLocalIterator():
        if r["kind"] != last:
            yield f"{r['kind']}:"
            last = r["kind"]
        yield f"  {r['path']}:{r['line']}:{r['col'] + 1} {_scaled(r['unit'], r['factor'])}"
    for r in clashes.orderBy("path", "line", "col").toLocalIterator():
        yield f"X001 {r['path']}:{r['line']}: {_scaled(r['unit'], r['factor'])}, but first {_scaled(r['reference'], r['reference_factor'])}"


def write_diagnostics(checked: Checked, path: str, version: str) -> None:
    """Keeps the findings as Parquet, one folder for each version of the rules."""
    checked.diagnostics.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)
