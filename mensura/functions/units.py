"""Unit algebra as vectorised functions on columns of unit texts."""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..units import UnitFault, combine, describe, parse, power, spell
from ..units.text import repair, strip_tags

_LISTS = ("wraps", "dims", "variables")
PARSED = T.StructType(
    [
        T.StructField(n, T.ArrayType(T.StringType()) if n in _LISTS else T.BooleanType() if n == "ambiguous" else T.StringType())
        for n in ("unit", "shown", "wraps", "dims", "factor", "offset", "variables", "ambiguous", "error", "suggestion")
    ]
)
OUTCOME = T.StructType([T.StructField(n, T.StringType()) for n in ("unit", "fault", "rule")])


def _parsed(text: str | None) -> dict:
    if text is None:
        return {}
    try:
        q, ambiguous = parse(text)
    except UnitFault as e:
        return {"error": str(e), "suggestion": repair(text)}
    return {
        "unit": spell(q), "shown": describe(q, factor=True), "wraps": list(q.wraps), "dims": [str(d) for d in q.dims], "factor": str(q.factor),
        "offset": str(q.offset), "variables": [n for n, _ in q.vars], "ambiguous": ambiguous,
    }


def _structs(rows: list[dict], schema: T.StructType) -> pa.Array:
    kind = lambda t: pa.list_(pa.string()) if isinstance(t, T.ArrayType) else pa.bool_() if isinstance(t, T.BooleanType) else pa.string()
    return pa.array([{f.name: r.get(f.name) for f in schema} for r in rows], pa.struct([(f.name, kind(f.dataType)) for f in schema]))


@F.arrow_udf(PARSED)
def parse_unit(texts: pa.Array) -> pa.Array:
    """A unit text's parts, or why it is none. Each distinct text of a batch is read once."""
    own = texts.to_pylist()
    known = {t: _parsed(t) for t in set(own)}
    return _structs([known[t] for t in own], PARSED)


@F.arrow_udf(T.StringType())
def without_tags(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else strip_tags(t) for t in texts.to_pylist()], pa.string())


def _combined(op: str, a: str | None, b: str | None, x: float | None, y: float | None) -> tuple:
    if a is None or b is None or op is None:
        return None, None, None
    literal = lambda v: None if v is None or v != v else Fraction(v).limit_denominator(10**6)
    try:
        p, q = parse(a).unit, parse(b).unit
    except UnitFault:
        return None, None, None
    got = power(p, q, literal(y)) if op == "**" else combine(op, p, q, literal(x), literal(y))
    return None if got.unit is None else spell(got.unit), got.fault, got.rule


@F.arrow_udf(OUTCOME)
def combine_units(op: pa.Array, a: pa.Array, b: pa.Array, a_value: pa.Array, b_value: pa.Array) -> pa.Array:
    """The unit of ``a op b`` (+ - * / **), the fault found and the rule that decided; values are those of literals."""
    memo: dict[tuple, dict] = {}
    rows = []
    for key in zip(*(x.to_pylist() for x in (op, a, b, a_value, b_value)), strict=True):
        if key not in memo:
            memo[key] = dict(zip(OUTCOME.names, _combined(*key), strict=True))
        rows.append(memo[key])
    return _structs(rows, OUTCOME)


def with_parsed(df: DataFrame, text: str, name: str = "parsed") -> DataFrame:
    """Adds the parts of a column of unit texts; each distinct text is read once and joined back."""
    known = df.select(F.col(text).alias("_text")).where("_text is not null").distinct().withColumn(name, parse_unit("_text"))
    return df.join(known, F.col(text) == F.col("_text"), "left").drop("_text")
