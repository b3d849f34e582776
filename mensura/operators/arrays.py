"""Running values and overlaps in array columns, without work that grows as the square of an array's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, though a lambda may name it for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, join=lambda a, x: a + x, kind: str = "int", block: int = BLOCK) -> Column:
    """Running totals of an array, or what else ``join`` makes of them: within blocks, then over the blocks' last ones, so
    that long arrays aren't copied for every element."""
    none = F.array().cast(f"array<{kind}>")
    add = lambda out, x: F.array_append(out, F.when(F.size(out) > 0, join(F.get(out, F.size(out) - 1), x)).otherwise(x))
    grown = lambda a: F.aggregate(a, none, add)

    def of(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
        local = F.transform(starts, lambda i: grown(F.slice(a, i * block + 1, F.lit(block))))
        lifted = lambda p, i, last: F.when(i == 0, p).otherwise(F.transform(p, lambda x: join(F.get(last, i - 1), x)))
        ends = lambda parts: grown(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return bound(local, lambda parts: bound(ends(parts), lambda last: F.flatten(F.transform(parts, lambda p, i: lifted(p, i, last)))))

    return bound(values, lambda a: F.when(F.size(a) > 0, of(a)).otherwise(none))


def apart(spans: Column, others: Column) -> Column:
    """The spans (structs with start and end, end exclusive) that overlap none of the others: one sort of both, and the
    largest end of another span that starts before a span's end."""
    events = F.concat(
        F.transform(others, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("other"), x["end"].alias("end"), F.lit(-1).alias("i"))),
        F.transform(spans, lambda x, i: F.struct(x["end"].alias("at"), F.lit(0).alias("other"), F.lit(-1).alias("end"), i.alias("i"))),
    )
    reach = lambda e: running(F.transform(e, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    own = lambda e, r: F.filter(F.zip_with(e, r, lambda x, y: F.struct(x["i"].alias("i"), y.alias("far"))), lambda x: x["i"] >= 0)
    in_order = bound(F.array_sort(events), lambda e: bound(reach(e), lambda r: F.array_sort(own(e, r))))
    far = bound(spans, lambda s: bound(in_order, lambda o: F.filter(F.zip_with(s, o, lambda x, y: F.struct(x.alias("x"), y["far"].alias("far"))), lambda z: z["far"] <= z["x"]["start"])))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), F.transform(far, lambda z: z["x"])).otherwise(spans)
