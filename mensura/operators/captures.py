"""Lines, comments and delimited captures in texts, as column expressions and DataFrame operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import apart, bound, running

#: What ends a line: the line feed and its relatives.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: The text before the first exclamation mark outside quotes; it doesn't match if a quote stays open. It gives nothing back, so
#: that long lines need no stack.
BEFORE_COMMENT = r"""^((?:[^!'"]++|'[^']*+'|"[^"]*+")*+)!"""


def quoted(s: str) -> str:
    """A literal as a regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", s)


def lines(df: DataFrame, text: str = "text", line: str = "line", content: str = "content") -> DataFrame:
    """One row per line, numbered from 1, without the empty one after a last line end. Null texts have no lines."""
    parts = F.split(text, LINE_END, -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(parts).alias("_at", content)).select(*rest, (F.col("_at") + 1).alias(line), content)


def comment_start(line: Column) -> Column:
    """The column (from 0) where a line's comment starts; null if it has none."""
    head = F.regexp_extract(line, BEFORE_COMMENT, 1)
    return F.when(F.contains(line, F.lit("!")) & line.rlike(BEFORE_COMMENT), F.length(head))


def marker(line: Column) -> Column:
    """PRE for a comment about what follows, POST for one about what precedes; null for any other."""
    at = comment_start(line)
    sign = F.substr(line, at + 2, F.lit(1))
    return F.when(sign.isin(">", "!"), "PRE").when(sign == "<", "POST")


def captures(text: Column, opening: str, closing: str) -> Column:
    """The bodies between delimiters, first come, without overlaps."""
    return F.regexp_extract_all(text, F.lit(f"(?s){quoted(opening)}(.*?){quoted(closing)}"), F.lit(1))


def capture_spans(text: Column, opening: str, closing: str) -> Column:
    """Array of start, end (code points, end exclusive) and body of the captures."""
    pattern = f"(?s){quoted(opening)}(.*?){quoted(closing)}"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))

    def places(z: Column, ends: Column) -> Column:
        body = lambda x: F.substr(x["hit"], F.lit(len(opening) + 1), F.length(x["hit"]) - len(opening) - len(closing))
        return F.transform(z, lambda x, i: F.struct((F.get(ends, i) - F.length(x["hit"])).alias("start"), F.get(ends, i).alias("end"), body(x).alias("body")))

    return bound(zipped, lambda z: bound(running(F.transform(z, lambda x: F.length(x["gap"]) + F.length(x["hit"]))), lambda ends: places(z, ends)))


def outside(spans: Column, dead: Column) -> Column:
    """The spans that overlap none of the dead ones."""
    return apart(spans, dead)


def by_priority(rows: DataFrame, key: list[str], rank: str, value: str) -> DataFrame:
    """The value of the least rank for each key, with how many others differ from it."""
    won = rows.groupBy(*key).agg(F.min_by(value, rank).alias("winner"), F.collect_set(value).alias("_all"))
    return won.select(*key, "winner", (F.size("_all") - 1).alias("n_conflicts"))


def islands(rows: DataFrame, key: list[str], line: str) -> DataFrame:
    """Adds the last line of the run of consecutive lines that each line belongs to."""
    w = Window.partitionBy(*key).orderBy(line)
    rows = rows.withColumn("_run", F.col(line) - F.row_number().over(w))
    return rows.withColumn("block_end", F.max(line).over(Window.partitionBy(*key, "_run"))).drop("_run")
