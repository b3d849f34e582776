"""Source files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("f90", "f95", "f03", "f08", "F90", "F95", "F03", "F08")


def glob_expression(pattern: str) -> str:
    """A path pattern as a regular expression: ``*`` and ``?`` within a name, ``**`` over names, ``[abc]`` and ``[!abc]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + ("[^/" + body[1:] if body[0] == "!" else "[" + body) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "_/" else "\\" + c), i + 1
    return "(^|/)" + out.strip("/") + "(/|$)"


def outermost(roots: list[str]) -> list[str]:
    """The roots that lie in no other one, each once, so that no file is found twice."""
    own = list(dict.fromkeys(r.rstrip("/") or "/" for r in roots))
    return [r for r in own if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in own)]


def read_sources(spark: SparkSession, roots: list[str], exclude: list[str] = ()) -> DataFrame:
    """(path, text, sha256) of the source files under the roots, each once, less those whose path matches an excluding
    pattern (see ``glob_expression``). Texts are UTF-8, or Latin-1 where they aren't valid."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(outermost(list(roots)))
    raw = raw.where(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).isin(*SUFFIXES))
    for pattern in exclude:
        raw = raw.where(~F.col("path").rlike(glob_expression(pattern)))
    return raw.select("path", _text().alias("text"), F.sha2("content", 256).alias("sha256"))


def _text() -> Column:
    text = F.col("content").cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode("content", "ISO-8859-1"))


def read_headers(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(name, text) of all files under the include folders, by their path in the first folder that has them."""
    out = None
    for i, root in enumerate(dict.fromkeys(r.rstrip("/") for r in roots)):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        at = F.lit(root.split(":", 1)[-1].lstrip("/") + "/")
        name = F.substr("path", F.instr("path", root.split(":", 1)[-1].lstrip("/") + "/") + F.length(at))
        own = raw.select(name.alias("name"), _text().alias("text"), F.lit(i).alias("nth"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("name").agg(F.min_by("text", "nth").alias("text"))


def with_overrides(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """Sources in which an edited text (path, text) stands for the file's; ``edited`` tells which these are."""
    e = edits.select("path", F.col("text").alias("_new"))
    out = sources.join(e, "path", "full").withColumns({"text": F.coalesce("_new", "text"), "edited": F.col("_new").isNotNull()}).drop("_new")
    return out.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
