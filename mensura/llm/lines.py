"""Line dedup by overlapping windows of three consecutive lines.

Each window is hashed; of windows that occur more than once anywhere the first (by document, then place) stays and the
lines of all later ones go. Windows overlap, so a repeated passage of any length from three lines goes as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

SIZE = 3


def remove_repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows with ``text`` less its repeated lines, and with ``n_lines`` and ``n_removed`` added.

    Lines are parted by the line feed and compared as they are. A null text has no lines and stays null; one of fewer than
    three lines loses nothing; one that loses all becomes empty. Documents come in order of id (null first), then of a hash of
    the text; rows equal in both are one document and keep the same lines. Other columns pass through.

    What is shuffled by window is a hash and a place; counts are combined first, so no window's places meet in one task but
    in a join that can be split.
    """
    scratch = scratch or Scratch(df.sparkSession, "lines")
    names = [*[c for c in df.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed"]
    cut = F.split(F.col(text), "\n", -1)
    docs = df.withColumns({"_kid": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), "_kt": F.xxhash64(text)})
    at = F.when(F.size("lines") >= SIZE, F.sequence(F.lit(0), F.size("lines") - SIZE)).otherwise(F.array().cast("array<int>"))
    three = lambda i: [F.get("lines", i + j) for j in range(SIZE)]
    hashed = F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*three(i)).alias("h"), F.xxhash64(F.lit("second"), *three(i)).alias("g")))
    windows = docs.select("_kid", "_kt", cut.alias("lines")).where("lines is not null").select("_kid", "_kt", F.explode(hashed).alias("w"))
    windows = scratch.keep(windows.select("_kid", "_kt", "w.pos", "w.h", "w.g"))
    first = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("_kid", "_kt", "pos")).alias("first")).where("n > 1").select("h", "g", "first")
    later = windows.join(first, ["h", "g"]).where(F.struct("_kid", "_kt", "pos") != F.col("first"))
    gone = later.groupBy("_kid", "_kt").agg(F.array_distinct(F.flatten(F.collect_list(F.array(*[F.col("pos") + j for j in range(SIZE)])))).alias("_gone"))
    out = docs.join(gone, ["_kid", "_kt"], "left").withColumn("_lines", cut)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    out = out.withColumns(
        {
            text: F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept),
            "n_lines": F.coalesce(F.size("_lines"), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        }
    )
    return out.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).withColumn("n_removed", F.greatest("n_removed", F.lit(0))).select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("kept_md5"))


SQL = """
WITH numbered AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, pos, parts[pos + 1] AS a, parts[pos + 2] AS b, parts[pos + 3] AS c FROM numbered WHERE pos + 3 <= len(parts)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM windows
), gone AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM ranked, (VALUES (0), (1), (2)) AS o(j) WHERE nth > 1
), lines AS (
  SELECT n.doc_id, n.pos, n.line, g.doc_id IS NOT NULL AS removed FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.pos = n.pos
), summed AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed) AS kept
  FROM lines GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN summed s ON s.doc_id = d.doc_id
"""


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, ``n_chars`` is recounted, and documents of which nothing is left go too."""
    out = remove_repeated_lines(docs)
    changed = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.where(~changed | (F.length(F.trim("text")) > 0)).select(*docs.columns)
