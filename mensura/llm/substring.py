"""Repeated passages: windows of 35 consecutive words that also start elsewhere, by a log-structured fingerprint index.

A window's fingerprint is the least hash of its eight-word runs, so equal windows have equal fingerprints and neighbouring
windows mostly share one: a text has about one fingerprint for fourteen words. The index holds immutable runs of
(fingerprint, document, occurrences), bucketed and sorted by fingerprint, and the documents they came from. A batch is
written as a new run and merge-joined with the historical ones without moving them; windows of old and new documents whose
fingerprint then occurs more than once are verified by 128 bits of hash of all their words, and those that are equal are
marked. Runs are compacted by merging them bucket by bucket.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import FEW, Scratch, arrow_limits, table

WINDOW, ANCHOR = 35, 8
#: A fingerprint with more occurrences has its windows dealt by their own hashes.
HOT = 2048
MIN_BUCKETS, IN_BUCKET = 64, 100_000  # of windows of hot fingerprints
BATCHES = 3
FANOUT = 2  # runs that are merged before the next batch comes


# ---- windows of a text


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` consecutive values."""
    done, out = 1, x
    while 2 * done <= width:
        out, done = op(out[:-done], out[done:]), 2 * done
    return op(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def window_fingerprints(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """For one text's word digests: each window's fingerprint, and the hashes of the runs that are one somewhere, once for
    each place they stand at."""
    if hashes.shape[1] < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = wordhash.runs(hashes[0], anchor)
    width = window - anchor + 1
    least = _slide(grams, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return least, grams[_slide(padded, width, np.maximum) == grams]


def whole_windows(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """128 bits for each window of a text: a row of two lanes."""
    return np.stack([wordhash.runs(x, window, i) for i, x in enumerate(hashes)], 1)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows: the first place of each distinct one, the number of each row's, and how often each occurs."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]).any(1)
    rank = np.cumsum(new) - 1
    back = np.empty(len(h), np.int64)
    back[order] = rank
    return order[new], back, np.bincount(rank)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """Word digests of each text."""
    texts = [(t or "").encode() for t in batch.column(column).to_pylist()]
    for part in wordhash.groups(texts):
        hashes, counts = wordhash.words(texts[part])
        for n, e in zip(counts, np.cumsum(counts), strict=True):
            yield hashes[:, e - n : e]


# ---- the index


class FingerprintIndex:
    """Runs of fingerprints, the documents they came from, and the windows marked as repeated so far, under a folder that all
    machines share. No table is ever changed: compaction writes merged ones and drops those that went into them.

    ``root``: the folder; an index that was saved there is opened again. Without one the index lives in ``scratch``.
    """

    RUN, TEXTS, MARKS = "run", "texts", "marks"
    KEYS = {RUN: ("fp",), TEXTS: ("kid", "kt")}
    COLUMNS = {RUN: "fp BIGINT, kid BIGINT, kt BIGINT, n BIGINT", TEXTS: "kid BIGINT, kt BIGINT, text STRING"}

    def __init__(self, spark: SparkSession, root: str | None = None, scratch: Scratch | None = None, buckets: int | None = None):
        self.spark, self.scratch = spark, scratch or Scratch(spark, "substring")
        self.root, self.saved = root or self.scratch.root, root is not None
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, list[str]] = {self.RUN: [], self.TEXTS: [], self.MARKS: []}
        arrow_limits(spark)
        if self.saved and self._exists("state"):
            versions = spark.read.parquet(f"{root}/state")
            for kind, name, buckets in versions.where(F.col("version") == versions.agg(F.max("version")).first()[0]).orderBy("kind", "at").select("kind", "name", "buckets").collect():
                self.tables[kind].append(name)
                self.buckets = buckets
                if kind in self.KEYS:
                    keys = ", ".join(self.KEYS[kind])
                    order = f" SORTED BY ({keys})" if kind == self.RUN else ""
                    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({self.COLUMNS[kind]}) USING parquet CLUSTERED BY ({keys}){order} INTO {buckets} BUCKETS LOCATION '{root}/{name}'")

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}_{uuid.uuid4().hex}"
        out = df.write.bucketBy(self.buckets, *self.KEYS.get(kind, ("fp",))).option("path", f"{self.root}/{name}")
        (out if kind == self.TEXTS else out.sortBy("fp")).saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch._delete(f"{self.root}/{name}")

    def _save(self) -> None:
        if self.saved:
            rows = [(kind, i, name) for kind, names in self.tables.items() for i, name in enumerate(names)]
            old = self.spark.read.parquet(f"{self.root}/state").agg(F.max("version")).first()[0] if self._exists("state") else 0
            state = self.spark.createDataFrame(rows, "kind string, at int, name string").withColumns({"version": F.lit(old + 1).cast("long"), "buckets": F.lit(self.buckets)})
            state.coalesce(1).write.mode("append").parquet(f"{self.root}/state")

    def compact(self) -> None:
        """All runs merged into one, and their documents; a bucket of the result is made of the same buckets alone."""
        for kind in (self.RUN, self.TEXTS):
            if len(old := self.tables[kind]) > 1:
                merged = self.spark.table(old[0])
                for name in old[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self.tables[kind] = [self._write(merged, kind)]
                self._save()
                self._drop(*old)

    def append(self, docs: DataFrame) -> None:
        """A batch of documents (kid, kt, text): merge-join, verify, mark, and only then compact, if there are enough runs.

        A batch re-reads historical documents only where they share a fingerprint with it.
        """
        if len(self.tables[self.RUN]) >= FANOUT:
            self.compact()
        spark, scratch = self.spark, self.scratch
        texts = self._write(docs.select("kid", "kt", "text").where("text is not null").repartition(self.buckets, "kid", "kt"), self.TEXTS)
        run = self._write(_fingerprints(spark.table(texts)).repartition(self.buckets, "fp"), self.RUN)
        self.tables[self.TEXTS].append(texts)
        self.tables[self.RUN].append(run)
        # fingerprints of the batch that occur more than once in all runs
        counted = lambda name: spark.table(name).groupBy("fp").agg(F.sum("n").alias("n"))
        total = counted(run)
        for old in self.tables[self.RUN][:-1]:
            total = total.join(counted(old).withColumnRenamed("n", "m").hint("merge"), "fp", "left").select("fp", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        shared = self._write(total.where("n > 1"), "shared")
        many = spark.table(shared).where(F.col("n") > HOT).agg(F.sum("n")).first()[0] or 0
        known = None
        for name in self.tables[self.RUN]:
            hit = spark.table(name).select("fp", "kid", "kt").join(spark.table(shared).hint("merge"), "fp").select("kid", "kt", "fp", (F.col("n") > HOT).alias("hot"))
            known = hit if known is None else known.unionByName(hit)
        known = scratch.keep(known.groupBy("kid", "kt").agg(F.collect_list(F.struct("fp", "hot")).alias("fps")), FEW)
        rows = None
        for name in self.tables[self.TEXTS]:
            own = spark.table(name).join(known.hint("merge"), ["kid", "kt"]).select("kid", "kt", "text", F.col("fps.fp").alias("fps"), F.col("fps.hot").alias("hot"))
            rows = own if rows is None else rows.unionByName(own)
        parts = scratch.keep(_candidate_windows(rows, max(MIN_BUCKETS, many * WINDOW // IN_BUCKET)))
        kind = lambda k: parts.where(F.col("kind") == k)
        starts = _by_key(kind(STRETCH).select("key", "kid", "kt", "start", "hashes"), _in_stretches)
        starts = starts.unionByName(_by_key(kind(BUCKET).select("key", "hashes", "owners"), _in_buckets)).unionByName(kind(SETTLED).select("kid", "kt", "starts"))
        marks = f"{self.MARKS}_{uuid.uuid4().hex}"
        starts.groupBy("kid", "kt").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")).write.parquet(f"{self.root}/{marks}")
        self.tables[self.MARKS].append(marks)
        self._save()
        scratch.drop(known, parts)
        self._drop(shared)

    def marks(self) -> DataFrame:
        """(kid, kt, starts): where repeated windows start in the documents so far."""
        names = self.tables[self.MARKS]
        if not names:
            return self.spark.createDataFrame([], "kid long, kt long, starts array<int>")
        return self.spark.read.schema("kid long, kt long, starts array<int>").parquet(*[f"{self.root}/{n}" for n in names])

    def close(self) -> None:
        """Forget the tables; those of an index without a folder of its own are removed."""
        for kind in self.KEYS:
            for name in self.tables[kind]:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                if not self.saved:
                    self.scratch._delete(f"{self.root}/{name}")


# ---- the operator


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with a key that equal rows share: their windows are the same ones."""
    return df.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("kid"), F.xxhash64(text).alias("kt")
    )


def _fingerprints(docs: DataFrame) -> DataFrame:
    """(fp, kid, kt, n) of each row that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fps, ns = [], [], []
            for i, h in enumerate(_texts(batch, 2)):
                own, n = np.unique(window_fingerprints(h)[1], return_counts=True)
                if len(own):
                    rows.append(np.full(len(own), i))
                    fps.append(own.view(np.int64))
                    ns.append(n)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(ns), pa.int64())], names=["fp", "kid", "kt", "n"])

    return docs.select("kid", "kt", "text").mapInArrow(run, "fp long, kid long, kt long, n long")


STRETCH, BUCKET, SETTLED = 0, 1, 2
_PARTS = "kind int, key long, kid long, kt long, start int, hashes binary, owners binary, starts array<int>"


def _candidate_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """Windows with a repeated fingerprint, in three kinds of rows.

    STRETCH: neighbouring windows of one fingerprint (key) with all their hashes. Windows of hot fingerprints go by their
    own hash instead: those that occur twice in one batch are SETTLED there, and each batch sends every BUCKET (key) of
    hashes what it has of it once: the hashes, first those that it has one place of, with these places (owners).
    """

    def bucketed(hot: list[tuple[np.ndarray, int, int, np.ndarray]]) -> Iterator[dict]:
        h = np.concatenate([x[0] for x in hot])
        size = [len(x[0]) for x in hot]
        kid, kt = (np.repeat(np.array([x[i] for x in hot], np.int64), size) for i in (1, 2))
        start = np.concatenate([x[3] for x in hot])
        first, back, n = distinct(h)
        own, twice = h[first], n[back] > 1
        at = 0
        for (_, a, b, places), m in zip(hot, size, strict=True):
            if (done := places[twice[at : at + m]]).size:
                yield {"kind": SETTLED, "kid": a, "kt": b, "starts": done.tolist()}
            at += m
        part = own[:, 0] % np.uint64(buckets)
        order = np.lexsort((n > 1, part))
        part = part[order]
        for group in np.split(order, np.flatnonzero(part[1:] != part[:-1]) + 1):
            lone = first[group[n[group] == 1]]
            yield {"kind": BUCKET, "key": int(own[group[0], 0] % np.uint64(buckets)), "hashes": own[group].tobytes(), "owners": np.stack([kid[lone], kt[lone], start[lone]]).astype(np.int64).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("kid", pa.int64()), ("kt", pa.int64()), ("start", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()), ("starts", pa.list_(pa.int32()))])
        for batch in batches:
            out: list[dict] = []
            held: list[tuple] = []
            known, warm = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, h in enumerate(_texts(batch, 2)):
                least = window_fingerprints(h)[0]
                if not len(least):
                    continue
                windows = whole_windows(h)
                fps = np.array(known[i], np.int64).view(np.uint64)
                order = np.argsort(fps)
                at = np.searchsorted(fps, least, sorter=order).clip(0, len(fps) - 1)
                hit = fps[order[at]] == least
                hot = np.array(warm[i])[order[at]] & hit
                kid, kt = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if hot.any():
                    starts = np.flatnonzero(hot)
                    held.append((windows[starts], kid, kt, starts))
                starts = np.flatnonzero(hit & ~hot)
                if not len(starts):
                    continue
                whole, own = windows[starts], least[starts]
                cut = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1, [len(starts)]])
                for a, b in zip(cut, cut[1:], strict=False):
                    out.append({"kind": STRETCH, "key": int(own[a : a + 1].view(np.int64)[0]), "kid": kid, "kt": kt, "start": int(starts[a]), "hashes": whole[a:b].tobytes()})
            if held:
                out += bucketed(held)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in schema], schema=schema)

    return rows.select("kid", "kt", "text", "fps", "hot").mapInArrow(run, _PARTS)


def _by_key(parts: DataFrame, settle) -> DataFrame:
    """(kid, kt, starts) that ``settle`` finds in the rows of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found = []
            for k, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if k != key:
                    found += settle(held) if held else ()
                    key, held = k, []
                held.append(tuple(row))
            if found:
                yield _starts(found)
        if held and (found := list(settle(held))):
            yield _starts(found)

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "kid long, kt long, starts array<int>")


def _in_stretches(rows: list[tuple]) -> Iterator[tuple]:
    """Windows that occur more than once within a fingerprint; there are HOT occurrences at most."""
    if len(rows) == 1 and len(rows[0][3]) == 16:
        return
    _, back, n = distinct(np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(-1, 2))
    twice, at = n[back] > 1, 0
    for kid, kt, start, raw in rows:
        own = np.flatnonzero(twice[at : at + len(raw) // 16])
        at += len(raw) // 16
        if len(own):
            yield kid, kt, (own + start).tolist()


def _in_buckets(rows: list[tuple]) -> Iterator[tuple]:
    """Windows that a batch has one place of, and others have too."""
    hashes = [np.frombuffer(r[0], np.uint64).reshape(-1, 2) for r in rows]
    _, back, n = distinct(np.concatenate(hashes))
    twice, at = n[back] > 1, 0
    for h, (_, owners) in zip(hashes, rows, strict=True):
        kid, kt, start = np.frombuffer(owners, np.int64).reshape(3, -1)
        own = np.flatnonzero(twice[at : at + len(kid)])
        at += len(h)
        own = own[np.lexsort((kt[own], kid[own]))]
        cut = np.flatnonzero((kid[own][1:] != kid[own][:-1]) | (kt[own][1:] != kt[own][:-1])) + 1
        for part in np.split(own, cut):
            if len(part):
                yield int(kid[part[0]]), int(kt[part[0]]), start[part].tolist()


def _starts(rows: list[tuple]) -> pa.RecordBatch:
    kid, kt, starts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kid, pa.int64()), pa.array(kt, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], names=["kid", "kt", "starts"])


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that no repeated window covers, joined by single
    spaces).

    Words are parted by ASCII white space and otherwise unchanged. Texts that are null or have under 35 words lose nothing.
    Windows are judged on the input; repeated rows repeat each other's windows. Other columns are not read. Rows enter the
    index in ``batches``, as they would from day to day; windows of documents that ``index`` knew before count as well, and
    ``clean`` with the same index tells what these have lost since. A worker holds one text and one group of at most some
    thousand stretches.
    """
    own = index or FingerprintIndex(df.sparkSession)
    docs = _keyed(df, doc_id, text)
    for b in range(batches):
        own.append(docs.where(F.pmod(F.xxhash64("kid", "kt"), F.lit(batches)) == b))
    out = clean(df, own, doc_id, text)
    if index is None:
        own.close()
    return out


def clean(df: DataFrame, index: FingerprintIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that are in the index less the words of windows that it has marked, as ``remove_repeats`` gives them."""
    marks = index.marks().groupBy("kid", "kt").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    docs = _keyed(df, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, gone, kept = [], [], []
            for t, at in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (t or "").encode().split()
                n = len(words)
                if at.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    first = np.unique(at.values.to_numpy())
                    edge[first] += 1
                    np.add.at(edge, first + WINDOW, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                ns.append(n)
                gone.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = docs.join(marks.hint("merge"), ["kid", "kt"], "left").select("doc_id", "text", "starts")
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return joined.mapInArrow(run, T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), *added]))


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), repeated AS (
  SELECT s FROM windows GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(35)) AS j FROM windows WHERE s IN (SELECT s FROM repeated))
), each AS (
  SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), summed AS (
  SELECT e.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS kept
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON s.doc_id = d.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
