"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

1. A document's set is its distinct five-word shingles. Documents of equal sets are one class; its least id stands for it.
2. Signatures of 200 hashes in 40 bands of 5 give buckets. A pair at the threshold 0.75 shares none with probability 2e-5.
3. In a small bucket every pair of classes is a candidate; in a larger one each member meets the bucket's pivot, the member
   that shares the most places in buckets (the text that others are copies of). What larger buckets then still hold in
   several components, such as texts around one common passage, is compared exactly without making the bucket's pairs: two
   sets can only reach the threshold if they share one of their rarest shingles (a quarter of each set, and one).
4. A pair's signatures are compared in batches of 40; it is dropped as soon as the posterior probability that its similarity
   reaches the threshold, given the matches so far, is under one in a million.
5. Survivors are confirmed on their full sets, on 128 bits a shingle; confirmed links join components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import FEW, Scratch, arrow_limits, table
from .components import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 40, 5
STEP = 40  # hashes compared at a time
MISS = 1e-6
PART = 256  # members confirmed against one copy of a pivot's text
SMALL = 8  # members of a bucket whose pairs are all compared

_K = BANDS * ROWS
_A = (wordhash.mix(np.arange(1, _K + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (wordhash.mix(np.arange(1001, _K + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_FEATURES = "id long, n_shingles long, digest binary, bands array<long>, sig binary"


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as two rows of hashes, sorted by the first; a text of fewer words is one shingle,
    one without words has none."""
    for part in wordhash.groups(texts):
        lanes, counts = wordhash.words([t.translate(wordhash.LOWER) for t in texts[part]])
        at = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < size))
        whole = np.stack([wordhash.whole(x, at[short], counts[short], i) for i, x in enumerate(lanes)])
        full = np.stack([wordhash.runs(x, size, i) for i, x in enumerate(lanes)])
        place = dict(zip(short.tolist(), range(len(short)), strict=True))
        for i, (a, n) in enumerate(zip(at.tolist(), counts.tolist(), strict=True)):
            if i in place:
                yield whole[:, [place[i]]]
            else:
                own = full[:, a : a + max(n - size + 1, 0)]
                yield own[:, np.unique(own[0], return_index=True)[1]]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set that isn't empty."""
    x = (shingles[0] >> np.uint64(32)).astype(np.uint32)
    out = np.full(_K, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(out, (x[a : a + 1024, None] * _A + _B).min(0), out=out)
    return out


def _bands(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    wide = sigs.astype(np.uint64).reshape(len(sigs), BANDS, ROWS)
    key = np.zeros((len(sigs), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = wordhash.mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, j])
    return key.view(np.int64)


def thresholds(k: int = _K, step: int = STEP, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, least matches): with fewer, the posterior chance of reaching the threshold is under ``miss``.

    Under a uniform prior the chance that a match probability is at least t, given m matches of n, is that of at most m
    successes in n + 1 trials of t. One byte of each hash is compared, so t allows for matches by chance.
    """
    j = NUMERATOR / DENOMINATOR
    t, out = j + (1 - j) / 256, []
    for n in range(step, k + 1, step):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the threshold; shingles are equal if both of their hashes are."""
    least, most = sorted((a.shape[1], b.shape[1]))
    if DENOMINATOR * least < NUMERATOR * most or not least:
        return False
    at = np.searchsorted(b[0], a[0]).clip(0, b.shape[1] - 1)
    both = int(((b[0][at] == a[0]) & (b[1][at] == a[1])).sum())
    return DENOMINATOR * both >= NUMERATOR * (least + most - both)


def _features(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            ns, digests, sigs = [], [], []
            for s in shingle_sets(texts):
                ns.append(s.shape[1])
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None)
                sigs.append(signature(s) if s.size else np.zeros(_K, np.uint32))
            if not ns:
                continue
            sigs = np.array(sigs)
            keys = pa.ListArray.from_arrays(
                pa.array(np.arange(len(ns) + 1, dtype=np.int32) * BANDS), pa.array(_bands(sigs).reshape(-1))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), keys, pa.array([x.tobytes() for x in sigs.astype(np.uint8)], pa.binary())],
                names=["id", "n_shingles", "digest", "bands", "sig"],
            )

    return df.mapInArrow(run, _FEATURES)


def _survivors(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs that the sequential test doesn't drop."""
    rules = thresholds()
    held = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")).hint("merge"), "a")
    held = held.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, _K) for i in (2, 3))
            on, done, hits = np.arange(len(sa)), 0, np.zeros(len(sa), np.int64)
            for n, least in rules:
                hits[on] += (sa[on, done:n] == sb[on, done:n]).sum(1)
                on, done = on[hits[on] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(on)), batch.column(1).take(pa.array(on))], names=["a", "b"])

    return held.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough. Members of one pivot are dealt to parts of at most some hundred, each of
    which gets the pivot's text once."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    parts = sizes.select("a", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    members = pairs.join(parts.hint("merge"), "a").select("a", "b", F.expr("int(pmod(xxhash64(b), parts))").alias("part"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = members.join(texts.withColumnRenamed("id", "b").hint("merge"), "b").select("a", "part", "b", "text")
    rows = rows.unionByName(heads.join(texts.withColumnRenamed("id", "a").hint("merge"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, key = [], None  # ids with several texts have several sets
        for batch in batches:
            a, part, b, texts = (batch.column(i).to_pylist() for i in range(4))
            found = ([], [])
            for x, p, y, s in zip(a, part, b, shingle_sets([(t or "").encode() for t in texts]), strict=True):
                if (x, p) != key:
                    head, key = [], (x, p)
                if y is None:
                    head.append(s)
                elif any(similar(h, s) for h in head):
                    found[0].append(x)
                    found[1].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _sharing_rare(members: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of members (id, root) of different components that share one of their rarest shingles and whose sizes and
    places allow the threshold: all pairs that can reach it, and few others."""
    own = texts.join(members.hint("merge"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s[0] for s in shingle_sets([(t or "").encode() for t in batch.column(2).to_pylist()])]
            if sets:
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "root", "all"])

    sets = own.select("id", "root", "text").mapInArrow(run, "id long, root long, all array<long>")
    rows = scratch.keep(sets.select("id", "root", F.size("all").alias("n"), F.explode("all").alias("token")))
    shared = rows.groupBy("token").agg(F.count("*").alias("seen")).where("seen > 1")
    rows = rows.join(shared.hint("merge"), "token").groupBy("id", "root", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("common"))
    # unshared shingles are the rarest and come first in each set's order
    lone, head = F.col("n") - F.size("common"), F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    rows = rows.withColumn("lone", lone).where(head > F.col("lone"))
    rows = rows.select("id", "root", "n", "lone", F.posexplode(F.slice("common", 1, (head - F.col("lone")).cast("int"))).alias("at", "t"))
    rows = scratch.keep(rows.select("id", "root", "n", (F.col("lone") + F.col("at")).alias("at"), F.col("t.token").alias("token")))
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y.hint("merge"), F.expr("x.token = y.token and x.id < y.id and x.root <> y.root"))
    need = F.ceil((F.col("x.n") + F.col("y.n")) * NUMERATOR / (NUMERATOR + DENOMINATOR))
    met = met.where(F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= need)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id reachable), kept (doc_id = component_id).

    Words are parted by ASCII white space, A-Z lower-cased. Texts that are null or without words have an empty set and are
    linked with nothing. Rows that bear one id are one document, linked if any of its texts is. A row with a null id is linked
    with nothing, has a null component and is kept. Other columns are not read. No group of rows is collected: the largest
    thing in a worker is one text's set.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "neardup")
    arrow_limits(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    seen = scratch.keep(_features(docs))
    real = seen.where("id is not null and digest is not null")
    classes = scratch.keep(real.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min_by(F.struct("bands", "sig"), "id").alias("x")))
    belongs = seen.select("id", "n_shingles", "digest").join(classes.where("n > 1").select("digest", "rep").hint("merge"), "digest", "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("rep"))
    # ids with texts of several classes link these
    twice = real.groupBy("id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e").select("id")
    same_id = belongs.where("n_shingles > 0").join(twice, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # places in buckets that several classes share
    places = classes.select(F.col("rep").alias("id"), F.explode("x.bands").alias("key"))
    sizes = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    places = scratch.keep(places.join(sizes.hint("merge"), "key").select("key", "id", "n"))
    weight = scratch.keep(places.groupBy("id").agg(F.sum("n").alias("weight")), FEW)
    ids = weight.select("id").hint("merge")
    sigs = scratch.keep(classes.select(F.col("rep").alias("id"), "x.sig").join(ids, "id", "left_semi"))
    texts = scratch.keep(docs.join(ids, "id", "left_semi"))
    # all pairs of small buckets, each member of larger ones with its pivot
    small = places.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    rest = lambda i: F.slice("ids", i + 2, F.size("ids") - i - 1)
    small = small.select(F.explode(F.transform(F.slice("ids", 1, F.size("ids") - 1), lambda x, i: F.struct(x.alias("a"), rest(i).alias("bs")))).alias("p"))
    small = small.select("p.a", F.explode("p.bs").alias("b"))
    large = scratch.keep(places.where(F.col("n") > SMALL).join(weight.hint("merge"), "id").select("key", "id", "weight"), FEW)
    pivots = large.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("a"))
    star = large.join(pivots.hint("merge"), "key").select("a", F.col("id").alias("b"))
    pairs = small.unionByName(star).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = scratch.keep(_confirmed(scratch.keep(_survivors(pairs, sigs), FEW), texts), FEW)
    roots = scratch.keep(components(links.unionByName(same_id), scratch), FEW)
    # members of larger buckets that hold several components
    large = large.select("key", "id").join(roots.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    members = scratch.keep(large.join(mixed.hint("merge"), "key", "left_semi").select("id", "root").distinct(), FEW)
    if members.limit(1).count():
        pairs = _survivors(_sharing_rare(members, texts, scratch), sigs)
        found = scratch.keep(_confirmed(scratch.keep(pairs, FEW), texts), FEW)
        if found.limit(1).count():
            own = roots.select("node", "root")
            for end in ("a", "b"):  # the components so far are the nodes of what is left to join
                found = found.join(own.withColumnRenamed("node", end).hint("merge"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
            more = scratch.keep(components(found, scratch), FEW)
            up = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = own.join(up.hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            roots = scratch.keep(roots.unionByName(more.select("node", "root").join(own.select("node").hint("merge"), "node", "left_anti")), FEW)
    out = belongs.join(roots.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left")
    component = F.coalesce("root", "rep")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Links of the few documents at hand, by all their common shingles; components as all that can be reached.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met.n >= 75 * (x.n + y.n - met.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.a = d.doc_id
"""


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document of the least id stays."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
