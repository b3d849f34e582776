"""Approximate nearest neighbours: inverted lists scanned by an adaptive number of rotated dimensions.

Vectors are rotated at random, so that of a squared distance any b of the D coordinates carry a share that is distributed
like Beta(b/2, (D-b)/2). Lists are stored as rotated column blocks. A list is scanned block by block: a candidate goes as
soon as its partial distance is larger than the share of the k-th best distance so far could be, but for a chosen chance.
Each query first searches its nearest lists; the distance of the k-th best found there is carried into the scan of all
others. Candidates that last get their distance on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, table

K = 10
SAMPLE = 20_000  # vectors to fit lists on, in expectation
IN_LIST = 16  # of the sample, at least
TARGET = 0.97  # share of the sample's own neighbours that the probed lists must hold
TRIED = 400  # vectors of the sample whose neighbours are looked up for that
FIRST = 2  # lists searched for a first bound
COLUMNS = 16
MARGIN = 2.33  # standard deviations of the test: a hundredth of the neighbours may fail one
DENSE = 0.2  # share of the candidates under which they are taken one by one
BLOCK, QUERIES = 2048, 128  # vectors and queries that are stored together
PART, ASKED = 16_384, 8192  # vectors and queries of a list that meet in one group
STEPS = 10
HELD = 50_000  # queries whose best a task holds before it sends them on


@dataclass
class Lists:
    centres: np.ndarray  # rotated
    rotation: np.ndarray
    probed: int = 1

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ self.rotation

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        return np.argsort(d, 1, kind="stable")[:, :n]


def fit(sample: np.ndarray, total: int, seed: int = 7, target: float = TARGET, k: int = K) -> Lists:
    """Lists for ``total`` vectors by k-means on a sample: as many as the root of the total, if the sample can feed them.

    How many of them a query probes is measured: the lists, nearest first, that hold ``target`` of the neighbours which
    vectors of the sample have in it; for a target of 1 all lists. Vectors in clusters need few lists, others many.
    """
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((sample.shape[1], sample.shape[1])))
    x = sample.astype(np.float64) @ rotation
    n = int(max(1, min(np.sqrt(total), len(x) // IN_LIST)))
    centres = x[np.sort(rng.choice(len(x), n, replace=False))]
    square = (x**2).sum(1)
    for _ in range(STEPS):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        size = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    lists = Lists(centres, rotation)
    own = lists.nearest(x, 1)[:, 0]
    ranks = []
    for i in np.sort(rng.choice(len(x), min(TRIED, len(x)), replace=False)):
        d = square - 2 * x @ x[i]
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        place = np.empty(n, np.int64)
        place[lists.nearest(x[i : i + 1], n)[0]] = np.arange(n)
        ranks += place[own[near]].tolist()
    lists.probed = int(np.quantile(ranks, target, method="higher")) + 1 if ranks and target < 1 else n
    return lists


def cuts(dims: int, columns: int = COLUMNS) -> list[tuple[int, int]]:
    return [(a, min(a + columns, dims)) for a in range(0, dims, columns)]


def column_blocks(x: np.ndarray) -> bytes:
    """Rotated vectors, one block of columns after the other."""
    return b"".join(np.ascontiguousarray(x[:, a:b]).tobytes() for a, b in cuts(x.shape[1]))


def from_blocks(raw: bytes, n: int, dims: int) -> list[np.ndarray]:
    return [np.frombuffer(raw, np.float64, n * (b - a), 8 * n * a).reshape(n, b - a) for a, b in cuts(dims)]


def scan(blocks: list[np.ndarray], queries: np.ndarray, bounds: np.ndarray, k: int, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a query and a vector that may be among the query's k nearest, and their squared distances: (query's place,
    vector's place, distance). ``bounds``: squared distances of the k-th best so far, infinite where there is none."""
    dims, n = queries.shape[1], len(blocks[0])
    edges = cuts(dims)

    def dense(i: int) -> np.ndarray:
        q, x = queries[:, slice(*edges[i])], blocks[i]
        return (q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T

    part = dense(0)
    bounds = bounds.copy()
    for i in np.flatnonzero(np.isinf(bounds)):  # the nearest so far give the first bound
        if n > k:
            near = np.argpartition(part[i], min(4 * k, n - 1))[: 4 * k]
            whole = sum(((b[near] - queries[i, slice(*e)]) ** 2).sum(1) for b, e in zip(blocks, edges, strict=True))
            bounds[i] = np.partition(whole, k - 1)[k - 1]
    limits = []
    slack = 1e-13 * ((queries**2).sum(1) + sum(float((b**2).max(initial=0)) * b.shape[1] for b in blocks))  # of rounding
    for _, b in edges:
        share = b / dims
        part_of = 1.0 if b == dims else min(1.0, share + margin * np.sqrt(share * (1 - share) / (dims / 2 + 1)))
        limits.append(bounds * part_of * (1 + 1e-9) + slack)
    pairs = None
    for i in range(len(edges)):
        if pairs is None:
            if i:
                part = part + dense(i)
            stay = part <= limits[i][:, None]
            if i + 1 == len(edges) or stay.sum() < DENSE * stay.size:
                at, of = np.nonzero(stay)
                pairs = at, of, part[at, of]
        else:
            at, of, d = pairs
            d = d + ((queries[at, slice(*edges[i])] - blocks[i][of]) ** 2).sum(1)
            stay = d <= limits[i][at]
            pairs = at[stay], of[stay], d[stay]
    return pairs


def _floats(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(-1, dims)


_BLOCK = "list int, kind int, block long, n int, turned binary, vectors binary, ids binary, counts binary, bounds binary"
_FOUND = "query_id long, vec_id long, score double"


class _Best:
    """The best of each query so far, of one task."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def bounds(self, ids: np.ndarray, given: np.ndarray) -> np.ndarray:
        own = [d[-1] ** 2 if (d := self.of.get(i, ((),))[0]) is not None and len(d) == self.k else np.inf for i in ids.tolist()]
        return np.minimum(given, own)

    def add(self, query: int, d: np.ndarray, ids: np.ndarray) -> None:
        if (old := self.of.get(query)) is not None:
            d, ids = np.concatenate([old[0], d]), np.concatenate([old[1], ids])
        best = np.lexsort((ids, d))[: self.k]
        self.of[query] = d[best], ids[best]

    def flush(self) -> pa.RecordBatch:
        size = [len(d) for d, _ in self.of.values()]
        cols = np.repeat(np.array([*self.of], np.int64), size), np.concatenate([i for _, i in self.of.values()]), np.concatenate([d for d, _ in self.of.values()])
        self.of.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def _compared(base: list[tuple], asked: list[tuple], dims: int, k: int, margin: float, best: _Best) -> None:
    """Blocks of vectors against blocks of queries of one list."""
    n = [r[0] for r in base]
    blocks = [np.concatenate(x) for x in zip(*(from_blocks(r[1], r[0], dims) for r in base), strict=True)]
    x = np.concatenate([np.frombuffer(r[2]).reshape(-1, dims) for r in base])
    ids = np.concatenate([np.frombuffer(r[3], np.int64) for r in base])
    counts = np.concatenate([np.frombuffer(r[4], np.int64) for r in base])
    ends = np.cumsum(counts)
    turned = np.concatenate([np.concatenate(from_blocks(r[1], r[0], dims), 1) for r in asked])
    q = np.concatenate([np.frombuffer(r[2]).reshape(-1, dims) for r in asked])
    q_ids = np.concatenate([np.frombuffer(r[3], np.int64) for r in asked])
    given = np.concatenate([np.frombuffer(r[5]) for r in asked])
    for a in range(0, len(q), QUERIES):
        for b in range(0, sum(n), BLOCK):
            # one more than k: the query itself may be among the vectors
            own = slice(a, a + QUERIES)
            at, of, _ = scan([c[b : b + BLOCK] for c in blocks], turned[own], best.bounds(q_ids[own], given[own]), k + 1, margin)
            cut = np.searchsorted(at, np.arange(len(q_ids[own]) + 1))
            for i in np.flatnonzero(np.diff(cut)):
                near = of[cut[i] : cut[i + 1]] + b
                d = np.sqrt(((x[near] - q[a + i]) ** 2).sum(1))
                members = np.concatenate([np.arange(ends[j] - counts[j], ends[j]) for j in near])
                d, own_ids = np.repeat(d, counts[near]), ids[members]
                other = own_ids != q_ids[a + i]
                best.add(int(q_ids[a + i]), d[other], own_ids[other])


def _met(base: DataFrame, quest: DataFrame, dims: int, k: int, margin: float) -> DataFrame:
    """Each list's vectors against the queries that probe it. A list is dealt into parts of bounded size on both sides; a
    group is one part against one."""
    parts = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.sum("n") / size).cast("int").alias(name))
    sizes = parts(base, PART, "bs").join(parts(quest, ASKED, "qs"), "list")
    part = lambda n: F.pmod(F.xxhash64("block"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    b = base.join(sizes, "list").withColumns({"b": part(F.col("bs")), "q": every(F.col("qs"))})
    q = quest.join(sizes, "list").withColumn("q", part(F.col("qs"))).withColumn("b", every(F.col("bs")))
    columns = ["list", "b", "q", "kind", "n", "turned", "vectors", "ids", "counts", "bounds"]
    rows = b.select(*columns).unionByName(q.select(*columns))
    rows = rows.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), "list", "b", "q").sortWithinPartitions("list", "b", "q", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, held = _Best(k), None, ([], [])
        for batch in batches:
            for *new, kind, n, turned, vectors, ids, counts, bounds in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                if new != key or sum(r[0] for r in held[1]) >= 4 * QUERIES:
                    if held[0] and held[1]:
                        _compared(*held, dims, k, margin, best)
                    held = (held[0] if new == key else [], [])
                    key = new
                held[kind].append((n, turned, vectors, ids, counts, bounds))
                if len(best.of) >= HELD:
                    yield best.flush()
        if held[0] and held[1]:
            _compared(*held, dims, k, margin, best)
        if best.of:
            yield best.flush()

    return rows.mapInArrow(run, _FOUND)


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, target: float = TARGET, margin: float = MARGIN, scratch: Scratch | None = None) -> DataFrame:
    """For each query row its k nearest among all other vectors: query_id, rank (from 1), vec_id, score (Euclidean).

    Vectors that are null or zero, hold null or non-finite components, have a null id or another length than most take no
    part, as query or candidate. Ties go to the smaller id; repeated rows of an id and vector are one. Equal vectors are
    searched as one, with their k + 1 smallest ids, which are all that can be among k nearest. Extra columns, long texts
    among them, are not read. Lists are fitted on a bounded sample; every vector is indexed. Hot lists are met in parts of
    bounded size. target: share of the neighbours in the lists probed, measured on the sample; margin: of the test that gives
    up candidates; at 1 and infinity the search is exact.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "nearest")
    arrow_limits(spark)
    empty = "query_id long, rank int, vec_id long, score double"

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(embedding)
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))

    all_of = sound(vectors)
    sizes = all_of.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    dims, total = int(sizes["d"]), int(sizes["n"])
    all_of, asked = all_of.where(F.size("v") == dims), sound(queries).where(F.size("v") == dims).distinct()
    # the k + 1 smallest ids of each vector: least ones of salted parts first, so that no task gets all copies of one
    salted = all_of.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    least = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    some = salted.withColumn("nth", least(["v", "salt"])).where(F.col("nth") <= k + 1)
    distinct = some.withColumn("nth", least(["v"])).where(F.col("nth") <= k + 1)
    kept = scratch.keep(distinct.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    chosen = kept.where(F.shiftrightunsigned(F.xxhash64("v"), 11) < int((1 << 53) * min(1.0, SAMPLE / total)))
    sample = np.array(sorted(r[0] for r in chosen.select("v").limit(2 * SAMPLE).toLocalIterator())).reshape(-1, dims)
    if not len(sample):
        sample = np.array([kept.select("v").first()[0]])
    fitted = fit(sample, total, target=target, k=k)
    lists = spark.sparkContext.broadcast(fitted)

    def to_blocks(batches: Iterator[pa.RecordBatch], kind: int, size: int, probes: slice) -> Iterator[pa.RecordBatch]:
        """Rows of one list packed: rotated column blocks, originals, ids, id counts, bounds."""
        held: dict[int, list] = {}

        def packed(at: int) -> pa.RecordBatch:
            rows = held.pop(at)
            ids = np.concatenate([r[2] for r in rows])
            cols = [
                [at], [kind], [int(ids[0])], [len(rows)], [column_blocks(np.array([r[0] for r in rows]))], [np.array([r[1] for r in rows]).tobytes()], [ids.tobytes()],
                [np.array([len(r[2]) for r in rows], np.int64).tobytes()], [np.array([r[3] for r in rows], np.float64).tobytes()],
            ]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _floats(batch.column(1), dims)
            turned = lists.value.rotated(x)
            ids = [np.atleast_1d(np.array(i, np.int64)) for i in batch.column(0).to_pylist()]
            bounds = batch.column(2).to_pylist()
            for i, near in enumerate(lists.value.nearest(turned, len(lists.value.centres))[:, probes]):
                for at in near.tolist():
                    held.setdefault(at, []).append((turned[i], x[i], ids[i], bounds[i]))
                    if len(held[at]) == size:
                        yield packed(at)
        for at in list(held):
            yield packed(at)

    none = F.lit(float("inf")).alias("bound")
    base = scratch.keep(kept.select("ids", "v", none).mapInArrow(lambda b: to_blocks(b, 0, BLOCK, slice(1)), _BLOCK))
    quest = scratch.keep(asked.select("id", "v", none).mapInArrow(lambda b: to_blocks(b, 1, QUERIES, slice(min(FIRST, fitted.probed))), _BLOCK))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)

    found = scratch.keep(ranked(_met(base, quest, dims, k, margin)))
    if fitted.probed > FIRST:
        # the k-th best of the nearest lists, squared, goes with the query
        bound = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), (F.col("score") * F.col("score")).alias("bound"))
        further = asked.join(bound.hint("merge"), "id", "left").select("id", "v", F.coalesce("bound", F.lit(float("inf"))))
        quest = scratch.keep(further.mapInArrow(lambda b: to_blocks(b, 1, QUERIES, slice(FIRST, fitted.probed)), _BLOCK))
        found = ranked(_met(base, quest, dims, k, margin).unionByName(found.select("query_id", "vec_id", "score")))
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
