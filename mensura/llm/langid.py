"""Language identification: words first, character n-grams for words that were never seen.

A known word adds its log frequency in each language. For an unseen word each of its characters is looked up as the end of
a known character n-gram, the longest first (4, then 3, 2, 1), and the mean of the log frequencies found is the word's
score. The sums over a text's words give a posterior over the languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, table, with_columns_after

UNKNOWN = "und"
TRAIN_DOCS = 5_000  # labelled documents to fit on, at most in expectation; the model holds all their words and n-grams
LONGEST = 4
SMOOTH = 0.5
MEMO = 100_000  # words whose scores a worker remembers
_WORD = re.compile(r"[^\W\d_]+")  # numerals that aren't decimal digits are in it, too
_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall(text.lower())
    if not all(map(str.isalpha, found)):
        found = "".join(c if c.isalpha() else " " for w in found for c in (*w, " ")).split()
    return found


def grams(word: str, n: int) -> list[str]:
    w = f"\x02{word}\x03"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """Counts of the kept words and n-grams by language, and what they sum to."""

    langs: list[str]
    words: dict[str, list[int]]
    grams: dict[str, list[int]]
    memo: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.word_at, self.word_log = self._logs(self.words)
        self.gram_at, self.gram_log = {}, np.zeros((0, len(self.langs)))
        for n in range(1, LONGEST + 1):
            at, logs = self._logs({g: c for g, c in self.grams.items() if len(g) == n})
            self.gram_at |= {g: i + len(self.gram_log) for g, i in at.items()}
            self.gram_log = np.concatenate([self.gram_log, logs])

    def _logs(self, counts: dict[str, list[int]]) -> tuple[dict[str, int], np.ndarray]:
        """Smoothed log frequencies of each entry by language."""
        c = np.array([*counts.values()], float).reshape(len(counts), len(self.langs)) + SMOOTH
        return {g: i for i, g in enumerate(counts)}, np.log(c / c.sum(0)) if len(c) else c

    def __getstate__(self):
        return {"langs": self.langs, "words": self.words, "grams": self.grams}

    def __setstate__(self, state) -> None:
        self.__init__(**state)

    def score(self, new: list[str]) -> np.ndarray:
        """A row of log frequencies for each word."""
        out = np.zeros((len(new), len(self.langs)))
        found, starts, unseen, known = [], [], [], []
        get = self.gram_at.get
        for i, word in enumerate(new):
            if word in self.word_at:
                known.append((i, self.word_at[word]))
                continue
            w, before = f"\x02{word}\x03", len(found)
            for end in range(2, len(w) + 1):
                for n in range(min(LONGEST, end), 0, -1):
                    if (at := get(w[end - n : end])) is not None:
                        found.append(at)
                        break
            if len(found) > before:
                unseen.append(i)
                starts.append(before)
        if known:
            i, at = np.array(known).T
            out[i] = self.word_log[at]
        if unseen:
            sizes = np.diff([*starts, len(found)])
            out[unseen] = np.add.reduceat(self.gram_log[found], starts) / sizes[:, None]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        own = words(text or "")
        if not own or not self.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        for a in range(0, len(own), MEMO // 4):
            part = own[a : a + MEMO // 4]
            if self.rows is None or len(self.memo) > MEMO - len(part):
                self.memo.clear()
                self.rows = np.empty((MEMO, len(self.langs)))
            new = list(set(part).difference(self.memo))
            at = len(self.memo)
            self.rows[at : at + len(new)] = self.score(new)
            self.memo.update(zip(new, range(at, at + len(new)), strict=True))
            total += self.rows[np.fromiter(map(self.memo.__getitem__, part), np.int64, len(part))].sum(0)
        best = int(np.argmax(total))  # the first of equals
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def _counted(df: DataFrame, text: str, lang: str, split) -> DataFrame:
    """(lang, gram, n): counted in each batch first, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c: Counter = Counter()
            for la, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g, n in Counter(split(t)).items():
                    c[la, g] += n
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c]), pa.array([k[1] for k in c]), pa.array(c.values(), pa.int64())], names=_COUNTS.names)

    return df.select(lang, text).mapInArrow(run, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _pair_counts(counts: DataFrame, langs: list[str]) -> dict[str, list[int]]:
    """All counts of a bounded sample, by entry."""
    total = counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    return {r["gram"]: [r["by"].get(x, 0) for x in langs] for r in total.orderBy("gram").toLocalIterator()}


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """A model of rows with a text and a language. ``labelled`` must hold only rows to learn from.

    A sample of ``train_docs`` rows in expectation is used, chosen by a hash of the text; texts that are equal are chosen
    together. The model has every word and every n-gram of up to four characters of the sample, so the sample's size bounds it.
    Without rows the model knows no language.
    """
    arrow_limits(labelled.sparkSession)
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    n = labelled.count()
    if n > train_docs:
        labelled = labelled.where(F.shiftrightunsigned(F.xxhash64(text), 11) < int((1 << 53) * (train_docs / n)))
    counts = _counted(labelled, text, lang, words).persist()
    try:
        langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
        known = _pair_counts(counts, langs)
        spread = counts.select("lang", "gram", "n")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c: Counter = Counter()
                for la, w, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    for k in range(1, LONGEST + 1):
                        for g in grams(w, k):
                            c[la, g] += m
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c]), pa.array([k[1] for k in c]), pa.array(c.values(), pa.int64())], names=_COUNTS.names)

        parts = spread.mapInArrow(run, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        return Model(langs, known, _pair_counts(parts, langs))
    finally:
        counts.unpersist()


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its posterior (0 to 1). A text that is null or has no letter is ``und`` with
    score 0, as is any text under a model without languages; equal posteriors go to the language first in order. Columns
    that bear the new names are replaced, all others pass through. Nothing is shuffled; the model is broadcast and of
    bounded size. Very long texts are scored a part at a time."""
    arrow_limits(df.sparkSession)
    df = with_columns_after(df, lang, score)
    schema = T.StructType([*df.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out = [own.predict(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


LEAST_SCORE = 0.5


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents without an identifiable language (no letters, or no language more likely than the
    others together)."""
    model = fit(docs.where(~held_out()).select("text", "lang"))
    out = predict(docs, model, lang="_lang_pred", score="_lang_score")
    return out.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= LEAST_SCORE)).select(*docs.columns)
