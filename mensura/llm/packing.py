"""Harmonic packing of tokenised documents into fixed-length training sequences.

A length belongs to class m if m pieces of it fill a sequence but m + 1 don't: capacity/(m+1) < length <= capacity/m.
A bin of class m takes exactly m pieces, so a worker fills bins with a counter per class and needs to know of no other
worker. What a class would waste is avoided by cutting: documents are cut into whole sequences and a rest, and a rest
that would leave more than ``slack`` of its bin empty is cut to the next smaller size capacity // m', its remainder being
classed anew. The unfilled bins at the end of a worker's input hold less than one sequence per class; they are emptied
and their pieces put together first-fit by falling length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_limits, table

CAPACITY = 2048
SLACK = 0.01
END_ID = 1
TABLE_ROWS = 250_000
_tables: dict[str, TokenTable] = {}

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType(), n == "doc_id") for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers use for each byte: itself if printable in Latin-1, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: The normaliser and the splitting of the tokenizer whose words are known to be apart.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def words_apart(model: str) -> bool:
    """Whether a tokenizer file is known to drop white space, to let no token cross it, and to cut words as ``TokenTable``
    does."""
    with open(model, encoding="utf-8") as f:
        d = json.load(f)
    added = all(t["content"].startswith("<|") and len(t["content"].split()) == 1 and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in d.get("added_tokens", ()))
    bpe = d["model"].get("type") == "BPE" and not d["model"].get("dropout")
    return added and bpe and d.get("normalizer") == NORMALISER and d.get("pre_tokenizer") == SPLITTING


class TokenTable:
    """Ids of distinct space-free words of a tokenizer that drops white space and lets no token cross it; of any other
    tokenizer (see ``words_apart``) whole texts are encoded.

    A word of ASCII and accented Latin-1 letters is unchanged by the tokenizer's normaliser but for its case, so it is cut
    here by the tokenizer's own pattern and only the distinct parts are given to its BPE model; any other word goes through
    the whole tokenizer.
    """

    plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, model: str, limit: int = TABLE_ROWS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.apart = words_apart(model)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.limit = limit
        self.ids: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= self.limit:
                self.parts.clear()
            found = array("I", [t.id for t in self.model.tokenize(part.translate(self.letters))]).tobytes()
            self.parts[part] = found
        return found

    def learn(self, new: list[bytes]) -> None:
        other = []
        for w in new:
            word = w.decode()
            if self.plain.fullmatch(word) and "<|" not in word:
                self.ids[w] = b"".join(map(self._part, self.cut.findall(word.lower())))
            else:
                other.append(word)
        for word, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False) if other else [], strict=True):
            self.ids[word.encode()] = array("I", e.ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of a whole text."""
        if not self.apart:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.encode().split()
        new = list(set(words).difference(self.ids))
        if new:
            if len(self.ids) + len(new) > self.limit:
                self.ids.clear()
                new = list(set(words))
            self.learn(new)
        return b"".join(map(self.ids.__getitem__, words))


def token_table(model: str) -> TokenTable:
    if model not in _tables:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tables[model] = TokenTable(model)
    return _tables[model]


def cut(total: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """Lengths and classes of the pieces of a document of ``total`` ids."""
    out = [(capacity, 1)] * (total // capacity)
    rest = total % capacity
    while rest:
        m = capacity // rest
        if capacity - m * rest > slack * capacity:
            m = -(-capacity // rest)
            while capacity // m > rest:
                m += 1
        size = min(rest, capacity // m)
        out.append((size, m))
        rest -= size
    return out


class Bins:
    """One worker's open bins."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.next, self.capacity = worker << 32, capacity
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def add(self, m: int, piece: tuple) -> list[tuple]:
        """The rows of the bin that this piece fills, if it fills one."""
        if m == 1:
            return self._close([piece])
        held = self.open.setdefault(m, [])
        held.append(piece)
        return self._close(self.open.pop(m)) if len(held) == m else []

    def finish(self) -> list[tuple]:
        rest = sorted((p for held in self.open.values() for p in held), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1]))
        self.open.clear()
        bins: list[list] = []
        first: dict[int, int] = {}  # for each length, no bin before this one has room for it
        for p in rest:
            i = first.get(p[2], 0)
            while i < len(bins) and bins[i][0] + p[2] > self.capacity:
                i += 1
            if i == len(bins):
                bins.append([0, []])
            first[p[2]] = i
            bins[i][0] += p[2]
            bins[i][1].append(p)
        return [row for _, pieces in bins for row in self._close(pieces)]


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids followed by the end id 1 (a null or empty text is that id alone). Repeated rows are
    separate documents. Other columns are not read. Sequences are numbered ``worker << 32 | n``; offsets in a sequence
    have no gaps. No shuffle: a worker holds one Arrow batch and the open bins, less than one sequence for each of the
    some 90 classes.
    """
    model = model or default_model()
    arrow_limits(df.sparkSession)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=SCHEMA.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bins = token_table(model), Bins(TaskContext.get().partitionId(), capacity)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(own.encode(t or "") + end)
                n, at = len(ids) // 4, 0
                for size, m in cut(n, capacity, slack):
                    rows += bins.add(m, (doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
                    at += size
            if rows:
                yield table_of(rows)
        if rows := bins.finish():
            yield table_of(rows)

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
