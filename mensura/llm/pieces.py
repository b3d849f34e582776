"""SentencePiece encoding and decoding by a table of distinct marked words.

The library replaces spaces by the marker U+2581 and puts one marker in front. If no piece of the model holds a marker
after another character, no merge can cross from a word into the marker that follows it, so a text may be cut in front
of every run of markers and the parts encoded on their own. Each distinct part ("marked word") is segmented once per
worker; a text's ids are the table's rows joined back by position.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, table, with_columns_after

MARK = "▁"
TABLE_ROWS = 250_000
_tables: dict[str, PieceTable] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTable:
    """Distinct marked words with their ids (little-endian int32 bytes) and decoded texts, emptied when it is full."""

    def __init__(self, model: str, limit: int = TABLE_ROWS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(crossing.search(self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())):
            raise ValueError("pieces of this model cross whitespace markers; marked words can't be encoded apart")
        if self.sp.encode("a  b") == self.sp.encode("a b") or self.sp.encode("a", out_type=str)[0][0] != MARK:
            raise ValueError("this model rewrites white space; marked words can't be encoded apart")
        self.limit = limit
        self.cut = re.compile(f"{MARK}+[^{MARK}]*")
        self.alone = self.sp.piece_to_id(MARK)
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}

    def words(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: list[str]) -> None:
        new = list(set(words).difference(self.ids))
        if not new:
            return
        if len(self.ids) + len(new) > self.limit:
            self.ids.clear()
            self.texts.clear()
            new = list(set(words))
        # the library adds one marker by itself, except to an empty text
        coded = self.sp.encode([w[1:] for w in new], num_threads=1)
        coded = [c if len(w) > 1 else [self.alone] for w, c in zip(new, coded, strict=True)]
        for w, c, t in zip(new, coded, self.sp.decode(coded, num_threads=1), strict=True):
            self.ids[w] = array("i", c).tobytes()
            self.texts[w] = " " + t  # decode drops the first marker

    def encode(self, text: str) -> tuple[bytes, str]:
        words = self.words(text)
        self.learn(words)
        return b"".join(map(self.ids.__getitem__, words)), "".join(map(self.texts.__getitem__, words))[1:]


def piece_table(model: str) -> PieceTable:
    if model not in _tables:
        _tables[model] = PieceTable(model)
    return _tables[model]


def list_array(raw: list[bytes]) -> pa.ListArray:
    """An Arrow list<int32> column from little-endian bytes."""
    ends = np.cumsum([0, *map(len, raw)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode(df: DataFrame, text: str = "text", model: str | None = None, ids: str = "piece_ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``ids`` (array<int>, what the library's encode gives) and ``decoded`` (what its decode gives for them).

    A null text counts as empty and gets an empty array. Repeated rows stay. Columns that bear the new names are
    replaced; all others pass through. Nothing is shuffled; a worker holds one Arrow batch and a table of at most
    ``TABLE_ROWS`` words or one text's words.
    """
    model = model or default_model()
    arrow_limits(df.sparkSession)
    df = with_columns_after(df, ids, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_table(model)
        for batch in batches:
            out = [own.encode(t or "") for t in batch.column(names.index(text)).to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns, list_array([x[0] for x in out]), pa.array([x[1] for x in out], pa.string())], names=names)

    return df.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs)
    return out.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
