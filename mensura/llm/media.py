"""Media columns: byte payloads stored as progressive JPEG files and read back as coefficients and RGB tensors.

``store`` writes each payload losslessly into the DCT coefficients of a progressive file (see jpeg.py), ``load`` accumulates
the file's scans into coefficient arrays, gives the payload back, inverse-transforms, upsamples the chroma and gives the
full-resolution RGB tensor with its shape and a feature of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg
from .common import arrow_limits, table, text_or_empty, with_columns_after

UNIT = 576
FILL = b"\xff"
GROUP = 2 << 20  # payload bytes handled at once; a longer payload is handled alone

LOADED = [
    T.StructField("payload", T.BinaryType()),
    T.StructField("rgb", T.BinaryType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("feature", T.StringType()),
]


def padded(raw: bytes) -> bytes:
    """Filled up with bytes 255 to a positive multiple of 576."""
    return raw + FILL * (-len(raw) % UNIT if raw else UNIT)


def groups(sizes: list[int], most: int = GROUP) -> Iterator[slice]:
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(a, i)
            a, total = i, 0
        total += n
    if total:
        yield slice(a, len(sizes))


def feature(tensor: np.ndarray) -> str:
    """Size, mean colour in thousandths and an eight-bin histogram of the green channel in permille; integers only."""
    h, w, _ = tensor.shape
    means = tensor.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (h * w)
    bins = np.bincount(tensor[..., 1].reshape(-1) >> 5, minlength=8) * 1000 // (h * w)
    return f"{w}x{h};{','.join(map(str, means.tolist()))};{','.join(map(str, bins.tolist()))}"


def store(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """Adds ``media``, a progressive JPEG file whose coefficients are the bytes of the binary column ``payload``, filled
    up to whole units; takes that column away. A null payload counts as empty. Rows are independent; nothing is shuffled."""
    arrow_limits(df.sparkSession)
    df = with_columns_after(df, *([media] if media != payload else []))
    rest = [f for f in df.schema.fields if f.name != payload]
    schema = T.StructType([*rest, T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [padded(x or b"") for x in batch.column(batch.schema.get_field_index(payload)).to_pylist()]
            for part in groups([len(x) for x in raw]):
                kept = [batch.column(batch.schema.get_field_index(f.name))[part] for f in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(jpeg.encode(raw[part]), pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def load(df: DataFrame, media: str = "media", wanted: tuple[str, ...] = ("payload", "rgb", "height", "width", "feature")) -> DataFrame:
    """Adds what is wanted of ``payload``, ``rgb`` (height x width x 3 bytes), ``height``, ``width`` and ``feature``.

    Rows without a file get nulls. Columns that bear these names are replaced.
    """
    arrow_limits(df.sparkSession)
    df = with_columns_after(df, *wanted)
    added = [f for f in LOADED if f.name in wanted]
    schema = T.StructType([*df.schema.fields, *added])

    def read(files: list[bytes | None]) -> Iterator[dict]:
        d = jpeg.decode([f for f in files if f is not None])
        i = 0
        for f in files:
            if f is None:
                yield {}
                continue
            out = {"payload": jpeg.payload(d, i)} if "payload" in wanted else {}
            if set(wanted) - {"payload"}:
                x = jpeg.rgb(d, i)
                out |= {"rgb": x.tobytes() if "rgb" in wanted else None, "height": x.shape[0], "width": x.shape[1], "feature": feature(x)}
            yield out
            i += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(batch.schema.get_field_index(media)).to_pylist()
            for part in groups([len(f or b" ") for f in files]):
                rows = list(read(files[part]))
                cols = [pa.array([r.get(f.name) for r in rows], {"payload": pa.binary(), "rgb": pa.binary(), "feature": pa.string()}.get(f.name, pa.int32())) for f in added]
                yield pa.RecordBatch.from_arrays([*batch.slice(part.start, part.stop - part.start).columns, *cols], names=schema.names)

    return df.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    raw = text_or_empty().cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(raw).cast("long").alias("n_bytes"), raw.alias("raw"))
    out = load(store(docs, "raw"), wanted=("payload", "feature"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
