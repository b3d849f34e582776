"""Shared plumbing of the training-data operators: table access, shared scratch space, Arrow batch sizes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20
FEW = 4  # shuffle partitions to a file of a small table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (``spark.checkpoint.dir``). Where none is named, a folder of this machine will do if no
    other machine takes part, as in tests; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="mensura-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a batch of the longest texts still fits a Python worker. Smaller ones that the
    session asks for stay. Frames run after they are made, so these settings can't be put back here."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Intermediate tables in the shared folder.

    ``keep(df)`` writes a table and returns the reread frame, which cuts the lineage and survives lost executors.
    ``drop(df)`` removes one that nothing needs any more; ``close()`` removes the rest.
    """

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}
        Scratch.open.append(self)

    def keep(self, df: DataFrame, share: int = 1) -> DataFrame:
        """share: how many shuffle partitions go to one file; more than one for tables of a few bytes a document, which would
        else be lots of small files."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        if share > 1:
            df = df.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // share))
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._scratch = self
        return back

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                self._delete(path)

    def close(self) -> None:
        if self in Scratch.open:
            Scratch.open.remove(self)
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended
            pass


def release_scratch() -> None:
    """Remove the intermediate tables of everything that has run so far; results must have been written by then."""
    for s in [*Scratch.open]:
        s.close()


atexit.register(release_scratch)


def with_columns_after(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that an operator is about to add, so that clashing names are replaced, not doubled."""
    return df.drop(*[n for n in names if n in df.columns])


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
