"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Keeper:
    """Called with a frame it writes it to ``spark.checkpoint.dir`` and gives back the reread one: its lineage is cut, and it
    survives lost executors. ``drop`` removes tables that nothing needs any more, ``close`` the rest; what is still there
    when the program ends goes then."""

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            root = "file://" + tempfile.mkdtemp(prefix="mensura-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root = spark, f"{root.rstrip('/')}/kept-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self.close)

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._kept = self  # its number isn't used again while it is there
        return back

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                self._delete(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended
            pass


def keeper(spark: SparkSession) -> Keeper:
    return Keeper(spark)
