"""Streams of edits to sources: (uri, version, ts, text)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET = "400 milliseconds"
_OUT = "uri string, version long, text string"


def debounced(edits: DataFrame, quiet: str = QUIET, late: str = "10 seconds") -> DataFrame:
    """The newest version of each burst of edits: one that no edit of its uri follows within ``quiet``. Edits that come
    more than ``late`` behind are dropped. Works on streams (append) and on tables."""
    marked = edits.withWatermark("ts", late) if edits.isStreaming else edits
    bursts = marked.groupBy("uri", F.session_window("ts", quiet).alias("burst"))
    newest = bursts.agg(F.max(F.struct("version", "text")).alias("last"), F.count("*").alias("n_edits"))
    return newest.select("uri", F.col("burst.end").alias("settled"), "last.version", "last.text", "n_edits")


def throttled(edits: DataFrame, every: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Of the edits of a uri in each stretch of time the first version and, if there is another, the last: what is shown at
    once, and what is shown when the stretch is over. Works on streams (append) and on tables."""
    marked = edits.withWatermark("ts", late) if edits.isStreaming else edits
    own = marked.groupBy("uri", F.window("ts", every).alias("stretch")).agg(F.min(F.struct("version", "text")).alias("first"), F.max(F.struct("version", "text")).alias("last"))
    both = F.array(F.struct(F.lit("leading").alias("edge"), F.col("first").alias("x")), F.struct(F.lit("trailing").alias("edge"), F.col("last").alias("x")))
    kept = F.filter(both, lambda e: (e["edge"] == "leading") | (F.col("first.version") < F.col("last.version")))
    return own.select("uri", F.col("stretch.end").alias("until"), F.explode(kept).alias("e")).select("uri", "until", "e.edge", "e.x.version", "e.x.text")


def superseding(edits: DataFrame) -> DataFrame:
    """The edits that are newer than all before them of their uri; a late lower version is dropped. The state is one
    version number for each uri."""

    def newer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("version", kind="stable")
        seen = state.get[0] if state.exists else -1
        rows = rows[rows["version"] > seen].drop_duplicates("version", keep="last")
        if len(rows):
            state.update((int(rows["version"].iloc[-1]),))
            yield pd.DataFrame({"uri": key[0], "version": rows["version"].tail(1), "text": rows["text"].tail(1)})

    return edits.groupBy("uri").applyInPandasWithState(newer, _OUT, "version long", "update", GroupStateTimeout.NoTimeout)
