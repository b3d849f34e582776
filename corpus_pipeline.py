"""A corpus-cleaning pipeline over ``documents``, built of the training-data operators.

Each stage gets its predecessor's written rows; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mensura.llm import langid, lines, neardup, packing, pii
from mensura.llm.common import Scratch, table

_left: list[Scratch] = []  # what earlier stages of this pipeline have left in the shared folder


def _alone(stage):
    """A stage that first removes what earlier stages left in the shared folder; their results have been written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            _left.pop().close()
        before = list(Scratch.open)
        try:
            return stage(spark, table(spark, sf_dir, "documents") if docs is None else docs, sf_dir)
        finally:
            _left.extend(s for s in Scratch.open if s not in before)

    return run_stage


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every document that is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language identification", _alone(langid.keep_identified)),
    ("line dedup", _alone(lines.drop_repeated_lines)),
    ("near duplicates", _alone(neardup.keep_one_of_each)),
    ("personal data", _alone(pii.redact_documents)),
    ("packing", _alone(pack)),
]

#: SQL can't express a learned stage; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if kept is not None:
            old = kept
        if i < len(STAGES) - 1:
            kept = Scratch(spark, "pipeline")
            docs = kept.keep(docs)
            if i:
                old.close()
    return docs
