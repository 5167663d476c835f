"""Incremental upkeep with Structured Streaming: new encounters as they arrive, by micro-batches.

The original works on finished tables only; its nearest notion, extracting ids that are not yet extracted and
caching features, is what a micro-batch does here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cohortloom.operators.cohort import not_yet
from cohortloom.sources.readers import read_upserted
from cohortloom.sources.sinks import upsert_parquet


def keep_features(stream: DataFrame, features: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, redo: bool = False) -> StreamingQuery:
    """Keeps a feature table (one row per enc) up to date from a stream of events.

    The table is one of sinks.upsert_parquet, read by readers.read_upserted. Every micro-batch computes features of its encounters and upserts them; encounters that the table already
    has are skipped unless ``redo``. A repeated micro-batch gives the same table. Runs until the available input
    is used up.
    """

    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        try:
            old = None if redo else read_upserted(df.sparkSession, path)
            if old is not None:
                df = df.join(not_yet(df, old), "enc", "left_semi")
            if df.head(1):
                upsert_parquet(features(df), path, "enc")
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
