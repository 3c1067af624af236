"""Incremental scans and event streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental_scan(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "path"):
    """Process files ``(path, content_sha, ...)`` as they arrive, each content once.

    A batch drops the contents that other batches have, and results and manifest of a batch lie in folders of their own
    that a repetition overwrites: a batch that was cut short anywhere and runs again changes nothing that is done. Returns the
    streaming query, which stops when all that is there has been read.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, epoch: int) -> None:
        fresh = df.dropDuplicates([key, "content_sha"])
        try:
            known = spark.read.parquet(f"{out}/manifest").where(F.col("epoch") != epoch).select(key, "content_sha")
            fresh = fresh.join(known, [key, "content_sha"], "left_anti")
        except Exception as e:  # the first batch has no manifest
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.persist()
        try:
            process(fresh).write.mode("overwrite").parquet(f"{out}/results/epoch={epoch}")
            fresh.select(key, "content_sha").write.mode("overwrite").parquet(f"{out}/manifest/epoch={epoch}")
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", group: str = "event_type", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums per tumbling window; events later than ``late`` behind the newest are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), group).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), group, "n", "total")


def correlate(sent: DataFrame, received: DataFrame, within: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """Probes ``(probe_id, sent_at)`` with the callbacks ``(payload_id, received_at)`` that answer them in time."""
    a, b = sent.withWatermark("sent_at", late), received.withWatermark("received_at", late)
    return a.join(b, F.expr(f"probe_id = payload_id and received_at >= sent_at and received_at <= sent_at + interval {within}"))


def running_counters(matches: DataFrame) -> DataFrame:
    """``(pattern_id, matches, verified)`` so far, kept in state, for every pattern of a batch of ``(pattern_id, verified)``."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, v = state.get if state.exists else (0, 0)
        for b in batches:
            n, v = n + len(b), v + int(b.verified.fillna(False).sum())
        state.update((n, v))
        yield pd.DataFrame({"pattern_id": [key[0]], "matches": [n], "verified": [v]})

    return matches.groupBy("pattern_id").applyInPandasWithState(update, "pattern_id string, matches long, verified long", "n long, v long", "update", "NoTimeout")


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_to_table(streamed: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a streaming aggregate over all that is there and read its final state.

    Each batch overwrites the table with the whole state, so a batch that is repeated after a failure changes nothing.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(out)

    query = streamed.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return streamed.sparkSession.read.schema(streamed.schema).parquet(out)
