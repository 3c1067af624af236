"""Streaming plans over the event table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.plans.registry import query
from loomgrain.session import shared_folder
from loomgrain.streaming import pipelines
from loomgrain.tables import read_table


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of an hour per event type, with state kept across batches."""
    schema = read_table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = shared_folder(spark, "windows")
    counts = pipelines.run_to_table(pipelines.windowed_counts(stream), f"{folder}/out", f"{folder}/state")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
