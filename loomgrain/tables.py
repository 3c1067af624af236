"""Reading tables and counting redelivered keys once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_by_key(df: DataFrame, key: str, arrived: str, columns: list[str]) -> DataFrame:
    """One row per non-null ``key``: the one with the latest ``arrived`` (a null counts as oldest).

    Only ``columns`` travel through the shuffle. Rows that tie in ``arrived`` are
    redeliveries of equal content, so any of them is the same result.
    """
    order = F.coalesce(F.col(arrived), F.timestamp_seconds(F.lit(0)))
    picked = F.max_by(F.struct(*[F.col(c) for c in columns]), order).alias("_row")
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(picked)
    return kept.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def bit_field(ids: DataFrame, slot: str, bits: int = 22) -> Column:
    """A scalar: the slots (from 0 to 2^bits - 1) that ``ids`` holds, as an array of 64-bit words of fixed length."""
    words = ids.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")).alias("word"))
    every = ids.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("at")).join(words, "at", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0).cast("long")).alias("word")))), lambda x: x.word).alias("words")).scalar()


def latest_texts(df: DataFrame, key: str, arrived: str, columns: list[str], bits: int = 22) -> DataFrame:
    """As :func:`latest_by_key`, for columns too large to move: only rows whose key may be repeated go through a shuffle.

    Keys alone are counted; the repeated ones set bits of a field of fixed size, and a row whose bit is not set
    passes as it is. A full field costs time, not correctness. Small scans are dealt out over the cores (:func:`spread`).
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    known = df.where(F.col(key).isNotNull())
    repeated = known.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_slot", slot)
    rows = spread(known.select(key, arrived, *[c for c in columns if c not in (key, arrived)]), key).withColumn("_slot", slot)
    word = F.element_at(bit_field(repeated.select("_slot"), "_slot", bits), (F.shiftright("_slot", 6) + 1).cast("int"))
    hit = F.expr("1L << cast(_slot & 63 as int)").bitwiseAND(word) != 0
    rows = rows.withColumn("_hit", hit)
    return rows.where("not _hit").select(key, *columns).unionByName(latest_by_key(rows.where("_hit"), key, arrived, columns))


def clean_set(column: str | Column) -> Column:
    """A null array as an empty one, without null members, each member once."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<bigint>"))))


def wide_hash(*columns: Column | str) -> Column:
    """A 128-bit hash as 16 bytes."""
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns)), 16, "0") for seed in (0, 1)]
    return F.unhex(F.concat(*halves))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of a plain scan, dealt out by ``key`` where the scan has fewer partitions than there are cores.

    For stages that compute long on little input, such as a few small files with many texts. Large inputs have
    partitions enough and are not moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows
