"""Problem 4: how often and in how many records every distinct value occurs.

Method: a vertical layout. Each value has a compressed bitmap of the records that hold it, cut into containers of 2^16
record numbers; a container keeps only those 64-bit words that have a bit set, with a counter of occurrences beside them.
Partial bitmaps merge by union (bitwise or), and the record count is the cardinality. Bitmaps are a table: they may be
stored, and those of new records merged into them later. Everything is a built-in aggregate, so values held by many records
combine before they move, and a container has 1024 words at most however common its value is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call_form(c: Column) -> Column:
    """Lower case, without surrounding whitespace."""
    return F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))


def _containers(words: DataFrame) -> DataFrame:
    """``(value, container, words, occurrences)`` from ``(value, word, bits, occurrences)``, each word once."""
    return words.groupBy("value", F.shiftright("word", 10).alias("container")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum("occurrences").alias("occurrences"))


def bitmaps(df: DataFrame, key: str, lists: list[str], form=call_form) -> DataFrame:
    """Compressed bitmaps: ``value``, ``container`` (record number / 2^16), its ``words`` (number / 64 and bits) and ``occurrences``.

    Null keys, null lists, null members and members that are blank in their compared form hold nothing.
    """
    every = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])
    long = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.explode(every).alias("_v"))
    long = long.select("_id", form(F.col("_v")).alias("value")).where("value is not null and value != ''")
    bit = F.bit_or(F.expr("shiftleft(1L, cast(_id & 63 as int))")).alias("bits")
    return _containers(long.groupBy("value", F.shiftright("_id", 6).alias("word")).agg(bit, F.count("*").alias("occurrences")))


def merged(*parts: DataFrame) -> DataFrame:
    """The union of bitmap tables; occurrences add up."""
    every = reduce(DataFrame.unionByName, parts)
    words = every.select("value", F.posexplode("words").alias("at", "w"), "occurrences")
    rows = words.select("value", "w.word", "w.bits", F.when(F.col("at") == 0, F.col("occurrences")).otherwise(0).alias("n"))
    return _containers(rows.groupBy("value", "word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("occurrences")))


def cardinality(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w.bits))


def frequencies(maps: DataFrame) -> DataFrame:
    """``(value, occurrences, records)`` of bitmaps."""
    return maps.groupBy("value").agg(F.sum("occurrences").alias("occurrences"), F.sum(cardinality(F.col("words"))).alias("records"))


def value_frequencies(df: DataFrame, key: str, lists: list[str], rare_at_most: int = 2, common_share: float = 0.10, form=call_form) -> DataFrame:
    """Every value with ``occurrences``, ``records`` and a ``mark``: rare, common or null.

    A value that at most ``rare_at_most`` records hold is rare, else one that at least ``common_share`` of all
    distinct records hold is common. Every distinct key counts as a record, those without values too. ``df`` must
    hold each key once for ``occurrences``; ``records`` is right with repeated rows, for a bit is set once.
    """
    total = df.agg(F.countDistinct(key)).scalar()
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") >= common_share * total, "common")
    return frequencies(bitmaps(df, key, lists, form)).withColumn("mark", mark)
