"""Rules over ordered events in a scope. Ties in the order columns are broken by the last of them, which must be unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.session import cut_lineage


def _ordered(scope: list[str], order: list[str]):
    return Window.partitionBy(*scope).orderBy(*order)


def ordered_events(events: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Events with their place in the scope, from 1."""
    return events.withColumn("place", F.row_number().over(_ordered(scope, order)).cast("long"))


def must_follow(events: DataFrame, scope: list[str], order: list[str], label: str, steps: list[str]) -> DataFrame:
    """Scopes that begin the sequence and do not finish it, with the number of steps matched.

    Steps match greedily: the first event of a step after the one before. Each step is one running minimum, so a
    scope streams through windows of the same partitioning and is never held as a list.
    """
    rows = events.withColumn("_p", F.row_number().over(_ordered(scope, order)))
    every = Window.partitionBy(*scope)
    reached = F.lit(0)
    for i, step in enumerate(steps):
        rows = rows.withColumn(f"_s{i}", F.min(F.when((F.col(label) == step) & (F.col("_p") > reached), F.col("_p"))).over(every))
        reached = F.col(f"_s{i}")
    matched = sum((F.when(F.col(f"_s{i}").isNotNull(), 1).otherwise(0) for i in range(len(steps))), F.lit(0))
    scopes = rows.groupBy(*scope).agg(F.max(matched).cast("long").alias("matched"))
    return scopes.where((F.col("matched") > 0) & (F.col("matched") < len(steps)))


def must_not_follow(events: DataFrame, scope: list[str], order: list[str], first: Column, second: Column, release: Column) -> DataFrame:
    """Events of ``second`` after one of ``first`` with no ``release`` since. An event that is both first and second opens only."""
    w = _ordered(scope, order)
    place = F.row_number().over(w)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_p", place).withColumn("_a", F.max(F.when(first, F.col("_p"))).over(before)).withColumn("_r", F.max(F.when(release, F.col("_p"))).over(before))
    # a release that opens as well closes what it opened
    open_ = F.col("_a").isNotNull() & (F.col("_r").isNull() | (F.col("_r") < F.col("_a")))
    return rows.where(second & ~first & open_).drop("_p", "_a", "_r")


def forbidden_between(events: DataFrame, scope: list[str], order: list[str], start: Column, end: Column, forbidden: Column) -> DataFrame:
    """Forbidden events after a start with no end since; starts and ends themselves are none."""
    w = _ordered(scope, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(start, F.lit(True)).when(end, F.lit(False)), ignorenulls=True).over(before)
    return events.withColumn("_open", state).where(F.col("_open") & forbidden & ~start & ~end).drop("_open")


def early_stop(events: DataFrame, scope: list[str], order: list[str], stop: Column) -> DataFrame:
    """Events of each scope up to and with the first that stops it."""
    w = _ordered(scope, order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_stopped", F.coalesce(F.max(F.when(stop, 1).otherwise(0)).over(w), F.lit(0))).where("_stopped = 0").drop("_stopped")


def exact_ranks(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by value) and ``n`` within each group, for groups of any size.

    Rows are range-partitioned and numbered in place; only the counts per partition and group are added up, so a
    group that holds a third of all rows is spread over as many tasks as it fills. Ties rank in any order.
    """
    spread = rows.repartitionByRange(*group, value).sortWithinPartitions(*group, value)
    placed = cut_lineage(spread.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_part")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_c").over(Window.partitionBy(*group)))
    return placed.join(counts, [*group, "_part"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_c", "_first", "_before")


def latency_profile(rows: DataFrame, group: list[str], value: str, ratio: float = 10.0) -> DataFrame:
    """Exact order statistics: p50 = value at index n / 2, p99 at index trunc(0.99 n), from 0; ``confirmed`` above the ratio.

    Null values and groups are ignored.
    """
    ranked = exact_ranks(rows.select(*group, value).dropna(), group, value)
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col(value)))
    stats = ranked.groupBy(*group).agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1)).alias("p99"))
    return stats.withColumn("confirmed", F.coalesce(F.try_divide("p99", "p50") > ratio, F.lit(False)))


def broken_pairs(events: DataFrame, rules: DataFrame, scope: list[str], order: list[str], label: str) -> DataFrame:
    """Two-step rules ``(rule_id, first, second)`` that a scope begins and does not finish, all rules in one pass.

    A rule is open in a scope if no ``second`` follows its first ``first``: that is one minimum and one maximum, so
    events combine before they move. Rules whose steps are equal need two events.
    """
    place = F.struct(*[F.col(c) for c in order])
    long = rules.select("rule_id", F.explode(F.array(F.struct(F.lit(1).alias("step"), F.col("first").alias("l")), F.struct(F.lit(2).alias("step"), F.col("second").alias("l")))).alias("s"))
    met = events.join(long.select("rule_id", "s.step", F.col("s.l").alias(label)), label)
    ends = met.groupBy("rule_id", *scope).agg(F.min(F.when(F.col("step") == 1, place)).alias("a"), F.max(F.when(F.col("step") == 2, place)).alias("b"))
    return ends.where(F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("b") <= F.col("a")))).select("rule_id", *scope)


# Names of calls that take and give back a resource.
ACQUIRE = ("lock", "acquire", "open", "begin", "connect", "borrow_mut", "subscribe", "write_lock", "read_lock")
RELEASE = ("unlock", "release", "close", "commit", "rollback", "disconnect", "drop", "unsubscribe", "dispose")


def resource_events(calls: DataFrame, name: str = "name") -> DataFrame:
    """Calls with an event type: acquire, release, await or call, by the last part of the name. Guards that release by scope are acquired only."""
    last = F.lower(F.regexp_extract(name, r"([^.:]*)!?$", 1))
    kind = F.when(last.isin(*ACQUIRE), "acquire").when(last.isin(*RELEASE), "release").when(F.col(name).startswith("await "), "await").otherwise("call")
    return calls.withColumn("event_type", kind)


# Pairs of calls of which the second must follow the first, for resources and sessions.
RESOURCE_PAIRS = [
    ("acquireLock", "releaseLock"), ("openConnection", "closeConnection"), ("openFile", "closeFile"), ("beginTransaction", "commitOrRollback"), ("spawnSandbox", "destroySandbox"),
    ("registerWebhook", "deregisterWebhookOnFailure"), ("deleteRecord", "createAuditEntry"), ("changePermission", "createAuditEntry"), ("exportUserData", "createAuditEntry"), ("resetPassword", "invalidateOtherSessions"),
]


def pair_rules(spark, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """A rule table ``(rule_id, first, second)`` for :func:`broken_pairs`."""
    rows = [(f"SEQ_{a}_{b}".upper(), a, b) for a, b in (RESOURCE_PAIRS if pairs is None else pairs)]
    return spark.createDataFrame(rows, "rule_id string, first string, second string")


def code_events(functions: DataFrame) -> DataFrame:
    """Events of functions of the front end in source order: ``(file_id, name, first_line, at, event_type, label)``.

    Calls are acquire, release or call by their last part; assignments, awaits and returns are events of their own. The function is the scope.
    """
    scope = ["file_id", "name", "first_line"]
    calls = functions.select(*scope, F.explode("calls").alias("c")).select(*scope, F.col("c.at").alias("at"), F.col("c.name").alias("label"))
    calls = resource_events(calls, "label")
    assigned = functions.select(*scope, F.explode("assignments").alias("a")).select(*scope, F.col("a.at").alias("at"), F.col("a.var").alias("label"), F.lit("assignment").alias("event_type"))
    marks = functions.select(*scope, F.explode("marks").alias("m")).select(*scope, F.col("m.at").alias("at"), F.col("m.kind").alias("label"), F.col("m.kind").alias("event_type")).where("event_type in ('await', 'return')")
    return calls.unionByName(assigned).unionByName(marks).select(*scope, "at", "event_type", "label")


def held_awaits(events: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Each await or call between a resource taken and the next given back, with the nearest take before it: ``(scope, at, label, held, held_at)``."""
    w = _ordered(scope, order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type").isin("acquire", "release"), F.struct("event_type", "label", *[c for c in order if c not in ("event_type", "label")])), ignorenulls=True).over(w)
    rows = events.withColumn("_l", last).where((F.col("event_type") == "await") & (F.col("_l.event_type") == "acquire"))
    return rows.select(*scope, *dict.fromkeys([*order, "label"]), F.col("_l.label").alias("held"), F.col(f"_l.{order[0]}").alias("held_at"))
