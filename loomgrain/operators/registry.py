"""Registries of sources and sinks learned from examples, and how calls are classified by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The category of a sink by what its name contains, the first that fits; of a pattern by its id; weakness numbers; how much an
# origin counts for a category; call names that mark nothing.
SINK_LADDER = [
    ("query", ["query", "execute"]), ("command", ["spawn", "system", "execsync"]), ("file", ["readfile", "writefile", "join"]), ("fetch", ["fetch", "axios", "http.get"]), ("redirect", ["redirect"]),
    ("markup", ["innerhtml", "document.write"]), ("storage", ["put", "set"]), ("log", ["log", "logger"]), ("response", ["send", "json"]),
]
PATTERN_LADDER = [
    ("query", ["sql"]), ("command", ["cmd", "command"]), ("markup", ["xss", "html_injection"]), ("fetch", ["ssrf", "server_side_request"]), ("file", ["path_traversal", "read_file", "write_file"]), ("redirect", ["redirect"]),
    ("code", ["eval", "code_exec", "rce"]), ("credential", ["credential", "secret", "password", "token"]), ("log", ["log"]),
]
CWE = {"code": 94, "query": 89, "nosql": 943, "command": 78, "file": 22, "fetch": 918, "redirect": 601, "markup": 79, "storage": 200, "log": 532, "response": 200, "credential": 798}
RELEVANCE = {
    "environment": ({"credential": 0.9, "log": 0.9}, 0.5),
    "database": ({"query": 0.7, "nosql": 0.7, "code": 0.3, "command": 0.3}, 0.4),
    "network": ({"fetch": 0.9, "redirect": 0.9, "code": 0.6, "command": 0.6}, 0.5),
    "file": ({"file": 0.9, "storage": 0.9, "log": 0.6, "query": 0.2, "code": 0.2}, 0.3),
}
NOISE = "then catch json next toString map filter forEach find sort join split trim log error send status".split()
ANNOTATION_WEIGHT = 100


def _ladder(text: Column, rungs: list[tuple[str, list[str]]], first: Column | None = None) -> Column:
    out = first if first is not None else F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in rungs:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), name)
    return out


def sink_category(name: Column) -> Column:
    """Category of a sink by its name, or ``unknown``."""
    s = F.lower(name)
    code = F.when(s.contains("eval") | (s.contains("exec") & ~s.contains("execsync")), "code")
    return _ladder(s, SINK_LADDER, code).otherwise("unknown")


def pattern_category(pattern_id: Column) -> Column:
    """Category that a pattern's id speaks of; null for none."""
    return _ladder(F.lower(pattern_id), PATTERN_LADDER)


def weakness(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in CWE.items() for x in (F.lit(k), F.lit(v))]), category), F.lit(0))


def relevance(category: Column, origin: Column) -> Column:
    """How likely data of an origin is to matter in a category of sink: 1 for user input and for unknown origins."""
    out = F.when(F.lit(False), F.lit(1.0))
    for name, (own, rest) in RELEVANCE.items():
        inner = F.lit(rest)
        for c, v in own.items():
            inner = F.when(category == c, v).otherwise(inner)
        out = out.when(origin == name, inner)
    return out.otherwise(1.0)


def short_name(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.:]*)!?$", 1)


def qualified_name(name: Column) -> Column:
    """The last two parts of a name of several, null of one."""
    parts = F.split(F.regexp_replace(name, "::", "."), r"\.")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), "."))


def learn_registry(functions: DataFrame, files: DataFrame | None = None, tag: str = "sink", tiers: dict[str, int] | None = None, least: int = 2) -> DataFrame:
    """``(kind, name, category, count)`` with kind ``source`` (parameter types), ``sink`` or ``qualified`` (called names).

    A name counts once per file. A comment ``// <tag>: name`` in ``files(file_id, content)`` adds 100. Sinks stay with as many files as their
    category's tier (``tiers``, else ``least``) asks for.
    """
    sources = functions.select("file_id", F.explode("types").alias("name")).distinct().select(F.lit("source").alias("kind"), "name", F.lit(1).alias("n"))
    called = functions.select("file_id", F.explode("calls.name").alias("c")).distinct()
    marked = None
    if files is not None:
        hits = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"//\s*" + tag + r":\s*([\w.:!$]+)"), 1)
        marked = files.select(F.explode(hits).alias("c"))

    def both(rows: DataFrame, n: int, once: bool) -> DataFrame:
        keep = ["file_id"] if once else []
        short = rows.select(*keep, F.lit("sink").alias("kind"), short_name(F.col("c")).alias("name"))
        long = rows.select(*keep, F.lit("qualified").alias("kind"), qualified_name(F.col("c")).alias("name"))
        out = short.unionByName(long).where("name is not null and name != ''")
        return (out.distinct() if once else out).select("kind", "name", F.lit(n).alias("n"))

    every = sources.unionByName(both(called, 1, True))
    if marked is not None:
        every = every.unionByName(both(marked, ANNOTATION_WEIGHT, False))
    counts = every.groupBy("kind", "name").agg(F.sum("n").alias("count"))
    category = F.when(F.col("kind") != "source", sink_category(F.col("name")))
    need = F.lit(least)
    for name, n in (tiers or {}).items():
        need = F.when(category == name, n).otherwise(need)
    return counts.withColumn("category", category).where(F.col("count") >= need).select("kind", "name", "category", "count")


def merge_registries(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Registries with their counts added up; a name keeps the category of the first that has it."""
    rows = [r.select("kind", "name", "category", "count", F.lit(i).alias("_at")) for i, r in enumerate((first, *others))]
    return reduce(DataFrame.unionByName, rows).groupBy("kind", "name").agg(F.min_by("category", "_at").alias("category"), F.sum("count").alias("count"))


def classify_calls(calls: DataFrame, registry: DataFrame, receivers: tuple[str, ...], least: int = 3) -> DataFrame:
    """``calls(..., name)`` with the ``category`` and the ``matched`` part: the whole name, its last two parts, else the last if counted ``least`` times.

    Calls on a receiver that begins with one of ``receivers`` are never sinks.
    """
    sinks = registry.where("kind in ('sink', 'qualified')").select("kind", F.col("name").alias("_n"), F.col("category").alias("_c"), "count")
    by = lambda kind, label, floor: sinks.where((F.col("kind") == kind) & (F.col("count") >= floor)).groupBy("_n").agg(F.min("_c").alias(label)).withColumnRenamed("_n", f"_{label}")
    rows = calls.withColumns({"_whole": F.regexp_replace("name", "::", "."), "_two": F.coalesce(qualified_name(F.col("name")), F.lit("")), "_one": short_name(F.col("name"))})
    whole, two, one = by("qualified", "cw", 0), by("qualified", "ct", 0), by("sink", "co", least)
    rows = rows.join(whole, rows["_whole"] == whole["_cw"], "left").join(two, rows["_two"] == two["_ct"], "left").join(one, rows["_one"] == one["_co"], "left")
    safe = reduce(lambda a, b: a | b, [F.col("name").startswith(r) for r in receivers], F.lit(False))
    category = F.when(~safe, F.coalesce("cw", "ct", "co"))
    matched = F.when(safe, None).when(F.col("cw").isNotNull(), "whole").when(F.col("ct").isNotNull(), "qualified").when(F.col("co").isNotNull(), "last")
    return rows.select(*calls.columns, category.alias("category"), matched.alias("matched"))


def learned_markers(positives: DataFrame, least: int = 2) -> DataFrame:
    """``(name, category, count)``: last parts of calls that at least ``least`` calls of positives ``(pattern_id, calls)`` of a category have.

    Names that everything calls mark nothing; of several categories the most frequent wins, of equals the first by name.
    """
    category = F.coalesce(F.try_element_at(F.split("pattern_id", "_"), F.lit(2)), F.lit("unknown"))
    rows = positives.select(category.alias("category"), F.explode("calls").alias("c")).select("category", short_name(F.col("c")).alias("name")).where(~F.col("name").isin(NOISE))
    counts = rows.groupBy("name", "category").agg(F.count("*").alias("count")).where(F.col("count") >= least)
    best = counts.groupBy("name").agg(F.min(F.struct((-F.col("count")).alias("c"), "category")).alias("b"))
    return best.select("name", "b.category", (-F.col("b.c")).alias("count"))
