"""Functions, calls, roles and data flows of whole source tables. They scan code, which SQL cannot; fixtures test them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import config_rules, dataflow, filters, fingerprint, frontend, registry, roles, taint
from loomgrain.plans import providers
from loomgrain.plans.feature_queries import files
from loomgrain.plans.registry import query
from loomgrain.session import cut_lineage


def _files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d, "repo", "file_path", "content")


@query()
def extracted_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = frontend.extract_functions(_files(spark, d))
    return rows.select("file_id", "name", "first_line", "last_line", F.size("params").cast("long").alias("params"), F.size("calls").cast("long").alias("calls"), F.concat_ws(">", "control").alias("control"))


@query()
def function_roles(spark: SparkSession, d: str) -> DataFrame:
    return roles.function_roles(frontend.extract_functions(_files(spark, d)))


@query()
def call_graph(spark: SparkSession, d: str) -> DataFrame:
    return frontend.call_edges(cut_lineage(frontend.extract_functions(_files(spark, d)).select("repo", "file_path", "name", "calls")))


@query()
def taint_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = taint.function_flows(_files(spark, d))
    return rows.select("file_id", "function", "propagates", F.round("branch_ratio", 6).alias("branch_ratio"), F.size("flows").cast("long").alias("flows"))


@query()
def taint_findings(spark: SparkSession, d: str) -> DataFrame:
    return taint.taint_findings(taint.function_flows(_files(spark, d)))


@query()
def built_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all dimensions of each function, as built from source."""
    rows = fingerprint.fingerprints(frontend.extract_functions(_files(spark, d)))
    dims = [c for c, kind in rows.dtypes if kind.startswith("array")]
    return rows.select("file_id", "function_name", "line", "comment_density", *[F.size(c).cast("long").alias(c) for c in dims])


@query()
def cooccurring_flows(spark: SparkSession, d: str) -> DataFrame:
    """Functions with both ends of a flow in their text, the cheap test before the walk."""
    functions = frontend.extract_functions(_files(spark, d))
    return filters.cooccurrence(functions, r"\w+\.fetch\(|\w+\.load\(|\w+\.scan\(", {"LOG_FLOW": r"logger\.\w+\(", "STORE_FLOW": r"\w+\.store\(", "SEND_FLOW": r"\w+\.publish\("})


@query()
def sink_hops(spark: SparkSession, d: str) -> DataFrame:
    """How far the values in logging calls are from a fetched value, in assignments."""
    functions = cut_lineage(frontend.extract_functions(_files(spark, d)).select("file_id", "name", "first_line", "assignments", "calls"))
    named = functions.withColumn("fn", F.concat_ws(":", F.col("file_id").cast("string"), "name", F.col("first_line").cast("string")))
    assigned = named.select("fn", F.explode("assignments").alias("a")).select("fn", "a.var", "a.at", "a.value")
    uses = named.select("fn", F.explode("calls").alias("c")).where("size(c.args) > 0").select("fn", F.lit(1 << 40).alias("at"), F.array_join("c.args", " ").alias("text")).distinct()
    return filters.trace_hops(assigned, uses, r"\.(?:fetch|load|scan|resolve)\(")


@query()
def project_taint(spark: SparkSession, d: str) -> DataFrame:
    functions = cut_lineage(frontend.extract_functions(_files(spark, d)).select("file_id", "repo", "file_path", "name", "first_line", "params", "calls"))
    rows = taint.project_pass(functions, frontend.call_edges(functions))
    return rows.select("file_id", "name", "first_line", F.coalesce("origin", F.lit("none")).alias("origin"), F.size("tainted_calls").cast("long").alias("tainted_calls"))


@query()
def code_events(spark: SparkSession, d: str) -> DataFrame:
    """Calls, assignments, awaits and returns of every function in source order, with resources taken and given back."""
    from loomgrain.operators import sequence

    rows = sequence.code_events(frontend.extract_functions(_files(spark, d)))
    return sequence.ordered_events(rows, ["file_id", "name", "first_line"], ["at", "event_type", "label"])


@query()
def held_awaits(spark: SparkSession, d: str) -> DataFrame:
    """Functions by how many awaits lie between taking a resource and giving it back, of all their awaits."""
    from loomgrain.operators import sequence

    events = sequence.code_events(frontend.extract_functions(_files(spark, d)))
    scope = ["file_id", "name", "first_line"]
    held = sequence.held_awaits(events, scope, ["at", "event_type", "label"]).groupBy(*scope).agg(F.count("*").alias("held"))
    return events.groupBy(*scope).agg(F.count_if(F.col("event_type") == "await").alias("awaits")).join(held, scope, "left").fillna(0, ["held"])


@query()
def def_use_chains(spark: SparkSession, d: str) -> DataFrame:
    """Definitions and uses of names in every function, with the definitions that may reach a use."""
    return dataflow.def_use_chains(_files(spark, d))


@query()
def sink_registry(spark: SparkSession, d: str) -> DataFrame:
    """Parameter types and called names of all files, counted once per file."""
    files_ = _files(spark, d)
    return registry.learn_registry(frontend.extract_functions(files_), files_)


@query()
def classified_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of all functions with the category that the registry of all files gives them."""
    functions = cut_lineage(frontend.extract_functions(_files(spark, d)).select("file_id", "name", "types", "calls"))
    calls = functions.select("file_id", F.col("name").alias("function"), F.explode("calls.name").alias("name"))
    return registry.classify_calls(calls, registry.learn_registry(functions), taint.SAFE_RECEIVERS)


@query()
def provided_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of all files by the provider of their language."""
    rows = providers.standard().functions(_files(spark, d))
    return rows.select("file_id", "name", "first_line", "provider", "is_handler")


@query()
def config_rule_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scripts that log in active code in files that also throw or return nothing: a check by rules of one's own."""
    rules = [
        config_rules.ConfigRule("LOG_IN_SCRIPT", "info", 117, (), (".js", ".ts", ".jsx", ".tsx"), any_of=("logger.warn(",), when=("return null",), every=True),
        config_rules.ConfigRule("STORE_UNCHECKED", "warning", 754, (), (".js", ".ts"), any_of=("Store.",), none_of=("import ",), unless=("try {",)),
    ]
    return config_rules.config_findings(_files(spark, d), rules)


@query()
def discovered_symbols(spark: SparkSession, d: str) -> DataFrame:
    """All declarations of all files by kind."""
    return frontend.discovered_symbols(_files(spark, d))
