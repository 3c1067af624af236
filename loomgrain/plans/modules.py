"""Finding modules that come with the package, as rules over a context of tables.

The context holds ``files(file_id, repo, file_path, content)`` and, for dependencies, ``advisories``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.operators import config_rules, frontend, joins, taint
from loomgrain.plans.rules import Context, RuleSet
from loomgrain.session import cut_lineage
from loomgrain.sources import readers


def _cross_file(context: Context) -> DataFrame:
    files = context["files"]
    flows = cut_lineage(taint.function_flows(files))
    edges = cut_lineage(frontend.call_edges(frontend.extract_functions(files).select("repo", "file_path", "name", "calls")))
    paths = taint.cross_file_paths(edges, flows)
    place = F.regexp_extract("sink", r"^(.*):[^:]*$", 1)
    text = F.format_string("%s reaches %s over %d calls", F.col("origin"), F.col("sink"), F.col("path_length"))
    return paths.select(place.alias("path"), F.lit(1).cast("long").alias("line"), text.alias("content"), (1 / F.col("path_length")).alias("confidence"))


def _middleware(context: Context) -> DataFrame:
    files = context["files"]
    found = config_rules.config_findings(files)
    return found.join(files.select("file_id", "file_path"), "file_id").select(F.col("file_path").alias("path"), "line", F.col("rule_id").alias("content"), F.lit(1.0).alias("confidence"))


def _dependencies(context: Context) -> DataFrame:
    declared = readers.dependencies(context["files"].select(F.col("file_path").alias("path"), "content"))
    hit = joins.vulnerable_dependencies(declared, context["advisories"])
    return hit.select("path", F.lit(1).cast("long").alias("line"), F.concat_ws(" ", "package", "version").alias("content"), F.lit(1.0).alias("confidence"))


def standard() -> RuleSet:
    """Cross-file data flow, configuration and dependencies."""
    rules = RuleSet()
    rules.rule("CROSS_FILE_TAINT", "critical", "taint", ("security", "taint"))(_cross_file)
    rules.rule("CONFIGURATION", "warning", "configuration", ("security",))(_middleware)
    rules.rule("VULNERABLE_DEPENDENCY", "warning", "dependencies", ("security",))(_dependencies)
    return rules
