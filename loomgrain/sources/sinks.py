"""Sinks: reports, bundles, manifests, baselines, mined examples and edits."""

from __future__ import annotations

import difflib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgrain.operators.findings import severity_rank

LEVELS = {"critical": "error", "warning": "warning", "info": "note"}


def _level() -> Column:
    out = None
    for severity, level in LEVELS.items():
        out = (F.when if out is None else out.when)(F.col("severity") == severity, level)
    return out.otherwise("none")


def write_json_report(findings: DataFrame, path: str) -> DataFrame:
    """Write findings as JSON lines and return the one-row summary ``(clean, total, requires_human, auto_fixable)``."""
    findings.write.mode("overwrite").json(f"{path}/findings")
    summary = findings.agg((F.count("*") == 0).alias("clean"), F.count("*").alias("total"), F.count_if("requires_human").alias("requires_human"), F.count_if("auto_fixable").alias("auto_fixable"))
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return summary


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One JSON object per rule, from its first finding by ``seq``, ordered by id."""
    first = findings.groupBy("rule_id").agg(F.min_by(F.struct("severity", "observation"), "seq").alias("f"))
    level = F.when(F.col("f.severity") == "critical", "error").when(F.col("f.severity") == "warning", "warning").otherwise("note")
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.coalesce("f.observation", F.lit("")).alias("text")).alias("shortDescription"), F.struct(level.alias("level")).alias("defaultConfiguration"))
    return first.select("rule_id", F.to_json(rule).alias("rule")).orderBy("rule_id")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, in order of ``seq``."""
    region = F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), _level().alias("level"), F.struct(F.coalesce("observation", F.lit("")).alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("seq", F.to_json(result).alias("result")).orderBy("seq")


def write_sarif(findings: DataFrame, path: str) -> None:
    """Rules and results as two sets of JSON lines: logs of any size are written by all tasks; join them with :func:`sarif_log`."""
    sarif_rules(findings).select(F.col("rule").alias("value")).write.mode("overwrite").text(f"{path}/rules")
    sarif_results(findings).select(F.col("result").alias("value")).write.mode("overwrite").text(f"{path}/results")


def sarif_log(spark: SparkSession, path: str, tool: str = "loomgrain") -> str:
    """One SARIF document from a written log, for reports that one process can hold."""
    rules = [json.loads(r.value) for r in spark.read.text(f"{path}/rules").toLocalIterator()]
    results = [json.loads(r.value) for r in spark.read.text(f"{path}/results").toLocalIterator()]
    run = {"tool": {"driver": {"name": tool, "rules": sorted(rules, key=lambda r: r["id"])}}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})


def text_lines(findings: DataFrame) -> DataFrame:
    """Readable lines, the gravest first, with what evidence there is."""
    evidence = [F.when(F.col(c) > limit, F.format_string(f"  {label}: %.2f", F.col(c))) for c, limit, label in (("control_flow", 0.5, "control flow"), ("ast", 0.7, "structure"), ("negative", 0.4, "like a negative")) if c in findings.columns]
    head = F.format_string("[%s] %s:%d %s", F.upper("severity"), F.coalesce("path", F.lit("?")), F.coalesce("line", F.lit(0)), F.col("rule_id"))
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "path", "line").select(F.concat_ws("\n", head, F.when(F.col("observation") != "", F.concat(F.lit("  "), "observation")), *evidence).alias("value"))


def markdown(findings: DataFrame) -> DataFrame:
    """Markdown lines ``(section, seq, value)``, one section per severity that occurs."""
    line = F.format_string("- **%s** `%s:%d` %s", F.col("rule_id"), F.coalesce("path", F.lit("?")), F.coalesce("line", F.lit(0)), F.coalesce("observation", F.lit("")))
    body = findings.select((4 - severity_rank(F.col("severity"))).alias("section"), "seq", line.alias("value"))
    heads = findings.select((4 - severity_rank(F.col("severity"))).alias("section"), F.concat(F.lit("## "), F.initcap("severity")).alias("value")).distinct().withColumn("seq", F.lit(-1).cast("long"))
    return heads.select("section", "seq", "value").unionByName(body.withColumn("seq", F.col("seq").cast("long"))).orderBy("section", "seq")


def content_checksum(df: DataFrame) -> str:
    """Order-free checksum of a table: the sum of row hashes, so it is one aggregate."""
    h = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(df.columns)])
    row = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}:{row.s}"


def write_bundle(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """Tables as Parquet with a manifest of counts and checksums, written last."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        written = spark.read.parquet(f"{path}/{name}")
        rows.append((name, version, written.count(), content_checksum(written)))
    spark.createDataFrame(rows, "name string, version int, rows long, checksum string").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def read_bundle(spark: SparkSession, path: str, version: int = 1) -> dict[str, DataFrame]:
    """The tables of a bundle. A newer version, a missing table or a wrong count or checksum raises."""
    out = {}
    for m in spark.read.schema("name string, version int, rows long, checksum string").json(f"{path}/_manifest").collect():
        if m.version > version:
            raise ValueError(f"{m.name}: bundle version {m.version} is newer than {version}")
        df = spark.read.parquet(f"{path}/{m.name}")
        if content_checksum(df) != m.checksum:
            raise ValueError(f"{m.name}: content does not match its manifest")
        out[m.name] = df
    return out


def changed_since(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose ``(path, content_sha)`` the manifest does not have."""
    return files.join(manifest.select("path", "content_sha"), ["path", "content_sha"], "left_anti")


def refresh(old: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``old(path, ...)`` for files that are neither refreshed nor gone, with the fresh ones."""
    kept = old.join(fresh.select("path").distinct(), "path", "left_anti").join(files.select("path").distinct(), "path", "left_semi")
    return kept.unionByName(fresh)


def mined_negatives(findings: DataFrame, low: float, high: float = 0.45) -> DataFrame:
    """Weak findings ``(file stem, snippet)`` to keep as negatives: confidence in [low, high)."""
    weak = findings.where((F.col("confidence") >= low) & (F.col("confidence") < high))
    stem = F.regexp_replace(F.concat_ws("_", F.col("rule_id"), F.substring_index("path", "/", -1), F.col("line").cast("string")), "[^A-Za-z0-9_-]", "_")
    return weak.select(F.concat(stem, F.lit("_negative")).alias("stem"), "snippet")


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Line diff of two texts; nulls are empty."""
    one = lambda a, b: "\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), "before", "after", lineterm=""))
    return pd.Series([one(a, b) for a, b in zip(before, after)], dtype=object)


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``(path, content, error)`` after all edits of each file, from the last to the first so that offsets stay true.

    ``edits(path, start, end, original, replacement, import_line)`` in characters. A file with an edit whose original does not stand at its
    place, or with edits that overlap, keeps its content and names the error. An import line goes after the last import if it is missing.
    """
    per = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "original", "replacement", "import_line")), asc=False).alias("edits"))

    @F.pandas_udf("content string, error string")
    def patch(content: pd.Series, edits: pd.Series) -> pd.DataFrame:
        out = []
        for text, todo in zip(content, edits):
            if todo is None or len(todo) == 0:
                out.append((text, None))
                continue
            new, error, limit = text or "", None, None
            for e in todo:
                if (text or "")[e["start"] : e["end"]] != e["original"]:
                    error = f"context mismatch at {e['start']}"
                elif limit is not None and e["end"] > limit:
                    error = f"edits overlap at {e['start']}"
                if error:
                    break
                new, limit = new[: e["start"]] + e["replacement"] + new[e["end"] :], e["start"]
            if error is None:
                for line in sorted({e["import_line"] for e in todo if e["import_line"]}):
                    lines = new.split("\n")
                    if line not in lines:
                        last = max([i for i, x in enumerate(lines) if x.startswith(("import ", "use ", "from "))], default=-1)
                        new = "\n".join([*lines[: last + 1], line, *lines[last + 1 :]])
            out.append((text if error else new, error))
        return pd.DataFrame(out, columns=["content", "error"])

    rows = files.join(per, "path", "left").withColumn("p", patch("content", "edits"))
    return rows.select("path", "p.content", "p.error")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def write_baseline(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, to be known at the next run."""
    findings.write.mode("overwrite").json(path)


def write_hypotheses(findings: DataFrame, path: str) -> None:
    """What a run-time check should try: one JSON object per finding that data flow supports or that needs a human, the surest first."""
    rows = findings.where(F.coalesce("has_taint", F.lit(False)) | F.coalesce("requires_human", F.lit(False)))
    rows.orderBy(F.col("confidence").desc(), "rule_id").write.mode("overwrite").json(path)


def write_runtime_report(results: DataFrame, path: str) -> None:
    """Verdicts of probes as JSON lines."""
    results.write.mode("overwrite").json(path)


def build_library(examples: DataFrame, path: str, call_weights: DataFrame, weights: DataFrame, filters: DataFrame, calibration: DataFrame, version: int = 1) -> None:
    """A library ready for scoring: examples, call weights, category weights, filters and calibration as one bundle."""
    write_bundle({"examples": examples, "call_weights": call_weights, "weights": weights, "filters": filters, "calibration": calibration}, path, version)


def write_file_cache(results: DataFrame, path: str, filters: DataFrame, library: DataFrame, version: int = 1) -> None:
    """Results per file with what they depend on: version, and checksums of the filters and the library."""
    spark = results.sparkSession
    results.write.mode("overwrite").parquet(f"{path}/results")
    row = [(version, content_checksum(filters), content_checksum(library))]
    spark.createDataFrame(row, "version int, filters string, library string").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def read_file_cache(spark: SparkSession, path: str, filters: DataFrame, library: DataFrame, version: int = 1) -> DataFrame | None:
    """The cached results, or None if version, filters or library are no longer those they were made with."""
    m = spark.read.schema("version int, filters string, library string").json(f"{path}/_manifest").first()
    if m is None or (m.version, m.filters, m.library) != (version, content_checksum(filters), content_checksum(library)):
        return None
    return spark.read.parquet(f"{path}/results")


def write_learned_pattern(pairs: DataFrame, changes: DataFrame, path: str) -> DataFrame:
    """Patterns learned from edits, as a library that reads like any other.

    ``pairs(pattern_id, ext, before, after)`` become ``<id>_positive.<ext>`` and ``<id>_negative.<ext>`` rows of ``(path, content)``;
    ``changes(pattern_id, kind, required_calls, forbidden_calls)`` become TOML sidecars. All is written, read again and counted: a pattern that does
    not come back whole raises. Returns what was read.
    """
    spark = pairs.sparkSession
    sides = F.array(F.struct(F.lit("positive").alias("side"), F.col("before").alias("content")), F.struct(F.lit("negative").alias("side"), F.col("after").alias("content")))
    files = pairs.select("pattern_id", "ext", F.explode(sides).alias("x")).select(F.concat("pattern_id", F.lit("_"), "x.side", F.lit("."), "ext").alias("path"), "x.content")
    quoted = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r'([\\"])', r"\\$1"), F.lit('"'))), ", "), F.lit("]"))
    toml = F.concat_ws("\n", F.concat(F.lit('kind = "'), "kind", F.lit('"')), F.concat(F.lit("required_calls = "), quoted("required_calls")), F.concat(F.lit("forbidden_calls = "), quoted("forbidden_calls")), F.lit(""))
    sidecars = changes.select(F.concat("pattern_id", F.lit(".toml")).alias("path"), toml.alias("content"))
    files.unionByName(sidecars).write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    whole = back.where("path not like '%.toml'").groupBy(F.regexp_extract("path", r"^(.*)_(?:positive|negative)\.", 1).alias("p")).agg(F.count("*").alias("n")).where("n != 2")
    if back.where("content is null").limit(1).count() or whole.limit(1).count():
        raise ValueError("a learned pattern is not whole")
    return back
