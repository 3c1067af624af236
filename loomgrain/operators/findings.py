"""Findings: composition, suppression, de-duplication, baselines, divergence and accuracy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions.scores import compose_confidence
from loomgrain.functions.text import glob_pattern

SEVERITIES = ["info", "warning", "critical"]


def severity_rank(c: Column) -> Column:
    return F.when(c == "critical", 3).when(c == "warning", 2).when(c == "info", 1).otherwise(0)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(severity_rank(F.col("severity")) >= SEVERITIES.index(severity) + 1)


def override_severity(findings: DataFrame, overrides: dict[str, str], disabled: list[str] | None = None) -> DataFrame:
    """Severity by rule where the project names one; disabled rules are dropped."""
    out = F.col("severity")
    for rule, severity in overrides.items():
        out = F.when(F.col("rule_id") == rule, severity).otherwise(out)
    kept = findings.where(~F.coalesce(F.col("rule_id").isin(disabled), F.lit(False))) if disabled else findings
    return kept.withColumn("severity", out)


def suppress(findings: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Drop findings whose rule (or ``all``) and path match a ``(rule, glob)`` of the project. Null paths match nothing."""
    if not rules:
        return findings
    hit = reduce(lambda a, b: a | b, [((F.lit(rule) == "all") | (F.col("rule_id") == rule)) & F.col("path").rlike(glob_pattern(g)) for rule, g in rules])
    return findings.where(~F.coalesce(hit, F.lit(False)))


def keep_best(findings: DataFrame, key: list[str], score: str, seq: str) -> DataFrame:
    """Per key the row of highest score; of equals the earlier one. One aggregate, no sort of a group."""
    other = [c for c in findings.columns if c not in key]
    best = F.max_by(F.struct(*other), F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), -F.col(seq)))
    return findings.groupBy(*key).agg(best.alias("_b")).select(*key, *[F.col(f"_b.{c}").alias(c) for c in other])


def compose(findings: DataFrame, place: list[str]) -> DataFrame:
    """Confidence from all layers that fired at one place.

    ``findings(*place, seq, rule_id, confidence, verified, ratio, validator)``. The last non-null ratio and
    validator of a place count, by ``seq``.
    """
    w = Window.partitionBy(*place)
    rule = F.col("rule_id")
    corpus = F.max(rule.startswith("CORPUS_")).over(w)
    taint = F.max((rule.startswith("CORPUS_") & F.col("verified")) | rule.startswith("TAINT_") | (rule == "CROSS_FILE_TAINT")).over(w)
    twin = F.max(rule == "NEAR_DUPLICATE_FUNCTION").over(w)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c))).over(w)[c]
    ratio, validator = last("ratio"), F.coalesce(last("validator"), F.lit(False))
    rows = findings.withColumns({"_c": corpus, "_t": taint, "_d": twin, "_r": ratio, "_v": validator})
    return rows.withColumn("confidence", compose_confidence(F.col("confidence"), F.col("_c"), F.col("_t"), F.col("_r"), F.col("_v"), F.col("_d"))).drop("_c", "_t", "_d", "_r", "_v")


def baseline_diff(current: DataFrame, baseline: DataFrame, key: list[str]) -> DataFrame:
    """New and resolved findings: rows of either side that the other lacks, nulls in the key being equal to nulls."""
    def without(a: DataFrame, b: DataFrame, state: str) -> DataFrame:
        keys = b.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
        return a.select(*key).distinct().join(keys, same, "left_anti").withColumn("state", F.lit(state))

    return without(current, baseline, "new").unionByName(without(baseline, current, "resolved"))


def divergence(a: DataFrame, b: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """How far two implementations agree, in all, and per each column of ``group``: both, only a, only b."""
    left = a.select(*key).distinct().withColumn("_a", F.lit(True))
    right = b.select(*key).distinct().withColumn("_b", F.lit(True))
    met = left.join(right, key, "full_outer")
    counts = [F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b")]
    parts = [met.agg(*counts).select(F.lit("all").alias("level"), F.lit(None).cast("string").alias("value"), "both", "only_a", "only_b")]
    parts += [met.groupBy(g).agg(*counts).select(F.lit(g).alias("level"), F.col(g).cast("string").alias("value"), "both", "only_a", "only_b") for g in group]
    return reduce(DataFrame.unionByName, parts)


def confusion(rows: DataFrame, levels: list[str], predicted: str, actual: str) -> DataFrame:
    """True and false positives, misses, precision, recall and F1, rolled up over ``levels`` (null stands for all)."""
    p, a = F.coalesce(F.col(predicted), F.lit(False)), F.coalesce(F.col(actual), F.lit(False))
    base = rows.rollup(*levels).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return base.select(*levels, "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide(2 * precision * recall, precision + recall), 6).alias("f1"))


def match_labels(findings: DataFrame, labels: DataFrame, reach: int = 30, tight: int = 15) -> DataFrame:
    """Greedy one-to-one assignment of findings to labels in a file: same symbol within ``reach`` lines, else any within ``tight``.

    ``findings(finding_id, file, line, symbol)``, ``labels(label_id, file, line, symbol)``. Findings go in order of id and
    take the nearest free label. One file is a group; the lists of one file fit a task by nature.
    """
    import pandas as pd

    def assign(key, f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        free = {r.label_id: (r.line, r.symbol) for r in g.sort_values("label_id").itertuples()}
        out = []
        for r in f.sort_values("finding_id").itertuples():
            near = [(abs(line - r.line), lid) for lid, (line, sym) in free.items() if sym == r.symbol and r.symbol is not None and abs(line - r.line) <= reach]
            near = near or [(abs(line - r.line), lid) for lid, (line, _) in free.items() if abs(line - r.line) <= tight]
            if near:
                hit = min(near)[1]
                del free[hit]
                out.append((r.finding_id, hit))
        return pd.DataFrame(out, columns=["finding_id", "label_id"])

    return findings.groupBy("file").cogroup(labels.groupBy("file")).applyInPandas(assign, "finding_id long, label_id long")


def without_known(findings: DataFrame, baseline: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Findings whose ``fingerprint`` the baseline lacks.

    An empty or null fingerprint says nothing and is never known, unless ``strict_compat``, where empty ones are equal too.
    """
    known = baseline.select(F.coalesce("fingerprint", F.lit("")).alias("_f")).distinct()
    same = F.coalesce("fingerprint", F.lit("")) == F.col("_f")
    return findings.join(known, same if strict_compat else same & (F.col("_f") != ""), "left_anti")


# Tags that a kind of fix covers.
FIX_SCOPES = {"style": ["quality", "dead-code"], "security": ["security", "taint", "hallucination"]}


def fix_scope(findings: DataFrame, scope: str) -> DataFrame:
    """Findings whose ``tags`` fall under a scope of fixes; any other scope keeps all."""
    if scope not in FIX_SCOPES:
        return findings
    return findings.where(F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in FIX_SCOPES[scope]])), F.lit(False)))


def report_filter(findings: DataFrame, rules: DataFrame | None = None, least_confidence: float = 0.0, tags: list[str] | None = None, least: str | None = None, rule_ids: list[str] | None = None, languages: dict[str, list[str]] | None = None) -> DataFrame:
    """What a report shows: enough confidence, rules with one of ``tags`` (by ``rules(rule_id, tags)``), severity, rules by id, and
    languages by the extension of the path (``languages`` maps a name to extensions). What is not asked for filters nothing."""
    out = findings.where(F.coalesce("confidence", F.lit(0.0)) >= least_confidence)
    if tags and rules is not None:
        tagged = rules.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))).select("rule_id").distinct()
        out = out.join(tagged, "rule_id", "left_semi")
    if least:
        out = at_least(out, least)
    if rule_ids:
        out = out.where(F.col("rule_id").isin(rule_ids))
    if languages:
        out = out.where(F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.(\w+)$", 1)).isin(sorted({e for es in languages.values() for e in es})))
    return out


def within_risk(probes: DataFrame, most: int) -> DataFrame:
    """Probes whose ``risk`` is at most ``most``; an unknown risk is none."""
    return probes.where(F.coalesce("risk", F.lit(0)) <= most)


def fuzzy_identity(strict_content: bool = False) -> list[Column]:
    """Key by which a finding is the same after its line moved: rule, path, symbol and its content without spacing and case."""
    content = F.coalesce("content", F.lit(""))
    loose = F.lower(F.trim(F.regexp_replace(content, r"\s+", " ")))
    return [F.col("rule_id").alias("rule_id"), F.col("path").alias("path"), F.col("symbol").alias("symbol"), (content if strict_content else loose).alias("content")]


def fuzzy_baseline_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """New and resolved findings ``(rule_id, path, symbol, content, state)`` by their fuzzy identity, wherever their line is now."""
    key = ["rule_id", "path", "symbol", "content"]
    return baseline_diff(current.select(*fuzzy_identity()), baseline.select(*fuzzy_identity()), key)
