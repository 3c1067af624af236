"""Semantic filters of patterns and the thresholds and gates of matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = ["contains_call_to", "must_not_contain_call_to", "contains_node_type", "must_not_contain_node_type", "required_taint_flows", "must_not_match_function_name", "must_not_match_file_path", "contains_import", "must_not_contain_import"]


def _list(name: str) -> Column:
    return F.filter(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: x.isNotNull())


def passes_filter(calls: Column, nodes: Column, imports: Column, name: Column, path: Column, flows: Column) -> Column:
    """Ten conditions at once over the columns ``LISTS`` and ``function_name_regex``; an empty list demands nothing.

    Calls compare as substrings without case; any of a "contains" list is enough, all required flows must be there.
    """
    some = lambda have, want: F.exists(_list(want), lambda w: F.exists(have, lambda c: F.contains(F.lower(c), F.lower(w))))
    empty = lambda want: F.size(_list(want)) == 0
    among = lambda have, want: F.arrays_overlap(have, _list(want))
    rules = [
        empty("contains_call_to") | some(calls, "contains_call_to"),
        empty("must_not_contain_call_to") | ~some(calls, "must_not_contain_call_to"),
        empty("contains_node_type") | among(nodes, "contains_node_type"),
        empty("must_not_contain_node_type") | ~among(nodes, "must_not_contain_node_type"),
        empty("contains_import") | among(imports, "contains_import"),
        empty("must_not_contain_import") | ~among(imports, "must_not_contain_import"),
        F.size(F.array_except(_list("required_taint_flows"), flows)) == 0,
        empty("must_not_match_function_name") | ~F.exists(_list("must_not_match_function_name"), lambda r: F.regexp(name, r)),
        empty("must_not_match_file_path") | ~F.exists(_list("must_not_match_file_path"), lambda p: F.contains(path, p)),
        F.col("function_name_regex").isNull() | F.regexp(name, F.col("function_name_regex")),
    ]
    return reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for r in rules])


def merge_filters(hand: DataFrame, learned: DataFrame) -> DataFrame:
    """Filters by hand extended by learned ``(pattern_id, constraint, value)``: each list is the union of both."""
    pivot = learned.groupBy("pattern_id").pivot("constraint", LISTS).agg(F.collect_set("value"))
    none = F.array().cast("array<string>")
    both = hand.alias("h").join(pivot.alias("l"), "pattern_id", "full_outer")
    return both.select("pattern_id", F.col("h.function_name_regex").alias("function_name_regex"), *[F.sort_array(F.array_union(F.coalesce(F.col(f"h.{c}"), none), F.coalesce(F.col(f"l.{c}"), none))).alias(c) for c in LISTS])


def effective_threshold(category: Column, overrides: dict[str, float], default: float, has_taint: Column, taint_floor: float = 0.15) -> Column:
    """The category's threshold, at most ``taint_floor`` where data flow confirms the match."""
    out = F.lit(default)
    for name, value in overrides.items():
        out = F.when(category == name, value).otherwise(out)
    return F.when(has_taint, F.least(out, F.lit(taint_floor))).otherwise(out)


def reportable(matches: DataFrame, overrides: dict[str, float], default: float = 0.32, floor: float = 0.20) -> DataFrame:
    """Matches above their threshold with enough evidence.

    ``matches(category, score, verified, ngram, signature, path)``. Dropped: under the threshold; n-gram and signature both under
    0.05; unverified under the floor; injection findings in front-end folders.
    """
    t = effective_threshold(F.col("category"), overrides, default, F.col("verified"))
    weak = (F.col("ngram") < 0.05) & (F.col("signature") < 0.05)
    return matches.where((F.col("score") >= t) & ~weak & (F.col("verified") | (F.col("score") >= floor)) & ~((F.col("category") == "SQLI") & F.col("path").contains("/frontend/")))


def cooccurrence(functions: DataFrame, source: str, sinks: dict[str, str]) -> DataFrame:
    """``(file_id, name, rule_id, source_text, sink_text)``: functions whose body has a source and, per rule, a sink."""
    rows = functions.where(F.col("body").rlike(source))
    hits = F.array_compact(F.array(*[F.when(F.col("body").rlike(p), F.struct(F.lit(rule).alias("rule_id"), F.regexp_extract("body", f"({p})", 1).alias("sink_text"))) for rule, p in sinks.items()]))
    return rows.select("file_id", "name", F.regexp_extract("body", f"({source})", 1).alias("source_text"), F.explode(hits).alias("h")).select("file_id", "name", "h.rule_id", "source_text", "h.sink_text")


def call_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Functions ``(name, calls)`` of two versions: state and the calls that came and went."""
    a, b = before.select("name", F.col("calls").alias("old")), after.select("name", F.col("calls").alias("new"))
    none = F.array().cast("array<string>")
    met = a.join(b, "name", "full_outer")
    came, went = F.sort_array(F.array_except(F.coalesce("new", none), F.coalesce("old", none))), F.sort_array(F.array_except(F.coalesce("old", none), F.coalesce("new", none)))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when((F.size(came) > 0) | (F.size(went) > 0), "changed").otherwise("same")
    return met.select("name", state.alias("state"), came.alias("added_calls"), went.alias("removed_calls"))


def learned_change(changes: DataFrame, sanitizers: str = "(?i)sanitize|escape|validate|verify|encode") -> DataFrame:
    """What an edit from a bad to a good version teaches: calls added are required, calls removed forbidden; a cleaner among the first makes it a sanitizer fix."""
    kind = F.when(F.exists("added_calls", lambda c: F.regexp(c, F.lit(sanitizers))), "sanitizer_added").when(F.size("removed_calls") > 0, "call_removed").otherwise("call_added")
    return changes.where("state = 'changed'").select("name", kind.alias("kind"), F.col("added_calls").alias("required_calls"), F.col("removed_calls").alias("forbidden_calls"))


def trace_hops(assignments: DataFrame, uses: DataFrame, sources: str, hops: int = 3) -> DataFrame:
    """How many assignments lie between a sink argument and a source: ``(fn, at, hop)``, the least within ``hops``.

    ``assignments(fn, var, at, value)``, ``uses(fn, at, text)``. One join per hop, from the use back to the last assignment of a
    name that its text holds.
    """
    word = F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)")
    defs = assignments.select(F.col("fn").alias("dfn"), F.col("var").alias("dvar"), F.col("at").alias("dat"), F.col("value").alias("dvalue"))
    front = uses.select("fn", F.col("at").alias("use"), "at", "text")
    found = front.where(F.col("text").rlike(sources)).select("fn", "use", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        names = front.select("fn", "use", "at", F.explode(F.array_distinct(F.regexp_extract_all("text", word, 1))).alias("name"))
        met = names.join(defs, (F.col("fn") == F.col("dfn")) & (F.col("name") == F.col("dvar")) & (F.col("dat") < F.col("at")))
        front = met.groupBy("fn", "use", "name").agg(F.max(F.struct("dat", "dvalue")).alias("d")).select("fn", "use", F.col("d.dat").alias("at"), F.col("d.dvalue").alias("text"))
        found = found.unionByName(front.where(F.col("text").rlike(sources)).select("fn", "use", F.lit(hop).alias("hop")))
    return found.groupBy("fn", F.col("use").alias("at")).agg(F.min("hop").alias("hop"))


def canonical_form(code: Column) -> Column:
    """Names as x and numbers as 0, so that texts that differ in them alone are equal."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"\b[A-Za-z_]\w*\b", "x"), r"\b\d[\w.]*", "0"), r"\s+", " ")


def prefix_similarity(a: Column, b: Column) -> Column:
    """Length of the common prefix over the longer length; 0 for two empty texts."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    common = F.coalesce(F.array_min(at) - 1, n)
    return F.coalesce(F.try_divide(common, F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def quality_scores(examples: DataFrame, checks: dict[str, tuple[Column, int]], penalties: dict[str, tuple[Column, int]], minima: dict[str, int]) -> DataFrame:
    """Additive score of each example, what it lacks, and whether its tier's minimum is met. ``examples`` needs a ``tier``."""
    gained = reduce(lambda a, b: a + b, [F.when(c, points).otherwise(0) for c, points in checks.values()], F.lit(0))
    lost = reduce(lambda a, b: a + b, [F.when(c, points).otherwise(0) for c, points in penalties.values()], F.lit(0))
    lacking = F.array_compact(F.array(*[F.when(~c, F.lit(name)) for name, (c, _) in checks.items()], *[F.when(c, F.lit(name)) for name, (c, _) in penalties.items()]))
    least = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in minima.items() for x in (F.lit(k), F.lit(v))]), F.col("tier")), F.lit(0))
    score = F.greatest(gained - lost, F.lit(0))
    return examples.withColumns({"score": score, "lacking": lacking}).withColumn("enough", F.col("score") >= least).orderBy("score")


def quality_summary(scored: DataFrame) -> DataFrame:
    """Per tier of :func:`quality_scores`: examples, those that are good enough, least, mean and greatest score, and what is lacking most often."""
    counts = scored.groupBy("tier").agg(F.count("*").alias("examples"), F.count_if("enough").alias("enough"), F.min("score").alias("least"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("most"))
    gaps = scored.select("tier", F.explode("lacking").alias("gap")).groupBy("tier", "gap").agg(F.count("*").alias("n"))
    worst = gaps.groupBy("tier").agg(F.min(F.struct((-F.col("n")).alias("n"), "gap")).alias("g")).select("tier", F.col("g.gap").alias("lacking_most"))
    return counts.join(worst, "tier", "left")
