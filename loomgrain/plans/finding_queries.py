"""Findings, ordered events, call graphs, range joins and recorded traces on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.functions import scores as S
from loomgrain.functions.text import glob_pattern
from loomgrain.operators import findings as N
from loomgrain.operators import graph, joins, sequence
from loomgrain.plans.feature_queries import FILES, FUNCTIONS, files, functions
from loomgrain.plans.registry import query
from loomgrain.tables import latest_by_key, read_table

_FINDINGS = """f AS (SELECT l_orderkey AS place, l_linenumber AS seq, CASE l_returnflag WHEN 'A' THEN 'CORPUS_shape' WHEN 'N' THEN 'TAINT_flow' ELSE 'NEAR_DUPLICATE_FUNCTION' END AS rule_id,
  l_discount * 10 AS confidence, l_linestatus = 'F' AND l_quantity > 25 AS verified, CASE WHEN l_tax > 0.04 THEN l_tax * 12 END AS ratio, CASE WHEN l_quantity < 30 THEN l_quantity < 10 END AS validator FROM lineitem)"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    rule = F.when(F.col("l_returnflag") == "A", "CORPUS_shape").when(F.col("l_returnflag") == "N", "TAINT_flow").otherwise("NEAR_DUPLICATE_FUNCTION")
    return read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("place"), F.col("l_linenumber").alias("seq"), rule.alias("rule_id"), (F.col("l_discount") * 10).alias("confidence"),
        ((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25)).alias("verified"), F.when(F.col("l_tax") > 0.04, F.col("l_tax") * 12).alias("ratio"),
        F.when(F.col("l_quantity") < 30, F.col("l_quantity") < 10).alias("validator"),
    )


@query(f"""
WITH {_FINDINGS}, p AS (SELECT place, bool_or(rule_id = 'CORPUS_shape') AS c, bool_or((rule_id = 'CORPUS_shape' AND verified) OR rule_id = 'TAINT_flow') AS t, bool_or(rule_id = 'NEAR_DUPLICATE_FUNCTION') AS dup,
  arg_max(ratio, (seq, ratio)) FILTER (ratio IS NOT NULL) AS r, coalesce(arg_max(validator, (seq, validator)) FILTER (validator IS NOT NULL), false) AS v FROM f GROUP BY 1),
s AS (SELECT f.place, seq, dup, confidence * CASE WHEN c AND NOT t THEN 0.6 ELSE 1.0 END * CASE WHEN coalesce(r > 0.85, false) AND v THEN 0.3 ELSE 1.0 END AS s FROM f JOIN p USING (place))
SELECT place, seq::BIGINT AS seq, round(least(CASE WHEN dup THEN least(s * 1.1, s + 0.3) ELSE s END, 1.0), 6) AS confidence FROM s""")
def compose_confidence(spark: SparkSession, d: str) -> DataFrame:
    return N.compose(_findings(spark, d), ["place"]).select("place", F.col("seq").cast("long").alias("seq"), F.round("confidence", 6).alias("confidence"))


@query("""
WITH r AS (SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 8 + l_linenumber) AS r FROM lineitem)
SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM r WHERE r = 1""")
def dedup_keep_best(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_extendedprice")
    return N.keep_best(rows.withColumn("seq", F.col("l_orderkey") * 8 + F.col("l_linenumber")), ["l_suppkey", "l_returnflag"], "l_extendedprice", "seq").drop("seq")


_RULES = [("python", "src/**"), ("all", "lib/**/*.rs"), ("rust", "**/*gateway*"), ("typescript", "app/?*/**.tsx")]
_HIT = " OR ".join(f"({'true' if r == 'all' else f'''rule_id = '{r}' '''} AND regexp_matches(path, '{glob_pattern(g)}'))" for r, g in _RULES)


@query(f"""
WITH {FUNCTIONS}, f AS (SELECT fn_id, language AS rule_id, file_path AS path FROM functions) SELECT fn_id, rule_id, path FROM f WHERE NOT coalesce({_HIT}, false)""")
def suppress_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = functions(spark, d, "language", "file_path").select("fn_id", F.col("language").alias("rule_id"), F.col("file_path").alias("path"))
    return N.suppress(rows, _RULES)


@query("""
WITH f AS (SELECT o_orderkey, o_orderstatus AS rule_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'critical' WHEN o_orderpriority LIKE '2%' THEN 'warning' ELSE 'info' END AS severity FROM orders),
g AS (SELECT o_orderkey, rule_id, CASE WHEN rule_id = 'F' THEN 'warning' ELSE severity END AS severity FROM f WHERE rule_id <> 'P')
SELECT * FROM g WHERE severity IN ('warning', 'critical')""")
def severity_override(spark: SparkSession, d: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    rows = read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("rule_id"), F.when(priority.startswith("1"), "critical").when(priority.startswith("2"), "warning").otherwise("info").alias("severity"))
    return N.at_least(N.override_severity(rows, {"F": "warning"}, ["P"]), "warning")


@query("""
WITH s AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'critical' WHEN o_orderpriority LIKE '2%' THEN 'warning' ELSE 'info' END AS severity, o_orderstatus, o_totalprice FROM orders)
SELECT severity, count(*)::BIGINT AS findings, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS requires_human, count(*) FILTER (o_totalprice < 50000)::BIGINT AS auto_fixable FROM s GROUP BY 1""")
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    severity = F.when(priority.startswith("1"), "critical").when(priority.startswith("2"), "warning").otherwise("info")
    return read_table(spark, d, "orders").groupBy(severity.alias("severity")).agg(F.count("*").alias("findings"), F.count_if(F.col("o_orderstatus") == "O").alias("requires_human"), F.count_if(F.col("o_totalprice") < 50000).alias("auto_fixable"))


_PAIRS = "p AS (SELECT DISTINCT ON (pair_id) * FROM match_pairs WHERE pair_id IS NOT NULL ORDER BY pair_id, ingested_at DESC)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return latest_by_key(read_table(spark, d, "match_pairs"), "pair_id", "ingested_at", ["run_id", "left_fn", "right_fn", "signature_sim"])


@query(f"""
WITH {_PAIRS}, b AS (SELECT DISTINCT left_fn, right_fn FROM p WHERE run_id < 'run-00010'), c AS (SELECT DISTINCT left_fn, right_fn FROM p WHERE run_id >= 'run-00010')
SELECT *, 'new' AS state FROM (SELECT * FROM c EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM b EXCEPT SELECT * FROM c)""")
def baseline_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d)
    return N.baseline_diff(rows.where("run_id >= 'run-00010'"), rows.where("run_id < 'run-00010'"), ["left_fn", "right_fn"])


@query(f"""
WITH {FUNCTIONS}, a AS (SELECT DISTINCT language, repo, function_name FROM functions WHERE comment_density < 0.1 AND language IS NOT NULL AND repo IS NOT NULL AND function_name IS NOT NULL),
b AS (SELECT DISTINCT language, repo, function_name FROM functions WHERE len(semantic_markers) > 1 AND language IS NOT NULL AND repo IS NOT NULL AND function_name IS NOT NULL),
m AS (SELECT coalesce(a.language, b.language) AS language, coalesce(a.repo, b.repo) AS repo, a.repo IS NOT NULL AS ina, b.repo IS NOT NULL AS inb FROM a FULL JOIN b ON a.language = b.language AND a.repo = b.repo AND a.function_name = b.function_name),
g AS (SELECT CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(repo) = 0 THEN 'repo' ELSE 'all' END AS level, coalesce(language, repo) AS value, count(*) FILTER (ina AND inb)::BIGINT AS "both",
  count(*) FILTER (NOT inb)::BIGINT AS only_a, count(*) FILTER (NOT ina)::BIGINT AS only_b FROM m GROUP BY GROUPING SETS ((), (language), (repo)))
SELECT * FROM g""")
def divergence_full_outer(spark: SparkSession, d: str) -> DataFrame:
    rows = functions(spark, d, "language", "repo", "function_name", "comment_density", "semantic_markers").dropna(subset=["language", "repo", "function_name"])
    return N.divergence(rows.where("comment_density < 0.1"), rows.where(F.size("semantic_markers") > 1), ["language", "repo", "function_name"], ["language", "repo"])


@query(f"""
WITH {FUNCTIONS}, {_PAIRS}, r AS (SELECT run_id, lower(x.language) AS language, coalesce(signature_sim >= 0.75, false) AS pr, coalesce(lower(x.language) = lower(y.language), false) AS ac
  FROM p JOIN functions x ON x.fn_id = left_fn JOIN functions y ON y.fn_id = right_fn),
g AS (SELECT run_id, language, count(*) FILTER (pr AND ac)::BIGINT AS tp, count(*) FILTER (pr AND NOT ac)::BIGINT AS fp, count(*) FILTER (NOT pr AND ac)::BIGINT AS fn FROM r GROUP BY ROLLUP (run_id, language)),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS pre, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS rec FROM g)
SELECT run_id, language, tp, fp, fn, round(pre, 6) AS precision, round(rec, 6) AS recall, round(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) END, 6) AS f1 FROM m""")
def confusion_rollup(spark: SparkSession, d: str) -> DataFrame:
    langs = functions(spark, d, "language").select("fn_id", F.lower("language").alias("language"))
    both = _pairs(spark, d).join(langs.withColumnRenamed("fn_id", "left_fn"), "left_fn").join(langs.withColumnsRenamed({"fn_id": "right_fn", "language": "other"}), "right_fn")
    return N.confusion(both.select("run_id", "language", (F.col("signature_sim") >= 0.75).alias("pr"), (F.col("language") == F.col("other")).alias("ac")), ["run_id", "language"], "pr", "ac")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events")


_ORDER = ["ts", "event_id"]


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS place FROM events")
def ordered_scope_events(spark: SparkSession, d: str) -> DataFrame:
    return sequence.ordered_events(_events(spark, d), ["user_id"], _ORDER).select("event_id", "user_id", "place")


@query("""
WITH d AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events), e AS (SELECT user_id, day, event_type, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS p FROM d),
s1 AS (SELECT user_id, day, min(p) AS p FROM e WHERE event_type = 'signup' GROUP BY 1, 2), s2 AS (SELECT e.user_id, e.day, min(e.p) AS p FROM e JOIN s1 ON e.user_id = s1.user_id AND e.day = s1.day AND e.p > s1.p WHERE event_type = 'view' GROUP BY 1, 2),
s3 AS (SELECT e.user_id, e.day, min(e.p) AS p FROM e JOIN s2 ON e.user_id = s2.user_id AND e.day = s2.day AND e.p > s2.p WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT s1.user_id, s1.day, (1 + (s2.p IS NOT NULL)::INT)::BIGINT AS matched FROM s1 LEFT JOIN s2 USING (user_id, day) LEFT JOIN s3 USING (user_id, day) WHERE s3.p IS NULL""")
def must_follow(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return sequence.must_follow(rows, ["user_id", "day"], _ORDER, "event_type", ["signup", "view", "purchase"])


@query("""
WITH e AS (SELECT *, row_number() OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, max(CASE WHEN event_type = 'error' THEN p END) OVER b AS a, max(CASE WHEN event_type = 'signup' THEN p END) OVER b AS r FROM e WINDOW b AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id FROM s WHERE event_type = 'purchase' AND a IS NOT NULL AND (r IS NULL OR r < a)""")
def must_not_follow(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return sequence.must_not_follow(_events(spark, d), ["user_id"], _ORDER, t == "error", t == "purchase", t == "signup").select("event_id", "user_id")


@query("""
WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN true WHEN event_type = 'purchase' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM events)
SELECT event_id, user_id FROM e WHERE o AND event_type = 'error'""")
def forbidden_between(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return sequence.forbidden_between(_events(spark, d), ["user_id"], _ORDER, t == "view", t == "purchase", t == "error").select("event_id", "user_id")


@query("""
WITH e AS (SELECT *, coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM events)
SELECT event_id, user_id FROM e WHERE stopped = 0""")
def early_stop_prefix(spark: SparkSession, d: str) -> DataFrame:
    return sequence.early_stop(_events(spark, d), ["user_id"], _ORDER, F.col("event_type") == "error").select("event_id", "user_id")


@query("""
WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
s AS (SELECT event_type, max(n)::BIGINT AS n, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = least(floor(n * 0.99)::BIGINT, n - 1) THEN value END) AS p99 FROM e GROUP BY 1)
SELECT event_type, n, p50, p99, coalesce(p99 / nullif(p50, 0) > 10, false) AS confirmed FROM s""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return sequence.latency_profile(_events(spark, d), ["event_type"], "value")


@query("""
WITH b AS (SELECT user_id, arg_min(event_type, event_id) AS t0, arg_min(value, event_id) AS v0, min(event_id) AS b0 FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_id, round(CASE WHEN event_type <> t0 THEN 0.35 ELSE 0.0 END + 0.25 * least(abs(value - v0) / greatest(v0, 1), 1.0) + CASE WHEN md5(event_type) <> md5(t0) THEN 0.25 ELSE 0.0 END
  + CASE WHEN greatest(event_id - b0, 0) > 1000 THEN 0.15 * least(greatest(event_id - b0, 0) / 5000.0, 1.0) ELSE 0.0 END, 6) AS divergence FROM events JOIN b USING (user_id) WHERE value IS NOT NULL""")
def response_divergence(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).where("value is not null")
    base = rows.groupBy("user_id").agg(F.min_by(F.struct(F.col("event_type").alias("t0"), F.col("value").alias("v0"), F.col("event_id").alias("b0")), "event_id").alias("b"))
    r = rows.join(base, "user_id").select("event_id", "event_type", "value", "b.*")
    score = S.response_divergence(F.col("event_type"), F.col("t0"), F.col("value"), F.col("v0"), F.md5("event_type"), F.md5("t0"), F.col("event_id"), F.col("b0"))
    return r.select("event_id", F.round(score, 6).alias("divergence"))


@query("""
WITH k AS (SELECT event_id, value, CASE event_type WHEN 'view' THEN 'timing_delta' WHEN 'click' THEN 'differential_response' WHEN 'error' THEN 'error_pattern' WHEN 'signup' THEN 'canary_callback' ELSE 'body_size_delta' END AS kind FROM events WHERE value IS NOT NULL)
SELECT event_id, CASE WHEN (kind = 'timing_delta' AND value >= 50) OR (kind = 'error_pattern' AND value > 20) OR (kind = 'canary_callback' AND value > 20) OR (kind = 'differential_response' AND value / 100 >= 50) OR (kind = 'body_size_delta' AND abs(value) >= 50) THEN 'confirmed'
    WHEN kind = 'differential_response' AND value / 100 < 0.05 THEN 'sanitized' ELSE 'not_confirmed' END AS verdict,
  round(CASE WHEN kind = 'timing_delta' AND value >= 50 THEN 0.82 WHEN kind = 'error_pattern' AND value > 20 THEN 0.78 WHEN kind = 'canary_callback' AND value > 20 THEN 0.99 WHEN kind = 'differential_response' AND value / 100 >= 50 THEN 0.6 + (value / 100 - 50) * 0.3
    WHEN kind = 'body_size_delta' AND abs(value) >= 50 THEN 0.55 ELSE 0.0 END, 6) AS confidence FROM k""")
def oracle_verdicts(spark: SparkSession, d: str) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    kind = F.when(t == "view", "timing_delta").when(t == "click", "differential_response").when(t == "error", "error_pattern").when(t == "signup", "canary_callback").otherwise("body_size_delta")
    rows = _events(spark, d).where("value is not null")
    return rows.select("event_id", S.oracle_verdict(kind, v, F.lit(50.0), v > 20, v / 100).alias("r")).select("event_id", "r.verdict", F.round("r.confidence", 6).alias("confidence"))


_EDGES = """edges AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    def part(table: str, a: str, src: str, b: str, dst: str) -> DataFrame:
        return read_table(spark, d, table).select(F.concat(F.lit(a), src).alias("src"), F.concat(F.lit(b), dst).alias("dst"))

    orders, customers = part("orders", "o", "o_orderkey", "c", "o_custkey"), part("customer", "c", "c_custkey", "n", "c_nationkey")
    return orders.unionByName(customers).unionByName(part("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(part("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query(f"""
WITH RECURSIVE {_EDGES}, seed AS (SELECT 'o' || o_orderkey AS node, o_orderstatus AS origin FROM orders WHERE o_orderpriority LIKE '1%'),
walk(seed, origin, node, hops) AS (SELECT node, origin, node, 0 FROM seed UNION SELECT w.seed, w.origin, e.dst, w.hops + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.hops < 5),
near AS (SELECT node, min(hops) AS hops FROM walk GROUP BY 1)
SELECT n.node, (SELECT w.origin FROM walk w WHERE w.node = n.node AND w.hops = n.hops ORDER BY w.seed, w.origin LIMIT 1) AS origin, n.hops::BIGINT AS hops FROM near n""")
def forward_propagate(spark: SparkSession, d: str) -> DataFrame:
    seeds = read_table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.col("o_orderstatus").alias("origin"))
    return graph.forward_propagate(_edges(spark, d), seeds)


@query(f"""
WITH RECURSIVE {_EDGES}, walk(sink, node, hops) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT w.sink, e.src, w.hops + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.hops < 9)
SELECT sink, node AS source, c_mktsegment AS origin, (min(hops) + 1)::BIGINT AS path_length FROM walk JOIN customer ON node = 'c' || c_custkey GROUP BY 1, 2, 3""")
def backward_resolve(spark: SparkSession, d: str) -> DataFrame:
    sinks = read_table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    sources = read_table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("origin"))
    return graph.backward_resolve(_edges(spark, d), sinks, sources)


@query("""
SELECT 's' || s_suppkey AS a, 'r' || r_regionkey AS b, n_regionkey = r_regionkey AS connected FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON true""")
def call_paths(spark: SparkSession, d: str) -> DataFrame:
    regions = read_table(spark, d, "region").agg(F.collect_set(F.concat(F.lit("r"), "r_regionkey"))).scalar()  # five by the schema
    asked = read_table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), regions.alias("r")).select("a", F.explode("r").alias("b"))
    return graph.path_exists(_edges(spark, d), asked)


_SPANS = "spans AS (SELECT repo, file_path, fn_id AS span_id, line AS s, line + 40 + fn_id % 60 AS e FROM functions WHERE line IS NOT NULL AND repo IS NOT NULL AND file_path IS NOT NULL)"


@query(f"""
WITH {FUNCTIONS}, {FILES}, {_SPANS}, ends AS (SELECT repo, file_path, max(e) AS last FROM spans GROUP BY 1, 2), pts AS (SELECT file_id, repo, file_path, unnest(range(1, last + 1)) AS point FROM files JOIN ends USING (repo, file_path)),
m AS (SELECT file_id, p.repo, p.file_path, point, span_id, row_number() OVER (PARTITION BY file_id, point ORDER BY e - s, s DESC, span_id) AS r FROM pts p JOIN spans x ON x.repo = p.repo AND x.file_path = p.file_path AND point BETWEEN s AND e)
SELECT file_id, point::BIGINT AS point, span_id FROM m WHERE r = 1""")
def enclosing_functions(spark: SparkSession, d: str) -> DataFrame:
    """The tightest function around every line of every file, up to the end of its last function."""
    spans = functions(spark, d, "repo", "file_path", "line").select("repo", "file_path", F.col("fn_id").alias("span_id"), F.col("line").cast("long").alias("start"), (F.col("line") + 40 + F.col("fn_id") % 60).alias("end"))
    ends = spans.groupBy("repo", "file_path").agg(F.max("end").cast("long").alias("last"))
    points = files(spark, d, "repo", "file_path").join(ends, ["repo", "file_path"]).where("last > 0").select("file_id", "repo", "file_path", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))).alias("point"))
    return joins.enclosing_span(points, spans, ["repo", "file_path"]).select("file_id", "point", "span_id")


@query(f"""
WITH {FUNCTIONS}, {FILES}, {_SPANS}, pts AS (SELECT DISTINCT file_id, x.repo, x.file_path, s AS point FROM files y JOIN spans x ON x.repo = y.repo AND x.file_path = y.file_path),
m AS (SELECT file_id, p.repo, p.file_path, point, span_id, row_number() OVER (PARTITION BY file_id, point ORDER BY e - s, s DESC, span_id) AS r FROM pts p JOIN spans x ON x.repo = p.repo AND x.file_path = p.file_path AND point BETWEEN s AND e)
SELECT file_id, point::BIGINT AS point, span_id FROM m WHERE r = 1""")
def enclosing_function_starts(spark: SparkSession, d: str) -> DataFrame:
    """The tightest function around the first line of every function, so no span of a file is out of reach."""
    spans = functions(spark, d, "repo", "file_path", "line").select("repo", "file_path", F.col("fn_id").alias("span_id"), F.col("line").cast("long").alias("start"), (F.col("line") + 40 + F.col("fn_id") % 60).alias("end"))
    starts = spans.where("start is not null").select("repo", "file_path", F.col("start").alias("point")).distinct()
    points = files(spark, d, "repo", "file_path").join(starts, ["repo", "file_path"]).select("file_id", "repo", "file_path", "point")
    return joins.enclosing_span(points, spans, ["repo", "file_path"]).select("file_id", "point", "span_id")


@query("""
WITH a AS (SELECT event_id AS error_id, user_id, floor(epoch(ts))::BIGINT AS at_error FROM events WHERE event_type = 'error'), b AS (SELECT event_id AS purchase_id, user_id, floor(epoch(ts))::BIGINT AS at_purchase FROM events WHERE event_type = 'purchase')
SELECT error_id, purchase_id, at_purchase - at_error AS seconds FROM a JOIN b USING (user_id) WHERE abs(at_error - at_purchase) <= 3600""")
def band_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    a = rows.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("at").alias("at_error"))
    b = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("at").alias("at_purchase"))
    return joins.band_join(a, b, ["user_id"], "at_error", "at_purchase", 3600).select("error_id", "purchase_id", (F.col("at_purchase") - F.col("at_error")).alias("seconds"))


@query(f"""
WITH {FUNCTIONS}, {_PAIRS}, sym AS (SELECT repo || '/' || file_path AS file, function_name AS name, fn_id FROM functions WHERE function_name IS NOT NULL),
u AS (SELECT pair_id AS use_id, x.repo || '/' || x.file_path AS file, y.function_name AS name FROM p JOIN functions x ON x.fn_id = left_fn JOIN functions y ON y.fn_id = right_fn WHERE y.function_name IS NOT NULL),
h AS (SELECT file, name, min(fn_id) AS here FROM sym GROUP BY 1, 2), o AS (SELECT name, min(fn_id) AS one FROM sym GROUP BY 1 HAVING count(*) = 1)
SELECT use_id, coalesce(here, one) AS symbol_id FROM u LEFT JOIN h USING (file, name) LEFT JOIN o USING (name)""")
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """Each matched pair as a use of the right function's name in the left function's file."""
    rows = functions(spark, d, "repo", "file_path", "function_name").select("fn_id", F.concat_ws("/", "repo", "file_path").alias("file"), F.col("function_name").alias("name"))
    pairs = latest_by_key(read_table(spark, d, "match_pairs"), "pair_id", "ingested_at", ["left_fn", "right_fn"])
    files_of = rows.select(F.col("fn_id").alias("left_fn"), "file")
    names_of = rows.where("name is not null").select(F.col("fn_id").alias("right_fn"), "name")
    uses = pairs.join(files_of, "left_fn").join(names_of, "right_fn").select(F.col("pair_id").alias("use_id"), "file", "name")
    return joins.resolve_names(uses, rows.where("name is not null").withColumnRenamed("fn_id", "symbol_id"))


@query(f"""
WITH {FILES}, old AS (SELECT repo, file_path, max(md5(coalesce(content, ''))) AS h FROM files WHERE committed_at < TIMESTAMPTZ '2025-07-01 00:00:00+00' GROUP BY 1, 2), cur AS (SELECT repo, file_path, max(md5(coalesce(content, ''))) AS h FROM files GROUP BY 1, 2)
SELECT c.repo, c.file_path, CASE WHEN o.h IS NULL THEN 'added' WHEN o.h = c.h THEN 'unchanged' ELSE 'changed' END AS state FROM cur c LEFT JOIN old o ON o.repo IS NOT DISTINCT FROM c.repo AND o.file_path IS NOT DISTINCT FROM c.file_path""")
def incremental_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d, "repo", "file_path", "content", "committed_at").withColumn("h", F.md5(F.coalesce("content", F.lit(""))))
    manifest = lambda r, name: r.groupBy("repo", "file_path").agg(F.max("h").alias(name))
    old, cur = manifest(rows.where(F.col("committed_at") < F.lit("2025-07-01").cast("timestamp")), "old").alias("o"), manifest(rows, "cur").alias("c")
    met = cur.join(old, F.col("o.repo").eqNullSafe(F.col("c.repo")) & F.col("o.file_path").eqNullSafe(F.col("c.file_path")), "left")
    return met.select("c.repo", "c.file_path", F.when(F.col("old").isNull(), "added").when(F.col("old") == F.col("cur"), "unchanged").otherwise("changed").alias("state"))


@query("""
SELECT vec_id, round(greatest(embedding[1], 0), 6) AS a, list_max(embedding) > 0.4 OR len(list_filter(embedding, lambda x: x > 0.15)) >= 2 AS gate,
  round(CASE WHEN embedding[1] > 0.8 AND embedding[2] > 0.8 THEN greatest(embedding[3], 0.85) WHEN embedding[3] > 0.9 AND embedding[1] > 0.5 THEN greatest(embedding[3], 0.75) ELSE embedding[3] END, 6) AS score,
  round(least(embedding[1], greatest(embedding[1] * CASE label WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.75 ELSE 0.7 END, 0.35)), 6) AS discounted,
  round(least(embedding[1] * CASE WHEN label % 2 = 0 THEN 1.15 ELSE 1.2 END, 0.95), 6) AS boosted FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)""")
def score_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """The gate over all components of each vector; override, hop discount and boost, which take three scores, over the leading ones."""
    v = read_table(spark, d, "embeddings").select("vec_id", "label", S.array_passes_gate(F.col("embedding").cast("array<double>")).alias("gate"), *[F.element_at("embedding", i).cast("double").alias(f"x{i}") for i in (1, 2, 3)])
    x1, x2, x3 = F.col("x1"), F.col("x2"), F.col("x3")
    r = lambda c: F.round(c, 6)
    return v.select(
        "vec_id", r(F.greatest(x1, F.lit(0.0))).alias("a"), "gate", r(S.semantic_override(x3, x1, x2, x3)).alias("score"),
        r(S.hop_discount(x1, F.col("label"))).alias("discounted"), r(S.taint_boost(x1, F.col("label") % 2 == 0)).alias("boosted"),
    )



