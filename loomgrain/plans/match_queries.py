"""Similarity, candidate, scoring, learning and clustering queries over functions and the example library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrain.functions import scores as S
from loomgrain.functions import similarity as M
from loomgrain.functions import text as T
from loomgrain.operators import graph, matching, profile, training
from loomgrain.plans.feature_queries import FILES, FUNCTIONS, files, functions
from loomgrain.plans.registry import query
from loomgrain.tables import latest_by_key, read_table

_SIZED = """
fs AS (SELECT fn_id, list_distinct(list_filter(coalesce(ngram_hashes, []), lambda x: x IS NOT NULL)) AS g FROM functions),
es AS (SELECT example_id, pattern_id, polarity, list_distinct(list_filter(coalesce(ngram_hashes, []), lambda x: x IS NOT NULL)) AS g FROM corpus_examples),
common AS (SELECT fn_id, example_id, count(*) AS c FROM (SELECT fn_id, unnest(g) AS h FROM fs) JOIN (SELECT example_id, unnest(g) AS h FROM es) USING (h) GROUP BY 1, 2),
near AS (SELECT fn_id, example_id, pattern_id, polarity, c / (len(fs.g) + len(es.g) - c) AS j FROM common JOIN fs USING (fn_id) JOIN es USING (example_id))"""


def _clean(c: str) -> str:
    return f"list_distinct(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL))"


def examples(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "corpus_examples").where("example_id is not null")


@query(f"""
WITH {FUNCTIONS}, {_SIZED}, best AS (SELECT fn_id, example_id, j, row_number() OVER (PARTITION BY fn_id ORDER BY j DESC, example_id) AS r FROM near)
SELECT fn_id, example_id, round(j, 6) AS jaccard FROM best WHERE r = 1""")
def best_example(spark: SparkSession, d: str) -> DataFrame:
    return matching.best_example(functions(spark, d, "ngram_hashes"), examples(spark, d))


_A, _B = _clean("f.ngram_hashes"), _clean("e.ngram_hashes")


@query(f"""
WITH {FUNCTIONS}, {_SIZED}, p AS (
  SELECT fn_id, example_id, f.weighted_ngram_hashes AS w, {_A} AS a, {_B} AS b, {_clean("f.semantic_markers")} AS sa, {_clean("e.semantic_markers")} AS sb,
    f.name_segments AS na, string_split(lower(coalesce(e.function_name, '')), '_') AS nb
  FROM near JOIN functions f USING (fn_id) JOIN corpus_examples e USING (example_id) WHERE j >= 0.2),
m AS (SELECT *, len(list_intersect(a, b)) AS c, len(list_intersect(sa, sb)) AS sc, {_clean("na")} AS ta, {_clean("nb")} AS tb,
  list_distinct(list_concat(list_filter(map_keys(coalesce(w, MAP {{}})), lambda k: true), b)) AS keys FROM p)
SELECT fn_id, example_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0.5 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE c / (len(a) + len(b) - c) END, 6) AS jaccard,
  round(CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0 ELSE sc / (len(sa) + len(sb) - sc) END, 6) AS semantic,
  round(CASE WHEN len(sa) = 0 AND len(sb) = 0 THEN 1.0 WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0 ELSE sc / least(len(sa), len(sb)) END, 6) AS overlap,
  round(CASE WHEN len(sb) = 0 THEN 0.5 WHEN len(sa) = 0 THEN 0.0 ELSE sc / len(sb) END, 6) AS containment,
  round(CASE WHEN len(sa) + len(sb) = 0 THEN 0.0 ELSE sc / (len(sa) + len(sb)) END, 6) AS training,
  round(CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 WHEN len(ta) = 1 OR len(tb) = 1 THEN CASE WHEN len(list_intersect(ta, tb)) > 0 THEN 1.0 ELSE 0.0 END
    ELSE len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb))) END, 6) AS type_usage,
  round(coalesce(list_sum(list_transform(keys, lambda k: least(coalesce(w[k], 0.0), CASE WHEN list_contains(b, k) THEN 1.0 ELSE 0.0 END)))
    / nullif(list_sum(list_transform(keys, lambda k: greatest(coalesce(w[k], 0.0), CASE WHEN list_contains(b, k) THEN 1.0 ELSE 0.0 END))), 0), 0.0), 6) AS weighted
FROM m""")
def pair_similarities(spark: SparkSession, d: str) -> DataFrame:
    fns = functions(spark, d, "ngram_hashes", "weighted_ngram_hashes", "semantic_markers", "name_segments")
    lib = examples(spark, d)
    common = matching.shared_counts(fns, lib, "fn_id", "example_id", "ngram_hashes")
    f = fns.select("fn_id", F.col("ngram_hashes").alias("fa"), F.col("weighted_ngram_hashes").alias("fw"), F.col("semantic_markers").alias("fs"), F.col("name_segments").alias("fn"), F.size(M.members("ngram_hashes")).alias("nf"))
    e = lib.select("example_id", F.col("ngram_hashes").alias("ea"), F.col("semantic_markers").alias("es"), F.split(F.lower(F.coalesce("function_name", F.lit(""))), "_").alias("en"), F.size(M.members("ngram_hashes")).alias("ne"))
    near = common.join(f.select("fn_id", "nf"), "fn_id").join(e.select("example_id", "ne"), "example_id").where(F.col("common") / (F.col("nf") + F.col("ne") - F.col("common")) >= 0.2)
    p = near.select("fn_id", "example_id").join(f, "fn_id").join(e, "example_id")
    ones = F.map_from_arrays(M.members("ea"), F.transform(M.members("ea"), lambda x: F.lit(1.0)))
    measures = {
        "jaccard": M.jaccard("fa", "ea"), "semantic": M.set_jaccard("fs", "es"), "overlap": M.overlap_coefficient("fs", "es"), "containment": M.containment("fs", "es"),
        "training": M.training_overlap("fs", "es"), "type_usage": M.type_usage_overlap("fn", "en"), "weighted": M.weighted_jaccard("fw", ones),
    }
    return p.select("fn_id", "example_id", *[F.round(c, 6).alias(n) for n, c in measures.items()])


@query()
def skeleton_lcs(spark: SparkSession, d: str) -> DataFrame:
    """Order-aware similarity of skeletons, for pairs alike enough by n-grams; the cheap test is its own plan stage."""
    fns, lib = functions(spark, d, "ngram_hashes", "skeleton_hashes"), examples(spark, d)
    common = matching.shared_counts(fns, lib, "fn_id", "example_id", "ngram_hashes")
    f = fns.select("fn_id", F.col("skeleton_hashes").alias("fs"), F.size(M.members("ngram_hashes")).alias("nf"))
    e = lib.select("example_id", F.col("skeleton_hashes").alias("es"), F.size(M.members("ngram_hashes")).alias("ne"))
    near = common.join(f.select("fn_id", "nf"), "fn_id").join(e.select("example_id", "ne"), "example_id").where(F.col("common") / (F.col("nf") + F.col("ne") - F.col("common")) > 0.25)
    p = near.select("fn_id", "example_id").join(f, "fn_id").join(e, "example_id")
    return p.select("fn_id", "example_id", F.round(M.lcs_similarity("fs", "es"), 6).alias("lcs"))


_FAM16 = M.hash_family(16)
_SIG = lambda c, n: "[" + ", ".join(f"list_min(list_transform({c}, lambda x: ((x % {M.MODULUS}) * {a} + {b}) % {M.MODULUS}))" for a, b in M.hash_family(n)) + "]"


@query(f"""
WITH {FUNCTIONS}, s AS (SELECT fn_id, {_clean("ngram_hashes")} AS g FROM functions)
SELECT fn_id, CASE WHEN len(g) = 0 THEN array_to_string(list_transform(range(16), lambda i: 0), ',') ELSE array_to_string({_SIG("g", 16)}, ',') END AS signature FROM s""")
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d, "ngram_hashes").select("fn_id", F.array_join(M.minhash_signature("ngram_hashes", 16).cast("array<string>"), ",").alias("signature"))


def _bands_sql(source: str, key: str, table: str, column: str) -> str:
    return f"""SELECT {key}, '{table}' AS t, b, array_to_string(sig[b * 3 + 1:b * 3 + 3], ',') AS bucket FROM (SELECT {key}, {_SIG("g", 24)} AS sig, unnest(range(8)) AS b
      FROM (SELECT {key}, {_clean(column)} AS g FROM {source}) WHERE len(g) > 0)"""


@query(f"""
WITH {FUNCTIONS}, fb AS ({_bands_sql("functions", "fn_id", "ngram", "ngram_hashes")} UNION ALL {_bands_sql("functions", "fn_id", "skeleton", "skeleton_hashes")}),
eb AS ({_bands_sql("corpus_examples", "example_id", "ngram", "ngram_hashes")} UNION ALL {_bands_sql("corpus_examples", "example_id", "skeleton", "skeleton_hashes")}),
hits AS (SELECT DISTINCT fn_id, example_id, t FROM fb JOIN eb USING (t, b, bucket))
SELECT fn_id, example_id, count(*)::BIGINT AS tables_hit, count(*) = 2 AS hit_both FROM hits GROUP BY 1, 2""")
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return matching.banded_candidates(functions(spark, d, "ngram_hashes", "skeleton_hashes"), examples(spark, d), {"ngram": "ngram_hashes", "skeleton": "skeleton_hashes"})


_LINKS = f"""{FUNCTIONS}, sig AS (SELECT fn_id, {_SIG("g", 24)} AS sig FROM (SELECT fn_id, {_clean("ngram_hashes")} AS g FROM functions) WHERE len(g) > 0),
cls AS (SELECT sig, min(fn_id) AS class_id FROM sig GROUP BY 1), mem AS (SELECT fn_id, class_id, sig FROM sig JOIN cls USING (sig)),
bnd AS (SELECT class_id, b, sig[b * 3 + 1:b * 3 + 3] AS k FROM (SELECT class_id, sig, unnest(range(8)) AS b FROM cls)),
prs AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM bnd x JOIN bnd y ON x.b = y.b AND x.k = y.k AND x.class_id < y.class_id),
lnk AS (SELECT a, b FROM prs JOIN cls p ON p.class_id = a JOIN cls q ON q.class_id = b
  WHERE len(list_filter(range(1, 25), lambda i: p.sig[i] = q.sig[i])) / 24 >= 0.75)"""


@query(f"""
WITH {_LINKS}, deg AS (SELECT c, count(*) AS n FROM (SELECT a AS c FROM lnk UNION ALL SELECT b FROM lnk) GROUP BY 1)
SELECT fn_id, mem.class_id, coalesce(n, 0)::BIGINT AS links FROM mem LEFT JOIN deg ON deg.c = mem.class_id""")
def near_duplicate_links(spark: SparkSession, d: str) -> DataFrame:
    members, links = matching.signature_links(functions(spark, d, "ngram_hashes"), "ngram_hashes")
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(degree, "class_id", "left").select("fn_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


@query(f"""
WITH RECURSIVE {_LINKS}, adj AS (SELECT a, b FROM lnk UNION SELECT b, a FROM lnk),
walk(a, b) AS (SELECT class_id, class_id FROM cls UNION SELECT walk.a, adj.b FROM walk JOIN adj ON walk.b = adj.a),
lab AS (SELECT a AS class_id, min(b) AS cluster_id FROM walk GROUP BY 1),
m AS (SELECT mem.fn_id, cluster_id, coalesce(function_name, '') AS name, sig, count(*) OVER (PARTITION BY cluster_id) AS size FROM mem JOIN lab USING (class_id) JOIN functions USING (fn_id)),
big AS (SELECT * FROM m WHERE size > 1),
sim AS (SELECT x.fn_id, sum(CASE WHEN x.name <> y.name THEN len(list_filter(range(1, 25), lambda i: x.sig[i] = y.sig[i])) / 24 ELSE 0 END) / (any_value(x.size) - 1) AS s FROM big x JOIN big y ON x.cluster_id = y.cluster_id GROUP BY 1)
SELECT fn_id, cluster_id, size::BIGINT AS size, round(s, 6) AS mean_similarity, CASE WHEN round(s, 6) < 0.85 THEN 'inconsistent' ELSE 'consistent' END AS role FROM big JOIN sim USING (fn_id)""")
def clone_clusters(spark: SparkSession, d: str) -> DataFrame:
    fns = functions(spark, d, "ngram_hashes", "function_name")
    members, links = matching.signature_links(fns, "ngram_hashes")
    labels = graph.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("class_id"), "label")
    placed = members.join(labels, "class_id", "left").select("fn_id", F.coalesce("label", "class_id").alias("cluster_id"), "sig")
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select("cluster_id")
    rows = placed.join(sizes, "cluster_id").join(fns.select("fn_id", F.col("function_name").alias("name")), "fn_id")
    return matching.member_roles(rows)


@query(f"""
WITH {FUNCTIONS}, o AS (SELECT DISTINCT fn_id, h FROM (SELECT fn_id, unnest(ngram_hashes) AS h FROM functions) WHERE h IS NOT NULL)
SELECT h AS ngram_hash, count(*)::BIGINT AS df, round(ln((SELECT count(DISTINCT fn_id) FROM o) / count(*)), 6) AS idf FROM o GROUP BY 1""")
def ngram_idf(spark: SparkSession, d: str) -> DataFrame:
    long = functions(spark, d, "ngram_hashes").select("fn_id", F.explode(M.members("ngram_hashes")).alias("ngram_hash"))
    return matching.document_frequency(long, "ngram_hash", "fn_id").withColumn("idf", F.round("idf", 6))


@query("""
WITH entries AS (SELECT DISTINCT ON (entry_id) * FROM auto_filters WHERE entry_id IS NOT NULL ORDER BY entry_id, ingested_at DESC),
o AS (SELECT DISTINCT pattern_id, c FROM (SELECT pattern_id, unnest(required_calls) AS c FROM entries) WHERE c IS NOT NULL AND pattern_id IS NOT NULL)
SELECT c AS call_name, count(*)::BIGINT AS df, round(ln((SELECT count(DISTINCT pattern_id) FROM o) / count(*)), 6) AS idf FROM o GROUP BY 1""")
def api_idf(spark: SparkSession, d: str) -> DataFrame:
    entries = latest_by_key(read_table(spark, d, "auto_filters"), "entry_id", "ingested_at", ["pattern_id", "required_calls"])
    long = entries.where("pattern_id is not null").select("pattern_id", F.explode(M.members("required_calls")).alias("call_name"))
    return matching.document_frequency(long, "call_name", "pattern_id").withColumn("idf", F.round("idf", 6))


@query(f"""
WITH {FUNCTIONS}, o AS (SELECT fn_id, function_name, unnest(regexp_extract_all(coalesce(function_name, ''), '([A-Z]?[a-z]+)', 1)) AS c FROM functions),
df AS (SELECT c, ln((SELECT count(DISTINCT fn_id) FROM o) / count(DISTINCT fn_id)) AS idf FROM o GROUP BY 1),
r AS (SELECT fn_id, c, row_number() OVER (PARTITION BY fn_id ORDER BY idf DESC, c) AS k FROM (SELECT DISTINCT fn_id, c FROM o) JOIN df USING (c))
SELECT fn_id, c AS term, k::BIGINT AS place FROM r WHERE k <= 3""")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The three rarest words of each function's name: a top-k report."""
    long = functions(spark, d, "function_name").select("fn_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("function_name", F.lit("")), F.lit("([A-Z]?[a-z]+)"), 1))).alias("term"))
    idf = matching.document_frequency(long, "term", "fn_id")
    place = F.row_number().over(Window.partitionBy("fn_id").orderBy(F.desc("idf"), "term"))
    return long.join(idf, "term").withColumn("place", place.cast("long")).where("place <= 3").select("fn_id", "term", "place")


_SIDES = "SELECT pattern_id, count(*) FILTER (polarity = 'positive') AS np, count(*) FILTER (polarity = 'negative') AS nn FROM corpus_examples GROUP BY 1"


def _constraint_sql(kind: str, c: str) -> str:
    return f"""SELECT pattern_id, '{kind}' AS kind, f AS feature, count(DISTINCT example_id) FILTER (polarity = 'positive') AS p, count(DISTINCT example_id) FILTER (polarity = 'negative') AS n
      FROM (SELECT pattern_id, polarity, example_id, unnest({c}) AS f FROM corpus_examples) WHERE f IS NOT NULL GROUP BY 1, 3"""


@query(f"""
WITH sides AS ({_SIDES}), got AS ({_constraint_sql("call", "semantic_markers")} UNION ALL {_constraint_sql("node", "structural_markers")}),
r AS (SELECT pattern_id, kind, feature, CASE WHEN p = np AND n = 0 THEN 'required' WHEN n = nn AND p = 0 THEN 'forbidden' END AS "constraint" FROM got JOIN sides USING (pattern_id) WHERE np > 0 AND nn > 0)
SELECT * FROM r WHERE "constraint" IS NOT NULL""")
def learned_constraints(spark: SparkSession, d: str) -> DataFrame:
    return matching.learned_constraints(examples(spark, d), {"call": "semantic_markers", "node": "structural_markers"})


@query("""
WITH o AS (SELECT pattern_id, f, min(polarity) AS lo, max(polarity) AS hi FROM (SELECT pattern_id, polarity, unnest(ngram_hashes) AS f FROM corpus_examples) WHERE f IS NOT NULL GROUP BY 1, 2),
b AS (SELECT pattern_id FROM corpus_examples GROUP BY 1 HAVING count(DISTINCT polarity) = 2)
SELECT pattern_id, f AS feature, lo AS only_in FROM o JOIN b USING (pattern_id) WHERE lo = hi""")
def auto_filter_diff(spark: SparkSession, d: str) -> DataFrame:
    return matching.exclusive_features(examples(spark, d), "ngram_hashes")


@query("""
WITH n AS (SELECT pattern_id, floor(count(*) * 0.8) AS need FROM corpus_examples WHERE polarity = 'negative' GROUP BY 1),
x AS (SELECT pattern_id, function_name, count(*)::BIGINT AS n FROM corpus_examples WHERE polarity = 'negative' AND function_name IS NOT NULL AND function_name <> 'anonymous' GROUP BY 1, 2)
SELECT x.pattern_id, x.function_name, x.n FROM x JOIN n USING (pattern_id) WHERE x.n >= need AND EXISTS (SELECT 1 FROM corpus_examples p WHERE p.polarity = 'positive' AND p.pattern_id = x.pattern_id)
  AND NOT EXISTS (SELECT 1 FROM corpus_examples p WHERE p.polarity = 'positive' AND p.pattern_id = x.pattern_id AND p.function_name = x.function_name)""")
def excluded_names(spark: SparkSession, d: str) -> DataFrame:
    return matching.common_negative_names(examples(spark, d))


@query("""
WITH o AS (SELECT lower(s) AS segment, coalesce(nullif(string_split(pattern_id, '_')[2], ''), 'unknown') AS category FROM
  (SELECT pattern_id, unnest(list_filter(string_split(regexp_replace(coalesce(function_name, ''), '([A-Z])', '_\\1', 'g'), '_'), lambda p: p <> '')) AS s FROM corpus_examples)),
c AS (SELECT segment, category, count(*)::BIGINT AS n FROM o GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT segment, category, n FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, category) AS r FROM c) WHERE r = 1""")
def learned_markers(spark: SparkSession, d: str) -> DataFrame:
    """The category that a name segment speaks for: at least twice, most often, the first by name of equals."""
    long = examples(spark, d).select(T.category_of(F.col("pattern_id")).alias("category"), F.explode(T.name_segments(F.col("function_name"))).alias("s"))
    counts = long.groupBy(F.lower("s").alias("segment"), "category").agg(F.count("*").alias("n")).where("n >= 2")
    best = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("n"), "category"))
    return counts.withColumn("_r", best).where("_r = 1").drop("_r")


@query(f"""
WITH {FILES}, o AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(coalesce(content, ''), '([A-Za-z_$][A-Za-z0-9_$.:]*)\\(', 1)) AS c FROM files)
SELECT c AS call_name, count(*)::BIGINT AS files, CASE WHEN count(*) >= 20 THEN 'strong' WHEN count(*) >= 5 THEN 'usual' ELSE 'weak' END AS tier FROM o GROUP BY 1 HAVING count(*) >= 2""")
def call_registry(spark: SparkSession, d: str) -> DataFrame:
    """Calls counted once per file, those of one file only left out."""
    long = files(spark, d, "content").select("file_id", F.explode(T.call_targets(F.col("content"))).alias("call_name"))
    counts = long.groupBy("call_name").agg(F.count("*").alias("files")).where("files >= 2")
    return counts.withColumn("tier", F.when(F.col("files") >= 20, "strong").when(F.col("files") >= 5, "usual").otherwise("weak"))


def _dims_sql() -> str:
    def j(a: str, b: str, empty: str) -> str:
        return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {empty} WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"

    o = "CASE WHEN len(fs) = 0 AND len(es) = 0 THEN 1.0 WHEN len(fs) = 0 OR len(es) = 0 THEN 0.0 ELSE len(list_intersect(fs, es)) / least(len(fs), len(es)) END"
    return f"{j('fg', 'eg', '0.5')} AS ngram, {o} AS ast, {j('fm', 'em', '0.0')} AS semantic, {j('fk', 'ek', '0.5')} AS skeleton"


@query(f"""
WITH {FUNCTIONS}, {_SIZED}, cand AS (SELECT DISTINCT fn_id, pattern_id FROM near WHERE polarity = 'positive' AND j >= 0.05),
p AS (SELECT fn_id, c.pattern_id, example_id, polarity, coalesce(lower(trim(f.language)), 'unknown') AS fl, coalesce(e.language, 'unknown') AS el,
  {_clean("f.ngram_hashes")} AS fg, {_clean("e.ngram_hashes")} AS eg, {_clean("f.structural_markers")} AS fs, {_clean("e.structural_markers")} AS es,
  {_clean("f.semantic_markers")} AS fm, {_clean("e.semantic_markers")} AS em, {_clean("f.skeleton_hashes")} AS fk, {_clean("e.skeleton_hashes")} AS ek
  FROM cand c JOIN corpus_examples e USING (pattern_id) JOIN functions f USING (fn_id)),
d AS (SELECT fn_id, pattern_id, example_id, polarity, fl, el, {_dims_sql()} FROM p),
t AS (SELECT *, 0.0 + ngram * 0.4 + ast * 0.2 + semantic * 0.2 + skeleton * 0.2 AS total FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY fn_id, pattern_id ORDER BY total * CASE WHEN fl = el OR fl = 'unknown' OR el = 'unknown' OR (fl IN ('typescript', 'javascript') AND el IN ('typescript', 'javascript')) THEN 1.0 ELSE 0.2 END DESC, example_id) AS r FROM t WHERE polarity = 'positive'),
n AS (SELECT fn_id, pattern_id, max(ngram) AS n1, max(ast) AS n2, max(semantic) AS n3, max(skeleton) AS n4 FROM t WHERE polarity <> 'positive' GROUP BY 1, 2),
s AS (SELECT fn_id, pattern_id, example_id, total, greatest(ngram - coalesce(n1, 0), 0) AS a1, greatest(ast - coalesce(n2, 0), 0) AS a2, greatest(semantic - coalesce(n3, 0), 0) AS a3, greatest(skeleton - coalesce(n4, 0), 0) AS a4
  FROM b LEFT JOIN n USING (fn_id, pattern_id) WHERE r = 1 AND ast >= 0.05),
g AS (SELECT fn_id, pattern_id, example_id, greatest(a1, a2, a3, a4) AS signal,
  CASE WHEN greatest(a1, a2, a3, a4) > 0.4 OR (a1 > 0.15)::INT + (a2 > 0.15)::INT + (a3 > 0.15)::INT + (a4 > 0.15)::INT >= 2 THEN total ELSE 0.0 END AS score FROM s)
SELECT fn_id, pattern_id, example_id, round(score, 6) AS score, round(signal, 6) AS signal, round(1 / (1 + exp(-greatest(least(score * 8.0 - 3.2, 20), -20))), 6) AS calibrated FROM g""")
def contrastive_scores(spark: SparkSession, d: str) -> DataFrame:
    fns = functions(spark, d, "language", *matching.FEATURES)
    out = matching.contrastive_scores(fns, examples(spark, d))
    return out.select("fn_id", "pattern_id", "example_id", *[F.round(c, 6).alias(c) for c in ("score", "signal", "calibrated")])


@query()
def contrastive_scores_whole(spark: SparkSession, d: str) -> DataFrame:
    """``contrastive_scores`` without the floor on n-grams: a pattern is scored if a positive shares any member of any dimension."""
    out = matching.contrastive_scores(functions(spark, d, "language", *matching.FEATURES), examples(spark, d), None)
    return out.select("fn_id", "pattern_id", "example_id", *[F.round(c, 6).alias(c) for c in ("score", "signal", "calibrated")])


@query("""
WITH p AS (SELECT DISTINCT ON (pair_id) * FROM match_pairs WHERE pair_id IS NOT NULL ORDER BY pair_id, ingested_at DESC),
c AS (SELECT left_fn, count(*) AS m, count(*) FILTER (signature_sim >= 0.75) AS v FROM p WHERE left_fn IS NOT NULL GROUP BY 1)
SELECT left_fn AS fn_id, m::BIGINT AS matches, v::BIGINT AS verified, round((0.8 + 0.2 * v / m) * pow(0.95, m / 20), 6) AS freshness FROM c""")
def freshness_scores(spark: SparkSession, d: str) -> DataFrame:
    pairs = latest_by_key(read_table(spark, d, "match_pairs"), "pair_id", "ingested_at", ["left_fn", "signature_sim"])
    counts = pairs.where("left_fn is not null").groupBy(F.col("left_fn").alias("fn_id")).agg(F.count("*").alias("matches"), F.count_if(F.col("signature_sim") >= 0.75).alias("verified"))
    return counts.withColumn("freshness", F.round(S.freshness(F.col("matches"), F.col("verified")), 6))


@query()
def platt_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Calibration of pair similarities by run, the label being that both functions have one language."""
    pairs = latest_by_key(read_table(spark, d, "match_pairs"), "pair_id", "ingested_at", ["run_id", "left_fn", "right_fn", "signature_sim"])
    langs = functions(spark, d, "language").select("fn_id", F.lower("language").alias("language"))
    both = pairs.join(langs.withColumnsRenamed({"fn_id": "left_fn", "language": "la"}), "left_fn").join(langs.withColumnsRenamed({"fn_id": "right_fn", "language": "lb"}), "right_fn")
    return training.platt_calibration(both.select("run_id", "signature_sim", (F.col("la") == F.col("lb")).alias("same")), "run_id", "signature_sim", "same")


@query()
def category_weights(spark: SparkSession, d: str) -> DataFrame:
    lib = examples(spark, d)
    dims = matching.dimensions("a_", "b_")
    side = lambda p: lib.select("pattern_id", F.col("example_id").alias(f"{p}id"), F.col("polarity").alias(f"{p}pol"), *[F.col(c).alias(f"{p}{c}") for c in matching.FEATURES])
    pairs = side("a_").where("a_pol = 'positive'").join(side("b_"), "pattern_id").where("(b_pol = 'negative') or (b_pol = 'positive' and a_id < b_id)")
    rows = pairs.select(T.category_of(F.col("pattern_id")).alias("category"), F.when(F.col("b_pol") == "positive", 1.0).otherwise(0.0).alias("label"), *[c.alias(n) for n, c in dims.items()])
    return training.category_weights(rows, list(dims))


@query("""
SELECT coalesce(nullif(string_split(pattern_id, '_')[2], ''), 'unknown') AS category, language, count(DISTINCT pattern_id)::BIGINT AS patterns, count(*) FILTER (polarity = 'positive')::BIGINT AS positives,
  count(*) FILTER (polarity = 'negative')::BIGINT AS negatives, count(*) FILTER (len(coalesce(semantic_markers, [])) > 0)::BIGINT AS with_semantics FROM corpus_examples GROUP BY 1, 2""")
def bundle_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    lib = examples(spark, d).groupBy(T.category_of(F.col("pattern_id")).alias("category"), "language")
    return lib.agg(F.countDistinct("pattern_id").alias("patterns"), F.count_if(F.col("polarity") == "positive").alias("positives"), F.count_if(F.col("polarity") == "negative").alias("negatives"), F.count_if(F.size(F.coalesce("semantic_markers", F.array())) > 0).alias("with_semantics"))


_LONG = """SELECT fn_id, language, function_name, line, 'ngram' AS kind, unnest(ngram_hashes)::VARCHAR AS feature FROM {0} UNION ALL SELECT fn_id, language, function_name, line, 'segment', unnest(name_segments) FROM {0}
  UNION ALL SELECT fn_id, language, function_name, line, 'structure', unnest(structural_markers)::VARCHAR FROM {0}"""
_HALVES = "old AS (SELECT * FROM functions WHERE extracted_at < TIMESTAMPTZ '2025-07-01 00:00:00+00'), new AS (SELECT * FROM functions WHERE NOT coalesce(extracted_at < TIMESTAMPTZ '2025-07-01 00:00:00+00', false))"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Functions of the profile (extracted before the middle of the year) and those held against it."""
    rows = functions(spark, d, "language", "function_name", "line", "file_path", "extracted_at", *profile.KINDS.values())
    early = F.coalesce(F.col("extracted_at") < F.lit("2025-07-01").cast("timestamp"), F.lit(False))
    return rows.where(early), rows.where(~early)


@query(f"""
WITH {FUNCTIONS}, {_HALVES}, lo AS (SELECT * FROM ({_LONG.format("old")}) WHERE feature IS NOT NULL), ln AS (SELECT * FROM ({_LONG.format("new")}) WHERE feature IS NOT NULL),
k AS (SELECT DISTINCT language, kind, feature, 1 AS seen FROM lo WHERE language IS NOT NULL),
c AS (SELECT fn_id, count(*) AS n, count(*) FILTER (seen IS NULL) AS u FROM ln LEFT JOIN k USING (language, kind, feature) GROUP BY 1)
SELECT n.fn_id, coalesce(c.n, 0)::BIGINT AS features, coalesce(u, 0)::BIGINT AS unseen, round(CASE WHEN n.language IS NULL OR n.language NOT IN (SELECT language FROM k) THEN 1.0 WHEN c.n IS NULL THEN 0.0 ELSE u / c.n END, 6) AS surprise
FROM new n LEFT JOIN c USING (fn_id)""")
def style_surprise(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return profile.style_surprise(new, profile.long_features(old))


_DIR = "array_to_string(string_split(file_path, '/')[1:len(string_split(file_path, '/')) - 1][greatest(len(string_split(file_path, '/')) - 3, 1):], '/')"


@query(f"""
WITH {FUNCTIONS}, {_HALVES}, k AS (SELECT DISTINCT language, {_DIR} AS folder, unnest(ngram_hashes) AS h, 1 AS seen FROM old), kk AS (SELECT * FROM k WHERE h IS NOT NULL AND language IS NOT NULL AND folder IS NOT NULL),
l AS (SELECT fn_id, language, {_DIR} AS folder, unnest(ngram_hashes) AS h FROM new),
c AS (SELECT fn_id, language, folder, count(*) AS n, count(*) FILTER (seen IS NULL) AS u FROM (SELECT * FROM l WHERE h IS NOT NULL) LEFT JOIN kk USING (language, folder, h) GROUP BY 1, 2, 3),
s AS (SELECT fn_id, CASE WHEN EXISTS (SELECT 1 FROM kk WHERE kk.language = c.language AND kk.folder = c.folder) THEN u / n ELSE 0.0 END AS s FROM c)
SELECT n.fn_id, round(coalesce(s, 0.0), 6) AS surprise FROM new n LEFT JOIN s USING (fn_id)""")
def directory_surprise(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return profile.directory_surprise(new, old)


@query(f"""
WITH {FUNCTIONS}, l AS (SELECT language, kind, feature, coalesce(function_name, '') || ':' || coalesce(line::VARCHAR, '') AS place FROM ({_LONG.format("functions")}) WHERE feature IS NOT NULL)
SELECT language, kind, feature, count(*)::BIGINT AS n, array_to_string(list_sort(list_distinct(list(place)))[1:3], '|') AS examples FROM l GROUP BY 1, 2, 3""")
def profile_frequencies(spark: SparkSession, d: str) -> DataFrame:
    rows = functions(spark, d, "language", "function_name", "line", *profile.KINDS.values())
    return profile.learn_profile(rows).withColumn("examples", F.array_join("examples", "|"))


@query(f"""
WITH {FUNCTIONS}, g AS (SELECT ngram_hashes, structural_markers, semantic_markers, skeleton_hashes, min(fn_id) AS group_id, count(*) AS n FROM functions GROUP BY 1, 2, 3, 4)
SELECT fn_id, group_id, n::BIGINT AS copies FROM functions f JOIN g ON g.ngram_hashes IS NOT DISTINCT FROM f.ngram_hashes AND g.structural_markers IS NOT DISTINCT FROM f.structural_markers
  AND g.semantic_markers IS NOT DISTINCT FROM f.semantic_markers AND g.skeleton_hashes IS NOT DISTINCT FROM f.skeleton_hashes""")
def identical_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Functions that need scoring only once: equal in four dimensions, grouped by a hash of them."""
    dims = [F.coalesce(F.to_json(F.array(F.to_json(c))), F.lit("-")) for c in matching.FEATURES]
    rows = functions(spark, d, *matching.FEATURES).select("fn_id", F.sha2(F.concat_ws("|", *dims), 256).alias("k"))
    groups = rows.groupBy("k").agg(F.min("fn_id").alias("group_id"), F.count("*").alias("copies"))
    return rows.join(groups, "k").select("fn_id", "group_id", "copies")


@query(f"""
WITH {FUNCTIONS} SELECT fn_id, len(coalesce(structural_markers, [])) >= 3 AND (len(coalesce(skeleton_hashes, [])) > 0 OR len(coalesce(semantic_markers, [])) > 0) AS nontrivial,
  NOT coalesce(is_registered_handler, false) OR NOT regexp_matches(lower(coalesce(function_name, '')), 'fetch|store|load') AS compatible_with_db FROM functions""")
def function_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = functions(spark, d, "structural_markers", "skeleton_hashes", "semantic_markers", "is_registered_handler", "function_name")
    role = F.when(F.coalesce("is_registered_handler", F.lit(False)), "handler").otherwise("unknown")
    other = F.when(F.lower(F.coalesce("function_name", F.lit(""))).rlike("fetch|store|load"), "db").otherwise("unknown")
    return rows.select("fn_id", matching.nontrivial(F.col("structural_markers"), F.col("skeleton_hashes"), F.col("semantic_markers")).alias("nontrivial"), matching.role_compatible(role, other).alias("compatible_with_db"))



