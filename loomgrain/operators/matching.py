"""Matching functions against a library of labelled examples: candidates, dimensions, gates and scores.

The library is a table like any other here. It is usually small, and then the optimiser broadcasts it by its
measured size; nothing depends on that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.functions import scores as S
from loomgrain.functions import similarity as M
from loomgrain.operators import contrast
from loomgrain.session import cut_lineage
from loomgrain.skew import cell_pairs, hot_join, with_stats
from loomgrain.tables import wide_hash

STRONG, MODERATE = 0.4, 0.15
WEIGHTS = {"ngram": 0.4, "ast": 0.2, "semantic": 0.2, "skeleton": 0.2}


def document_frequency(long: DataFrame, term: str, holder: str) -> DataFrame:
    """``term``, ``df`` (distinct holders) and ``idf`` = ln(N / df), without smoothing; N counts the holders in ``long``."""
    df = long.select(term, holder).distinct().groupBy(term).agg(F.count("*").alias("df"))
    total = long.agg(F.countDistinct(holder)).scalar()
    return df.select(term, "df", F.ln(total / F.col("df")).alias("idf"))


def shared_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, items: str) -> DataFrame:
    """``(left_key, right_key, common)`` for all pairs that share a member, by an inverted index."""
    a = left.select(left_key, F.explode(M.members(items)).alias("_i"))
    b = right.select(right_key, F.explode(M.members(items)).alias("_i"))
    return a.join(b, "_i").groupBy(left_key, right_key).agg(F.count("*").alias("common"))


def best_example(functions: DataFrame, examples: DataFrame) -> DataFrame:
    """The example each function is most like by its n-grams (ties: the least example), functions that share none left out."""
    sized_f = functions.select("fn_id", "ngram_hashes", F.size(M.members("ngram_hashes")).alias("nf"))
    sized_e = examples.select("example_id", "ngram_hashes", F.size(M.members("ngram_hashes")).alias("ne"))
    common = shared_counts(sized_f, sized_e, "fn_id", "example_id", "ngram_hashes")
    scored = common.join(sized_f.select("fn_id", "nf"), "fn_id").join(sized_e.select("example_id", "ne"), "example_id")
    scored = scored.withColumn("jaccard", F.col("common") / (F.col("nf") + F.col("ne") - F.col("common")))
    best = F.max(F.struct("jaccard", (-F.col("example_id")).alias("e"))).alias("b")
    return scored.groupBy("fn_id").agg(best).select("fn_id", (-F.col("b.e")).alias("example_id"), F.round("b.jaccard", 6).alias("jaccard"))


def effective_bands(hashes: int, bands: int, rows: int, strict_compat: bool = False) -> int:
    """How many bands a signature fills: all that are asked for must fit, unless ``strict_compat``, where those beyond its end stay empty."""
    if bands * rows > hashes and not strict_compat:
        raise ValueError(f"{bands} bands of {rows} rows need {bands * rows} hashes, not {hashes}")
    return min(bands, hashes // rows)


def banded_candidates(functions: DataFrame, examples: DataFrame, tables: dict[str, str], bands: int = 8, rows: int = 3) -> DataFrame:
    """Candidate pairs from one banded index per feature column, with the number of indexes hit and ``hit_both``.

    Empty sets are in no index. Buckets are joined on equality; a pair is counted once per index.
    """

    def index(df: DataFrame, key: str) -> DataFrame:
        # the signatures of all tables in one projection: one pass over the rows in Python
        signed = df.select(key, *[M.minhash_signature(c, bands * rows).alias(f"_s{i}") for i, c in enumerate(tables.values())], *[(F.size(M.members(c)) > 0).alias(f"_h{i}") for i, c in enumerate(tables.values())])
        buckets = [
            F.when(F.col(f"_h{i}"), F.struct(F.lit(i).alias("table"), F.xxhash64(F.lit(i), F.lit(b), F.slice(f"_s{i}", b * rows + 1, rows)).alias("bucket")))
            for i in range(len(tables)) for b in range(bands)
        ]
        return signed.select(key, F.explode(F.array_compact(F.array(*buckets))).alias("k")).select(key, "k.table", "k.bucket")

    met = index(functions, "fn_id").join(index(examples, "example_id"), ["table", "bucket"])
    hits = met.groupBy("fn_id", "example_id").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1, table)"))).cast("long").alias("tables_hit"))
    return hits.withColumn("hit_both", F.col("tables_hit") == len(tables))


def role_compatible(a: Column, b: Column) -> Column:
    """A request handler is neither a shell executor nor a database query."""
    inner = ["shell", "db"]
    return ~((a == "handler") & b.isin(inner) | a.isin(inner) & (b == "handler"))


def nontrivial(structural: Column, control: Column, calls: Column) -> Column:
    """At least three structural markers, and some control flow or call."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return (size(structural) >= 3) & ((size(control) > 0) | (size(calls) > 0))


def dimensions(prefix_f: str = "f_", prefix_e: str = "e_") -> dict[str, Column]:
    f, e = (lambda c: F.col(prefix_f + c)), (lambda c: F.col(prefix_e + c))
    return {
        "ngram": M.jaccard(f("ngram_hashes"), e("ngram_hashes")),
        "ast": M.overlap_coefficient(f("structural_markers"), e("structural_markers")),
        "semantic": M.set_jaccard(f("semantic_markers"), e("semantic_markers")),
        "skeleton": M.jaccard(f("skeleton_hashes"), e("skeleton_hashes")),
    }


FEATURES = ["ngram_hashes", "structural_markers", "semantic_markers", "skeleton_hashes"]


def _near_patterns(functions: DataFrame, examples: DataFrame, least_ngram: float) -> DataFrame:
    common = shared_counts(functions, examples.where("polarity = 'positive'"), "fn_id", "example_id", "ngram_hashes")
    sizes_f = functions.select("fn_id", F.size(M.members("ngram_hashes")).alias("nf"))
    sizes_e = examples.select("example_id", "pattern_id", F.size(M.members("ngram_hashes")).alias("ne"))
    near = common.join(sizes_f, "fn_id").join(sizes_e, "example_id").where(F.col("common") >= F.lit(least_ngram) * (F.col("nf") + F.col("ne") - F.col("common")))
    return near.select("fn_id", "pattern_id").distinct()


def contrastive_scores(functions: DataFrame, examples: DataFrame, least_ngram: float | None = 0.05, calibrate: Callable[[Column], Column] = S.sigmoid) -> DataFrame:
    """Scores of (function, pattern): best positive against the worst of the negatives, per dimension.

    Candidates share n-grams with a positive to at least ``least_ngram``, or, if that is None, any member of any
    dimension; the structural gate wants some marker in common. The signal of a dimension is what the best positive has over the most similar negative; one strong
    signal or two moderate ones open the gate, else the score is 0. Patterns without positives match nothing.
    """
    if least_ngram is None:
        columns = dict(zip(WEIGHTS, FEATURES))
        out = contrast.whole_scores(functions, examples, WEIGHTS, columns, 0.05, STRONG, MODERATE)
        return out.withColumn("calibrated", calibrate(F.col("score")))
    candidates = _near_patterns(functions, examples, least_ngram)
    lib = examples.select("pattern_id", "example_id", "polarity", F.col("language").alias("e_language"), *[F.col(c).alias(f"e_{c}") for c in FEATURES])
    fns = functions.select("fn_id", F.lower(F.trim("language")).alias("f_language"), *[F.col(c).alias(f"f_{c}") for c in FEATURES])
    pairs = candidates.join(lib, "pattern_id").join(fns, "fn_id")
    dims = dimensions()
    scored = pairs.select("fn_id", "pattern_id", "example_id", "polarity", "f_language", "e_language", *[c.alias(n) for n, c in dims.items()])
    total = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    positive = F.col("polarity") == "positive"
    ranked = total * S.cross_lingual_penalty(F.col("e_language"), F.col("f_language"))
    best = F.max(F.when(positive, F.struct(ranked.alias("rank"), (-F.col("example_id")).alias("e"), total.alias("score"), *dims)))
    worst = [F.coalesce(F.max(F.when(~positive, F.col(n))), F.lit(0.0)).alias(f"neg_{n}") for n in dims]
    per = scored.groupBy("fn_id", "pattern_id").agg(best.alias("b"), *worst).where("b is not null and b.ast >= 0.05")
    signals = [F.greatest(F.col(f"b.{n}") - F.col(f"neg_{n}"), F.lit(0.0)) for n in dims]
    gate = S.passes_noise_gate(signals, STRONG, MODERATE)
    out = per.select("fn_id", "pattern_id", (-F.col("b.e")).alias("example_id"), F.when(gate, F.col("b.score")).otherwise(0.0).alias("score"), F.greatest(*signals).alias("signal"))
    return out.withColumn("calibrated", calibrate(F.col("score")))


def learned_constraints(examples: DataFrame, features: dict[str, str]) -> DataFrame:
    """``(pattern_id, kind, feature, constraint)``: required if in all positives and no negative, forbidden if the converse."""
    sides = examples.groupBy("pattern_id").agg(F.count_if(F.col("polarity") == "positive").alias("np"), F.count_if(F.col("polarity") == "negative").alias("nn")).where("np > 0 and nn > 0")
    parts = None
    for kind, column in features.items():
        long = examples.select("pattern_id", "polarity", F.explode(M.members(column)).alias("feature"))
        got = long.groupBy("pattern_id", "feature").agg(F.count_if(F.col("polarity") == "positive").alias("p"), F.count_if(F.col("polarity") == "negative").alias("n")).join(sides, "pattern_id")
        rule = F.when((F.col("p") == F.col("np")) & (F.col("n") == 0), "required").when((F.col("n") == F.col("nn")) & (F.col("p") == 0), "forbidden")
        part = got.select("pattern_id", F.lit(kind).alias("kind"), "feature", rule.alias("constraint")).where("constraint is not null")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def exclusive_features(examples: DataFrame, column: str) -> DataFrame:
    """``(pattern_id, feature, only_in)``: features of the positives alone or of the negatives alone."""
    long = examples.select("pattern_id", "polarity", F.explode(M.members(column)).alias("feature"))
    both = examples.groupBy("pattern_id").agg(F.countDistinct("polarity").alias("k")).where("k = 2").select("pattern_id")
    sides = long.groupBy("pattern_id", "feature").agg(F.min("polarity").alias("lo"), F.max("polarity").alias("hi")).where("lo = hi")
    return sides.join(both, "pattern_id").select("pattern_id", "feature", F.col("lo").alias("only_in"))


def common_negative_names(examples: DataFrame, share: float = 0.8) -> DataFrame:
    """Function names that at least ``share`` of a pattern's negatives have (rounded down) and no positive has."""
    neg, pos = examples.where("polarity = 'negative'"), examples.where("polarity = 'positive'")
    n = neg.groupBy("pattern_id").agg(F.floor(F.count("*") * share).alias("need"))
    names = neg.where("function_name is not null and function_name != 'anonymous'").groupBy("pattern_id", "function_name").agg(F.count("*").alias("n"))
    kept = names.join(n, "pattern_id").where("n >= need").join(pos.select("pattern_id").distinct(), "pattern_id", "left_semi")
    return kept.join(pos.select("pattern_id", "function_name").distinct(), ["pattern_id", "function_name"], "left_anti").select("pattern_id", "function_name", "n")


def signature_links(functions: DataFrame, column: str, limit: float = 0.75, bands: int = 8, rows: int = 3) -> tuple[DataFrame, DataFrame]:
    """Members ``(fn_id, class_id, sig)`` of classes of equal signatures, and the class pairs ``(a, b)`` whose signatures are alike to at least ``limit``.

    Copies are one class, so a bucket holds different signatures only. Empty sets have no class.
    """
    signed = functions.where(F.size(M.members(column)) > 0).select("fn_id", M.minhash_signature(column, bands * rows).alias("sig"))
    signed = cut_lineage(signed.withColumn("h", wide_hash("sig")))  # used twice below
    members = cut_lineage(with_stats(signed.select("fn_id", "h"), "h", {"class_id": F.min("fn_id")}).select("fn_id", "class_id"))
    classes = cut_lineage(signed.join(members.where("fn_id = class_id"), "fn_id").select("class_id", "sig"))
    bucket = F.explode(F.array(*[F.xxhash64(F.lit(b), F.slice("sig", b * rows + 1, rows)) for b in range(bands)]))
    pairs = cell_pairs(classes.select("class_id", bucket.alias("k")), "k", "class_id").distinct()
    sig = lambda x: classes.select(F.col("class_id").alias(x), F.col("sig").alias(f"s{x}"))
    linked = pairs.join(sig("a"), "a").join(sig("b"), "b").where(M.signature_similarity("sa", "sb") >= limit).select("a", "b")
    return hot_join(members, classes, "class_id").select("fn_id", "class_id", "sig"), linked


def member_roles(members: DataFrame, limit: float = 0.85) -> DataFrame:
    """Mean signature similarity of each member to the others of its cluster of another name, and its role.

    ``members(fn_id, cluster_id, name, sig)``. Equal positions are counted per value, so a cluster costs its size
    and not its square. As the divisor is the cluster's size less one, members of one name lower the mean.
    """
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    spread = members.select("fn_id", "cluster_id", F.coalesce("name", F.lit("")).alias("name"), F.posexplode("sig").alias("pos", "value"))
    named = spread.groupBy("cluster_id", "pos", "value", "name").agg(F.count("*").alias("same"))
    allv = named.groupBy("cluster_id", "pos", "value").agg(F.sum("same").alias("every"))
    at = ["cluster_id", "pos", "value"]
    hits = spread.join(named, [*at, "name"]).join(allv, at).groupBy("fn_id", "cluster_id").agg(F.sum(F.col("every") - F.col("same")).alias("hits"), F.count("*").alias("width"))
    mean = F.try_divide(F.col("hits") / F.col("width"), F.col("size") - 1)
    out = hits.join(size, "cluster_id").select("fn_id", "cluster_id", "size", F.round(mean, 6).alias("mean_similarity"))
    return out.withColumn("role", F.when(F.col("size") <= 1, "consistent").when(F.col("mean_similarity") < limit, "inconsistent").otherwise("consistent"))


# Categories that make a member of a cluster safe or unsafe whatever the others are like.
GUARDING = ["sanitize", "auth_middleware"]
DANGEROUS = ["cmd_exec", "code_eval", "db_query", "db_write", "dom_xss"]


def marked_roles(roles: DataFrame, markers: DataFrame, category_hashes: dict[str, int]) -> DataFrame:
    """``roles(fn_id, ..., role)`` with ``safe`` for members that guard and do nothing dangerous, ``unsafe`` for the converse.

    ``markers(fn_id, semantic_markers)``; ``category_hashes`` gives the marker of each category. Others keep their role.
    """
    some = lambda names: F.arrays_overlap("_m", F.array(*[F.lit(category_hashes[n]).cast("long") for n in names]))
    rows = roles.join(markers.select("fn_id", M.members("semantic_markers").alias("_m")), "fn_id", "left").withColumn("_m", F.coalesce("_m", F.array().cast("array<bigint>")))
    guards, danger = some(GUARDING), some(DANGEROUS)
    return rows.withColumn("role", F.when(guards & ~danger, "safe").when(danger & ~guards, "unsafe").otherwise(F.col("role"))).drop("_m")
