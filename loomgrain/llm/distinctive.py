"""Problem 1: how characteristic a term is of a record.

Method: a two-Poisson mixture per term. The term's counts over all records are gathered into a
frequency histogram (zero class included); expectation-maximisation fits an ordinary and an elite
rate to it, and the posterior probability of the elite component scores each occurrence.
Equal histograms have equal fits, and the fit works on histograms, never on postings.

The ordinary rate is held at no less than the term's mean rate over all records, zeros included: what a term
without an elite would show anyway. The components so start far apart (mean rate and highest count), a common term
is elite only where its count is high, and a rare one wherever it is repeated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomgrain.tables import clean_set

FIT = StructType([StructField(n, DoubleType()) for n in ("p", "lam1", "lam0")])


def occurrences(df: DataFrame, key: str = "fn_id", terms: str = "ngram_hashes", weights: str = "weighted_ngram_hashes") -> DataFrame:
    """Long form ``(id, term, w)``: each term of a record once, with its weight there, 1.0 where missing or null."""
    w = F.transform(clean_set(terms), lambda t: F.struct(t.alias("term"), F.coalesce(F.try_element_at(weights, t), F.lit(1.0)).alias("w")))
    return df.select(F.col(key).alias("id"), F.explode(w).alias("o")).select("id", "o.term", "o.w")


def term_statistics(occ: DataFrame, steps: int = 8) -> DataFrame:
    """``term``, ``df`` and its histogram ``[(bin, records, mass)]``; heavy terms combine before the shuffle.

    A bin holds the counts between two of ``steps`` points a doubling and keeps their sum, so no count is cut off and the
    mean of a bin is exact. Negative counts and those that are no number count 0 in the fit.
    """
    count = F.greatest(F.nanvl(F.col("w"), F.lit(0.0)), F.lit(0.0))
    binned = F.when(count > 0, F.round(F.log2(count) * steps)).otherwise(F.lit(-1e6)).cast("int")
    partial = occ.groupBy("term", binned.alias("bin")).agg(F.count("*").alias("n"), F.sum(count).alias("mass"))
    return partial.groupBy("term").agg(F.sum("n").alias("df"), F.sort_array(F.collect_list(F.struct("bin", "n", "mass"))).alias("histogram"))


def fit_two_poisson(counts: list[np.ndarray], sizes: list[np.ndarray], zeros: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Fits all histograms at once. Columns: share of the elite, elite rate, ordinary rate.

    ``counts[i]`` are the count values of term i, ``sizes[i]`` how many records have each, ``zeros[i]`` how many
    have none. The elite starts at the highest count, the ordinary rate at the mean over all records, its least value.
    """
    m = len(zeros)
    lengths = np.array([len(c) for c in counts], int) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
    k, n = np.zeros(lengths.sum()), np.zeros(lengths.sum())
    if not m:
        return np.empty((0, 3))
    inside = np.ones(len(k), bool)
    inside[starts] = False
    n[starts] = zeros
    k[inside], n[inside] = np.concatenate(counts), np.concatenate(sizes)
    owner = np.repeat(np.arange(m), lengths)
    total, mass = np.maximum(np.add.reduceat(n, starts), 1), np.add.reduceat(n * k, starts)
    held = np.maximum(total - zeros, 1)
    least = np.maximum(mass / total, 1e-12)
    lam1 = np.maximum(np.maximum.reduceat(k, starts), 2 * least)
    lam0 = least
    p = np.clip(held / total, 1e-12, 0.5)
    for _ in range(rounds):
        r = _elite(k, p[owner], lam1[owner], lam0[owner])
        elite, elite_mass = np.add.reduceat(n * r, starts), np.add.reduceat(n * r * k, starts)
        p = np.clip(elite / total, 1e-12, 1 - 1e-9)
        lam0 = np.maximum((mass - elite_mass) / np.maximum(total - elite, 1e-12), least)
        lam1 = np.maximum(elite_mass / np.maximum(elite, 1e-12), lam0 * (1 + 1e-9))
    return np.stack([p, lam1, lam0], axis=1)


def _elite(k, p, lam1, lam0):
    """Posterior of the elite component for count ``k``; the factorials cancel."""
    odds = np.log(p) - np.log1p(-p) + k * (np.log(lam1) - np.log(lam0)) - (lam1 - lam0)
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


@F.pandas_udf(FIT)
def _fit(histogram: pd.Series, records: pd.Series, total: pd.Series) -> pd.DataFrame:
    sizes = [np.array([x["n"] for x in h], float) for h in histogram]
    counts = [np.array([x["mass"] for x in h], float) / s for h, s in zip(histogram, sizes)]
    zeros = np.maximum(total.to_numpy(float) - records.to_numpy(float), 0)
    return pd.DataFrame(fit_two_poisson(counts, sizes, zeros), columns=["p", "lam1", "lam0"])


def score_terms(df: DataFrame, key: str = "fn_id", terms: str = "ngram_hashes", weights: str = "weighted_ngram_hashes", min_df: int = 2, hot_share: float = 0.001) -> DataFrame:
    """Scores of every term that at least ``min_df`` records hold, in every record that holds it.

    Columns: ``id``, ``term``, ``w``, ``df``, ``n_records``, ``score`` = w ln(N / df), ``elite``, the posterior of the
    elite component, and ``evidence`` = w ln(elite rate / ordinary rate), what the count adds to its log-odds. ``df`` must
    hold each key once; N counts records without terms too. Null and empty sets score nothing, null members are ignored
    and repeated ones count once.

    Terms in more than ``hot_share`` of the records are dealt out over salted keys. There are at most
    (mean terms per record) / ``hot_share`` of them at any size, so that list is broadcast.
    """
    occ = occurrences(df, key, terms, weights)
    total = df.agg(F.countDistinct(key)).scalar()
    stats = term_statistics(occ).where(F.col("df") >= min_df).withColumn("n_records", total)
    salts = F.ceil(F.col("df") / F.greatest(F.col("n_records") * hot_share, F.lit(1000.0))).cast("int")
    stats = stats.withColumn("salts", salts)
    hot = stats.where("salts > 1").select("term", F.col("salts").alias("hot_salts"))
    fitted = stats.withColumn("fit", _fit("histogram", "df", "n_records"))
    fitted = fitted.select("term", "df", "n_records", "fit.p", "fit.lam1", "fit.lam0", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = occ.join(F.broadcast(hot), "term", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("hot_salts", F.lit(1))).cast("int"))
    joined = dealt.join(fitted, ["term", "salt"])
    evidence = F.col("w") * (F.ln("lam1") - F.ln("lam0"))
    odds = F.ln("p") - F.log1p(-F.col("p")) + evidence - (F.col("lam1") - F.col("lam0"))
    return joined.select(
        "id", "term", "w", "df", "n_records",
        (F.col("w") * F.ln(F.col("n_records") / F.col("df"))).alias("score"),
        (1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(700.0)), F.lit(-700.0))))).alias("elite"),
        evidence.alias("evidence"),
    )


def standing_out(scores: DataFrame, factor: float = 2.0, slack: float = 0.5) -> DataFrame:
    """The term of each record that stands out alone: ``id``, ``term``.

    The mixture names the candidates: terms whose evidence for the elite is at least ``slack`` times the highest of the
    record. An exact check follows: the candidate's score is at least ``factor`` times that of every other term.
    Records with fewer than two terms have none; a score of nought stands out nowhere.
    """
    one = F.struct("score", F.col("evidence").cast("float").alias("evidence"), "term")
    top = scores.groupBy("id").agg(F.sort_array(F.collect_list(one), asc=False).alias("s"), F.max(F.col("evidence").cast("float")).alias("most"))
    first, second = F.col("s")[0], F.try_element_at("s", F.lit(2))
    kept = (first.evidence >= slack * F.col("most")) & second.isNotNull() & (first.score > 0) & (first.score >= factor * second.score)
    return top.where(kept).select("id", first.term.alias("term"))
