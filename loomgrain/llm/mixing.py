"""Problem 9: mix sources to target shares of all tokens.

Method: pivotal dependent rounding. Each text of a source should be drawn f times on average; its whole
part is certain, its fraction is a probability. Within a leaf two fractions meet and mass is moved at random
from one to the other, keeping both expectations, until one of them is 0 or 1; one fraction at most is left per leaf.
The residuals of the leaves meet in the next level of a reduction tree, until one per source is drawn by chance.
The number of texts drawn of a source is thereby fixed to within one, and as neighbours in length meet first,
its tokens stay close to the target as well.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.session import cut_lineage
from loomgrain.tables import spread

# Fixed value: the usual split pattern of byte-level vocabularies, where the vocabulary's own module names none.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SMALL_PLAN = 100_000
SOURCE_SALTS = 256
LARGEST_VOCABULARY = 64 << 20


_encodings: dict[str, object] = {}


def encoding(name: str, data: bytes):
    """The tokenizer of a vocabulary of ranks, built once per worker."""
    if name not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encodings[name] = tiktoken.Encoding(os.path.basename(name), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def source_form(column: str):
    return F.lower(F.trim(F.col(column)))


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, source, tokens)``, each document once; null and empty texts and null ids and sources are left out.

    The vocabulary is read by the driver and sent to the workers; a file of more than 64 MB is none and raises.
    """
    if os.path.getsize(vocabulary) > LARGEST_VOCABULARY:
        raise ValueError(f"{vocabulary} is too large for a vocabulary")
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary, shared.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "source": b.source, "tokens": [len(enc.encode_ordinary(t)) for t in b.text]})

    rows = documents.select("doc_id", source_form("source").alias("source"), "text").where("doc_id is not null and source is not null and text != ''")
    counted = spread(rows, "doc_id").mapInPandas(count, "doc_id long, source string, tokens long")
    return counted.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("r")).select("doc_id", "r.source", "r.tokens").where("tokens > 0")


def plan_targets(plans: DataFrame, stock: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row per plan and source with the copies each text of it should get on average.

    Shares are normalised within a plan; a source named twice adds its shares and keeps its lower cap. A source
    without texts cannot contribute: the others keep their proportions. Unless ``total_tokens`` is given, a plan is as
    large as it can be with every proportion met under the caps, or as all its texts if none of its sources has a cap.
    With it, what a source cannot give under its cap is given by the others in proportion, as far as theirs allow.
    """
    named = plans.select("plan_id", source_form("source").alias("source"), "target_share", "max_repeats")
    named = named.where("plan_id is not null and source is not null and target_share > 0")
    named = named.groupBy("plan_id", "source").agg(F.sum("target_share").alias("asked"), F.min("max_repeats").alias("cap"))
    rows = named.join(stock, "source", "left").fillna(0, ["stock_tokens", "stock_texts"])
    per_plan = rows.groupBy("plan_id").agg(
        F.sum("asked").alias("asked_all"),
        F.sum(F.when(F.col("stock_tokens") > 0, F.col("asked"))).alias("asked_stocked"),
        F.sum("stock_tokens").alias("everything"),
    )
    rows = rows.join(per_plan, "plan_id").withColumn("share", F.when(F.col("stock_tokens") > 0, F.col("asked") / F.col("asked_stocked")).otherwise(0.0))
    bound = F.when((F.col("share") > 0) & F.col("cap").isNotNull(), F.col("cap") * F.col("stock_tokens") / F.col("share"))
    sizes = rows.groupBy("plan_id").agg(F.coalesce(F.min(bound), F.first("everything").cast("double")).alias("size"))
    if total_tokens is not None:
        # sources fill up in order of cap / share; the scale that makes the others give the rest is the first that fills no further one
        most = F.coalesce(F.col("cap") * F.col("stock_tokens"), F.lit(float("inf"))).cast("double")
        full = rows.where("share > 0").select("plan_id", "source", "share", most.alias("most"), (most / F.col("share")).alias("ratio"))
        w = Window.partitionBy("plan_id").orderBy("ratio", "source")  # the sources of one plan
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        open_share = F.lit(1.0) - F.coalesce(F.sum("share").over(before), F.lit(0.0))
        scale = (F.lit(float(total_tokens)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / open_share
        fits = full.withColumn("scale", scale).where(F.col("scale") <= F.col("ratio")).groupBy("plan_id").agg(F.min(F.struct("ratio", "scale")).alias("s"))
        sizes = rows.select("plan_id").distinct().join(fits, "plan_id", "left").select("plan_id", F.coalesce("s.scale", F.lit(float("inf"))).alias("size"))
    rows = rows.join(sizes, "plan_id")
    copies = F.when(F.col("stock_tokens") > 0, F.col("size") * F.col("share") / F.col("stock_tokens")).otherwise(0.0)
    copies = F.least(copies, F.coalesce(F.col("cap").cast("double"), copies))
    return rows.select("plan_id", "source", (F.col("asked") / F.col("asked_all")).alias("target_share"), "cap", "stock_tokens", "stock_texts", copies.alias("copies"))


def settle(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pivotal rounding of one leaf, in the order given: all but at most one entry end as 0 or 1."""
    p = p.copy()
    i = -1
    for j in range(len(p)):
        if p[j] <= 1e-12 or p[j] >= 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        a, b, u = p[i], p[j], rng.random()
        if a + b < 1:  # one of them gives all it has
            win = u < a / (a + b)
            p[i], p[j] = (a + b, 0.0) if win else (0.0, a + b)
        else:  # one of them is filled up
            win = u < (1 - b) / (2 - a - b)
            p[i], p[j] = (1.0, a + b - 1) if win else (a + b - 1, 1.0)
        open_ = [k for k in (i, j) if 1e-12 < p[k] < 1 - 1e-12]
        for k in (i, j):
            if k not in open_:
                p[k] = round(p[k])
        i = open_[0] if open_ else -1
    return p


def draw(documents: DataFrame, plans: DataFrame, vocabulary: str, total_tokens: float | None = None, leaf: int = 4096, fan: int = 64, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Texts drawn for each plan, ``(plan_id, source, doc_id, tokens, copies)`` with copies > 0, and the plan targets."""
    texts = cut_lineage(token_counts(documents, vocabulary))
    stock = texts.groupBy("source").agg(F.sum("tokens").alias("stock_tokens"), F.count("*").alias("stock_texts"))
    targets = cut_lineage(plan_targets(plans, stock, total_tokens))
    wanted = targets.where("copies > 0")
    if targets.limit(SMALL_PLAN + 1).count() > SMALL_PLAN:  # few sources and many plans: texts of a source are dealt out, its plans visit each part
        wanted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SOURCE_SALTS - 1))))
        met = texts.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SOURCE_SALTS)).cast("int")).join(wanted, ["source", "_salt"])
    else:
        met = texts.join(F.broadcast(wanted), "source")
    leaves = F.ceil(F.col("stock_texts") / leaf).cast("long")
    rows = met.select(
        "plan_id", "source", "doc_id", "tokens", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("p"),
        F.pmod(F.xxhash64("doc_id"), leaves).alias("node"),
    )
    most = targets.agg(F.max(leaves)).first()[0] or 0
    schema = "plan_id string, source string, doc_id long, tokens long, whole long, p double, node long"
    done = rows.where("p <= 1e-12")
    open_ = rows.where("p > 1e-12")
    level = 0

    def leaf_of(level: int):
        def settle_leaf(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            name = f"{seed}|{level}|{key[0]}|{key[1]}|{key[2]}"
            rng = np.random.default_rng(int(pd.util.hash_array(np.array([name], dtype=object))[0]))
            pdf = pdf.sort_values(["tokens", "doc_id"], ignore_index=True)
            pdf["p"] = settle(pdf["p"].to_numpy(), rng)
            return pdf.assign(node=pdf["node"] // fan)

        return settle_leaf

    while most:
        settled = cut_lineage(open_.groupBy("plan_id", "source", "node").applyInPandas(leaf_of(level), schema))
        done = done.unionByName(settled.where("p = 0 or p = 1"))
        open_ = settled.where("p > 0 and p < 1")
        level += 1
        if most == 1:
            break
        most = ceil(most / fan)
    # what is left is one text per plan and source: chance decides, in proportion
    chance = F.pmod(F.xxhash64("plan_id", "source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = open_.withColumn("p", (chance < F.col("p")).cast("double"))
    drawn = done.unionByName(last).select("plan_id", "source", "doc_id", "tokens", (F.col("whole") + F.col("p").cast("long")).alias("copies"))
    return drawn.where("copies > 0"), targets


def reached_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per plan and source: the normalised target, texts and tokens drawn, the share reached and the most copies of a text."""
    got = drawn.groupBy("plan_id", "source").agg(F.count("*").alias("texts"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    rows = targets.select("plan_id", "source", "target_share", F.col("cap").alias("max_repeats")).join(got, ["plan_id", "source"], "left").fillna(0, ["texts", "tokens", "most_copies"])
    total = rows.groupBy("plan_id").agg(F.sum("tokens").alias("all_tokens"))
    return rows.join(total, "plan_id").withColumn("reached_share", F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0))).drop("all_tokens")
