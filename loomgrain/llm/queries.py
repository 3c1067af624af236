"""Registered queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm import components, distinctive, leakage, mixing, near_dup, parse_check, set_join, source_kind, term_counts, visual_form
from loomgrain.tables import latest_by_key, read_table


def _functions(spark: SparkSession, d: str) -> DataFrame:
    return latest_by_key(read_table(spark, d, "fingerprints"), "fn_id", "ingested_at", ["ngram_hashes", "weighted_ngram_hashes"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scores = distinctive.score_terms(_functions(spark, d))
    return distinctive.standing_out(scores).select(F.col("id").alias("fn_id"), F.col("term").alias("ngram_hash"))


def p1_elite(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each function by the posterior of the elite component: how many are elite, and the surest one."""
    scores = distinctive.score_terms(_functions(spark, d))
    best = F.max_by("term", F.struct("elite", "score", "term"))
    return scores.groupBy(F.col("id").alias("fn_id")).agg(F.count("*").alias("shared_terms"), F.count_if(F.col("elite") >= 0.5).alias("elite_terms"), best.alias("surest_term"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = read_table(spark, d, "match_pairs").where("signature_sim >= 0.75").select(F.col("left_fn").alias("a"), F.col("right_fn").alias("b"))
    lists = read_table(spark, d, "function_clusters").select(F.transform("members", lambda m: m.fn_id).alias("m"))
    links = pairs.unionByName(components.chain_links(lists, "m"))
    return components.connected_groups(links).select(F.col("id").alias("fn_id"), F.col("group_id").alias("cluster_id"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    functions = set_join.item_records(read_table(spark, d, "fingerprints"), "fn_id", 0, "ingested_at", 8)
    return functions.unionByName(set_join.item_records(read_table(spark, d, "corpus_examples"), "example_id", 1, None, 8))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return set_join.similar_pairs(p3_records(spark, d))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return set_join.record_links(p3_records(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_frequencies(spark, d).where("mark is not null").select("call_name", "mark")


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    lists = ["contains_call_to", "required_calls"]
    entries = latest_by_key(read_table(spark, d, "auto_filters"), "entry_id", "ingested_at", lists)
    return term_counts.value_frequencies(entries, "entry_id", lists).withColumnRenamed("value", "call_name")


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    return source_kind.source_kinds(read_table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_kinds(spark, d).where("generated or minified or vendored or data").select("file_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_check.checked_files(read_table(spark, d, "source_files")).where("problem is not null and file_id is not null").select("file_id").distinct()


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return parse_check.broken_rates(parse_check.checked_files(read_table(spark, d, "source_files")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_groups(read_table(spark, d, "fingerprints"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).distinct()


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a parameter of the operator; vocabularies are not part of this package


def _draw(spark: SparkSession, d: str):
    return mixing.draw(read_table(spark, d, "documents"), read_table(spark, d, "mix_plans"), VOCABULARY)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(*_draw(spark, d))


def p9_draw(spark: SparkSession, d: str) -> DataFrame:
    return _draw(spark, d)[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.look_alike_pairs(read_table(spark, d, "documents"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.form_classes(read_table(spark, d, "documents"))


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_elite": p1_elite,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p3_links": p3_links,
        "p4_found": p4_found,
        "p4_frequencies": p4_frequencies,
        "p5_found": p5_found,
        "p5_kinds": p5_kinds,
        "p6_found": p6_found,
        "p6_rates": p6_rates,
        "p7_found": p7_found,
        "p8_found": p8_found,
        "p8_spans": p8_spans,
        "p9_shares": p9_shares,
        "p9_draw": p9_draw,
        "p10_found": p10_found,
        "p10_forms": p10_forms,
    }


def oracle_sql() -> dict[str, str]:
    from loomgrain.llm.sql import SQL

    return SQL
