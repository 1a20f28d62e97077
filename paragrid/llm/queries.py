"""One query per operator over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragrid.llm import decontamination, hard_negatives, html_extract, lexical_search, line_dedup, lm_scoring, packing, quality_classifier, quality_rules, simhash, suffix_dedup, url_filter, warc
from paragrid.llm.sql import HARD_NEGATIVES_SQL, HOST_QUALITY_SQL, LEXICAL_SEARCH_SQL, LINE_DEDUP_SQL, URL_FILTER_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; where its files give fewer partitions than there are cores, it is dealt over all of them."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name in ("documents", "pages") and found.rdd.getNumPartitions() < cores else found


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs; a page's label is that of the document whose number its path ends with."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    key = F.expr("try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)', 1) as bigint)")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), labels, key=key).select("page_id", "host", "path", "rule", "verdict")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = line_dedup.drop_common_lines(docs)
    return made.select("doc_id", F.col("__l_lines").alias("n_lines"), F.col("__l_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry=["doc_id", "source"])
    m = F.col("__q_m")
    return judged.select("doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], quality_rules.base_failed(m).alias("base_failed"), F.col("__q_kept").alias("kept"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh vector bears the next label, as the contract wants it."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")), F.col("id") % 50 == 0)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), 20)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labels outside the fold that is held out."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = quality_classifier.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), may_learn=~fold)
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op1_simhash": op1_simhash, "op2_suffix_dedup": op2_suffix_dedup, "op3_html_text": op3_html_text, "op4_warc": op4_warc, "op5_lm_scoring": op5_lm_scoring, "op6_best_fit_packing": op6_best_fit_packing, "op7_url_filter": op7_url_filter, "op8_line_dedup": op8_line_dedup, "op9_decontamination": op9_decontamination, "op10_host_quality": op10_host_quality, "op11_hard_negatives": op11_hard_negatives, "op12_lexical_search": op12_lexical_search, "op13_quality_classifier": op13_quality_classifier}
ORACLES = {"op7_url_filter": URL_FILTER_SQL, "op8_line_dedup": LINE_DEDUP_SQL, "op10_host_quality": HOST_QUALITY_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_lexical_search": LEXICAL_SEARCH_SQL}
