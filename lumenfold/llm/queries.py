"""The registered queries of this subpackage: queries() and oracle_sql()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fill_in_middle, host_reputation, impact_search, licences, line_dedup, permutation_index, quality_rules, revisits, secret_links, simhash, window_index
from .common import table
from .host_reputation import Rule

URL_RULES = [Rule("allow", "org"), Rule("block", "example.org", "es/"), Rule("block", "example.org", "en/1"), Rule("allow", "com", "fr/"), Rule("block", "com", "de/")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.digest(revisits.resolve(revisits.records_of_pages(table(spark, sf_dir, "pages"))))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, distance=4))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.per_document(licences.scan(table(spark, sf_dir, "documents")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.digest(quality_rules.score(docs, model))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # labels are keyed by document; the outcome of a page is the label with its number
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = host_reputation.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", F.round("bound", 6).alias("bound"), "verdict")


def op7_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_index.digest(window_index.drop_repeated_windows(table(spark, sf_dir, "documents")))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), top=20)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", F.round("containment", 6).alias("containment"))


def op11_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.digest(secret_links.scan(table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.transform(table(spark, sf_dir, "documents")))


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_line_dedup, op2_warc_revisits, op3_simhash, op4_licences, op5_quality, op6_url_filter, op7_window_dedup, op8_nearest, op9_bpe, op10_decontaminate, op11_secret_links, op12_fill_in_middle, op13_impact_search, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
