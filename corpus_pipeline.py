"""Corpus pipeline: five stages over documents, each by one operator of lumenfold.llm.

A stage takes all rows that its predecessor kept and returns the columns of documents;
the last one returns tokens. run() chains them through written tables.

In every stage: a null text counts as empty; rows that repeat a doc_id are told apart by
their texts; repeated rows share one fate, but for near_duplicates, which keeps one of them;
an empty table gives an empty one; columns beyond those of documents are handed on, whatever
their names, except by the last stage; a long text is taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, decontaminate, line_dedup, near_copies, quality_rules, simhash
from lumenfold.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the rule ensemble doesn't reject (operator 5).

    The model is fitted on `labels` of the whole table `documents`, held-out rows left out.
    Empty texts have statistics of zero and are judged by them. A score of exactly one half
    keeps the document.
    """
    model = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in ten documents or more (operator 1). Documents stay, without them.

    Lines are compared stripped and with A-Z lower-cased; blank lines stay. A document that
    loses all its lines stays with an empty text.
    """
    return line_dedup.without_frequent_lines(docs, min_docs=10)


def fingerprint_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies (operator 3):
    fingerprints of four-word shingles that differ in four bits at most, links taken over. Empty
    texts are alike and one of them stays. Of rows with the smallest doc_id one stays.
    """
    return simhash.keep_first(docs, width=4, distance=4)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Not a stage. Near copies by another measure, Jaccard 0.8 or more on sets of five-word
    shingles, for corpora from which texts that operator 3 doesn't link are to go as well."""
    return near_copies.keep_first(docs, width=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item (operator 10): at least 0.8 of its five-word
    shingles. Empty texts and empty items hold and are nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left (operator 9), row for row; an empty text has none."""
    import public_tokenizers

    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", fingerprint_duplicates), ("decontaminated", decontaminated), ("tokens", tokens)]

#: SQL can't express the model, the fingerprints or the tokens; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
