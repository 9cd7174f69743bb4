"""A training corpus from raw documents: quality, boilerplate lines, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents``; the last
one returns the token digests of what is left. Every stage decides on rows: a repeated doc_id is a row of its own,
null ids are rows like others, and null and empty texts are scored, kept or dropped as any text. Columns that are called
like a stage's own pass unharmed; empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from quernel.llm.common import materialize, table, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = unused("score", docs)
    return quality.score(docs, model, out_col=name).where(F.col(name) >= 0.3).drop(name)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; ``n_chars`` follows. A document that has no other line stays, empty."""
    rows, dropped = line_dedup.line_dedup(docs), unused("n_dropped", docs)
    return rows.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id."""
    return jaccard_join.without_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; of an id that repeats, all rows go if one holds a passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text."""
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", tokens),
]

#: The classifier, the retrieval and the tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i + 1}")
    return docs
