"""Reciprocal rank fusion, the either-arm gate, page expansion, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, DEPTH, TOP = 60, 50, 3


def fuse(first: DataFrame, second: DataFrame, k: int = TOP, constant: int = K) -> DataFrame:
    """(query_id, id, score, rank) of two ranked lists(query_id, id, rank): the sum of 1 / (constant + rank) over the lists.

    One aggregation over their union, instead of a full outer join. Ties keep the first list's order, then the second's.
    """
    both = first.select("query_id", "id", "rank", F.lit(0).alias("arm")).unionByName(second.select("query_id", "id", "rank", F.lit(1).alias("arm")))
    summed = both.groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"), F.min(F.struct("arm", "rank")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "seen"))
    return summed.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def drop_orphans(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """Hits whose section is live."""
    return hits.join(sections.select("id"), "id", "left_semi")


def either_gate(arms: DataFrame, threshold: float, ceiling: float | None) -> DataFrame:
    """Adds ``passed`` to rows(bm25_top, dense_best): one arm suffices; an absent arm never clears; without a ceiling any dense hit does."""
    lexical = F.coalesce(F.col("bm25_top") >= threshold, F.lit(False))
    dense = F.col("dense_best").isNotNull() if ceiling is None else F.coalesce(F.col("dense_best") <= ceiling, F.lit(False))
    return arms.withColumn("passed", lexical | dense)


def expand_pages(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, file, id, place): all sections of each hit's file, files by their first hit's rank, sections in corpus order."""
    files = hits.join(sections.select("id", "file"), "id").groupBy("query_id", "file").agg(F.min("rank").alias("first"))
    rows = files.join(sections.select("file", "id", "seq"), "file")
    return rows.select("query_id", "file", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "seq")).alias("place"))


def rerank(pool: DataFrame, score: Callable, depth: int = 20, k: int = TOP) -> DataFrame:
    """Re-order the first ``depth`` of each query's pool by a score column or model function; ties keep the pool's order."""
    head = pool.where(F.col("rank") <= depth).withColumn("model_score", score(pool))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("model_score").desc(), "rank"))
    return head.withColumn("new_rank", rank).where(F.col("new_rank") <= k)
