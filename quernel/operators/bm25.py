"""BM25 over sections: statistics, postings, batches of queries, gates.

A corpus is a DataFrame with ``id, seq, tokens`` and, where given, ``question_tokens``, ``heading_path``, ``lang``,
``page_type``. ``seq`` is the corpus order that breaks ties. Query tokens are few: they are joined to the postings
before anything is shuffled, so only postings of asked words move. A batch of queries is broadcast if its count of rows allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize

K1, B = 1.5, 0.75
HEADING_BOOST = 0.5
QUESTION_WEIGHT = 0.3
THRESHOLD = {"en": 0.5, "zh": 4.0}


def corpus_stats(sections: DataFrame) -> DataFrame:
    """One row: n, avg_len (mean number of tokens, repeated ones included), files."""
    files = F.countDistinct("file") if "file" in sections.columns else F.lit(0).cast("long")
    return sections.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avg_len"), files.alias("files"))


def term_stats(sections: DataFrame) -> DataFrame:
    """(token, df): sections that hold a token."""
    return sections.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def smoothed_idf(sections: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln((n + 1) / (df + 1)) + 1."""
    return term_stats(sections).crossJoin(F.broadcast(corpus_stats(sections).select("n"))).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than half the cores is dealt out before costly work on its rows; others stay where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


#: Rows of a table that is broadcast, at most: query tokens and query labels are some 100 bytes each.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame) -> DataFrame:
    """A table with a broadcast hint if it has few enough rows, by count; else it is left to Spark."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def counts(sections: DataFrame, question_weight: float = QUESTION_WEIGHT, asked: DataFrame | None = None) -> DataFrame:
    """(id, seq, token, tf, len): tf is that of the body plus the weighted one of question tokens; ``asked`` limits the tokens."""
    rows = sections.select("id", "seq", F.size("tokens").alias("len"), F.explode("tokens").alias("token"))
    if asked is not None:
        rows = rows.join(asked, "token", "left_semi")
    tf = rows.groupBy("id", "seq", "len", "token").agg(F.count("*").cast("double").alias("tf"))
    if "question_tokens" not in sections.columns:
        return tf
    q = sections.select("id", "seq", F.explode("question_tokens").alias("token"))
    if asked is not None:
        q = q.join(asked, "token", "left_semi")
    q = q.groupBy("id", "seq", "token").agg(F.count("*").alias("in_question"))
    # tokens hold the question's words too: the body's share is the rest
    return tf.join(q, ["id", "seq", "token"], "left").withColumn("tf", F.col("tf") - F.coalesce("in_question", F.lit(0)) * (1 - question_weight)).drop("in_question")


def postings(sections: DataFrame, question_weight: float = QUESTION_WEIGHT, asked: DataFrame | None = None) -> DataFrame:
    """The rows of ``counts`` with a weight."""
    return counts(sections, question_weight, asked).where("tf > 0")


def ask(queries: DataFrame, text_col: str = "text", id_col: str = "query_id") -> DataFrame:
    """(query_id, token, times): tokens of each query with their repetitions."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokenize(text_col)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))


def scores(asked: DataFrame, sections: DataFrame, question_weight: float = QUESTION_WEIGHT) -> DataFrame:
    """(query_id, id, seq, score) of every section that a query touches by its tokens or, at a boost, by a heading above it.

    Statistics are those of all sections, whatever is filtered later. Repeated query tokens count repeatedly.
    """
    asked = sized(asked)
    words = sized(asked.select("token").distinct())
    every = counts(sections, question_weight, words)
    posts = every.where("tf > 0")
    # a row for each section and token: their number is the document frequency, from the same exchange
    df = every.groupBy("token").agg(F.count("*").alias("df"))
    stats = corpus_stats(sections).select("n", "avg_len")
    idf = df.crossJoin(F.broadcast(stats)).select("token", "avg_len", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    norm = F.when(F.col("avg_len") > 0, 1 - B + B * F.col("len") / F.col("avg_len")).otherwise(1.0)
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    base = posts.join(idf, "token").select("id", "seq", "token", weight.alias("w")).join(asked, "token").select("query_id", "id", "seq", (F.col("w") * F.col("times")).alias("part"))
    if "heading_path" in sections.columns:
        head = sections.select("id", "seq", F.explode(F.array_distinct(tokenize(F.array_join("heading_path", " ")))).alias("token"))
        boost = head.join(asked, "token").select("query_id", "id", "seq", (F.col("times") * HEADING_BOOST).alias("part"))
        base = base.unionByName(boost)
    return base.groupBy("query_id", "id", "seq").agg(F.sum("part").alias("score"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The best k sections of each query with rank 1..k: score descending to 9 digits, then corpus order; scores of zero or less are dropped after the cut."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "seq"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).where("score > 0")


def bm25_search(queries: DataFrame, sections: DataFrame, k: int = 10, lang: str | None = None, exclude_qa: bool = False) -> DataFrame:
    """(query_id, id, rank, score). ``lang`` filters candidates by the query's language, ``exclude_qa`` drops filed answers; both after the statistics."""
    scored = scores(ask(queries), sections)
    if lang is not None or exclude_qa:
        keep = sections
        if exclude_qa:
            keep = keep.where(~F.col("page_type").eqNullSafe("qa"))
        if lang is not None:
            keep = keep.where(F.col("lang") == lang)
        scored = scored.join(keep.select("id", "seq"), ["id", "seq"], "left_semi")
    return top_k(scored, k).select("query_id", "id", "rank", "score")


def gate(queries: DataFrame, hits: DataFrame, threshold: float = THRESHOLD["en"]) -> DataFrame:
    """(query_id, top_score, refused, reason): refused without hits or below the threshold (at it is not below)."""
    top = hits.groupBy("query_id").agg(F.max("score").alias("top_score"))
    rows = queries.select("query_id").join(top, "query_id", "left")
    reason = F.when(F.col("top_score").isNull(), "retrieval_empty").when(F.col("top_score") < threshold, "below_threshold")
    return rows.select("query_id", "top_score", reason.isNotNull().alias("refused"), reason.alias("reason"))
