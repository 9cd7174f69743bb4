"""Scans and sinks over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import corpus as C
from .registry import query, table


@query("SELECT doc_id, source, row_number() OVER (ORDER BY source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS seq FROM documents")
def s_01_corpus_order(spark, d):
    path = F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return C.in_corpus_order(table(spark, d, "documents").select("doc_id", "source", path.alias("path"))).select("doc_id", "source", "seq")


@query("WITH f AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS p, n_chars AS bytes FROM documents), e AS (SELECT p AS relpath, false AS is_dir, bytes FROM f UNION SELECT split_part(p, '/', 1), true, NULL FROM f UNION SELECT split_part(p, '/', 1) || '/' || split_part(p, '/', 2), true, NULL FROM f), o AS (SELECT *, row_number() OVER (ORDER BY relpath) AS place, count(*) OVER () > 10000 AS truncated FROM e) SELECT relpath, is_dir, bytes, place, truncated FROM o WHERE place <= 10000")
def s_12_tree(spark, d):
    path = F.concat(F.lit("root/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return C.tree(table(spark, d, "documents").select(path.alias("path"), F.col("n_chars").alias("bytes")), "root")


@query("SELECT event_id FROM (SELECT event_id, sum(length(props) + 1) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s + 1000 <= 50000")
def k_06_append_capped(spark, d):
    return C.append_capped(table(spark, d, "events").select("event_id", F.col("event_id").alias("seq"), F.col("props").alias("line")), 1000, 50_000).select("event_id")


@query("SELECT user_id, event_type FROM events WHERE event_type <> 'error' EXCEPT SELECT user_id, event_type FROM events WHERE event_type = 'view'")
def k_07_append_new(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type")
    return C.append_new(rows.where("event_type <> 'error'"), rows.where("event_type = 'view'"), ["user_id", "event_type"])


@query("SELECT doc_id, '---' || chr(10) || 'source: ' || source || chr(10) || '---' || chr(10) || text AS page FROM documents")
def k_13_capture(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("---\nsource: "), "source", F.lit("\n---\n"), "text").alias("page"))


@query("SELECT doc_id, max(length(text) // 3 > 6000) OVER (PARTITION BY source) AS rejected, length(text) // 3 > 0.5 * 8000 AS asynchronous FROM documents")
def p_12_token_cap(spark, d):
    from pyspark.sql import Window

    from ..functions.text import estimate_tokens

    n = estimate_tokens("text")
    return table(spark, d, "documents").select("doc_id", F.max(n > 6000).over(Window.partitionBy("source")).alias("rejected"), (n > 0.5 * 8000).alias("asynchronous"))


@query("SELECT doc_id, length(text) = 0 OR length(text) > 10485760 AS rejected FROM documents")
def p_11_size_guard(spark, d):
    return table(spark, d, "documents").select("doc_id", ((F.length("text") == 0) | (F.length("text") > 10_485_760)).alias("rejected"))
