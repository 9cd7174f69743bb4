"""Retrieval: BM25, nearest neighbours, fusion, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bm25, dense, fusion
from ..operators.postings import Index
from ..sources import corpus as C
from .registry import Fixture, query, table
from .scalar import tokens_sql


def sections(spark, d, *more):
    """Each document is one section without a heading."""
    return bm25.spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("source").alias("file"), X.tokenize("text").alias("tokens"), *more)


#: Indices of this process by application, path and the table's state.
_INDICES: dict[tuple, Index] = {}


def index_of(spark, d) -> Index:
    """The stored index of the documents: built by the first query that asks it, anew when the table has changed."""
    path = f"{d}/documents.parquet"
    key = (spark.sparkContext.applicationId, path, C.stamp(spark, path))
    if key not in _INDICES:
        rows = sections(spark, d, "lang", F.when(F.col("doc_id") % 3 == 0, "qa").when(F.col("doc_id") % 3 == 1, "entity").alias("page_type"))
        _INDICES[key] = Index.build(rows, C.scratch(spark))
    return _INDICES[key]


def asks(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


STATS = f"""toks AS (SELECT doc_id AS id, source AS file, {tokens_sql('text')} AS tokens FROM documents),
post AS (SELECT id, len(tokens) AS len, unnest(tokens) AS token FROM toks),
df AS (SELECT token, count(DISTINCT id) AS df FROM post GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_len, count(DISTINCT file) AS files FROM toks)"""
BM25 = f"""{STATS},
q AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS token FROM benchmark),
tf AS (SELECT id, len, token, count(*) AS tf FROM post GROUP BY 1, 2, 3),
sc AS (SELECT query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM q JOIN tf USING (token) JOIN df USING (token) CROSS JOIN st GROUP BY 1, 2),
hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc)"""


@query(f"WITH {STATS} SELECT n, avg_len, files, (SELECT count(*) FROM df) AS tokens, (SELECT sum(df) FROM df) AS postings FROM st")
def a_01_corpus_stats(spark, d):
    rows = sections(spark, d)
    terms = bm25.term_stats(rows).agg(F.count("*").alias("tokens"), F.sum("df").alias("postings"))
    return bm25.corpus_stats(rows).crossJoin(terms)


@query(f"WITH {STATS} SELECT token, df FROM df")
def a_01_term_stats(spark, d):
    return bm25.term_stats(sections(spark, d))


@query(f"WITH {STATS} SELECT id, token, count(*) AS tf FROM post GROUP BY 1, 2")
def a_02_term_frequency(spark, d):
    return bm25.postings(sections(spark, d)).select("id", "token", F.col("tf").cast("long").alias("tf"))


@query(f"WITH {STATS} SELECT token, df, ln((n + 1) / (df + 1.0)) + 1 AS idf FROM df CROSS JOIN st")
def a_03_idf(spark, d):
    return bm25.smoothed_idf(sections(spark, d))


@query(f"WITH {BM25} SELECT query_id, id, rank, score FROM hits WHERE rank <= 10 AND score > 0")
def o_01_bm25_topk(spark, d):
    return index_of(spark, d).search(asks(spark, d), 10)


def refreshed(spark, d) -> Index:
    """The index of the documents by way of an older state, in which some were missing, some others and some more."""
    rows = sections(spark, d, F.xxhash64("text").alias("hash"))
    old = table(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 7 == 2, F.concat(F.lit("before: "), F.substring("text", 9, 1 << 30))).otherwise(F.col("text")))
    more = old.where("doc_id % 5 = 1").withColumn("doc_id", -F.col("doc_id"))
    old = old.where("doc_id % 11 <> 3").unionByName(more)
    old = old.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("source").alias("file"), X.tokenize("text").alias("tokens"), F.xxhash64("text").alias("hash"))
    return Index.build(old, C.scratch(spark)).refresh(rows, C.scratch(spark))


@query(f"WITH {BM25} SELECT query_id, id, rank, score FROM hits WHERE rank <= 10 AND score > 0")
def o_01_refreshed_topk(spark, d):
    return refreshed(spark, d).search(asks(spark, d), 10)


@query(f"WITH {STATS} SELECT token, df, n, avg_len FROM df CROSS JOIN st")
def k_02_refreshed_terms(spark, d):
    index = refreshed(spark, d)
    return index.terms.crossJoin(F.broadcast(index.stats.select("n", (F.col("total_len") / F.col("n")).alias("avg_len"))))


@query(f"WITH {BM25} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, score FROM hits JOIN documents ON id = doc_id WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5")
def p_02_language_filter(spark, d):
    return index_of(spark, d).search(asks(spark, d), 5, F.col("lang") == "en")


@query(f"WITH {BM25} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, score FROM hits WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5")
def p_03_exclude_qa(spark, d):
    return index_of(spark, d).search(asks(spark, d), 5, ~F.col("page_type").eqNullSafe("qa"))


@query(f"""WITH {BM25}, t AS (SELECT query_id, max(score) AS top_score FROM hits WHERE rank <= 10 AND score > 0 GROUP BY 1)
SELECT item_id AS query_id, top_score, top_score IS NULL OR top_score < 20 AS refused, CASE WHEN top_score IS NULL THEN 'retrieval_empty' WHEN top_score < 20 THEN 'below_threshold' END AS reason
FROM benchmark LEFT JOIN t ON query_id = item_id""")
def p_04_gate(spark, d):
    q = asks(spark, d)
    return bm25.gate(q, index_of(spark, d).search(q, 10), 20.0)


MIXED = Fixture(
    "s",
    "id string, seq long, heading_path array<string>, content string, question string, lang string",
    [
        ("a#refunds", 1, ["Billing policy", "Refunds"], "Refund within 30 days of order", None, "en"), ("a#fees", 2, ["Billing policy", "Fees"], "No fees apply", None, "en"),
        ("b", 3, ["b"], "Shipping takes five days", "how long is shipping", "en"), ("c", 4, ["退款"], "退款政策 三十天內 可退款", None, "zh"), ("d", 5, ["d"], "order refund order refund", None, "en"),
        ("e", 6, ["Refunds"], "", None, "en"),
    ],
)
MIXED.over("documents", {
    "id": "'d' || doc_id",
    "seq": "doc_id",
    "heading_path": "CASE doc_id % 3 WHEN 0 THEN array(source, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) WHEN 1 THEN array(split_part(text, ' ', 3)) ELSE array(lang) END",
    "content": "text",
    "question": "CASE doc_id % 4 WHEN 0 THEN split_part(text, ' ', 4) || ' ' || split_part(text, ' ', 5) END",
    "lang": "lang",
})
ASKED = Fixture("q", "query_id int, text string", [(1, "refund policy"), (2, "refunds refunds order"), (3, "shipping shipping days"), (4, "退款政策"), (5, "billing"), (6, "the of"), (7, "nothing matches")])
ASKED.over("benchmark", {
    "query_id": "item_id",
    "text": "text || CASE item_id % 4 WHEN 0 THEN ' 退款政策 src' || (item_id % 20) ELSE '' END",
})


def mixed_sections(spark, d):
    rows = MIXED.df(spark, d).withColumn("question_tokens", F.coalesce(X.tokenize("question"), F.expr("CAST(array() AS array<string>)")))
    return rows.withColumn("tokens", F.concat(X.tokenize(F.element_at("heading_path", -1)), X.tokenize("content"), "question_tokens"))


@query(
    f"""WITH {MIXED.cte()}, {ASKED.cte()}, t AS (SELECT *, coalesce({tokens_sql('question')}, []) AS qt, list_concat(list_concat({tokens_sql('heading_path[-1]')}, {tokens_sql('content')}), coalesce({tokens_sql('question')}, [])) AS toks FROM s),
    st AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM t), k AS (SELECT query_id, unnest({tokens_sql('text')}) AS token FROM q),
    df AS (SELECT token, (SELECT count(*) FROM t WHERE list_contains(toks, token)) AS df FROM (SELECT DISTINCT token FROM k)),
    w AS (SELECT k.query_id, k.token, t.id, t.seq, len(toks) AS len, len(list_filter(toks, lambda x: x = k.token)) - 0.7 * len(list_filter(qt, lambda x: x = k.token)) AS tf, CASE WHEN list_contains({tokens_sql("array_to_string(heading_path, ' ')")}, k.token) THEN 0.5 ELSE 0 END AS boost FROM k CROSS JOIN t),
    sc AS (SELECT query_id, id, seq, sum(CASE WHEN tf > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a)) ELSE 0 END + boost) AS score FROM w JOIN df USING (token) CROSS JOIN st GROUP BY 1, 2, 3)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seq) AS rank, score FROM sc WHERE score > 0 QUALIFY rank <= 3"""
)
def o_01_bm25_headings(spark, d):
    index = Index.build(mixed_sections(spark, d).select("id", "seq", "tokens", "question_tokens", "heading_path"), C.scratch(spark))
    return index.search(ASKED.df(spark, d), 3)


@query(
    f"""WITH {ASKED.cte()}, c AS (SELECT query_id, len(regexp_extract_all(text, '[{X.HAN}]')) AS h, len(regexp_extract_all(text, '[A-Za-z]')) AS a FROM q)
    SELECT query_id, CASE WHEN h + a = 0 OR h / CAST(h + a AS DOUBLE) <= 0.40 THEN 'en' WHEN h / CAST(h + a AS DOUBLE) >= 0.60 THEN 'zh' ELSE 'mixed' END AS route FROM c"""
)
def p_05_route(spark, d):
    ratio = X.script_ratio("text")
    return ASKED.df(spark, d).select("query_id", F.when(ratio >= 0.6, "zh").when(ratio <= 0.4, "en").otherwise("mixed").alias("route"))


def probes(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


KNN = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
nn AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS own, b.label, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM e a JOIN e b ON a.vec_id % 50 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM nn)"""


@query(f"WITH {KNN} SELECT query_id, id, distance, rank FROM rk WHERE rank <= 5")
def o_02_knn(spark, d):
    return dense.nearest(probes(spark, d), table(spark, d, "embeddings"), 5)


@query(f"WITH {KNN} SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM rk WHERE rk.rank <= 100 AND label = own QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5")
def o_03_knn_filter(spark, d):
    return dense.nearest_of(probes(spark, d), table(spark, d, "embeddings"), 5, "label").select("query_id", "id", "distance", "rank")


@query(f"WITH {KNN} SELECT query_id, min(distance) AS best, min(distance) > 1.1 AS refused FROM rk WHERE id <> query_id AND rank <= 5 GROUP BY 1")
def p_06_dense_gate(spark, d):
    hits = dense.nearest(probes(spark, d), table(spark, d, "embeddings"), 5).where("id <> query_id")
    return dense.gate(probes(spark, d), hits)


#: Query i asks by the passage's words and by the vector of id 50 i; documents and vectors share ids.
HYBRID = f"{BM25}, {KNN}, lex AS (SELECT query_id, id, rank FROM hits WHERE rank <= 50 AND score > 0), den AS (SELECT query_id // 50 AS query_id, id, rank FROM rk WHERE rank <= 50 AND id IN (SELECT doc_id FROM documents))"
FUSED = """fu AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, min(arm * 1000000 + rank) AS seen FROM (SELECT *, 0 AS arm FROM lex UNION ALL SELECT *, 1 AS arm FROM den) GROUP BY 1, 2),
top AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank FROM fu QUALIFY rank <= 3)"""


def arms(spark, d):
    lexical = index_of(spark, d).search(asks(spark, d), fusion.DEPTH)
    near = dense.nearest(probes(spark, d), table(spark, d, "embeddings"), fusion.DEPTH)
    near = near.select((F.col("query_id") / 50).cast("long").alias("query_id"), "id", "rank", "distance")
    return lexical, fusion.drop_orphans(near, table(spark, d, "documents").select(F.col("doc_id").alias("id")))


@query(f"WITH {HYBRID}, {FUSED} SELECT query_id, id, score, rank FROM top")
def o_04_rrf(spark, d):
    lexical, near = arms(spark, d)
    return fusion.fuse(lexical, near)


@query(f"WITH {KNN} SELECT query_id, id, rank FROM rk WHERE rank <= 50 AND id IN (SELECT doc_id FROM documents)")
def j_02_drop_orphans(spark, d):
    near = dense.nearest(probes(spark, d), table(spark, d, "embeddings"), fusion.DEPTH)
    return fusion.drop_orphans(near, table(spark, d, "documents").select(F.col("doc_id").alias("id"))).select("query_id", "id", "rank")


@query(f"""WITH {HYBRID}, {FUSED}, g AS (SELECT query_id, max(score) AS t FROM hits WHERE rank <= 50 AND score > 0 GROUP BY 1)
SELECT query_id, id, score, rank FROM top WHERE query_id IN (SELECT query_id FROM g WHERE t >= 0.5) OR query_id IN (SELECT query_id FROM den)""")
def o_05_hybrid(spark, d):
    lexical, near = arms(spark, d)
    ranked = fusion.fuse(lexical, near)
    tops = ranked.select("query_id").distinct().join(lexical.groupBy("query_id").agg(F.max("score").alias("bm25_top")), "query_id", "left").join(near.groupBy("query_id").agg(F.min("distance").alias("dense_best")), "query_id", "left")
    passed = fusion.either_gate(tops, bm25.THRESHOLD["en"], None).where("passed")
    return ranked.join(passed.select("query_id"), "query_id", "left_semi")


GATES = Fixture("g", "id int, bm25_top double, dense_best double", [(1, 0.5, None), (2, 0.49, None), (3, None, 1.1), (4, None, 1.2), (5, None, None), (6, 0.1, 0.2), (7, 9.0, 2.0)])
GATES.over("documents", {
    "id": "doc_id",
    "bm25_top": "CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 100 AS DOUBLE) / 100 END",
    "dense_best": "CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 150 AS DOUBLE) / 60 END",
})


@query(f"WITH {GATES.cte()} SELECT id, coalesce(bm25_top >= 0.5, false) OR coalesce(dense_best <= 1.1, false) AS passed, coalesce(bm25_top >= 0.5, false) OR dense_best IS NOT NULL AS open_passed FROM g")
def p_07_or_gate(spark, d):
    rows = fusion.either_gate(GATES.df(spark, d), 0.5, 1.1).select("id", "passed")
    return rows.join(fusion.either_gate(GATES.df(spark, d), 0.5, None).select("id", F.col("passed").alias("open_passed")), "id")


@query(f"""WITH {BM25}, f AS (SELECT query_id, source AS file, min(rank) AS first FROM hits JOIN documents ON doc_id = id WHERE rank <= 3 AND score > 0 GROUP BY 1, 2)
SELECT query_id, file, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY first, doc_id) AS place FROM f JOIN documents ON source = file""")
def j_04_expand(spark, d):
    index = index_of(spark, d)
    return fusion.expand_pages(index.search(asks(spark, d), 3), index.live().select("id", "seq", "file"))


@query(f"WITH {HYBRID}, {FUSED} SELECT lex.query_id, lex.id, (lex.id * 7919) % 1000 AS model_score, row_number() OVER (PARTITION BY lex.query_id ORDER BY (lex.id * 7919) % 1000 DESC, lex.rank) AS new_rank FROM lex WHERE rank <= 20 QUALIFY new_rank <= 3")
def o_06_rerank(spark, d):
    pool = index_of(spark, d).search(asks(spark, d), 20)
    return fusion.rerank(pool, lambda p: (F.col("id") * 7919) % 1000).select("query_id", "id", "model_score", "new_rank")


@query(f"""WITH {STATS}, p AS (SELECT item_id, t AS token, min(i) AS pos FROM (SELECT item_id, unnest({tokens_sql('text')}) AS t, unnest(range(len({tokens_sql('text')}))) AS i FROM benchmark) GROUP BY 1, 2)
SELECT item_id, token, row_number() OVER (PARTITION BY item_id ORDER BY round(ln((n + 1) / (df + 1.0)) + 1, 9) DESC, pos) AS place FROM p JOIN df USING (token) CROSS JOIN st
WHERE length(token) >= 2 AND NOT regexp_matches(token, '^[0-9]+$') QUALIFY place <= 10""")
def o_11_key_tokens(spark, d):
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(X.tokenize("text")).alias("pos", "token")).groupBy("item_id", "token").agg(F.min("pos").alias("pos"))
    words = words.where("length(token) >= 2 AND NOT token rlike '^[0-9]+$'").join(bm25.smoothed_idf(sections(spark, d)), "token")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.round("idf", 9).desc(), "pos"))
    return words.withColumn("place", place).where("place <= 10").select("item_id", "token", "place")


@query(f"""WITH {BM25} SELECT query_id, id AS source_id, file || ' > ' || id AS breadcrumb, round(score, 3) AS score, substr(text, 1, 240) AS excerpt FROM hits JOIN toks USING (id) JOIN documents ON doc_id = id WHERE rank <= 3 AND score > 0""")
def p_19_sources(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    hits = index_of(spark, d).search(asks(spark, d), 3).join(docs, "id")
    return hits.select("query_id", F.col("id").alias("source_id"), F.concat_ws(" > ", "source", F.col("id").cast("string")).alias("breadcrumb"), F.round("score", 3).alias("score"), F.substring("text", 1, 240).alias("excerpt"))
