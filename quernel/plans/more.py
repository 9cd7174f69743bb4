"""The inventory's remaining rows: projections, predicates and joins that stand inside larger operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bm25, dense, seams
from ..operators import evaluation as E
from ..operators import governance as G
from ..sources import corpus as C
from .governance import CANDIDATES, DOCS, NEIGHBOURS, PAGES, RESOLVE, docs, pages
from .evaluation import MC, OUT, paired
from .registry import SQL, Fixture, query, table
from .retrieval import BM25, HYBRID, KNN, STATS, arms, asks, index_of, probes, sections
from .scalar import tokens_sql


@query("SELECT source || '/' || doc_id || '.' || ext AS path, ext, i AS rank FROM (SELECT source, doc_id, CASE doc_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'txt' WHEN 2 THEN 'md' ELSE 'pdf' END AS ext, doc_id % 4 + 1 AS i FROM documents)")
def s_03_raw_scan_order(spark, d):
    kinds = F.array(*map(F.lit, ("html", "txt", "md", "pdf")))
    ext = F.get(kinds, (F.col("doc_id") % 4).cast("int"))
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), ext.alias("ext"), F.array_position(kinds, ext).alias("rank"))


@query("SELECT source AS dir, lang AS name, count(*) AS files, sum(n_chars) AS bytes FROM documents GROUP BY 1, 2")
def s_11_listing(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("dir"), F.col("lang").alias("name")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


TRASH = Fixture("tr", "path string", [("trash/2024-01-02T00:00:00Z/docs/a.md",), ("trash/2024-01-01T00:00:00Z/b.md",), ("trash/x",)])
TRASH.over("documents", {
    "path": "CASE doc_id % 4 WHEN 3 THEN 'trash/x' || doc_id ELSE 'trash/2024-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T00:00:00Z/' || CASE doc_id % 2 WHEN 0 THEN 'docs/' ELSE '' END || doc_id || '.md' END",
})


@query(rf"WITH {TRASH.cte()} SELECT regexp_extract(path, '^trash/([^/]+Z)/(.+)$', 1) AS ts, regexp_extract(path, '^trash/([^/]+Z)/(.+)$', 2) AS relpath FROM tr WHERE regexp_matches(path, '^trash/([^/]+Z)/(.+)$')")
def s_17_trash(spark, d):
    at = lambda i: F.regexp_extract("path", r"^trash/([^/]+Z)/(.+)$", i)
    return TRASH.df(spark, d).where(at(1) != "").select(at(1).alias("ts"), at(2).alias("relpath"))


@query(f"WITH {STATS} SELECT token, df, row_number() OVER (ORDER BY token) AS place FROM df")
def k_02_index_order(spark, d):
    return C.in_corpus_order(index_of(spark, d).terms, "token").withColumnRenamed("seq", "place")


@query("SELECT event_id, '## [' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '] ' || event_type || ' | \"' || replace(substr(props, 1, 60), '\"', '''') || '\"' AS line FROM events")
def k_05_log_lines(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select("event_id", F.concat(F.lit("## ["), stamp, F.lit("] "), "event_type", F.lit(' | "'), X.log_safe("props"), F.lit('"')).alias("line"))


@query(f"WITH {PAGES.cte()} SELECT status AS axis, count(*) AS n, string_agg('- ' || slug || ' (' || dir || ')', chr(10) ORDER BY slug, dir) AS lines FROM pages_ GROUP BY 1")
def k_08_report(spark, d):
    bullet = F.concat(F.lit("- "), "slug", F.lit(" ("), "dir", F.lit(")"))
    rows = pages(spark, d).groupBy(F.col("status").alias("axis")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("slug", "dir", bullet.alias("b")))).alias("x"))
    return rows.select("axis", "n", F.array_join(F.transform("x", lambda x: x["b"]), "\n").alias("lines"))


RELPATHS = Fixture("rp", "path string", [("docs/a.md",), ("/etc/x",), ("docs/../y",), ("raw/b.txt",), ("C:/x",), ("other/z",)])
RELPATHS.over("documents", {
    "path": "CASE doc_id % 6 WHEN 0 THEN 'docs/' || doc_id || '.md' WHEN 1 THEN '/etc/' || doc_id WHEN 2 THEN 'docs/../' || doc_id WHEN 3 THEN 'raw/' || source || '.txt' WHEN 4 THEN 'C:/' || doc_id ELSE source || '/z' END",
})


@query(rf"WITH {RELPATHS.cte()} SELECT path, NOT regexp_matches(path, '^([/\\]|[A-Za-z]:)') AND NOT list_contains(string_split(path, '/'), '..') AND string_split(path, '/')[1] IN ('docs', 'raw') AS ok FROM rp")
def p_09_path_safety(spark, d):
    return RELPATHS.df(spark, d).select("path", X.safe_path("path", ["docs", "raw"]).alias("ok"))


@query("SELECT doc_id, length(text) // 3 > 0.5 * 8000 AS asynchronous FROM documents")
def p_13_async_route(spark, d):
    return table(spark, d, "documents").select("doc_id", (X.estimate_tokens("text") > 0.5 * 8000).alias("asynchronous"))


@query(f"SELECT slug, CASE WHEN count(property) > 0 THEN 'C10' END AS code FROM (WITH {PAGES.cte()} SELECT slug FROM pages_ WHERE dir = 'qa') AS p LEFT JOIN ({SQL['g_c10_invalid_schema']}) AS f USING (slug) GROUP BY 1")
def p_15_schema_code(spark, d):
    bad = G.invalid_answers(pages(spark, d)).select("slug").distinct().withColumn("code", F.lit("C10"))
    return pages(spark, d).where("dir = 'qa'").select("slug").join(bad, "slug", "left")


FILING = Fixture("fi", "id int, passed boolean, answer string, top string", [(1, True, "yes", "wiki/entities/a.md"), (2, True, "yes", "wiki/qa/b.md"), (3, False, "yes", "wiki/entities/a.md"), (4, True, "I cannot confirm from the knowledge base.", "wiki/entities/a.md"), (5, True, "yes", None)])
FILING.over("documents", {
    "id": "doc_id",
    "passed": "doc_id % 3 <> 0",
    "answer": "CASE doc_id % 5 WHEN 0 THEN 'I cannot confirm from the knowledge base.' ELSE text END",
    "top": "CASE doc_id % 4 WHEN 0 THEN 'wiki/qa/' || doc_id || '.md' WHEN 1 THEN 'wiki/entities/' || doc_id || '.md' WHEN 2 THEN 'wiki/concepts/' || doc_id || '.md' END",
})


@query(f"WITH {FILING.cte()} SELECT id FROM fi WHERE passed AND trim(answer) <> '{X.REFUSAL}' AND NOT coalesce(starts_with(top, 'wiki/qa/'), false)")
def p_16_filing_eligible(spark, d):
    return FILING.df(spark, d).where(F.col("passed") & ~X.is_refusal("answer") & ~F.coalesce(F.col("top").startswith("wiki/qa/"), F.lit(False))).select("id")


@query("SELECT item_id, '[' || item_id || '] passage > ' || item_id || chr(10) || '<<<UNTRUSTED>>>' || chr(10) || text || chr(10) || '<<<END>>>' AS block FROM benchmark")
def p_18_prompt_block(spark, d):
    i = F.col("item_id").cast("string")
    return table(spark, d, "benchmark").select("item_id", F.concat(F.lit("["), i, F.lit("] "), F.array_join(F.array(F.lit("passage"), i), " > "), F.lit("\n"), X.wrap_untrusted("text")).alias("block"))


@query(f"WITH {PAGES.cte()} SELECT slug, CASE dir WHEN 'entities' THEN 'wiki/entities/' WHEN 'concepts' THEN 'wiki/concepts/' ELSE 'wiki/qa/' END || slug || '.md' AS path FROM pages_")
def p_20_citation_path(spark, d):
    folder = F.element_at(F.create_map(*map(F.lit, ("entities", "wiki/entities/", "concepts", "wiki/concepts/", "qa", "wiki/qa/"))), F.col("dir"))
    return pages(spark, d).select("slug", F.concat(folder, "slug", F.lit(".md")).alias("path"))


@query(f"WITH {BM25}, {KNN} SELECT 'lexical' AS arm, query_id, id, score FROM hits WHERE rank <= 3 AND score > 0 UNION ALL SELECT 'dense', query_id, id, NULL FROM rk WHERE rank <= 3")
def p_21_normalised_results(spark, d):
    lexical = index_of(spark, d).search(asks(spark, d), 3).select(F.lit("lexical").alias("arm"), "query_id", "id", "score")
    near = dense.nearest(probes(spark, d), table(spark, d, "embeddings"), 3).select(F.lit("dense").alias("arm"), "query_id", "id", F.lit(None).cast("double").alias("score"))
    return lexical.unionByName(near)


@query(f"WITH {BM25} SELECT query_id, CASE WHEN arg_min(id, rank) % 5 = 0 THEN 'cached ' || arg_min(id, rank) ELSE string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY rank) END AS body FROM hits WHERE rank <= 3 AND score > 0 GROUP BY 1")
def p_22_degraded_serving(spark, d):
    rows = index_of(spark, d).search(asks(spark, d), 3).groupBy("query_id").agg(F.min_by("id", "rank").alias("top"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    excerpts = F.array_join(F.transform("x", lambda x: x["id"].cast("string")), "\n")
    return rows.select("query_id", F.when(F.col("top") % 5 == 0, F.concat(F.lit("cached "), F.col("top").cast("string"))).otherwise(excerpts).alias("body"))


@query(f"SELECT item_id, len({tokens_sql('text')}) > 0 AND item_id % 7 <> 0 AS ok, CASE WHEN item_id % 7 = 0 THEN 'no_family' WHEN len({tokens_sql('text')}) = 0 THEN 'no_token' END AS reason FROM benchmark")
def p_23_query_qc(spark, d):
    reason = F.when(F.col("item_id") % 7 == 0, "no_family").when(F.size(X.tokenize("text")) == 0, "no_token")
    return table(spark, d, "benchmark").select("item_id", reason.isNull().alias("ok"), reason.alias("reason"))


@query(f"WITH {STATS}, q AS (SELECT DISTINCT item_id, unnest({tokens_sql('text')}) AS token FROM benchmark) SELECT item_id, token, CASE WHEN df IS NULL THEN 'absent' WHEN ln((n + 1) / (df + 1.0)) + 1 < 1.5 THEN 'common' END AS flag FROM q LEFT JOIN df USING (token) CROSS JOIN st WHERE df IS NULL OR ln((n + 1) / (df + 1.0)) + 1 < 1.5")
def p_24_key_token_qc(spark, d):
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(X.tokenize("text"))).alias("token"))
    rows = words.join(bm25.smoothed_idf(sections(spark, d)), "token", "left")
    return rows.select("item_id", "token", F.when(F.col("idf").isNull(), "absent").when(F.col("idf") < 1.5, "common").alias("flag")).where("flag IS NOT NULL")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) > 0")
def p_25_query_filter(spark, d):
    return table(spark, d, "conversations").where("role = 'user' AND length(text) > 0").select("conv_id", "turn")


@query(f"WITH {STATS}, q AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS token FROM benchmark) SELECT query_id, count(*) AS matches, count(DISTINCT id) AS touched FROM q JOIN post USING (token) GROUP BY 1")
def j_01_query_postings(spark, d):
    return index_of(spark, d).touched(bm25.ask(asks(spark, d)))


@query(f"WITH {HYBRID} SELECT coalesce(lex.query_id, den.query_id) AS query_id, coalesce(lex.id, den.id) AS id, lex.rank AS lexical_rank, den.rank AS dense_rank FROM lex FULL JOIN den ON lex.query_id = den.query_id AND lex.id = den.id")
def j_03_full_merge(spark, d):
    lexical, near = arms(spark, d)
    return lexical.select("query_id", "id", F.col("rank").alias("lexical_rank")).join(near.select("query_id", "id", F.col("rank").alias("dense_rank")), ["query_id", "id"], "full")


REFS = "refs AS (SELECT DISTINCT slug, split_part(unnest(sources), '#', 1) AS source FROM pages_ WHERE dir <> 'qa')"


def refs(spark, d):
    return pages(spark, d).where("dir <> 'qa'").select("slug", F.explode("sources").alias("ref")).select("slug", F.element_at(F.split("ref", "#"), 1).alias("source")).distinct()


@query(f"WITH {PAGES.cte()}, {DOCS.cte()}, {REFS} SELECT slug, source FROM refs WHERE source NOT IN (SELECT basename FROM docs_)")
def j_06_missing_sources(spark, d):
    return refs(spark, d).join(docs(spark, d).select(F.col("basename").alias("source")), "source", "left_anti").select("slug", "source")


@query(f"WITH {PAGES.cte()}, {DOCS.cte()}, {REFS} SELECT slug, source, count(path) AS matches FROM refs LEFT JOIN docs_ ON basename = source GROUP BY 1, 2")
def j_07_source_resolution(spark, d):
    return refs(spark, d).join(docs(spark, d).select(F.col("basename").alias("source"), "path"), "source", "left").groupBy("slug", "source").agg(F.count("path").alias("matches"))


@query(rf"WITH {PAGES.cte()}, {RESOLVE}, w AS (SELECT slug AS page, trim(unnest(regexp_extract_all(body, '{X.WIKILINK}', 1))) AS target FROM pages_ WHERE dir <> 'qa') SELECT page, target FROM w WHERE target NOT IN (SELECT name FROM res)")
def j_08_unresolved_links(spark, d):
    links = pages(spark, d).where("dir <> 'qa'").select(F.col("slug").alias("page"), F.explode(X.wikilinks("body")).alias("target"))
    return links.join(G.resolution_map(pages(spark, d)).select(F.col("name").alias("target")), "target", "left_anti").select("page", "target")


@query(f"WITH {PAGES.cte()}, {DOCS.cte()} SELECT slug, basename AS source, sha256(content) AS now_hash FROM pages_ JOIN docs_ ON basename = split_part(sources[1], '#', 1) WHERE dir <> 'qa'")
def j_10_page_source_hash(spark, d):
    first = pages(spark, d).where("dir <> 'qa'").select("slug", F.element_at(F.split(F.get("sources", F.lit(0)), "#"), 1).alias("source"))
    return first.join(docs(spark, d).select(F.col("basename").alias("source"), F.sha2("content", 256).alias("now_hash")), "source").select("slug", "source", "now_hash")


@query(f"WITH {PAGES.cte()}, q AS (SELECT slug, updated, split_part(unnest(sources), '#', 1) AS cited FROM pages_ WHERE dir = 'qa') SELECT DISTINCT q.slug, q.cited FROM q JOIN pages_ p ON p.slug = q.cited AND p.dir <> 'qa' AND p.updated > q.updated")
def j_11_later_citation(spark, d):
    qa = pages(spark, d).where("dir = 'qa'").select("slug", "updated", F.explode("sources").alias("ref")).select("slug", "updated", F.element_at(F.split("ref", "#"), 1).alias("cited"))
    wiki = pages(spark, d).where("dir <> 'qa'").select(F.col("slug").alias("cited"), F.col("updated").alias("later"))
    return qa.join(wiki, "cited").where("later > updated").select("slug", "cited").distinct()


@query(NEIGHBOURS)
def j_13_bm25_neighbours(spark, d):
    return G.page_neighbours(pages(spark, d), 3, 1.0).select("query_id", F.col("id").alias("neighbour"), "rank", "score")


GROUPS = Fixture("grp", "group_id string, kind string, ids array<string>", [("g1", "contradiction", ["a", "b", "c"]), ("g2", "redundancy", ["d", "e"]), ("g3", "contradiction", ["f", "g"])])
GROUPS.over("documents", {
    "group_id": "'g' || doc_id",
    "kind": "CASE doc_id % 3 WHEN 0 THEN 'redundancy' ELSE 'contradiction' END",
    "ids": "array('a' || doc_id, 'b' || doc_id, 'a' || (doc_id + 7))",
})
GOLDS = Fixture("gq", "query_id int, gold array<string>", [(1, ["a"]), (2, ["d"]), (3, ["a", "f"]), (4, ["g"]), (5, [])])
GOLDS.over("documents", {
    "query_id": "doc_id",
    "gold": "CASE doc_id % 4 WHEN 0 THEN array() WHEN 1 THEN array('b' || doc_id) WHEN 2 THEN array('a' || doc_id, 'b' || doc_id) ELSE array('b' || doc_id, 'a' || (doc_id div 2)) END",
})


@query(f"WITH {GROUPS.cte()}, {GOLDS.cte()}, m AS (SELECT query_id, any_value(gold) AS gold, any_value(kind) AS kind, any_value(ids) AS ids FROM (SELECT query_id, gold, unnest(gold) AS g FROM gq) JOIN grp ON list_contains(ids, g) GROUP BY query_id HAVING count(DISTINCT group_id) = 1) SELECT query_id, array_to_string(list_sort(list_filter(ids, lambda x: NOT list_contains(gold, x))), ',') AS leaks FROM m WHERE kind <> 'redundancy'")
def j_19_leak_ids(spark, d):
    members = GROUPS.df(spark, d).select("group_id", "kind", "ids", F.explode("ids").alias("g"))
    rows = GOLDS.df(spark, d).select("query_id", "gold", F.explode("gold").alias("g")).join(members, "g").groupBy("query_id").agg(F.countDistinct("group_id").alias("n"), F.first("gold").alias("gold"), F.first("kind").alias("kind"), F.first("ids").alias("ids"))
    return rows.where("n = 1 AND kind <> 'redundancy'").select("query_id", F.array_join(F.array_sort(F.array_except("ids", "gold")), ",").alias("leaks"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list(zone))), ',') AS zones FROM (SELECT doc_id, 'quality' AS zone FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'long' FROM documents WHERE length(text) > 5000) GROUP BY 1")
def j_22_zone_union(spark, d):
    rows = table(spark, d, "labels")
    zone = lambda df, name: df.select("doc_id", F.lit(name).alias("zone"))
    every = zone(rows.where("quality = 0"), "quality").union(zone(rows.where("toxic = 1"), "toxic")).union(zone(table(spark, d, "documents").where("length(text) > 5000"), "long"))
    return every.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("zone")), ",").alias("zones"))


@query(f"WITH {PAGES.cte()}, {REFS} SELECT DISTINCT source, first_value(slug) OVER (PARTITION BY source ORDER BY slug) AS first_page FROM refs")
def j_26_union_of_sources(spark, d):
    return refs(spark, d).groupBy("source").agg(F.min("slug").alias("first_page"))


KNOWN = Fixture("known", "ref string", [("refunds.md#a",), ("refunds.md#z",), ("shipping.md#s",), ("pricing.md#q",)])
#: Sections of some files: of each cited source two, of each cited file one.
KNOWN.over("documents", {"ref": "CASE WHEN doc_id % 3 = 0 THEN 'file' || (doc_id div 4) || '.md#x' ELSE source || '.md#s' || (doc_id % 3) END"})


@query(f"WITH {PAGES.cte()}, c AS (SELECT slug, unnest(sources) AS ref FROM pages_ WHERE dir <> 'qa'), {KNOWN.cte()}, s AS (SELECT DISTINCT ref FROM known), f AS (SELECT DISTINCT slug, split_part(ref, '#', 1) AS file FROM c) SELECT f.slug, s.ref, c.ref IS NOT NULL AS cited FROM f JOIN s ON split_part(s.ref, '#', 1) = f.file LEFT JOIN c ON c.slug = f.slug AND c.ref = s.ref")
def j_27_cited_and_siblings(spark, d):
    cited = pages(spark, d).where("dir <> 'qa'").select("slug", F.explode("sources").alias("ref"))
    known = KNOWN.df(spark, d).distinct().withColumn("file", F.element_at(F.split("ref", "#"), 1))
    files = cited.select("slug", F.element_at(F.split("ref", "#"), 1).alias("file")).distinct()
    return files.join(known, "file").join(cited.withColumn("cited", F.lit(True)), ["slug", "ref"], "left").select("slug", "ref", F.coalesce("cited", F.lit(False)).alias("cited"))


@query(f"WITH {PAGES.cte()}, q AS (SELECT DISTINCT split_part(unnest(sources), '#', 1) AS slug FROM pages_ WHERE dir = 'qa') SELECT q.slug, arg_min(dir, CASE dir WHEN 'entities' THEN 0 WHEN 'concepts' THEN 1 ELSE 2 END) AS dir FROM q JOIN pages_ p ON p.slug = q.slug GROUP BY 1")
def j_28_citation_priority(spark, d):
    cited = pages(spark, d).where("dir = 'qa'").select(F.explode("sources").alias("ref")).select(F.element_at(F.split("ref", "#"), 1).alias("slug")).distinct()
    order = F.when(F.col("dir") == "entities", 0).when(F.col("dir") == "concepts", 1).otherwise(2)
    return cited.join(pages(spark, d).select("slug", "dir"), "slug").groupBy("slug").agg(F.min_by("dir", order).alias("dir"))


@query(f"""WITH {STATS}, q AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS token FROM benchmark), tf AS (SELECT id, len, token, count(*) AS tf FROM post GROUP BY 1, 2, 3), w(weight) AS (VALUES (CAST(0.1 AS DOUBLE)), (0.3), (1.0)),
sc AS (SELECT weight, query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (weight * tf) * 2.5 / (weight * tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS s FROM q JOIN tf USING (token) JOIN df USING (token) CROSS JOIN st CROSS JOIN w GROUP BY 1, 2, 3) SELECT weight, max(s) AS best, avg(s) AS mean FROM sc GROUP BY 1""")
def a_21_question_weight_sweep(spark, d):
    return index_of(spark, d).swept(bm25.ask(asks(spark, d)), (0.1, 0.3, 1.0))


@query("SELECT event_type, coalesce(max(value), 0) AS peak, count(*) AS requests, count(*) FILTER (value < 10) / CAST(count(*) AS DOUBLE) AS error_rate FROM events GROUP BY 1")
def a_27_load_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("peak"), F.count("*").alias("requests"), F.avg((F.col("value") < 10).cast("int")).alias("error_rate"))


@query(rf"WITH {PAGES.cte()} SELECT t AS target, count(*) AS mentions, count(DISTINCT slug) AS pages FROM (SELECT slug, trim(unnest(regexp_extract_all(body, '{X.WIKILINK}', 1))) AS t FROM pages_) GROUP BY 1")
def a_06_link_mentions(spark, d):
    return pages(spark, d).select("slug", F.explode(X.wikilinks("body")).alias("target")).groupBy("target").agg(F.count("*").alias("mentions"), F.countDistinct("slug").alias("pages"))


@query(f"WITH {HYBRID} SELECT query_id, id, rank FROM lex WHERE rank <= 10")
def w_01_rank_within_arm(spark, d):
    return index_of(spark, d).search(asks(spark, d), 10).select("query_id", "id", "rank")


@query("SELECT item_id, array_to_string(list(w ORDER BY first), ' ') AS words FROM (SELECT item_id, w, min(i) AS first FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w, unnest(range(len(string_split(lower(text), ' ')))) AS i FROM benchmark) GROUP BY 1, 2) GROUP BY 1")
def w_10_first_seen(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(F.split(F.lower("text"), " ")), " ").alias("words"))


@query("SELECT doc_id, CAST(least(10, greatest(1, doc_id % 25 - 5)) AS INT) AS clamped FROM documents")
def o_12_clamp(spark, d):
    k = (F.col("doc_id") % 25 - 5).cast("int")
    return table(spark, d, "documents").select("doc_id", F.least(F.lit(10), F.greatest(F.lit(1), k)).alias("clamped"))


@query(f"SELECT a.item_id AS a, len(list_intersect(list_distinct({tokens_sql('a.text')}), list_distinct({tokens_sql('b.text')}))) AS common FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def u_02_token_intersection(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", X.tokenize("text").alias("t"))
    return rows.alias("a").join(rows.alias("b"), F.expr("b.item_id = a.item_id + 1")).select(F.col("a.item_id").alias("a"), F.size(F.array_intersect("a.t", "b.t")).cast("long").alias("common"))


@query(f"WITH {PAGES.cte()} SELECT dir, array_to_string(list_sort(list_distinct(flatten(list(list_transform(sources, lambda s: split_part(s, '#', 1)))))), ',') AS files FROM pages_ GROUP BY 1")
def u_04_source_union(spark, d):
    files = F.transform("sources", lambda s: F.element_at(F.split(s, "#"), 1))
    return pages(spark, d).groupBy("dir").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(files)))), ",").alias("files"))


@query("SELECT doc_id, nfc_normalize(text) = text AS normal FROM documents")
def f_16_nfc(spark, d):
    normal = F.pandas_udf(lambda s: s.map(lambda t: unicodedata.is_normalized("NFC", t)), "boolean")
    return table(spark, d, "documents").select("doc_id", normal("text").alias("normal"))


@query("SELECT doc_id, '---' || chr(10) || 'lang: ' || lang || chr(10) || 'chars: ' || n_chars || chr(10) || '---' || chr(10) AS head FROM documents")
def f_21_render_frontmatter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.format_string("---\nlang: %s\nchars: %d\n---\n", "lang", "n_chars").alias("head"))


@query(rf"WITH {PAGES.cte()} SELECT slug, regexp_extract(substr(body, 1, 600), '\(collision group: ''([^'']*)''\)', 1) AS marked FROM pages_")
def f_35_separation_mark(spark, d):
    return pages(spark, d).select("slug", F.regexp_extract(F.substring("body", 1, 600), r"\(collision group: '([^']*)'\)", 1).alias("marked"))


@query()
def x_01_embed(spark, d):
    return table(spark, d, "benchmark").select("item_id", seams.embed("text").alias("embedding"))


@query()
def x_02_draft_and_verify(spark, d):
    hits = index_of(spark, d).search(asks(spark, d), 3)
    texts = hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("sections"))
    return seams.answer(asks(spark, d).withColumnRenamed("text", "question").join(texts, "query_id", "left"))


@query(
    rf"""WITH {PAGES.cte()}, c AS ({CANDIDATES}), w AS (SELECT c.a, c.b, x.body AS x, y.body AS y FROM c JOIN {PAGES.name} x ON x.slug = c.a JOIN {PAGES.name} y ON y.slug = c.b),
    n AS (SELECT a, b, regexp_extract_all(x, '\d+') AS nx, regexp_extract_all(y, '\d+') AS ny, list_distinct(regexp_extract_all(regexp_replace(lower(x), '\d+', '', 'g'), '[a-z0-9]+')) AS wx, list_distinct(regexp_extract_all(lower(y), '[a-z0-9]+')) AS wy FROM w)
    SELECT a, b, CASE WHEN nx <> ny AND len(wx) > 0 AND len(list_intersect(wx, wy)) / CAST(len(wx) AS DOUBLE) > 0.5 THEN 'contradiction' ELSE 'consistent' END AS verdict FROM n"""
)
def x_06_judge_pairs(spark, d):
    p = G.contradictions(pages(spark, d))
    body = pages(spark, d).select("slug", "body")
    rows = p.join(body.select(F.col("slug").alias("a"), F.col("body").alias("x")), "a").join(body.select(F.col("slug").alias("b"), F.col("body").alias("y")), "b")
    return rows.select("a", "b", seams.judge("x", "y").alias("verdict"))


@query(
    f"""WITH {BM25}, h AS (SELECT query_id, id FROM hits WHERE rank <= 5 AND score > 0),
    w AS (SELECT h.query_id, h.id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS c FROM h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.id)
    SELECT query_id, id, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, c)) / CAST(len(q) AS DOUBLE) END AS model_score FROM w"""
)
def x_07_cross_encoder(spark, d):
    hits = index_of(spark, d).search(asks(spark, d), 5).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id").join(asks(spark, d), "query_id")
    return hits.select("query_id", "id", seams.cross_encode("text", "content").alias("model_score"))


@query("SELECT conv_id, turn, CASE WHEN lag(turn) OVER w IS NULL THEN text ELSE lag(text) OVER w || ' / ' || text END AS rewritten FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def x_09_rewrite(spark, d):
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, d, "conversations").withColumn("history", F.collect_list("text").over(by))
    return rows.select("conv_id", "turn", seams.rewrite("text", "history").alias("rewritten"))


Z11 = f"""WITH {OUT}, n AS (SELECT 'ab' AS pair, count(*) FILTER (a = 1 AND b = 0) AS b, count(*) FILTER (a = 0 AND b = 1) AS c FROM o UNION ALL SELECT 'ac', count(*) FILTER (a = 1 AND c = 0), count(*) FILTER (a = 0 AND c = 1) FROM o
UNION ALL SELECT 'bc', count(*) FILTER (b = 1 AND c = 0), count(*) FILTER (b = 0 AND c = 1) FROM o), t AS (SELECT pair, b, c, CASE WHEN b + c = 0 THEN 1 ELSE {MC} END AS p FROM n),
h AS (SELECT *, p * (3 - row_number() OVER (ORDER BY p, pair) + 1) AS s FROM t), cq AS ({SQL["z_05_cochran_q"].replace("WITH " + OUT + ", s AS", "WITH s AS")})
SELECT pair, h.b, h.c, round(h.p, 9) AS p, round(least(1.0, max(s) OVER (ORDER BY h.p, pair ROWS UNBOUNDED PRECEDING)), 9) AS holm, round(q, 9) AS q, round(cq.p, 9) AS q_p FROM h CROSS JOIN cq"""


@query(Z11)
def z_11_three_arms(spark, d):
    rows = paired(spark, d)
    tests = None
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        one = E.discordant(rows, [], a, b).withColumn("pair", F.lit(a + b))
        tests = one if tests is None else tests.unionByName(one)
    rows = E.holm(tests, "p").crossJoin(E.cochran_q(rows, ["a", "b", "c"]).select("q", F.col("p").alias("q_p")))
    return rows.select("pair", "b", "c", *(F.round(c, 9).alias(c) for c in ("p", "holm", "q", "q_p")))


