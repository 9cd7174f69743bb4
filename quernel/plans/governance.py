"""Governance checks over literal pages, sources and logs; the log check also over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import governance as G
from ..operators import sections as S
from ..sources import corpus as C
from ..streaming import stateful as T
from .registry import SQL, Fixture, query, table
from .scalar import tokens_sql

PAGES = Fixture(
    "pages_",
    "slug string, dir string, status string, updated string, sources array<string>, aliases array<string>, body string, reason string, count int, fm string",
    [
        ("refunds", "entities", "live", "2024-05-01T00:00:00Z", ["refunds.md#a", "billing.md#x"], ["money-back", "returns"], "See [[shipping]] and [[order-tracking]] then [[Money-back]].", None, None, "{}"),
        ("shipping", "concepts", "live", "2024-05-10T12:00:00Z", ["shipping.md#s"], ["refunds", "delivery"], "Track with [[order-tracking|the tracker]] or [[delivery#fees]]. Shipping takes five days.", None, None, "{}"),
        ("our-shipping", "concepts", "live", "2024-05-02T00:00:00Z", ["shipping.md#s", "gone.md#q"], ["returns"], "Shipping takes three days, see [[ lost-page ]]", None, None, "{}"),
        ("pricing", "concepts", "live", "2024-05-02T00:00:00Z", ["pricing.md#p"], [], "Prices (collision group: 'x, y') [[refunds]]", None, None, "{}"),
        ("pricing-2", "concepts", "live", "2024-05-02T00:00:00Z", ["pricing.md#p"], [], "Prices again", None, None, "{}"),
        ("plan", "entities", "live", "2024-05-02T00:00:00Z", ["old.md#o"], [], "(collision group: 'plan, plan-3')", None, None, "{}"),
        ("plan-3", "entities", "live", "2024-05-02T00:00:00Z", ["old.md#o"], [], "(collision group: 'plan-3,plan')", None, None, "{}"),
        ("legacy", "concepts", "failed_grounding", "2024-05-02T00:00:00Z", ["gone.md#a", "dup.md#b", "billing.md#c"], [], "", " ", None, "{}"),
        ("alone", "concepts", "failed_grounding", "2024-05-02T00:00:00Z", [], [], "", "claim_unsupported", None, "{}"),
        ("how-refund", "qa", "live", "2024-05-01T00:00:00Z", ["refunds#a", "shipping#s"], [], "answer", None, 3, '{"status": "live", "type": "qa", "question": "How?", "count": 3}'),
        ("fresh", "qa", "live", "2024-06-01T00:00:00Z", ["shipping#s"], [], "answer", None, 1, '{"status": "zombie", "type": "qa", "question": "  ", "count": true}'),
        ("ask-a", "qa", "draft", "2024-05-03T00:00:00Z", ["refunds#a"], [], "answer", None, 5, '{"status": "draft", "type": "page", "question": 7, "count": 0}'),
        ("ask-b", "qa", "draft", "2024-05-04T00:00:00Z", ["refunds#a"], [], "answer", None, 5, '{"type": "qa", "question": "Q", "count": 2.5}'),
    ],
)
DAY = "'2024-05-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T00:00:00Z'"
STATE = "CASE doc_id % 4 WHEN 0 THEN 'draft' WHEN 3 THEN 'zombie' ELSE 'live' END"
MARK = "CASE doc_id % 9 WHEN 0 THEN '(collision group: ''p' || (doc_id div 3) || ', p' || (doc_id div 3) || '-2'') ' WHEN 1 THEN '(collision group: ''p' || (doc_id div 3) || '-2,p' || (doc_id div 3) || ''') ' ELSE '' END"
LINKS = "' [[alias' || (doc_id % 40) || ']] and [[p' || (doc_id * 7 % 500) || '|label]] or [[ gone' || (doc_id % 23) || ' ]]'"
META = [
    """CASE doc_id % 20 WHEN 18 THEN '' ELSE ', "type": "qa"' END""",
    """', "question": ' || CASE doc_id % 20 WHEN 9 THEN '"  "' WHEN 19 THEN '7' ELSE '"Q' || doc_id || '"' END""",
    """', "count": ' || CASE doc_id % 20 WHEN 8 THEN 'true' WHEN 19 THEN '2.5' ELSE CAST(1 + doc_id % 9 AS STRING) END""",
]
#: A page for each document: slugs that differ by numbers, files and pages as sources, aliases that collide, links to pages, aliases and nothing.
PAGES.over("documents", {
    "slug": "'p' || (doc_id div 3) || CASE doc_id % 3 WHEN 0 THEN '' ELSE '-' || (doc_id % 3 + 1) END",
    "dir": "CASE WHEN doc_id % 10 < 5 THEN 'entities' WHEN doc_id % 10 < 8 THEN 'concepts' ELSE 'qa' END",
    "status": f"CASE WHEN doc_id % 10 >= 8 THEN {STATE} WHEN doc_id % 7 = 3 THEN 'failed_grounding' ELSE 'live' END",
    "updated": DAY,
    "sources": "CASE WHEN doc_id % 10 >= 8 THEN array('p' || (doc_id div 7) || '#a', 'p' || (doc_id div 5) || '-2#b') WHEN doc_id % 14 = 3 THEN array() ELSE array(source || '.md#s' || (doc_id % 5), 'file' || (doc_id div 4) || '.md#x') END",
    "aliases": "CASE doc_id % 6 WHEN 0 THEN array('alias' || (doc_id div 12), 'p' || (doc_id div 9)) WHEN 3 THEN array('alias' || (doc_id div 12)) ELSE array() END",
    "body": f"{MARK} || text || {LINKS}",
    "reason": "CASE WHEN doc_id % 7 = 3 THEN CASE doc_id % 3 WHEN 0 THEN 'claim_unsupported' WHEN 1 THEN ' ' END END",
    "count": "CASE WHEN doc_id % 10 >= 8 THEN 1 + doc_id % 9 END",
    "fm": f"""CASE WHEN doc_id % 10 < 8 THEN '{{}}' ELSE '{{"status": "' || {STATE} || '"' || {" || ".join(META)} || '}}' END""",
})
DOCS = Fixture(
    "docs_",
    "path string, basename string, content string, modified string",
    [
        ("docs/refunds.md", "refunds.md", "refund text", "2024-05-05T12:00:00Z"), ("docs/billing.md", "billing.md", "billing", "2024-05-01T00:00:00Z"), ("docs/shipping.md", "shipping.md", "ship text", "2024-05-11T00:00:00Z"),
        ("docs/pricing.md", "pricing.md", "price", "2024-04-01T00:00:00Z"), ("docs/a/dup.md", "dup.md", "1", "2024-04-01T00:00:00Z"), ("docs/b/dup.md", "dup.md", "2", "2024-04-01T00:00:00Z"),
    ],
)
#: The files that pages cite: some are gone, some names are there twice, and one file stands for each source that is left.
DOCS.over("documents", {
    "path": "CASE WHEN doc_id < 30 AND doc_id % 3 = 0 THEN 'docs/' || 'src' || (doc_id div 3) WHEN doc_id % 4 = 0 THEN 'docs/a/file' || (doc_id div 4) ELSE 'docs/b/file' || (doc_id div 4) END || '.md'",
    "basename": "CASE WHEN doc_id < 30 AND doc_id % 3 = 0 THEN 'src' || (doc_id div 3) ELSE 'file' || (doc_id div 4) END || '.md'",
    "content": "text",
    "modified": "'2024-05-' || lpad(CAST(1 + doc_id * 5 % 28 AS STRING), 2, '0') || 'T12:00:00Z'",
}, "doc_id < 30 AND doc_id % 3 = 0 OR doc_id >= 30 AND (doc_id % 4 = 0 AND doc_id % 36 <> 0 OR doc_id % 44 = 1)")
HASHES = Fixture("hashes", "slug string, source string, hash string", [("refunds", "refunds.md", "old"), ("shipping", "shipping.md", None), ("pricing", "pricing.md", "old"), ("our-shipping", "shipping.md", "older")])
HASHES.over("documents", {
    "slug": "'p' || (doc_id div 3) || CASE doc_id % 3 WHEN 0 THEN '' ELSE '-' || (doc_id % 3 + 1) END",
    "source": "source || '.md'",
    "hash": "CASE doc_id % 3 WHEN 0 THEN 'old' WHEN 1 THEN md5(text) END",
})
LOG = Fixture(
    "log_",
    "line_no int, line string",
    [*enumerate([
        "# log", '## [2024-01-01T00:00:01Z] chat_grounding_fallback | "How long?" reason=below_threshold top_section=a#b', '## [2024-01-01T00:00:02Z] chat | "how long" top=a#b:1.0',
        '## [2024-01-01T00:00:03Z] chat | "How long??" top=a#b:2.0', '## [2024-01-01T00:00:04Z] chat_grounding_fallback | "how  long" reason=below_threshold top_section=a#b', "noise", '## [2024-01-01T00:00:05Z] chat | "how long" top=none',
        '## [2024-01-01T00:00:06Z] chat_grounding_fallback | "what else" reason=retrieval_empty', '## [2024-01-01T00:00:07Z] chat_grounding_fallback | "what else!" reason=provider_error', '## [2024-01-01T00:00:08Z] chat | "what else" top=x',
        '## [2024-01-01T00:00:09Z] chat_grounding_fallback | "cited one" reason=claim_unsupported cited=b,a', '## [2024-01-01T00:00:10Z] ingest | "x" pages=3',
    ])],
)
STAMP = "'## [' || replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') || 'Z] '"
#: A log of the events: errors are failed answers, views answers, clicks another kind, and the rest is no line of the grammar.
LOG.over("events", {
    "line_no": "event_id",
    "line": STAMP + " || CASE event_type WHEN 'error' THEN 'chat_grounding_fallback | \"How long, user ' || user_id || CASE event_id % 3 WHEN 0 THEN '?' ELSE '' END || '\" reason=' || CASE event_id % 4 WHEN 0 THEN 'below_threshold' WHEN 1 THEN 'retrieval_empty' WHEN 2 THEN 'claim_unsupported' ELSE 'provider_error' END || CASE event_id % 5 WHEN 0 THEN ' cited=b,a' WHEN 1 THEN '' ELSE ' top_section=s' || (event_id % 3) || '#b' END WHEN 'view' THEN 'chat | \"how long,  user ' || user_id || '\" top=x:1.0' WHEN 'click' THEN 'ingest | \"x\" pages=3' ELSE 'noise' END",
})


def pages(spark, d):
    return PAGES.df(spark, d)


def docs(spark, d):
    return DOCS.df(spark, d)


def log(spark, d):
    return G.parse_lines(LOG.df(spark, d))


RESOLVE = "res AS (SELECT slug AS name, slug AS canonical FROM pages_ UNION SELECT name, min(slug) FROM (SELECT unnest(aliases) AS name, slug FROM pages_) WHERE name NOT IN (SELECT slug FROM pages_) GROUP BY 1)"


@query(f"WITH {PAGES.cte()}, {RESOLVE} SELECT name, canonical FROM res")
def j_15_resolution_map(spark, d):
    return G.resolution_map(pages(spark, d))


@query(f"WITH {PAGES.cte()}, {RESOLVE} SELECT name, canonical FROM res WHERE name <> canonical")
def j_29_alias_map(spark, d):
    return G.resolution_map(pages(spark, d)).where("name <> canonical")


@query(
    rf"""WITH {PAGES.cte()}, {RESOLVE}, w AS (SELECT slug AS page, dir, body, unnest(regexp_extract_all(body, '{X.WIKILINK}', 1)) AS raw, unnest(regexp_extract_all(body, '{X.WIKILINK}')) AS whole FROM pages_ WHERE dir <> 'qa'),
    m AS (SELECT trim(raw) AS slug, page, dir, substr(body, greatest(1, instr(body, whole) - 25), instr(body, whole) + length(whole) + 25 - greatest(1, instr(body, whole) - 25)) AS ctx FROM w WHERE trim(raw) NOT IN (SELECT name FROM res))
    SELECT slug, count(*) AS mentions, array_to_string(list_sort(list_distinct(list(page))), ',') AS referenced_by, first(ctx ORDER BY dir <> 'entities', page) AS context FROM m GROUP BY 1"""
)
def g_c2_red_links(spark, d):
    return G.red_links(pages(spark, d)).withColumn("referenced_by", F.array_join("referenced_by", ","))


@query(
    f"""WITH {PAGES.cte()}, {DOCS.cte()}, b AS (SELECT slug, coalesce(nullif(trim(reason), ''), 'unknown') AS reason, sources FROM pages_ WHERE status = 'failed_grounding'),
    s AS (SELECT slug, reason, split_part(unnest(CASE WHEN len(sources) = 0 THEN [NULL] ELSE sources END), '#', 1) AS source FROM b)
    SELECT slug, reason, source, CASE WHEN source IS NULL THEN NULL WHEN count(path) = 0 THEN 'missing' WHEN count(path) = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution
    FROM s LEFT JOIN docs_ ON basename = source GROUP BY 1, 2, 3"""
)
def g_c3_failed_grounding(spark, d):
    return G.failed_grounding(pages(spark, d), docs(spark, d))


@query(
    rf"""WITH {PAGES.cte()}, p AS (SELECT dir, slug, CASE WHEN regexp_matches(slug, '^.+-\d+$') AND CAST(regexp_extract(slug, '^(.+)-(\d+)$', 2) AS INT) >= 2 THEN regexp_extract(slug, '^(.+)-(\d+)$', 1) ELSE slug END AS base,
    list_sort(list_filter(list_transform(string_split(regexp_extract(substr(body, 1, 600), '\(collision group: ''([^'']*)''\)', 1), ','), lambda x: trim(x)), lambda x: x <> '')) AS marked FROM pages_ WHERE dir <> 'qa'),
    g AS (SELECT dir, base, list_sort(list(slug)) AS members, list(marked) AS marks FROM p GROUP BY 1, 2)
    SELECT base, array_to_string(members, ',') AS members, CAST(len(members) AS INT) AS size FROM g WHERE len(members) >= 2 AND len(list_filter(marks, lambda m: m = members)) < len(marks)"""
)
def g_c4_collisions(spark, d):
    return G.collisions(pages(spark, d)).withColumn("members", F.array_join("members", ","))


PAIRS = "refs AS (SELECT DISTINCT slug, split_part(unnest(sources), '#', 1) AS source FROM pages_ WHERE dir <> 'qa'), pr AS (SELECT DISTINCT x.slug AS a, y.slug AS b FROM refs x JOIN refs y ON x.source = y.source AND x.slug < y.slug)"


@query(f"WITH {PAGES.cte()}, {PAIRS} SELECT a, b FROM pr")
def j_12_shared_source(spark, d):
    return G.shared_source_pairs(pages(spark, d))


#: The three best pages by BM25 of each page's whole body.
NEIGHBOURS = f"""WITH {PAGES.cte()}, t AS (SELECT slug, row_number() OVER (ORDER BY slug) AS seq, {tokens_sql('body')} AS tokens FROM pages_ WHERE dir <> 'qa'), st AS (SELECT count(*) AS n, avg(len(tokens)) AS a FROM t), post AS (SELECT slug, seq, len(tokens) AS len, unnest(tokens) AS token FROM t),
df AS (SELECT token, count(DISTINCT slug) AS df FROM post GROUP BY 1), tf AS (SELECT slug, seq, len, token, count(*) AS tf FROM post GROUP BY ALL), q AS (SELECT slug AS query_id, token FROM post),
sc AS (SELECT query_id, slug, seq, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS score FROM q JOIN tf USING (token) JOIN df USING (token) CROSS JOIN st WHERE query_id <> slug GROUP BY 1, 2, 3)
SELECT query_id, slug AS neighbour, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seq) AS rank, score FROM sc WHERE score >= 1.0 QUALIFY rank <= 3"""
CANDIDATES = f"""WITH {PAGES.cte()}, {PAIRS}, nb AS (SELECT DISTINCT least(query_id, neighbour) AS a, greatest(query_id, neighbour) AS b FROM ({NEIGHBOURS}) AS x), both_ AS (SELECT a, b FROM pr UNION SELECT a, b FROM nb), t AS (SELECT slug, list_distinct({tokens_sql('body')}) AS t FROM pages_),
    s AS (SELECT a, b, CASE WHEN len(list_distinct(list_concat(x.t, y.t))) = 0 THEN 0 ELSE len(list_intersect(x.t, y.t)) / CAST(len(list_distinct(list_concat(x.t, y.t))) AS DOUBLE) END AS similarity FROM both_ JOIN t x ON x.slug = a JOIN t y ON y.slug = b)
    SELECT a, b, similarity, row_number() OVER (ORDER BY similarity DESC, a, b) AS place FROM s QUALIFY place <= 30"""


@query(CANDIDATES)
def g_c5_contradiction_candidates(spark, d):
    return G.contradictions(pages(spark, d))


@query(
    """SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey AND x.n_regionkey = y.n_regionkey
    UNION SELECT x.n_nationkey, y.n_nationkey FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey AND x.n_nationkey % 7 = y.n_nationkey % 7"""
)
def u_01_pair_union(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") % 7).alias("class"))
    pair = lambda c: rows.alias("x").join(rows.alias("y"), c).where("x.n_nationkey < y.n_nationkey").select(F.col("x.n_nationkey").alias("a"), F.col("y.n_nationkey").alias("b"))
    return pair("n_regionkey").union(pair("class")).distinct()


@query(
    f"""WITH {PAGES.cte()}, {DOCS.cte()}, {HASHES.cte()} SELECT p.slug, h.source, (epoch(CAST(modified AS TIMESTAMPTZ)) - epoch(CAST(updated AS TIMESTAMPTZ))) / 86400.0 AS drift_days
    FROM pages_ p JOIN docs_ ON basename = split_part(sources[1], '#', 1) JOIN hashes h ON h.slug = p.slug AND h.source = basename WHERE p.dir <> 'qa' AND h.hash IS NOT NULL AND h.hash <> sha256(content) AND CAST(modified AS TIMESTAMPTZ) >= CAST(updated AS TIMESTAMPTZ)"""
)
def g_c6_stale_pages(spark, d):
    maps = HASHES.df(spark, d).groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct("source", "hash"))).alias("hashes"))
    return G.stale_pages(pages(spark, d).join(maps, "slug", "left"), docs(spark, d))


@query(f"WITH {PAGES.cte()} SELECT slug, count, updated, row_number() OVER (ORDER BY count DESC, updated DESC, slug) AS place FROM pages_ WHERE dir = 'qa' AND status = 'draft' QUALIFY place <= 10")
def g_c8_promotion(spark, d):
    return G.promotion_candidates(pages(spark, d))


@query(
    f"""WITH {PAGES.cte()}, w AS (SELECT slug, CAST(arg_max(updated, dir) AS TIMESTAMPTZ) AS u FROM pages_ WHERE dir <> 'qa' GROUP BY 1), q AS (SELECT DISTINCT slug, CAST(updated AS TIMESTAMPTZ) AS t, split_part(unnest(sources), '#', 1) AS cited FROM pages_ WHERE dir = 'qa' AND status = 'live')
    SELECT q.slug, round(max(epoch(u) - epoch(t)) / 86400.0, 1) AS drift_days, array_to_string(list_sort(list(cited)), ',') AS cited FROM q JOIN w ON w.slug = cited WHERE epoch(u) - epoch(t) > 3 * 86400 GROUP BY 1"""
)
def g_c9_stale_answers(spark, d):
    return G.stale_answers(pages(spark, d)).withColumn("cited", F.array_join("cited", ","))


@query(
    f"""WITH {PAGES.cte()}, v AS (SELECT slug, fm, json_type(fm, '$.status') AS ks, fm ->> '$.status' AS s, json_type(fm, '$.type') AS kt, fm ->> '$.type' AS t, json_type(fm, '$.question') AS kq, fm ->> '$.question' AS q, json_type(fm, '$.count') AS kc, fm ->> '$.count' AS c FROM pages_ WHERE dir = 'qa')
    SELECT slug, 'status' AS property, coalesce(s, '<missing>') AS value FROM v WHERE NOT coalesce(s IN ('live', 'draft', 'stale', 'superseded'), false)
    UNION ALL SELECT slug, 'type', coalesce(t, '<missing>') FROM v WHERE NOT coalesce(t = 'qa', false)
    UNION ALL SELECT slug, 'question', coalesce(q, '<missing>') FROM v WHERE coalesce(kq, '') <> 'VARCHAR' OR trim(q) = ''
    UNION ALL SELECT slug, 'count', coalesce(c, '<missing>') FROM v WHERE coalesce(kc, '') NOT IN ('UBIGINT', 'BIGINT') OR CAST(c AS DOUBLE) <= 0"""
)
def g_c10_invalid_schema(spark, d):
    return G.invalid_answers(pages(spark, d))


@query(
    f"""WITH {PAGES.cte()}, {DOCS.cte()}, r AS (SELECT DISTINCT slug, split_part(unnest(sources), '#', 1) AS source FROM pages_ WHERE dir <> 'qa'), m AS (SELECT slug, source, source NOT IN (SELECT basename FROM docs_) AS gone FROM r)
    SELECT slug, array_to_string(list_sort(list(source) FILTER (gone)), ',') AS missing, CASE WHEN bool_and(gone) THEN 'full' ELSE 'partial' END AS kind FROM m GROUP BY 1 HAVING bool_or(gone)"""
)
def g_c11_orphans(spark, d):
    return G.orphans(pages(spark, d), docs(spark, d)).withColumn("missing", F.array_join("missing", ","))


@query(
    f"""WITH {PAGES.cte()}, a AS (SELECT alias, list_sort(list_distinct(list(slug))) AS c FROM (SELECT unnest(aliases) AS alias, slug FROM pages_) GROUP BY 1), s AS (SELECT *, alias IN (SELECT slug FROM pages_) AS own FROM a)
    SELECT CASE WHEN own THEN 'alias_vs_slug' ELSE 'alias_vs_alias' END AS kind, alias, array_to_string(c, ',') AS claimed_by, CASE WHEN own THEN alias ELSE c[1] END AS resolved_to FROM s WHERE own OR len(c) >= 2"""
)
def g_c12_alias_collisions(spark, d):
    return G.alias_collisions(pages(spark, d)).withColumn("claimed_by", F.array_join("claimed_by", ","))


#: The lines of the grammar, their question and the last value of each key behind it.
PARSED = rf"""{LOG.cte()}, g AS (SELECT line_no, regexp_extract(line, '^## \[([^\]]+)\] (\S+) \| (.*)$', ['ts', 'kind', 'summary']) AS x FROM log_ WHERE regexp_matches(line, '^## \[[^\]]+\] \S+ \| ')),
lg AS (SELECT line_no, x.ts AS ts, x.kind AS kind, regexp_extract(x.summary, '"([^"]*)"', 1) AS query, regexp_replace(x.summary, '"[^"]*"', '', 'g') AS rest FROM g),
kv AS (SELECT line_no, unnest(regexp_extract_all(rest, '(\w+)=(\S+)', 1)) AS k, unnest(regexp_extract_all(rest, '(\w+)=(\S+)', 2)) AS v, unnest(range(len(regexp_extract_all(rest, '(\w+)=(\S+)')))) AS i FROM lg),
kl AS (SELECT line_no, k, max_by(v, i) AS v, max(i) AS i FROM kv GROUP BY 1, 2)"""
CANONICAL = r"regexp_replace(trim(regexp_replace(trim(lower(query), chr(10) || ' '), '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g'), chr(10) || ' '), '\s+', ' ', 'g')"
#: The counter of pending failures goes row by row; a success counts where it stands at zero.
GAPS = f"""WITH RECURSIVE {PARSED},
o AS (SELECT *, {CANONICAL} AS canonical, kind = 'chat' AS good, row_number() OVER (PARTITION BY {CANONICAL} ORDER BY line_no) AS i FROM lg WHERE kind IN ('chat', 'chat_grounding_fallback')),
w AS (SELECT line_no, canonical, ts, good, i, CASE WHEN good THEN 0 ELSE 1 END AS pending, good AS success FROM o WHERE i = 1
  UNION ALL SELECT o.line_no, o.canonical, o.ts, o.good, o.i, CASE WHEN o.good THEN greatest(0, w.pending - 1) ELSE w.pending + 1 END, o.good AND w.pending = 0 FROM w JOIN o ON o.canonical = w.canonical AND o.i = w.i + 1),
a AS (SELECT canonical, max(ts) AS answered FROM w WHERE success GROUP BY 1),
f AS (SELECT o.*, r.v AS reason, coalesce(t.v, array_to_string(list_sort(string_split(c.v, ',')), ',')) AS section FROM o JOIN kl r ON r.line_no = o.line_no AND r.k = 'reason' AND r.v IN ('retrieval_empty', 'below_threshold', 'claim_unsupported')
  LEFT JOIN kl t ON t.line_no = o.line_no AND t.k = 'top_section' LEFT JOIN kl c ON c.line_no = o.line_no AND c.k = 'cited' WHERE NOT good),
u AS (SELECT canonical, reason, section, query, min(line_no) AS first FROM f GROUP BY ALL),
m AS (SELECT canonical, reason, section, list(query ORDER BY first)[1:3] AS samples FROM u GROUP BY ALL),
h AS (SELECT canonical, reason, section, count(*) AS hits, min(ts) AS first_seen, max(ts) AS last_seen FROM f GROUP BY ALL)
SELECT h.canonical, h.reason, h.section, hits, first_seen, last_seen, array_to_string(samples, '|') AS samples FROM h JOIN m ON m.canonical = h.canonical AND m.reason = h.reason AND m.section IS NOT DISTINCT FROM h.section LEFT JOIN a ON a.canonical = h.canonical
WHERE answered IS NULL OR answered <= last_seen"""


@query(f"""WITH {PARSED} SELECT lg.line_no, ts, kind, query, coalesce('{{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY i) || '}}', '{{}}') AS kv FROM lg LEFT JOIN kl USING (line_no) GROUP BY ALL""")
def s_06_log_scan(spark, d):
    return log(spark, d).select("line_no", "ts", "kind", "query", F.to_json("kv").alias("kv"))


@query(GAPS)
def g_c1_coverage(spark, d):
    return G.coverage_gaps(log(spark, d)).withColumn("samples", F.array_join("samples", "|"))


PENDING = (
    """WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type IN ('error', 'view')),
    w AS (SELECT event_id, user_id, event_type, i, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS pending, event_type = 'view' AS success FROM o WHERE i = 1
      UNION ALL SELECT o.event_id, o.user_id, o.event_type, o.i, CASE WHEN o.event_type = 'error' THEN w.pending + 1 ELSE greatest(0, w.pending - 1) END, o.event_type = 'view' AND w.pending = 0 FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
    SELECT event_id, success FROM w"""
)


@query(PENDING)
def w_05_pending_failures(spark, d):
    rows = table(spark, d, "events").where(F.col("event_type").isin("error", "view"))
    return G.pending_successes(rows, "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "view").select("event_id", "success")


@query(PENDING)
def w_05_pending_stream(spark, d):
    """The same from a stream of the table, in the order of event time, whatever the order of the rows."""
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").where(F.col("event_type").isin("error", "view"))
    # the order is that of the ids: each is a second of a clock
    rows = rows.select(F.col("user_id").alias("key"), F.col("event_id").alias("row_id"), F.timestamp_seconds(F.col("event_id") + 1).alias("ts"), (F.col("event_type") == "error").alias("failed"))
    out, name = C.scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = T.pending_failures_stream(rows, "0 seconds").writeStream.option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True)
        stream.start(f"{out}/rows", format="parquet").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema("key long, row_id long, success boolean").parquet(f"{out}/rows").select(F.col("row_id").alias("event_id"), "success")



def findings(spark, d):
    p, s = pages(spark, d), docs(spark, d)
    maps = HASHES.df(spark, d).groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct("source", "hash"))).alias("hashes"))
    return {
        "C1": G.coverage_gaps(log(spark, d)), "C2": G.red_links(p), "C3": G.failed_grounding(p, s).select("slug").distinct(), "C4": G.collisions(p), "C5": G.contradictions(p),
        "C6": G.stale_pages(p.join(maps, "slug", "left"), s), "C8": G.promotion_candidates(p), "C9": G.stale_answers(p), "C10": G.invalid_answers(p), "C11": G.orphans(p, s), "C12": G.alias_collisions(p),
    }


#: Each check's findings by the SQL of its own query, in report order.
COUNTED = {
    "C6": "g_c6_stale_pages", "C3": "g_c3_failed_grounding", "C11": "g_c11_orphans", "C5": "g_c5_contradiction_candidates", "C4": "g_c4_collisions", "C12": "g_c12_alias_collisions", "C1": "g_c1_coverage", "C2": "g_c2_red_links",
    "C8": "g_c8_promotion", "C10": "g_c10_invalid_schema", "C9": "g_c9_stale_answers",
}
FINDINGS = "SELECT nr AS place, check_id, label, axis, n FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS nr, '{check}' AS check_id, '{label}' AS label, '{axis}' AS axis, (SELECT count({'DISTINCT slug' if check == 'C3' else '*'}) FROM ({SQL[COUNTED[check]]}) AS x{i}) AS n" for i, (check, label, axis) in enumerate(G.TAXONOMY)
) + ") AS x"


@query(FINDINGS)
def a_08_findings_by_check(spark, d):
    return G.summary(findings(spark, d))


@query(f"SELECT axis, min(place) AS first, sum(n)::BIGINT AS n FROM ({FINDINGS}) AS f GROUP BY 1")
def a_09_findings_by_axis(spark, d):
    return G.summary(findings(spark, d)).groupBy("axis").agg(F.min("place").alias("first"), F.sum("n").alias("n"))


MARKDOWN = Fixture(
    "md",
    "name string, text string",
    [
        ("a.md", "<!-- auto\n -->\n\n---\nstatus: live\ncount: 2\n---\nintro text\n\n# Top\n\n## One\nbody one\n```\n# not a heading\n```\n## One\n\n### Deep\ndeep body\n## x-2\n# Next\nlast"),
        ("b.md", "no headings at all\n"), ("c.md", "---\n: [bad\n---\n# H"), ("d.md", ""), ("e.md", None), ("f.md", "# Only\n\n# Intro\nx\n# X\n# X\n"),
    ],
)


NL = "chr(10)"
#: A page with frontmatter, nested headings, one of them empty, and a fence around each document.
MARKDOWN.over("documents", {
    "name": "'d' || doc_id || '.md'",
    "text": f"'---' || {NL} || 'status: live' || {NL} || 'count: ' || doc_id || {NL} || '---' || {NL} || 'Intro of ' || doc_id || {NL} || '# Top' || {NL} || {NL} || '## One' || {NL} || text || {NL} || '```' || {NL} || '# not a heading' || {NL} || '```' || {NL} || '## One' || {NL} || {NL} || '### Deep' || {NL} || 'deep ' || source",
})


FRONTMATTER = Fixture(
    "want",
    "name string, frontmatter string, body string",
    [
        ("a.md", '{"status": "live", "count": 2}', "intro text\n\n# Top\n\n## One\nbody one\n```\n# not a heading\n```\n## One\n\n### Deep\ndeep body\n## x-2\n# Next\nlast"),
        ("b.md", "{}", "no headings at all\n"), ("c.md", "{}", "---\n: [bad\n---\n# H"), ("d.md", "{}", ""), ("e.md", None, None), ("f.md", "{}", "# Only\n\n# Intro\nx\n# X\n# X\n"),
    ],
)
FRONTMATTER.over("documents", {
    "name": "'d' || doc_id || '.md'",
    "frontmatter": """'{"status": "live", "count": ' || doc_id || '}'""",
    "body": f"'Intro of ' || doc_id || {NL} || '# Top' || {NL} || {NL} || '## One' || {NL} || text || {NL} || '```' || {NL} || '# not a heading' || {NL} || '```' || {NL} || '## One' || {NL} || {NL} || '### Deep' || {NL} || 'deep ' || source",
})
#: A heading without text of its own and with deeper ones below it is no section; a repeated slug gets a number.
SECTIONS = Fixture(
    "want",
    "name string, emit_seq int, heading string, heading_path string, content string, leaf boolean, id string",
    [
        ("a.md", 0, "a.md", "a.md", "intro text", True, "a.md#intro"), ("a.md", 1, "One", "Top > One", "body one\n```\n# not a heading\n```", True, "a.md#one"), ("a.md", 2, "Deep", "Top > One > Deep", "deep body", True, "a.md#deep"),
        ("a.md", 3, "x-2", "Top > x-2", "", True, "a.md#x-2"), ("a.md", 4, "Next", "Next", "last", True, "a.md#next"), ("b.md", 0, "b.md", "b.md", "no headings at all", True, "b.md"),
        ("c.md", 0, "c.md", "c.md", "---\n: [bad\n---", True, "c.md#intro"), ("c.md", 1, "H", "H", "", True, "c.md#h"), ("d.md", 0, "d.md", "d.md", "", True, "d.md"),
        ("f.md", 0, "Only", "Only", "", True, "f.md#only"), ("f.md", 1, "Intro", "Intro", "x", True, "f.md#intro"), ("f.md", 2, "X", "X", "", True, "f.md#x"), ("f.md", 3, "X", "X", "", True, "f.md#x-2"),
    ],
)


@query(f"WITH {FRONTMATTER.cte()} SELECT * FROM want")
def f_06_frontmatter(spark, d):
    return S.with_frontmatter(MARKDOWN.df(spark, d)).select("name", "frontmatter", "body")


def parsed(spark, d):
    files = S.with_frontmatter(MARKDOWN.df(spark, d))
    return files, S.sections(files)


#: What the nested headings of ``MARKDOWN`` give: three sections of each document.
NESTED = r"""SELECT 'd' || doc_id || '.md' AS name, n AS emit_seq, CASE n WHEN 0 THEN 'd' || doc_id || '.md' WHEN 1 THEN 'One' ELSE 'Deep' END AS heading, CASE n WHEN 0 THEN 'd' || doc_id || '.md' WHEN 1 THEN 'Top > One' ELSE 'Top > One > Deep' END AS heading_path,
CASE n WHEN 0 THEN 'Intro of ' || doc_id WHEN 1 THEN ltrim(text || chr(10) || '```' || chr(10) || '# not a heading' || chr(10) || '```', ' ' || chr(10)) ELSE 'deep ' || source END AS content, true AS leaf,
'd' || doc_id || '.md#' || CASE n WHEN 0 THEN 'intro' WHEN 1 THEN 'one' ELSE 'deep' END AS id FROM documents, (SELECT CAST(unnest(range(3)) AS INT) AS n) AS p"""


@query(NESTED)
def f_36_sections(spark, d):
    return parsed(spark, d)[1].withColumn("heading_path", F.array_join("heading_path", " > "))


#: No document has a heading: each is one section, its whole text.
@query("SELECT CAST(doc_id AS VARCHAR) AS name, 0 AS emit_seq, CAST(doc_id AS VARCHAR) AS id, sha256(trim(text, ' ' || chr(10))) AS content_sha FROM documents")
def f_36_sections_of_documents(spark, d):
    rows = S.sections(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body")))
    return rows.select("name", "emit_seq", "id", F.sha2("content", 256).alias("content_sha"))


@query(f"WITH {MARKDOWN.cte()} SELECT name, 0 AS missing FROM md")
def a_28_uncarried(spark, d):
    files, rows = parsed(spark, d)
    return S.uncarried(files, rows)


@query("SELECT CAST(doc_id AS VARCHAR) AS name, length(text) >= 2000 AS longform FROM documents")
def p_14_longform(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))
    return S.longform(files, S.sections(files))


@query(
    r"""WITH l AS (SELECT doc_id, regexp_replace(translate(trim(regexp_replace(unnest(string_split(text, chr(10))), '[\s\x{A0}]+', ' ', 'g')), 'lI', '11'), '\d+', '#', 'g') AS key FROM documents),
    c AS (SELECT doc_id, key, count(*) AS n FROM l WHERE key <> '' GROUP BY 1, 2), f AS (SELECT doc_id, key FROM c WHERE n >= 3 AND (length(key) >= 5 OR regexp_matches(key, '^#\s*/\s*#$')))
    SELECT doc_id, key FROM f UNION SELECT c.doc_id, c.key FROM c JOIN f ON f.doc_id = c.doc_id AND starts_with(f.key, c.key) WHERE n >= 2 AND length(c.key) >= 5"""
)
def a_04_furniture(spark, d):
    return S.furniture(table(spark, d, "documents"))


@query()
def f_20_html_to_markdown(spark, d):
    return S.convert_pages(table(spark, d, "pages")).select("page_id", "url", "markdown")


@query(r"SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages".replace('\\"', '"'))
def f_20_page_links(spark, d):
    rows = table(spark, d, "pages")
    return rows.select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


@query()
def f_23_split_text(spark, d):
    return S.chunks(table(spark, d, "documents"), "doc_id", "text")


PARAGRAPHS = Fixture("pg", "id int, t string", [(1, "aaa bbb\n\nccc\n\n" + "d" * 40 + "\n\ne"), (2, ""), (3, "one"), (4, "x" * 50 + "\n \n" + "y" * 5 + "\n\nz")])


#: The sentences of each document as paragraphs.
PARAGRAPHS.over("documents", {"id": "doc_id", "t": "replace(text, '. ', '.' || chr(10) || chr(10))"})


@query(
    rf"""WITH RECURSIVE {PARAGRAPHS.cte()}, p AS (SELECT id, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM pg),
    w AS (SELECT id, 1 AS i, '' AS cur, CAST([] AS VARCHAR[]) AS done, ps FROM p
      UNION ALL SELECT id, i + 1, CASE WHEN cur = '' THEN ps[i] WHEN length(cur || chr(10) || chr(10) || ps[i]) // 3 <= 60 THEN cur || chr(10) || chr(10) || ps[i] ELSE ps[i] END,
        CASE WHEN cur = '' OR length(cur || chr(10) || chr(10) || ps[i]) // 3 <= 60 THEN done ELSE list_append(done, cur) END, ps FROM w WHERE i <= len(ps)),
    f AS (SELECT id, CASE WHEN cur = '' THEN done ELSE list_append(done, cur) END AS parts FROM w WHERE i = len(ps) + 1)
    SELECT id, CAST(unnest(range(len(parts))) AS INT) AS place, unnest(parts) AS part FROM f"""
)
def w_11_pack_paragraphs(spark, d):
    return PARAGRAPHS.df(spark, d).select("id", F.posexplode(S.pack_paragraphs(F.col("t"), 60)).alias("place", "part"))


@query(
    f"""WITH {PAGES.cte()} SELECT slug, CASE WHEN status = 'failed_grounding' THEN 'dropped' WHEN dir <> 'qa' THEN 'indexed' WHEN fm IS NULL THEN 'dropped' WHEN fm ->> '$.status' = 'live' THEN 'indexed' WHEN fm ->> '$.status' = 'draft' THEN 'skipped' ELSE 'warned' END AS admission FROM pages_"""
)
def p_01_admission(spark, d):
    status = F.expr("try_variant_get(parse_json(fm), '$.status', 'string')")
    how = F.when(F.col("status") == "failed_grounding", "dropped").when(F.col("dir") != "qa", "indexed").when(F.col("fm").isNull(), "dropped").when(status == "live", "indexed").when(status == "draft", "skipped").otherwise("warned")
    return pages(spark, d).select("slug", how.alias("admission"))


@query(
    f"""WITH {PAGES.cte()}, q AS (SELECT slug, split_part(unnest(sources), '#', 1) AS cited FROM pages_ WHERE dir = 'qa'), l AS (SELECT slug, trim(unnest(regexp_extract_all(body, '{X.WIKILINK}', 1))) AS t FROM pages_), {RESOLVE}
    SELECT DISTINCT canonical AS target, slug AS source, 'link' AS how FROM l JOIN res ON name = t UNION SELECT DISTINCT cited, slug, 'citation' FROM q"""
)
def j_09_inbound(spark, d):
    links = pages(spark, d).select("slug", F.explode(X.wikilinks("body")).alias("name")).join(G.resolution_map(pages(spark, d)), "name").select(F.col("canonical").alias("target"), F.col("slug").alias("source"), F.lit("link").alias("how"))
    cites = pages(spark, d).where("dir = 'qa'").select(F.explode("sources").alias("ref"), "slug").select(F.element_at(F.split("ref", "#"), 1).alias("target"), F.col("slug").alias("source"), F.lit("citation").alias("how"))
    return links.union(cites).distinct()


@query(
    f"""WITH {PAGES.cte()}, r AS (SELECT slug, list_filter(sources, lambda s: contains(s, '#')) AS refs FROM pages_) SELECT slug, array_to_string(list_transform(refs, lambda s: split_part(s, '#', 1)), ',') AS derived_from FROM r"""
)
def j_05_derived_from(spark, d):
    return pages(spark, d).select("slug", F.array_join(F.transform(F.filter("sources", lambda s: F.instr(s, F.lit("#")) > 0), lambda s: F.element_at(F.split(s, "#"), 1)), ",").alias("derived_from"))


@query(f"""WITH {PAGES.cte()}, s AS (SELECT split_part(unnest(sources), '#', 1) AS source, slug, status FROM pages_ WHERE dir <> 'qa') SELECT source, count(*) AS pages, bool_and(status = 'live') AS skip FROM (SELECT DISTINCT * FROM s) GROUP BY 1""")
def j_23_hash_skip(spark, d):
    refs = pages(spark, d).where("dir <> 'qa'").select(F.explode("sources").alias("ref"), "slug", "status").select(F.element_at(F.split("ref", "#"), 1).alias("source"), "slug", "status").distinct()
    return refs.groupBy("source").agg(F.count("*").alias("pages"), F.every(F.col("status") == "live").alias("skip"))


@query(
    f"""WITH {PAGES.cte()}, {DOCS.cte()}, r AS (SELECT DISTINCT slug, split_part(unnest(sources), '#', 1) AS source FROM pages_ WHERE dir <> 'qa')
    SELECT slug, bool_and(source = 'src0.md' OR source NOT IN (SELECT basename FROM docs_)) AS full_orphan FROM r GROUP BY 1 HAVING bool_or(source = 'src0.md')"""
)
def j_25_retire_impact(spark, d):
    refs = pages(spark, d).where("dir <> 'qa'").select("slug", F.explode("sources").alias("ref")).select("slug", F.element_at(F.split("ref", "#"), 1).alias("source")).distinct()
    left = docs(spark, d).where("basename <> 'src0.md'").select(F.col("basename").alias("source")).distinct().withColumn("there", F.lit(True))
    return refs.join(left, "source", "left").groupBy("slug").agg(F.every(F.col("there").isNull()).alias("full_orphan"), F.bool_or(F.col("source") == "src0.md").alias("hit")).where("hit").drop("hit")


@query(f"WITH {PAGES.cte()} SELECT dir AS file, count(*) AS bullets, string_agg('- [[' || slug || ']]' || CASE WHEN len(aliases) > 0 THEN ' (' || array_to_string(aliases, ', ') || ')' ELSE '' END, chr(10) ORDER BY slug) AS listing FROM pages_ GROUP BY 1")
def k_04_wiki_index(spark, d):
    bullet = F.concat(F.lit("- [["), "slug", F.lit("]]"), F.when(F.size("aliases") > 0, F.concat(F.lit(" ("), F.array_join("aliases", ", "), F.lit(")"))).otherwise(""))
    rows = pages(spark, d).select(F.col("dir").alias("file"), F.struct("slug", bullet.alias("b")).alias("x")).groupBy("file").agg(F.count("*").alias("bullets"), F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("file", "bullets", F.array_join(F.transform("x", lambda x: x["b"]), "\n").alias("listing"))
