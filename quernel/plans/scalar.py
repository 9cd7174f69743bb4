"""Scalar functions over the test tables and literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .registry import Fixture, query, table

HAN = X.HAN
TEXTS = Fixture(
    "texts",
    "id int, t string",
    [
        (1, "How do I 退款 my order 7 days?"), (2, "退貨政策 and refunds"), (3, "貨"), (4, "What's the API-key?"), (5, "𠀀𠀁x"), (6, ""), (7, None),
        (8, "Foo É退 ٣ Bar!"), (9, "  --  "), (10, "Straße 12 a b"), (11, "帳號 account deletion 申請流程"), (12, "A 1 b2"), (13, "\"quoted\" it's, ok?!"),
    ],
)
#: Benchmark passages among Han characters.
TEXTS.over("benchmark", {
    "id": "item_id",
    "t": "CASE item_id % 5 WHEN 0 THEN '退貨政策 ' WHEN 1 THEN '貨' ELSE '' END || text || CASE item_id % 3 WHEN 0 THEN ' How do I 退款 my API-key?' WHEN 1 THEN ' 帳號 申請流程 É退 ٣' ELSE '' END",
})
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


def tokens_sql(x: str) -> str:
    """The tokenizer as DuckDB SQL."""
    return (
        f"list_filter(flatten(list_transform(regexp_extract_all(lower({x}), '{X.WORD_OR_HAN}'), lambda r: CASE WHEN regexp_matches(r, '^[a-z0-9]') OR length(r) < 2 THEN [r]"
        f" ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)), lambda t: NOT list_contains({STOP}, t) AND NOT regexp_matches(t, '^[a-z]$'))"
    )


def slug_sql(x: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"coalesce(nullif(trim(regexp_replace(translate({x}, '{upper}', '{upper.lower()}'), '[^\p{{L}}0-9]+', '-', 'g'), '-'), ''), 'section')"


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def count_sql(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


@query(f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")
def f_01_tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.tokenize("text"), " ").alias("tokens"))


@query(f"WITH {TEXTS.cte()} SELECT id, array_to_string({tokens_sql('t')}, ' ') AS tokens FROM texts")
def f_01_tokenize_han(spark, d):
    return TEXTS.df(spark, d).select("id", F.array_join(X.tokenize("t"), " ").alias("tokens"))


@query(f"SELECT p_partkey, {slug_sql('p_name')} AS slug FROM part")
def f_02_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slugify("p_name").alias("slug"))


@query(f"WITH {TEXTS.cte()} SELECT id, {slug_sql('t')} AS slug FROM texts")
def f_02_slug_han(spark, d):
    return TEXTS.df(spark, d).select("id", X.slugify("t").alias("slug"))


@query(f"WITH {TEXTS.cte()} SELECT id, i AS at, regexp_matches(substr(t, i, 1), '[{HAN}]') AS han FROM (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM texts)")
def f_03_is_han(spark, d):
    rows = TEXTS.df(spark, d).where("length(t) > 0").select("id", "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("i")).withColumn("at", F.col("i").cast("long"))
    return rows.select("id", "at", X.is_han(F.substring("t", F.col("at").cast("int"), F.lit(1))).alias("han"))


LANG_SQL = f"CASE WHEN h + o > 0 AND h >= 0.20 * (h + o) THEN 'zh' ELSE 'en' END"


@query(
    rf"""SELECT doc_id, {LANG_SQL} AS lang FROM (SELECT doc_id, {count_sql('text', f'[{HAN}]')} AS h, {count_sql('text', r'\p{L}')} - {count_sql('text', f'[{HAN}]')} AS o FROM documents)"""
)
def f_04_detect_lang(spark, d):
    return table(spark, d, "documents").select("doc_id", X.detect_lang("text").alias("lang"))


@query(
    rf"""WITH {TEXTS.cte()}, c AS (SELECT id, coalesce({count_sql('t', f'[{HAN}]')}, 0) AS h, coalesce({count_sql('t', r'\p{L}')}, 0) - coalesce({count_sql('t', f'[{HAN}]')}, 0) AS o,
    coalesce({count_sql('t', '[A-Za-z]')}, 0) AS a FROM texts)
    SELECT id, {LANG_SQL} AS lang, CASE WHEN h + a > 0 THEN h / CAST(h + a AS DOUBLE) ELSE 0 END AS ratio FROM c"""
)
def f_05_script_ratio(spark, d):
    return TEXTS.df(spark, d).select("id", X.detect_lang("t").alias("lang"), X.script_ratio("t").alias("ratio"))


@query(f"SELECT doc_id, {norm_sql('text')} AS q FROM documents")
def f_07_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_question("text").alias("q"))


@query(
    f"""SELECT doc_id, (CASE WHEN {slug_sql('l')} = 'section' THEN 'qa' ELSE substr({slug_sql('l')}, 1, 40) END) || '-' || substr(sha1({norm_sql('l')}), 1, 6) AS slug
    FROM (SELECT doc_id, split_part(text, chr(10), 1) AS l FROM documents)"""
)
def f_08_slug_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.question_slug(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"))


@query(
    r"""SELECT item_id, regexp_replace(trim(regexp_replace(trim(lower(text), chr(10) || ' '), '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g'), chr(10) || ' '), '\s+', ' ', 'g') AS q FROM benchmark"""
)
def f_09_canonicalise(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.canonical_query("text").alias("q"))


SUMMARIES = Fixture("s", "id int, summary string", [(1, '"how to=x" reason=empty top_section=a#b reason=late'), (2, "cited=a,b"), (3, ""), (4, '"q" x= y=2')])
SUMMARIES.over("events", {
    "id": "event_id",
    "summary": "'\"how to=x\" reason=' || event_type || ' user=' || user_id || CASE event_id % 3 WHEN 0 THEN ' reason=late x= y=2' WHEN 1 THEN ' cited=a,b' ELSE '' END",
})


@query(
    rf"""WITH {SUMMARIES.cte()}, p AS (SELECT id, unnest(regexp_extract_all(regexp_replace(summary, '"[^"]*"', '', 'g'), '(\w+)=(\S+)', 1)) AS k,
    unnest(regexp_extract_all(regexp_replace(summary, '"[^"]*"', '', 'g'), '(\w+)=(\S+)', 2)) AS v,
    unnest(range(len(regexp_extract_all(regexp_replace(summary, '"[^"]*"', '', 'g'), '(\w+)=(\S+)')))) AS i FROM s)
    SELECT id, k, max_by(v, i) AS v FROM p GROUP BY id, k"""
)
def f_10_parse_kv(spark, d):
    return SUMMARIES.df(spark, d).select("id", F.explode(X.parse_kv("summary")).alias("k", "v"))


BODIES = Fixture(
    "b", "id int, body string",
    [(1, "see [[refunds]] and [[ shipping #fees|Fees]] [[a|b]] [Source: docs.md#a ] [Source:  x.md#b]"), (2, "none [[]] [Source: ]"), (3, "[[x#y]] [[x]] [Source: z][Source: z]")],
)
BODIES.over("documents", {
    "id": "doc_id",
    "body": "text || ' [[p' || (doc_id div 3) || ']] [[ x' || (doc_id % 5) || ' #fees|Fees]] [[p' || (doc_id div 3) || '|b]] [Source: f' || (doc_id % 7) || '.md#a ] [Source:  x.md#b]' || CASE doc_id % 4 WHEN 0 THEN ' [[]] [Source: ]' ELSE '' END",
})


@query(rf"WITH {BODIES.cte()} SELECT id, trim(x) AS slug, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(body, '{X.WIKILINK}', 1)) AS x FROM b) GROUP BY 1, 2")
def f_11_wikilinks(spark, d):
    return BODIES.df(spark, d).select("id", F.explode(X.wikilinks("body")).alias("slug")).groupBy("id", "slug").agg(F.count("*").alias("n"))


@query(
    rf"""WITH {BODIES.cte()} SELECT id, array_to_string(regexp_extract_all(body, '{X.CITATION_TRIMMED}', 1), '|') AS inline,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, '{X.CITATION}', 1), lambda x: trim(x)))), '|') AS cited FROM b"""
)
def f_12_citations(spark, d):
    return BODIES.df(spark, d).select("id", F.array_join(X.citations("body"), "|").alias("inline"), F.array_join(X.cited_ids("body"), "|").alias("cited"))


@query("SELECT doc_id, length(text) // 3 AS tokens FROM documents")
def f_13_estimate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens("text").alias("tokens"))


@query("SELECT doc_id, sha256(text) AS text_sha, sha256(concat_ws('|', source, lang)) AS pair_sha FROM documents")
def f_14_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"), F.sha2(F.concat_ws("|", "source", "lang"), 256).alias("pair_sha"))


LINES = Fixture("l", "id int, t string", [(1, "Page  2/63 Il"), (2, "  p\u00a0age 11 l"), (3, "⼀⽂ text ⼭"), (4, "（全） ：ok， done。"), (5, "say \"hi\"\nnow\r!")])
LINES.over("documents", {
    "id": "doc_id",
    "t": "text || CASE doc_id % 3 WHEN 0 THEN ' Page  ' || doc_id || '/63 Il' WHEN 1 THEN ' ⼀⽂ text ⼭' ELSE ' （全） ：ok， done。 say \"hi\"' END",
})


@query(rf"WITH {LINES.cte()} SELECT id, regexp_replace(translate(trim(regexp_replace(t, '[\s\x{{A0}}]+', ' ', 'g')), 'lI', '11'), '\d+', '#', 'g') AS k FROM l WHERE id <= 2")
def f_17_furniture_key(spark, d):
    return LINES.df(spark, d).where("id <= 2").select("id", X.furniture_key("t").alias("k"))


@query(f"WITH {LINES.cte()} SELECT id, nfc_normalize(translate(t, '⼀⽂⼭', '一文山')) AS t FROM l WHERE id = 3")
def f_15_kangxi(spark, d):
    return LINES.df(spark, d).where("id = 3").select("id", X.kangxi("t").alias("t"))


@query(rf"WITH {LINES.cte()} SELECT id, translate(regexp_replace(t, '[\s\x{{A0}}]+', '', 'g'), '，。：；！？（）', ',.:;!?()') AS anchor FROM l")
def f_18_anchor(spark, d):
    return LINES.df(spark, d).select("id", X.normalize_anchor("t").alias("anchor"))


@query(rf"WITH {LINES.cte()} SELECT id, replace(replace(replace(substr(t, 1, 60), chr(10), ''), chr(13), ''), '\"', '''') AS safe, CASE WHEN length(t) > 6 THEN substr(t, 1, 6) || '…' ELSE t END AS short FROM l".replace('\\"', '"'))
def f_29_truncate(spark, d):
    return LINES.df(spark, d).select("id", X.log_safe("t").alias("safe"), X.truncated("t", 6, "…").alias("short"))


@query("SELECT item_id, '<<<UNTRUSTED>>>' || chr(10) || text || chr(10) || '<<<END>>>' AS wrapped FROM benchmark")
def f_30_wrap_untrusted(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.wrap_untrusted("text").alias("wrapped"))


HOPS = Fixture("h", "id int, xff string, peer string", [(1, "1.1.1.1, 2.2.2.2 ", "9.9.9.9"), (2, None, "9.9.9.9"), (3, "", None), (4, "3.3.3.3", None), (5, "a,", "p")])
HOPS.over("events", {
    "id": "event_id",
    "xff": "CASE event_id % 5 WHEN 0 THEN '10.0.0.' || user_id || ', 2.2.2.' || (event_id % 250) || ' ' WHEN 1 THEN '' WHEN 2 THEN 'a,' WHEN 3 THEN '3.3.3.' || user_id END",
    "peer": "CASE WHEN event_id % 3 = 0 THEN '9.9.9.' || user_id END",
})


@query(f"WITH {HOPS.cte()} SELECT id, coalesce(nullif(trim(list_last(string_split(xff, ','))), ''), nullif(peer, ''), 'unknown') AS ip FROM h")
def f_32_client_ip(spark, d):
    return HOPS.df(spark, d).select("id", X.client_ip("xff", "peer").alias("ip"))


PATHS = Fixture("p", "path string", [("/wiki/qa/a-b/refile",), ("/wiki/qa/a-b",), ("/wiki/qa/promote-batch",), ("/wiki/pages/x/aliases/y",), ("/wiki/pages/x/aliases",), ("/wiki/pages/x/",), ("/chat/stream",), ("/",), ("/wiki/qa/z/demote",), ("/wiki/pages/reconcile",)])
PATHS.over("documents", {
    "path": "CASE doc_id % 10 WHEN 0 THEN '/wiki/qa/s' || doc_id || '/refile' WHEN 1 THEN '/wiki/qa/s' || doc_id WHEN 2 THEN '/wiki/qa/promote-batch' WHEN 3 THEN '/wiki/pages/s' || doc_id || '/aliases/y' WHEN 4 THEN '/wiki/pages/s' || doc_id || '/aliases' WHEN 5 THEN '/wiki/pages/s' || doc_id || '/' WHEN 6 THEN '/chat/' || source WHEN 7 THEN '/' WHEN 8 THEN '/wiki/qa/s' || doc_id || '/demote' ELSE '/wiki/pages/reconcile' END",
})


@query(
    rf"""WITH {PATHS.cte()}, n AS (SELECT path, CASE WHEN length(path) > 1 THEN rtrim(path, '/') ELSE path END AS q FROM p), s AS (SELECT path, q, string_split(q, '/') AS s FROM n)
    SELECT path, CASE WHEN s[2:3] = ['wiki', 'qa'] AND len(s) = 5 AND s[5] IN ('refile', 'promote', 'demote') THEN '/wiki/qa/{{slug}}/' || s[5]
      WHEN s[2:3] = ['wiki', 'pages'] AND len(s) = 6 AND s[5] = 'aliases' THEN '/wiki/pages/{{slug}}/aliases/{{alias}}'
      WHEN s[2:3] = ['wiki', 'pages'] AND len(s) = 5 AND s[5] = 'aliases' THEN '/wiki/pages/{{slug}}/aliases'
      WHEN s[2:3] = ['wiki', 'pages'] AND len(s) = 4 AND s[4] NOT IN ('reconcile', 'collision') THEN '/wiki/pages/{{slug}}'
      WHEN s[2:3] = ['wiki', 'qa'] AND len(s) = 4 AND s[4] <> 'promote-batch' THEN '/wiki/qa/{{slug}}' ELSE q END AS template FROM s"""
)
def f_33_canonical_path(spark, d):
    return PATHS.df(spark, d).select("path", X.canonical_path("path").alias("template"))


PAIR = f"FROM (SELECT a.item_id AS a, b.item_id AS b, list_distinct({tokens_sql('a.text')}) AS x, list_distinct({tokens_sql('b.text')}) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"


def _neighbours(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", X.tokenize("text").alias("t"))
    return rows.select(F.col("item_id").alias("a"), F.col("t").alias("x")).join(rows.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("t").alias("y")), "a")


@query(f"SELECT a, b, len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) AS similarity {PAIR}")
def f_24_jaccard(spark, d):
    return _neighbours(spark, d).select("a", "b", X.jaccard("x", "y").alias("similarity"))


@query(f"SELECT a, b, len(list_intersect(x, y)) / CAST(len(x) AS DOUBLE) AS overlap, CASE WHEN len(list_intersect(x, y)) / CAST(len(x) AS DOUBLE) >= 0.5 THEN 'high_overlap' ELSE 'low_overlap' END AS stratum {PAIR}")
def f_25_overlap_ratio(spark, d):
    ratio = X.overlap_ratio("x", "y")
    return _neighbours(spark, d).select("a", "b", ratio.alias("overlap"), F.when(ratio >= 0.5, "high_overlap").otherwise("low_overlap").alias("stratum"))


DRIFT = f"FROM (SELECT a.item_id AS a, {tokens_sql('a.text')} AS x, {tokens_sql('b.text')} AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"


@query(
    f"""SELECT a, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(x), list_distinct(y))) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END AS jaccard,
    len(y) / CAST(greatest(len(x), 1) AS DOUBLE) AS length_ratio, len(list_distinct(y)) - len(list_intersect(list_distinct(x), list_distinct(y))) AS added {DRIFT}"""
)
def f_26_drift(spark, d):
    return _neighbours(spark, d).select(
        "a", X.jaccard("x", "y", 1.0).alias("jaccard"), (F.size("y") / F.greatest(F.size("x"), F.lit(1))).alias("length_ratio"), F.size(F.array_except("y", "x")).alias("added")
    )


ANSWERS = Fixture("a", "id int, answer string", [(1, " I cannot confirm from the knowledge base. "), (2, "I cannot confirm"), (3, None)])
ANSWERS.over("documents", {
    "id": "doc_id",
    "answer": "CASE doc_id % 4 WHEN 0 THEN ' I cannot confirm from the knowledge base. ' WHEN 1 THEN 'I cannot confirm' WHEN 2 THEN text END",
})


@query(f"WITH {ANSWERS.cte()} SELECT id, trim(answer) = '{X.REFUSAL}' AS refused FROM a")
def f_27_refusal(spark, d):
    return ANSWERS.df(spark, d).select("id", X.is_refusal("answer").alias("refused"))


DATES = Fixture("t", "id int, ts string", [(1, "2024-05-01T10:00:00Z"), (2, "2024-05-01T10:00:00"), (3, "2024-05-01"), (4, "soon"), (5, None), (6, "2024-05-01T10:00:00+02:00")])
DATES.over("documents", {
    "id": "doc_id",
    "ts": "CASE WHEN doc_id % 6 = 5 THEN CASE doc_id % 4 WHEN 1 THEN 'soon' END ELSE '2024-05-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || CASE doc_id % 6 WHEN 0 THEN 'T10:00:00Z' WHEN 1 THEN 'T10:00:00' WHEN 2 THEN '' WHEN 3 THEN 'T10:00:00+02:00' ELSE 'T23:59:59Z' END END",
})


@query(f"WITH {DATES.cte()} SELECT id, CAST(epoch(try_cast(ts AS TIMESTAMPTZ)) AS BIGINT) AS s FROM t")
def f_28_parse_instant(spark, d):
    return DATES.df(spark, d).select("id", F.unix_seconds(X.parse_instant("ts")).alias("s"))


SECTIONS = Fixture("s", "id string, path array<string>, content string", [("a#b", ["A", "B"], " body "), ("c", [], "only"), ("d#e", ["D"], "  "), ("f", [], "")])
SECTIONS.over("documents", {
    "id": "'d' || doc_id",
    "path": "CASE doc_id % 4 WHEN 0 THEN array(source, lang) WHEN 1 THEN array(source) ELSE array() END",
    "content": "CASE doc_id % 3 WHEN 0 THEN '  ' ELSE ' ' || text || ' ' END",
})


@query(
    f"""WITH {SECTIONS.cte()} SELECT id, CASE WHEN len(path) > 0 AND trim(content) <> '' THEN array_to_string(path, ' > ') || chr(10) || trim(content)
    WHEN trim(content) <> '' THEN trim(content) WHEN len(path) > 0 THEN array_to_string(path, ' > ') ELSE id END AS text FROM s"""
)
def f_22_embed_text(spark, d):
    return SECTIONS.df(spark, d).select("id", X.embed_text("path", "content", "id").alias("text"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def f_39_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("try_variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


NAMES = Fixture("n", "id int, name string", [(1, "a.md"), (2, "../x"), (3, "a#b.md"), (4, "c:\\d"), (5, "wiki/a.md"), (6, "/abs"), (7, ".hidden"), (8, ""), (9, "docs/../raw/x"), (10, "名.md"), (11, "a\u202eb"), (12, "raw/x\ty")])
NAMES.over("documents", {
    "id": "doc_id",
    "name": "CASE doc_id % 12 WHEN 0 THEN '../x' || doc_id WHEN 1 THEN source || '#b.md' WHEN 2 THEN 'c:' || chr(92) || 'd' WHEN 3 THEN 'wiki/' || doc_id || '.md' WHEN 4 THEN '/abs' || doc_id WHEN 5 THEN '.hidden' WHEN 6 THEN '' WHEN 7 THEN 'docs/../raw/x' WHEN 8 THEN '名' || doc_id || '.md' WHEN 9 THEN 'raw/x' || chr(9) || 'y' ELSE source || '.md' END",
})


@query(
    rf"""WITH {NAMES.cte()} SELECT id, name <> '' AND NOT regexp_matches(name, '[/\\\x00-\x1f]') AND name NOT IN ('.', '..') AND NOT starts_with(name, '.') AS slug_ok,
    trim(name) <> '' AND NOT regexp_matches(name, '[#/\\:\x00-\x1f\x7f\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]') AS file_ok,
    NOT regexp_matches(name, '^([/\\]|[A-Za-z]:)') AND NOT list_contains(regexp_split_to_array(name, '[/\\]'), '..') AND regexp_split_to_array(name, '[/\\]')[1] IN ('docs', 'raw', 'wiki') AS path_ok FROM n"""
)
def p_08_safe_names(spark, d):
    return NAMES.df(spark, d).select("id", X.bare_slug("name").alias("slug_ok"), X.safe_filename("name").alias("file_ok"), X.safe_path("name", ["docs", "raw", "wiki"]).alias("path_ok"))
