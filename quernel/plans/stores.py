"""Files and stores: scans, indices, uploads, query sets, outlines, reports, streams of frames and the seams' logic."""

from __future__ import annotations

import datetime
import zlib

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dense, reports, seams
from ..operators import evaluation as E
from ..operators import governance as G
from ..operators import sections as S
from ..operators.cells import Cells
from ..operators.postings import Index
from ..sources import corpus as C
from ..streaming import stateful as T
from .governance import MARKDOWN
from .registry import Fixture, query, table
from .retrieval import KNN, STATS, index_of, probes
from .scalar import tokens_sql

# ---------------------------------------------------------------- files

#: A page for each document, in the whitelisted folders, beside them, below hidden folders and as a hidden file.
TREE = "(SELECT doc_id, n_chars AS bytes, CASE doc_id % 6 WHEN 0 THEN 'entities/' WHEN 1 THEN 'concepts/' WHEN 2 THEN 'qa/' WHEN 3 THEN 'other/' WHEN 4 THEN 'entities/.trash/' ELSE '' END || CASE WHEN doc_id % 35 = 0 THEN '.' ELSE '' END || doc_id || '.md' AS path FROM documents) AS files"


def files(spark, d):
    folder = F.get(F.array(*map(F.lit, ("entities/", "concepts/", "qa/", "other/", "entities/.trash/", ""))), (F.col("doc_id") % 6).cast("int"))
    path = F.concat(folder, F.when(F.col("doc_id") % 35 == 0, ".").otherwise(""), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("bytes"), path.alias("path"))


@query(f"SELECT doc_id, path FROM {TREE} WHERE contains(path, '/') AND split_part(path, '/', 1) IN ('entities', 'concepts', 'qa')")
def s_02_subdirs(spark, d):
    return C.in_subdirs(files(spark, d), ["entities", "concepts", "qa"]).select("doc_id", "path")


@query(f"SELECT doc_id, path FROM {TREE} WHERE path = 'entities/18.md'")
def s_13_single_file(spark, d):
    return C.read_file(files(spark, d), "entities/18.md", ["entities", "concepts", "qa"]).select("doc_id", "path")


@query(rf"SELECT count(*) AS n FROM {TREE} WHERE starts_with(path, 'entities/') AND NOT regexp_matches(substr(path, 10), '(^|/)\.')")
def s_14_count_tree(spark, d):
    return C.count_tree(files(spark, d), "entities")


@query("SELECT max(ts) > TIMESTAMP '2024-01-01' AS stale FROM events")
def s_15_index_stale(spark, d):
    index = spark.createDataFrame([(datetime.datetime(2024, 1, 1),)], "modified timestamp_ntz")
    return C.stale(table(spark, d, "events").select(F.col("ts").cast("timestamp_ntz").alias("modified")), index)


UPLOADED = "(SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '../' ELSE '' END || doc_id || CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.HTML' WHEN 2 THEN '.txt' WHEN 3 THEN '.pdf' WHEN 4 THEN '.exe' ELSE '' END AS name, CAST(strlen(text) AS BIGINT) * 300 AS bytes FROM documents)"


@query(
    rf"""WITH u AS {UPLOADED}, r AS (SELECT name, bytes, CASE WHEN contains(name, '/') THEN 'unsafe_name' WHEN NOT regexp_matches(lower(name), '\.(md|html|txt|pdf)$') THEN 'unsupported_type' WHEN bytes > 10485760 THEN 'too_large' END AS reason FROM u)
    SELECT name, CASE WHEN reason IS NULL THEN 'written' ELSE 'rejected' END AS status, reason, CASE WHEN reason IS NULL THEN CASE WHEN lower(name) LIKE '%.md' THEN 'docs' ELSE 'raw' END END AS target FROM r"""
)
def k_12_upload_routing(spark, d):
    ext = F.get(F.array(*map(F.lit, (".md", ".HTML", ".txt", ".pdf", ".exe", ""))), (F.col("doc_id") % 6).cast("int"))
    name = F.concat(F.when(F.col("doc_id") % 11 == 0, "../").otherwise(""), F.col("doc_id").cast("string"), ext)
    return C.upload_outcome(table(spark, d, "documents").select(name.alias("name"), (F.octet_length("text").cast("long") * 300).alias("bytes")))


SLUGS = Fixture("sl", "slug string", [("plain",), ("a-b_c",), ("",), (".",), ("..",), (".hidden",), ("a/b",), ("a\\b",), ("tab\there",), ("über",), ("a.b",)])
SLUGS.over("documents", {
    "slug": "CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN '.hidden' || doc_id WHEN 2 THEN source || '/' || doc_id WHEN 3 THEN 'a' || chr(92) || doc_id WHEN 4 THEN 'tab' || chr(9) || doc_id WHEN 5 THEN '..' ELSE source || '-' || doc_id END",
})


@query(f"WITH {SLUGS.cte()} SELECT slug, slug <> '' AND NOT starts_with(slug, '.') AND NOT contains(slug, '/') AND NOT contains(slug, chr(92)) AND NOT contains(slug, chr(9)) AS ok FROM sl")
def p_10_bare_slug(spark, d):
    return SLUGS.df(spark, d).select("slug", X.bare_slug("slug").alias("ok"))


@query("SELECT event_id, user_id, event_type FROM events")
def s_07_feedback_scan(spark, d):
    """Written as JSON lines, in several files, and scanned."""
    path = C.scratch(spark)
    table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value")).write.text(path)
    return C.scan_jsonl(spark, path, "event_id long, user_id long, event_type string").drop("line_no")


CHECKPOINT = Fixture("cp", "line_no int, query_id string, arm string", [(0, "q1", "a"), (1, "q1", "b"), (3, "q2", "a")])


@query(f"WITH {CHECKPOINT.cte()} SELECT * FROM cp")
def s_08_checkpoint_scan(spark, d):
    """Whole lines, a blank one, and a torn last one."""
    path = C.scratch(spark)
    lines = ['{"query_id": "q1", "arm": "a"}', '{"query_id": "q1", "arm": "b"}', "", '{"query_id": "q2", "arm": "a"}', '{"query_id": "q2", "ar']
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return C.scan_jsonl(spark, path, "query_id string, arm string", torn_tail=True)


@query("""WITH n AS (SELECT count(*) FILTER (doc_id % 2 = 0) AS half, count(*) AS whole FROM documents)
SELECT 'first' AS step, true AS loaded, half AS rows FROM n UNION ALL SELECT 'again', false, half FROM n UNION ALL SELECT 'changed', true, whole FROM n UNION ALL SELECT 'missing', false, 0""")
def s_16_reload_if_changed(spark, d):
    path, out = C.scratch(spark), []
    held = C.Loaded(spark, path, lambda p: spark.read.parquet(p).count())
    for step, part in (("first", "doc_id % 2 = 0"), ("again", None), ("changed", "true")):
        if part:
            C.swap_in(table(spark, d, "documents").where(part), path)
        out.append((step, held.reload_if_changed(), held.value))
    none = C.Loaded(spark, path + "-none", lambda p: 1)
    out.append(("missing", none.reload_if_changed(), none.value or 0))
    return spark.createDataFrame(out, "step string, loaded boolean, rows long")


@query("SELECT 'there' AS file, string_agg(source || ' ' || n, chr(10) ORDER BY source) AS text FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) UNION ALL SELECT 'missing', ''")
def s_18_hot_cache(spark, d):
    """The sources with their documents as a small file that is read often."""
    path = C.scratch(spark)
    table(spark, d, "documents").groupBy("source").count().orderBy("source").select(F.concat_ws(" ", "source", F.col("count").cast("string")).alias("value")).coalesce(1).write.text(path)
    return spark.createDataFrame([("there", C.read_hot(spark, path)), ("missing", C.read_hot(spark, path + "-none"))], "file string, text string")


# ---------------------------------------------------------------- indices


@query(f"WITH {STATS} SELECT token, df FROM df")
def s_04_index_load(spark, d):
    """The index written and loaded; the terms are those of the documents."""
    return Index(spark, index_of(spark, d).parts).terms


@query("SELECT count(*) AS sections FROM documents")
def s_05_stat_only(spark, d):
    """The number of sections by the index's row of statistics, without its sections."""
    return index_of(spark, d).stats.select(F.col("n").alias("sections"))


@query(f"WITH {KNN} SELECT query_id, id, distance, rank FROM rk WHERE rank <= 5")
def o_02_cells(spark, d):
    """The nearest neighbours from a stored layout of cells, most of which a query does not read."""
    return Cells.build(table(spark, d, "embeddings"), C.scratch(spark)).nearest(probes(spark, d), 5)


@query(f"WITH {KNN} SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM rk WHERE rk.rank <= 100 AND label = own QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5")
def o_03_cells_filter(spark, d):
    wide = Cells.build(table(spark, d, "embeddings"), C.scratch(spark), keep=["label"]).nearest(probes(spark, d), 100, ["label"])
    return dense.own_label(wide, probes(spark, d), 5, "label").select("query_id", "id", "distance", "rank")


@query(f"WITH {KNN} SELECT query_id, id, distance, rank FROM rk WHERE rank <= 3")
def s_10_dense_index(spark, d):
    """Nearest neighbours in a dense index that was written, with its metadata, and loaded."""
    path = C.scratch(spark)
    C.write_vectors(table(spark, d, "embeddings").select("vec_id", "embedding"), path, "given")
    vectors, _ = C.read_vectors(spark, path, "given")
    return dense.nearest(probes(spark, d), vectors, 3)


@query("SELECT count(*) AS rows, count(DISTINCT label) AS files, 'given' AS model FROM embeddings")
def k_03_dense_metadata(spark, d):
    path = C.scratch(spark)
    C.write_vectors(table(spark, d, "embeddings").select("vec_id", "embedding", "label"), path, "given", "label")
    return spark.createDataFrame([tuple(C.read_vectors(spark, path)[1][c] for c in ("rows", "files", "model"))], "rows long, files long, model string")


# ---------------------------------------------------------------- query sets

QUERIES_YAML = """
queries:
  - {query_id: q1, text: how long, scenario_stratum: factoid, overlap_stratum: high_overlap, language: en, gold_section_ids: [a#b], key_tokens: [days], generating_family: x}
  - {query_id: q2, text: nothing, scenario_stratum: unanswerable, overlap_stratum: low_overlap, language: zh}
paraphrases:
  - {paraphrase_id: p1, paraphrase_type: reworded, text: what time, gold_docs_section_id: a#b, key_tokens_docs: [days, time], key_tokens_wiki: [days]}
"""


@query("SELECT 'q1' AS query_id, 'how long' AS text, 'factoid' AS stratum, 'a#b' AS gold, 'days' AS tokens, 'x' AS family UNION ALL SELECT 'q2', 'nothing', 'unanswerable', '', '', ''")
def s_09_query_set(spark, d):
    rows = C.query_set(spark, QUERIES_YAML)
    return rows.select("query_id", "text", F.col("scenario_stratum").alias("stratum"), F.array_join("gold_section_ids", ",").alias("gold"), F.array_join("key_tokens", ",").alias("tokens"), F.col("generating_family").alias("family"))


@query("SELECT 'p1' AS paraphrase_id, 'reworded' AS paraphrase_type, 'what time' AS text, 'a#b' AS gold, 'days,time' AS docs, 'days' AS wiki")
def s_09_paraphrases(spark, d):
    rows = C.paraphrase_set(spark, QUERIES_YAML)
    return rows.select("paraphrase_id", "paraphrase_type", "text", F.col("gold_docs_section_id").alias("gold"), F.array_join("key_tokens_docs", ",").alias("docs"), F.array_join("key_tokens_wiki", ",").alias("wiki"))


# ---------------------------------------------------------------- Markdown

OUTLINE = r"""l AS (SELECT {key}, string_split({text}, chr(10)) AS l FROM {rows}),
e AS (SELECT {key}, list_transform(l, lambda x, i: x || CASE WHEN i < len(l) THEN chr(10) ELSE '' END) AS l FROM l),
p AS (SELECT {key}, list_transform(list_filter(l, lambda x: regexp_matches(x, '^\s*#{{1,6}} ')), lambda x: rtrim(x, chr(10))) AS h, substr(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '^\s*#{{1,6}} ')), ''), 1, {chars}) AS b FROM e)
SELECT {key}, CASE WHEN {key} IS NULL OR h IS NULL THEN NULL ELSE array_to_string(list_filter(list_append(h, b), lambda x: x <> ''), chr(10)) END AS outline FROM p"""


@query(f"WITH {MARKDOWN.cte()}, " + OUTLINE.format(key="name", text="text", rows="md", chars=30))
def f_19_outline(spark, d):
    return MARKDOWN.df(spark, d).select("name", S.outline_text("text", 10).alias("outline"))


@query("WITH " + OUTLINE.format(key="doc_id", text="text", rows="documents", chars=6000))
def f_19_outline_of_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", S.outline_text("text").alias("outline"))


@query(
    f"""WITH {MARKDOWN.cte()}, l AS (SELECT name, i, x, CASE WHEN starts_with(x, '```') THEN 1 ELSE 0 END AS f FROM (SELECT name, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM md))
    SELECT name, CAST(i AS INT) AS line, x, coalesce(sum(f) OVER (PARTITION BY name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM l"""
)
def w_09_fence_parity(spark, d):
    return S.fence_parity(MARKDOWN.df(spark, d).select("name", F.posexplode(F.split("text", "\n")).alias("line", "x")))


EDITS = Fixture(
    "ed",
    "slug string, body string, sources array<string>",
    [
        ("good", "yes [Source: a#1] and [Source:  b#2 ]", ["a#1", "b#2"]), ("plain", "no citation", ["a#1"]), ("bare", "no citation", []), ("wider", "see [Source: c#3] [Source: a#1]", ["a#1"]),
        ("gone", "see [Source: old#9]", ["old#9", "a#1"]), ("both", "[Source: old#9] [Source: c#3]", ["old#9"]),
    ],
)
EDITS.over("documents", {
    "slug": "'e' || doc_id",
    "body": "text || CASE doc_id % 4 WHEN 0 THEN ' [Source: f' || (doc_id % 50) || '#1] and [Source:  f' || (doc_id % 30) || '#2 ]' WHEN 1 THEN ' [Source: gone#9]' ELSE '' END",
    "sources": "CASE doc_id % 3 WHEN 0 THEN array() WHEN 1 THEN array('f' || (doc_id % 50) || '#1', 'gone#9') ELSE array('f' || (doc_id % 30) || '#2') END",
})
LIVE = Fixture("lv", "id string", [("a#1",), ("b#2",), ("c#3",)])
LIVE.over("documents", {"id": "'f' || (doc_id % 40) || '#' || (1 + doc_id % 2)"})


@query(
    rf"""WITH {EDITS.cte()}, {LIVE.cte()}, c AS (SELECT DISTINCT slug, sources, trim(unnest(regexp_extract_all(body, '\[Source:\s*([^\]]+)\]', 1))) AS id FROM ed),
    w AS (SELECT slug, CASE WHEN NOT list_contains(sources, id) THEN 'not a source: ' || id WHEN id NOT IN (SELECT id FROM lv) THEN 'no such section: ' || id END AS why FROM c),
    f AS (SELECT slug, string_agg(why, '|' ORDER BY why) AS failures FROM w WHERE why IS NOT NULL GROUP BY 1)
    SELECT ed.slug, coalesce(failures, CASE WHEN NOT regexp_matches(body, '\[Source:') AND len(sources) = 0 THEN 'no sources' ELSE '' END) AS failures FROM ed LEFT JOIN f ON f.slug = ed.slug"""
)
def p_17_edit_grounding(spark, d):
    return G.edit_grounding(EDITS.df(spark, d), LIVE.df(spark, d)).select("slug", F.array_join("failures", "|").alias("failures"))


@query("SELECT item_id, translate(substr(text, 1, 60), '\"' || chr(13) || chr(10), '''') AS safe FROM benchmark")
def f_31_log_safe(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.log_safe("text").alias("safe"))


CITED = Fixture("ci", "id int, t string", [(1, "b [Source: b] a [Source:a ] b [Source:  b  ]"), (2, "none"), (3, ""), (4, "[Source: x y#z]")])
CITED.over("documents", {
    "id": "doc_id",
    "t": "text || CASE doc_id % 3 WHEN 0 THEN ' [Source: b' || doc_id || '] a [Source:a ] b [Source:  b' || doc_id || '  ]' WHEN 1 THEN ' [Source: ]' ELSE '' END",
})


@query(r"WITH " + CITED.cte() + r" SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '\[Source:\s*([^\]]+)\]', 1), lambda x: trim(x)))), ',') AS ids FROM ci")
def f_37_cited_ids(spark, d):
    return CITED.df(spark, d).select("id", F.array_join(X.cited_ids("t"), ",").alias("ids"))


# ---------------------------------------------------------------- reports

SWEEP = "WITH s AS (SELECT threshold, avg(CASE WHEN quality = 0 AND n < threshold THEN 1.0 WHEN quality = 0 THEN 0 END) AS w, avg(CASE WHEN quality = 1 AND n < threshold THEN 1.0 WHEN quality = 1 THEN 0 END) AS o FROM (SELECT quality, length(text) AS n FROM labels JOIN documents USING (doc_id)) CROSS JOIN (VALUES (100), (500), (2000)) AS t(threshold) GROUP BY 1)"


@query(
    SWEEP
    + r""" SELECT '# Calibration of the refusal threshold' || chr(10) || chr(10) || 'Recommended: 500. Current: 100.' || chr(10) || chr(10) || '| Threshold | Correct refusals | Over-refusals | Youden J |' || chr(10) || '|---|---|---|---|' || chr(10)
    || string_agg('| ' || threshold || CASE threshold WHEN 500 THEN ' (recommended)' WHEN 100 THEN ' (current)' ELSE '' END || ' | ' || CAST(round(w * 100) AS BIGINT) || '%' || ' | ' || CAST(round(o * 100) AS BIGINT) || '%' || ' | ' || printf('%.3f', round(w - o, 3)) || ' |', chr(10) ORDER BY threshold) AS report FROM s"""
)
def k_09_calibration_report(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id").select("quality", "n", F.explode(F.array(*map(F.lit, (100, 500, 2000)))).alias("threshold"))
    refused = (F.col("n") < F.col("threshold")).cast("double")
    sweep = rows.groupBy("threshold").agg(F.avg(F.when(F.col("quality") == 0, refused)).alias("refused_well"), F.avg(F.when(F.col("quality") == 1, refused)).alias("refused_wrongly"))
    return reports.calibration_report(sweep, 500, 100)


MEANS = "m AS (SELECT lang, arm, avg(hit) AS hit, avg(rr) AS rr FROM (SELECT lang, arm, CASE arm WHEN 'long' THEN CAST(length(text) > 1000 AS INT) ELSE CAST(length(text) <= 1000 AS INT) END AS hit, 1.0 / (1 + doc_id % 4) AS rr FROM documents CROSS JOIN (VALUES ('long'), ('short')) AS a(arm)) GROUP BY 1, 2)"


def arm_means(spark, d):
    long = F.length("text") > 1000
    arms = F.explode(F.array(F.struct(F.lit("long").alias("arm"), long.cast("int").alias("hit")), F.struct(F.lit("short").alias("arm"), (~long).cast("int").alias("hit")))).alias("x")
    rows = table(spark, d, "documents").select(F.col("lang").alias("stratum"), (1 / (1 + F.col("doc_id") % 4)).alias("rr"), arms).select("stratum", "rr", "x.*")
    return rows.groupBy("stratum", "arm").agg(F.avg("hit").alias("hit_rate"), F.avg("rr").alias("mrr"))


@query(f"WITH {MEANS}" + r""" SELECT '# Comparison of the arms' || chr(10) || chr(10) || '| Stratum | Arm | Hit rate | MRR |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || lang || ' | ' || arm || ' | ' || CAST(round(hit * 100) AS BIGINT) || '%' || ' | ' || printf('%.3f', round(rr, 3)) || ' |', chr(10) ORDER BY lang, arm) AS report FROM m""")
def k_09_comparison_report(spark, d):
    return reports.comparison_report(arm_means(spark, d))


VERDICT = """# Verdict

The wiki arm stays.

## Comparisons

| Axis | Stratum | Arm | Difference | p (Holm) |
|---|---|---|---|---|
| grounded | all | rag | -0.050 | 0.038 |
| grounded | en | rag | 0.010 | - |

## Clauses

| Clause | Fired |
|---|---|
| demote | true |
| kill | false |

## Cost of a grounded correct answer

| Arm | USD |
|---|---|
| rag | 0.012 |
| wiki | - |

## Limits

1. one corpus
2. one judge"""


@query("SELECT '" + VERDICT + "' AS report")
def k_09_verdict_report(spark, d):
    comparisons = spark.createDataFrame([("grounded", "en", "rag", 0.01, None), ("grounded", "all", "rag", -0.05, 0.0384)], "axis string, stratum string, arm string, difference double, p double")
    clauses = spark.createDataFrame([("kill", False), ("demote", True)], "clause string, fired boolean")
    costs = spark.createDataFrame([("wiki", None), ("rag", 0.0123)], "arm string, cost double")
    return reports.verdict_report(comparisons, clauses, costs, "Verdict", "The wiki arm stays.", ["one corpus", "one judge"])


@query(
    f"WITH {MEANS}, r AS (SELECT lang, hit, row_number() OVER (ORDER BY lang) AS i, count(*) OVER () AS k FROM m WHERE arm = 'long')"
    """ SELECT '<svg xmlns="http://www.w3.org/2000/svg" width="540" height="' || ((max(k) + 1) * 26 + 6) || '"><text x="4" y="16">Hit rate</text>' || string_agg('<rect x="120" y="' || (i * 26) || '" width="' || CAST(round(hit * 400) AS INT) || '" height="20"/><text x="4" y="' || (i * 26 + 15) || '">' || lang || '</text>', '' ORDER BY i) || '</svg>' AS svg FROM r"""
)
def k_10_chart(spark, d):
    return reports.bar_chart(arm_means(spark, d).where("arm = 'long'"), "stratum", "hit_rate", "Hit rate")


@query(
    """WITH v AS (SELECT doc_id AS id, quality = 1 AS hit, toxic * 5 + length(text) % 7 AS overlap FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)
    SELECT id, hit FROM v WHERE NOT hit OR overlap > 2 QUALIFY row_number() OVER (PARTITION BY hit ORDER BY sha256('7:' || id), id) <= 10"""
)
def o_13_control_sample(spark, d):
    rows = table(spark, d, "labels").where("quality IS NOT NULL").join(table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    return E.control_sample(rows.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("hit"), (F.col("toxic") * 5 + F.col("n") % 7).alias("overlap")), 2, 10, 7)


# ---------------------------------------------------------------- streams of frames


@query("SELECT item_id AS query_id, 'sources_ready' AS phase, 0 AS seq, '[\"s' || item_id || '\"]' AS payload FROM benchmark UNION ALL SELECT item_id, 'done', 1, CASE WHEN item_id % 3 = 0 THEN 'refused' ELSE 'says ' || text END FROM benchmark")
def t_08_two_phase(spark, d):
    rows = table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    retrieved = rows.select("query_id", F.array(F.concat(F.lit("s"), F.col("query_id").cast("string"))).alias("sources"), (F.col("query_id") % 3 == 0).alias("refused"), F.lit("refused").alias("refusal"))
    return T.two_phase(retrieved, rows.where("query_id % 3 <> 0").select("query_id", F.concat(F.lit("says "), "text").alias("answer")))


@query(
    """WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events), p AS (SELECT user_id, ts, unnest(range(1, 1 + greatest(0, CAST(floor((epoch_us(nx) - epoch_us(ts) - 1) / 1e6 / 86400) AS BIGINT)))) AS k FROM e WHERE nx IS NOT NULL)
    SELECT user_id, ts, 'frame' AS kind FROM events UNION ALL SELECT user_id, ts + k * INTERVAL 86400 SECOND, 'ping' FROM p"""
)
def t_09_heartbeats(spark, d):
    return T.heartbeats(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 86400)


@query("WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1e6 * 172800 THEN 1 ELSE 0 END AS late FROM events) SELECT user_id, event_id FROM g QUALIFY max(late) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) = 0")
def t_09_idle_cut(spark, d):
    return T.idle_cut(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", 172_800).select("user_id", "event_id")


STREAMS = Fixture("st", "gate string, id int, opened int, closed int", [("a", 1, 0, 100), ("a", 2, 1, 5), ("a", 3, 2, 50), ("a", 4, 5, 9), ("a", 5, 6, 9), ("b", 6, 0, 9), ("a", 7, 9, 10)])
STREAMS.over("events", {"gate": "'g' || (user_id % 40)", "id": "event_id", "opened": "event_id * 3", "closed": "event_id * 3 + 1 + event_id * 7919 % 900"})


@query(
    f"""WITH RECURSIVE {STREAMS.cte()}, o AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY opened, id) AS i FROM st),
    w AS (SELECT gate, id, i, [closed] AS held, true AS admitted FROM o WHERE i = 1
      UNION ALL SELECT o.gate, o.id, o.i, CASE WHEN len(list_filter(held, lambda x: x > opened)) < 2 THEN list_append(list_filter(held, lambda x: x > opened), closed) ELSE list_filter(held, lambda x: x > opened) END,
        len(list_filter(held, lambda x: x > opened)) < 2 FROM w JOIN o ON o.gate = w.gate AND o.i = w.i + 1)
    SELECT id, admitted FROM w"""
)
def t_09_admitted_streams(spark, d):
    """At most two open streams a gate."""
    return T.admitted_streams(STREAMS.df(spark, d), ["gate"], "opened", "closed", "id", 2).select("id", "admitted")


# ---------------------------------------------------------------- seams


@query("SELECT 'none' AS failures, true AS result, 0 AS retries UNION ALL SELECT 'one', true, 1 UNION ALL SELECT 'two', true, 2 UNION ALL SELECT 'three', NULL, 2 UNION ALL SELECT 'slow', NULL, 1")
def x_03_attempts(spark, d):
    def tried(fail: int, step: float) -> tuple:
        now, calls = [0.0], [0]

        def call():
            now[0] += step
            calls[0] += 1
            if calls[0] <= fail:
                raise OSError("no answer")
            return True

        return seams.attempts(call, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))

    cases = {"none": (0, 0.1), "one": (1, 0.1), "two": (2, 0.1), "three": (3, 0.1), "slow": (3, 2.3)}
    return spark.createDataFrame([(name, *tried(*case)) for name, case in cases.items()], "failures string, result boolean, retries int")


@query(r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\b[A-Z][a-z]+')) >= 3 THEN 'entity' ELSE 'concept' END AS kind FROM documents WHERE lang = 'en'")
def x_04_classify_source(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", seams.classify_source("text").alias("kind"))


CHAPTERS = Fixture("ch", "id int, place int, title string, anchor string", [(1, 0, "First line of a long", "First line of a long text"), (1, 1, "Second part begins here", "Second part begins here"), (2, 0, "short", "short")])


@query(f"WITH {CHAPTERS.cte()} SELECT * FROM ch")
def x_05_chapters(spark, d):
    text = "First line of a long text\n" + "x" * 2100 + "\n\nSecond part begins here\nmore"
    return seams.propose_chapters(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id int, text string"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(doc_id % 5 AS INT) AS page, text FROM documents")
def x_08_transcribe(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), (F.col("doc_id") % 5).cast("int").alias("page"), F.col("text").cast("binary").alias("image"))
    return seams.transcribe(rows)


@query(
    """SELECT doc_id AS id, doc_id % 5 IN (1, 3) AS answers, CASE doc_id % 5 WHEN 1 THEN 'yes ' || doc_id WHEN 2 THEN '' WHEN 3 THEN 'fenced ' || doc_id WHEN 4 THEN 'unparseable judge reply: no JSON' ELSE 'unparseable judge reply: [1]' END AS reasoning FROM documents"""
)
def x_10_judge(spark, d):
    """Replies of each form about each document."""
    i = F.col("doc_id").cast("string")
    forms = [F.lit("[1]"), F.concat(F.lit('{"answers": true, "reasoning": " yes '), i, F.lit(' "}')), F.lit("{}"), F.concat(F.lit('```json\n{"answers": 1, "reasoning": "fenced '), i, F.lit('"}\n```')), F.lit("no JSON")]
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("q").alias("query"), F.get(F.array(*forms), (F.col("doc_id") % 5).cast("int")).alias("content"))
    return seams.judged(items, lambda q, c: c).select("id", "answers", "reasoning")


def pdf(*pages: bytes) -> bytes:
    """A small PDF whose pages show some text, deflated where it is long."""
    out = b"%PDF-1.4\n"
    for i, text in enumerate(pages, 1):
        body = b"BT /F1 12 Tf " + text + b" ET" if text else b"0 0 m"
        head = b""
        if len(body) > 60:
            body, head = zlib.compress(body), b" /Filter /FlateDecode"
        out += b"%d 0 obj <</Length %d%s>> stream\n%s\nendstream endobj\n" % (i, len(body), head, body)
    return out + b"%%EOF"


PDFS = {1: (b"(Hello \\(world\\)) Tj T* (second line) Tj", b""), 2: (b"", b""), 3: (b"[(A) -20 (fter a very long first line of words)] TJ 0 -14 Td <4869> Tj",), 4: (b"( ) Tj",)}


def pdfs(spark, d):
    """A PDF for each document: with a line of text, with a blank one, or with an empty page."""
    line = F.when(F.col("doc_id") % 3 == 0, F.format_string("BT /F1 12 Tf (Doc %d of %s) Tj ET", "doc_id", "source")).when(F.col("doc_id") % 3 == 1, "BT /F1 12 Tf ( ) Tj ET").otherwise("0 0 m")
    whole = F.format_string("%%PDF-1.4\n1 0 obj <</Length %d>> stream\n%s\nendstream endobj\n%%%%EOF", F.length(line), line)
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), whole.cast("binary").alias("content"))


@query("SELECT doc_id AS id, doc_id % 3 = 0 AS has_text FROM documents")
def s_19_pdf_text_layer(spark, d):
    return pdfs(spark, d).select("id", seams.has_text_layer("content").alias("has_text"))


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'Doc ' || doc_id || ' of ' || source ELSE '' END AS markdown FROM documents")
def s_20_pdf_markdown(spark, d):
    return pdfs(spark, d).select("id", seams.pdf_to_markdown("content").alias("markdown"))


# ---------------------------------------------------------------- pages and texts


@query(
    f"""WITH t AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS slug, source, list_distinct({tokens_sql('text')}) AS t FROM documents), p AS (SELECT x.slug AS a, y.slug AS b, x.t AS s, y.t AS u FROM t x JOIN t y ON x.source = y.source AND x.slug < y.slug),
    j AS (SELECT a, b, CASE WHEN len(list_distinct(list_concat(s, u))) = 0 THEN 0 ELSE len(list_intersect(s, u)) / CAST(len(s) + len(u) - len(list_intersect(s, u)) AS DOUBLE) END AS similarity FROM p)
    SELECT a, b, similarity FROM j QUALIFY row_number() OVER (ORDER BY similarity DESC, a, b) <= 30"""
)
def o_07_alike_pages(spark, d):
    """The most alike documents of a common source."""
    rows = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("slug"), F.lit("entities").alias("dir"), F.array("source").alias("sources"), F.col("text").alias("body"))
    return G.ranked_pairs(G.most_alike(rows, 30).select("a", "b"), rows, 30).drop("place")


PAGE = "<html><head><title>T</title><script>x()</script></head><body><h1>Top &amp; more</h1><!-- c --><p>a <b>b</b> <a href='u'>l</a></p><ul><li>1</li><li>2</li></ul><pre>k  v</pre></body></html>"
CONVERTED = Fixture("cv", "id int, markdown string", [(1, "T\n\n# Top & more\n\na **b** [l](u)\n\n* 1\n* 2\n\n```\nk  v\n```"), (2, ""), (3, None)])


@query(f"WITH {CONVERTED.cte()} SELECT * FROM cv")
def f_20_html_of_a_page(spark, d):
    return S.convert_pages(spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "id int, html string")).select("id", "markdown")


SPLIT = Fixture("sp", "id int, chunk int, content string", [(1, 0, "aaaa bbbb"), (1, 1, "bbbb cccc"), (1, 2, "dddd"), (2, 0, "short"), (4, 0, "xxxxxxxxxx"), (4, 1, "xxxxxxxxxx"), (4, 2, "xxxxxxxxxx"), (4, 3, "xxxxxx")])


@query(f"WITH {SPLIT.cte()} SELECT * FROM sp")
def f_23_split_small(spark, d):
    rows = spark.createDataFrame([(1, "aaaa bbbb cccc\n\ndddd"), (2, "short"), (3, ""), (4, "x" * 21), (5, None)], "id int, content string")
    return S.chunks(rows, size=10, overlap=5)
