"""Mutations of a stored table of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutate as M
from ..sources import corpus as C
from ..sources.versions import VersionedTable
from .governance import DOCS, PAGES, docs, pages
from .registry import Fixture, query

CHANGES = Fixture("ch", "slug string, status string, body string, aliases array<string>", [("refunds", "draft", "new body", ["zz"]), ("brand-new", "live", "first", ["n"])])
#: Pages that exist, with and without a number, and new ones.
CHANGES.over("documents", {
    "slug": "'p' || (doc_id div 3) || CASE doc_id % 6 WHEN 0 THEN '' WHEN 5 THEN '-new' ELSE '-' || (doc_id % 3 + 1) END",
    "status": "CASE doc_id % 2 WHEN 0 THEN 'draft' ELSE 'live' END",
    "body": "'again: ' || text",
    "aliases": "array('z' || doc_id)",
}, "doc_id % 6 < 2 OR doc_id % 6 = 5")
BASE = "p AS (SELECT slug, status, body, array_to_string(aliases, ',') AS aliases FROM pages_)"


def changed(rows, change, keys):
    """The rows after a change that was committed to a stored table of them."""
    held = VersionedTable.create(rows, C.scratch(rows.sparkSession), ["slug"])
    held.apply(change, keys)
    return held.snapshot()


def show(df):
    return df.withColumn("aliases", F.array_join("aliases", ",")) if "aliases" in df.columns else df


@query(
    f"""WITH {PAGES.cte()}, {CHANGES.cte()}, o AS (SELECT slug, status, body, aliases FROM pages_) SELECT coalesce(ch.slug, o.slug) AS slug, CASE WHEN ch.slug IS NULL THEN o.status ELSE ch.status END AS status,
    CASE WHEN ch.slug IS NULL THEN o.body ELSE ch.body END AS body, array_to_string(CASE WHEN o.slug IS NULL THEN ch.aliases ELSE o.aliases END, ',') AS aliases FROM o FULL JOIN ch ON ch.slug = o.slug"""
)
def m_01_upsert(spark, d):
    new = CHANGES.df(spark, d)
    return show(changed(pages(spark, d).select("slug", "status", "body", "aliases"), lambda old: M.upsert(old, new, keep=("aliases",)), new))


@query(f"WITH {PAGES.cte()}, {CHANGES.cte()} SELECT slug FROM pages_ WHERE NOT (len(list_filter(sources, lambda s: split_part(s, '#', 1) = 'src0.md')) > 0 AND slug NOT IN (SELECT slug FROM ch))")
def m_02_delete_orphans(spark, d):
    cites = F.exists("sources", lambda x: F.element_at(F.split(x, "#"), 1) == "src0.md")
    return changed(pages(spark, d), lambda old: M.delete_orphans(old, "src0.md", CHANGES.df(spark, d)), lambda now: now.where(cites)).select("slug")


@query(f"WITH {PAGES.cte()}, {CHANGES.cte()} SELECT slug, greatest(1, coalesce(count, 0) + CASE WHEN status IN ('draft', 'live') THEN 1 ELSE 0 END) AS count FROM pages_ WHERE dir = 'qa'")
def m_03_file_answer(spark, d):
    return pages(spark, d).where("dir = 'qa'").select("slug", F.greatest(F.lit(1), F.coalesce("count", F.lit(0)) + F.col("status").isin("draft", "live").cast("int")).alias("count"))


BATCH = Fixture("batch", "place int, slug string", [(1, "ask-a"), (2, "../x"), (3, "nope"), (4, "fresh"), (5, "ask-a"), (6, "ask-b")])
BATCH.over("documents", {
    "place": "doc_id",
    "slug": "CASE doc_id % 5 WHEN 0 THEN '../x' || doc_id WHEN 1 THEN 'nope' || doc_id ELSE 'p' || ((doc_id div 6) * 2) || CASE doc_id % 3 WHEN 0 THEN '' ELSE '-' || (doc_id % 3 + 1) END END",
})


@query(
    f"""WITH {PAGES.cte()}, {BATCH.cte()}, s AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY place) AS seen FROM batch)
    SELECT place, s.slug, CASE WHEN regexp_matches(s.slug, '[/\\\\]') THEN 'invalid_slug' WHEN status IS NULL THEN 'not_found' WHEN status NOT IN ('draft', 'live') THEN 'invalid_status' WHEN status = 'live' OR seen > 1 THEN 'already_live' ELSE 'live' END AS outcome
    FROM s LEFT JOIN pages_ p ON p.slug = s.slug AND p.dir = 'qa'"""
)
def m_04_promote(spark, d):
    return M.promote(pages(spark, d), BATCH.df(spark, d))[1]


@query(f"WITH {PAGES.cte()}, {BATCH.cte()} SELECT slug, CASE WHEN dir = 'qa' AND slug IN (SELECT slug FROM batch) AND status = 'live' THEN 'draft' ELSE status END AS status FROM pages_")
def m_05_demote(spark, d):
    batch = BATCH.df(spark, d)
    return changed(pages(spark, d), lambda old: M.promote(old, batch, "draft")[0], batch).select("slug", "status")


EDITS = Fixture("ed", "slug string, body string", [("ask-a", "x [Source: refunds#a]"), ("ask-b", "y [Source: other#z]"), ("fresh", "z"), ("none", "q")])
#: An edit of each page, some of pages that are not there.
EDITS.over("documents", {
    "slug": "CASE doc_id % 7 WHEN 0 THEN 'nope' || doc_id ELSE 'p' || (doc_id div 3) || CASE doc_id % 3 WHEN 0 THEN '' ELSE '-' || (doc_id % 3 + 1) END END",
    "body": "text || CASE doc_id % 3 WHEN 0 THEN ' [Source: refunds#a]' WHEN 1 THEN ' [Source: other#z]' ELSE '' END",
})


@query(
    rf"""WITH {PAGES.cte()}, {EDITS.cte()} SELECT ed.slug, CASE WHEN p.slug IS NULL THEN 'not_found' WHEN status = 'live' THEN 'conflict' WHEN len(list_filter(regexp_extract_all(ed.body, '\[Source:\s*([^\]]+?)\s*\]', 1), lambda x: x NOT IN ('refunds#a', 'shipping#s'))) > 0 THEN 'ungrounded'
    WHEN len(regexp_extract_all(ed.body, '\[Source:')) = 0 AND len(sources) = 0 THEN 'ungrounded' ELSE 'edited' END AS outcome FROM ed LEFT JOIN pages_ p ON p.slug = ed.slug AND p.dir = 'qa'"""
)
def m_06_edit_draft(spark, d):
    return M.edit_draft(pages(spark, d), EDITS.df(spark, d), spark.createDataFrame([("refunds#a",), ("shipping#s",)], "id string"))[1]


@query(f"WITH {PAGES.cte()}, {BATCH.cte()} SELECT slug, dir FROM pages_ WHERE NOT (dir = 'qa' AND status <> 'live' AND slug IN (SELECT slug FROM batch))")
def m_07_delete_answers(spark, d):
    batch = BATCH.df(spark, d)
    return changed(pages(spark, d), lambda old: M.delete_answers(old, batch), batch).select("slug", "dir")


REFILED = Fixture("rf", "slug string, passed boolean, reason string, body string", [("how-refund", True, None, "better"), ("fresh", False, "below_threshold", None), ("ask-a", False, "provider_error", None)])
REFILED.over("documents", {
    "slug": "'p' || (doc_id div 3) || CASE doc_id % 3 WHEN 0 THEN '' ELSE '-' || (doc_id % 3 + 1) END",
    "passed": "doc_id % 4 = 1",
    "reason": "CASE doc_id % 4 WHEN 0 THEN 'below_threshold' WHEN 2 THEN 'provider_error' WHEN 3 THEN 'claim_unsupported' END",
    "body": "CASE WHEN doc_id % 4 = 1 THEN 'better: ' || text END",
}, "doc_id % 5 <> 3")


@query(
    f"""WITH {PAGES.cte()}, {REFILED.cte()} SELECT p.slug, CASE WHEN passed OR (NOT passed AND rf.reason IN ('retrieval_empty', 'below_threshold', 'claim_unsupported') AND status = 'live') THEN 'draft' ELSE status END AS status,
    CASE WHEN passed THEN rf.body ELSE p.body END AS body FROM pages_ p LEFT JOIN rf ON rf.slug = p.slug AND p.dir = 'qa'"""
)
def m_08_refile(spark, d):
    results = REFILED.df(spark, d)
    return changed(pages(spark, d).drop("reason"), lambda old: M.refile(old, results), results).select("slug", "status", "body")


@query(f"""WITH {PAGES.cte()}, {DOCS.cte()}, {CHANGES.cte()}, r AS (SELECT slug, split_part(unnest(sources), '#', 1) AS source FROM pages_), g AS (SELECT slug FROM r GROUP BY 1 HAVING bool_and(source NOT IN (SELECT basename FROM docs_)))
    SELECT slug FROM pages_ WHERE NOT (slug IN (SELECT slug FROM g) AND slug IN (SELECT slug FROM ch))""")
def m_09_delete_full_orphans(spark, d):
    batch = CHANGES.df(spark, d).select("slug")
    return changed(pages(spark, d), lambda old: M.delete_full_orphans(old, docs(spark, d), batch), batch).select("slug")


ALIASES = Fixture("al", "slug string, alias string", [("refunds", "payback"), ("refunds", "delivery"), ("ghost", "g"), ("shipping", "delivery"), ("pricing", "plan")])
ALIASES.over("documents", {
    "slug": "CASE doc_id % 5 WHEN 0 THEN 'ghost' || doc_id ELSE 'p' || (doc_id div 3) || CASE doc_id % 3 WHEN 0 THEN '' ELSE '-' || (doc_id % 3 + 1) END END",
    "alias": "CASE doc_id % 4 WHEN 0 THEN 'new' || doc_id WHEN 1 THEN 'alias' || (doc_id div 12) WHEN 2 THEN 'p' || (doc_id div 5) ELSE 'p' || (doc_id div 3) || CASE doc_id % 3 WHEN 0 THEN '' ELSE '-' || (doc_id % 3 + 1) END END",
})


@query(
    f"""WITH {PAGES.cte()}, {ALIASES.cte()}, n AS (SELECT slug AS name, slug AS c FROM pages_ UNION SELECT name, min(slug) FROM (SELECT unnest(aliases) AS name, slug FROM pages_) WHERE name NOT IN (SELECT slug FROM pages_) GROUP BY 1)
    SELECT slug, alias, CASE WHEN slug NOT IN (SELECT slug FROM pages_) THEN 'not_found' WHEN c = slug THEN 'unchanged' WHEN c IS NOT NULL THEN 'collision' ELSE 'added' END AS outcome FROM al LEFT JOIN n ON name = alias"""
)
def m_10_add_alias(spark, d):
    return M.add_alias(pages(spark, d), ALIASES.df(spark, d))[1]


@query(f"WITH {PAGES.cte()} SELECT slug, array_to_string(list_transform(sources, lambda s: CASE WHEN split_part(s, '#', 1) = 'src0.md' THEN 'freight.md' || substr(s, 8) ELSE s END), ',') AS sources FROM pages_")
def m_11_rename_source(spark, d):
    cites = F.exists("sources", lambda x: F.element_at(F.split(x, "#"), 1) == "src0.md")
    rows = changed(pages(spark, d), lambda old: M.rename_source(old, "src0.md", "freight.md"), lambda now: now.where(cites))
    return rows.select("slug", F.array_join("sources", ",").alias("sources"))


#: Every third proposal saw a body that the page does not have any more.
@query(f"WITH {PAGES.cte()}, {CHANGES.cte()} SELECT slug, CASE WHEN length(p.body) % 3 = 0 THEN 'stale' ELSE 'applied' END AS outcome FROM pages_ p JOIN ch USING (slug)")
def m_12_compare_and_set(spark, d):
    seen = F.when(F.length("body") % 3 == 0, "old").otherwise(F.sha2("body", 256))
    proposals = pages(spark, d).select("slug", seen.alias("seen_hash")).join(CHANGES.df(spark, d).select("slug", "body"), "slug")
    return M.compare_and_set(pages(spark, d), proposals)[1]


FILES = Fixture(
    "fl",
    "path string, basename string, ext string, bytes long, sha string, hand_authored boolean",
    [("r/a.md", "a.md", "md", 10, "s1", False), ("r/A.md", "A.md", "md", 10, "s2", False), ("r/b#c.md", "b#c.md", "md", 1, "x", False), ("r/d.html", "d.html", "html", 0, "e", False), ("r/e.txt", "e.txt", "txt", 99999999, "y", False), ("r/f.md", "f.md", "md", 5, "s9", True), ("r/g.pdf", "g.pdf", "pdf", 5, "sg", False), ("r/h.doc", "h.doc", "doc", 5, "sh", False)],
)
FILES.over("documents", {
    "path": "'r/' || source || '/' || doc_id",
    "basename": "CASE doc_id % 9 WHEN 0 THEN 'A' || (doc_id div 18) WHEN 1 THEN 'a' || (doc_id div 18) WHEN 2 THEN 'b#' || doc_id ELSE 'f' || doc_id END || '.' || CASE doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'html' WHEN 2 THEN 'txt' WHEN 3 THEN 'pdf' ELSE 'doc' END",
    "ext": "CASE doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'html' WHEN 2 THEN 'txt' WHEN 3 THEN 'pdf' ELSE 'doc' END",
    "bytes": "CASE doc_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 99999999 ELSE n_chars END",
    "sha": "md5(text)",
    "hand_authored": "doc_id % 10 = 7",
})


IMPORTED = Fixture("kn", "basename string, sha string", [("g.pdf", "sg"), ("a.md", "other")])
#: Sources imported before: some with the bytes they still have.
IMPORTED.over("documents", {
    "basename": "'f' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'html' WHEN 2 THEN 'txt' WHEN 3 THEN 'pdf' ELSE 'doc' END",
    "sha": "CASE doc_id % 2 WHEN 0 THEN md5(text) ELSE 'other' END",
}, "doc_id % 3 = 0")


@query(
    rf"""WITH {FILES.cte()}, {IMPORTED.cte()}, n AS (SELECT *, row_number() OVER (PARTITION BY lower(basename) ORDER BY path) AS i FROM fl) SELECT path, CASE WHEN regexp_matches(basename, '[#/\\:]') THEN 'unsafe_filename' WHEN ext NOT IN ('html', 'txt', 'md', 'pdf') THEN 'unsupported'
    WHEN i > 1 THEN 'collision' WHEN hand_authored THEN 'hand_authored' WHEN bytes = 0 THEN 'empty' WHEN bytes > 10485760 THEN 'too_large' WHEN k.sha = n.sha THEN 'unchanged' ELSE 'imported' END AS outcome FROM n LEFT JOIN kn k USING (basename)"""
)
def m_13_import_outcome(spark, d):
    return M.import_outcome(FILES.df(spark, d), IMPORTED.df(spark, d))


SLUGS = Fixture("sl", "place int, base string", [(1, "x"), (2, "x"), (3, "y"), (4, "x-2"), (5, "x")])
#: A third of all titles is the same; some have a number already.
SLUGS.over("documents", {"place": "doc_id", "base": "CASE WHEN doc_id % 3 = 0 THEN 'section' WHEN doc_id % 50 = 1 THEN source || '-2' ELSE source || '-' || lang END"})
TAKEN = Fixture("tk", "slug string", [("x-2",)])
TAKEN.over("documents", {"slug": "CASE doc_id % 4 WHEN 0 THEN 'section' WHEN 1 THEN 'section-' || (doc_id * 3 % 200) WHEN 2 THEN source || '-' || lang || '-' || (1 + doc_id % 6) ELSE source || '-3' END"}, "doc_id % 5 = 0")


@query(
    f"""WITH RECURSIVE {SLUGS.cte()}, {TAKEN.cte()}, o AS (SELECT *, row_number() OVER (ORDER BY place) AS i FROM sl),
    w AS (SELECT 0::BIGINT AS i, 0 AS place, '' AS base, '' AS slug, (SELECT list(DISTINCT slug) FROM tk) AS used
      UNION ALL SELECT i, place, base, slug, list_append(used, slug) FROM (SELECT o.i, o.place, o.base, used, list_filter(list_transform(range(1, len(used) + 2), lambda n: CASE WHEN n = 1 THEN o.base ELSE o.base || '-' || n END), lambda x: NOT list_contains(used, x))[1] AS slug FROM w JOIN o ON o.i = w.i + 1) AS t)
    SELECT place, base, slug FROM w WHERE i > 0"""
)
def w_06_slug_numbering(spark, d):
    return M.number_slugs(SLUGS.df(spark, d), TAKEN.df(spark, d))
