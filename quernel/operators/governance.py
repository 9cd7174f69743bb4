"""Corpus governance: relational checks over pages, sources and the event log.

``pages``: slug, dir (entities, concepts, qa), status, updated (ISO text), sources array<string> (``file#anchor``),
aliases array<string>, body, and for some checks reason, unsupported, hashes map<string,string>, question, count.
``docs``: path, basename, content. ``log``: line_no, ts, kind, query, kv map<string,string>.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WIKILINK, canonical_query, cited_ids, jaccard, parse_instant, parse_kv, tokenize
from ..sources.corpus import scratch
from . import alike
from .bm25 import sized
from .postings import Index

VALID_STATUS = ("live", "draft", "stale", "superseded")
#: Check: axis and label, in report order (fixed values).
TAXONOMY = [
    ("C6", "stale", "Freshness"), ("C3", "failed-grounding", "Freshness"), ("C11", "orphan", "Freshness"), ("C5", "contradiction", "Coherence"),
    ("C4", "collision", "Coherence"), ("C12", "alias-collision", "Coherence"), ("C1", "coverage-gap", "Coverage"), ("C2", "red-link", "Coverage"),
    ("C8", "promotion", "Lifecycle"), ("C10", "invalid-schema", "Lifecycle"), ("C9", "stale-qa", "Lifecycle"),
]
LOG_LINE = r"^## \[([^\]]+)\] (\S+) \| (.*)$"


def parse_log(text: DataFrame) -> DataFrame:
    """(line_no, ts, kind, query, kv) of a log(text): one row a line of the grammar; other lines are left out."""
    return parse_lines(text.select(F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]")).alias("line_no", "line")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """``parse_log`` of lines(line_no, line) that stand in a table."""
    lines = lines.where(F.col("line").rlike(LOG_LINE))
    part = lambda i: F.regexp_extract("line", LOG_LINE, i)
    rows = lines.select("line_no", part(1).alias("ts"), part(2).alias("kind"), part(3).alias("summary"))
    return rows.select("line_no", "ts", "kind", F.regexp_extract("summary", '"([^"]*)"', 1).alias("query"), parse_kv("summary").alias("kv"))


def pending_successes(events: DataFrame, key: str, order: str, up: Column, down: Column) -> DataFrame:
    """Adds ``success``: a ``down`` row that finds no pending ``up`` row of its key.

    The counter rises with ``up``, falls with ``down`` and never below zero: a reflected walk, so it is zero before
    a row if and only if the free walk stands at its running minimum.
    """
    step = F.when(up, 1).when(down, -1).otherwise(0)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_walk", F.sum(step).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_prev", F.coalesce(F.lag("_walk").over(Window.partitionBy(key).orderBy(order)), F.lit(0))).withColumn("_low", F.least(F.lit(0), F.coalesce(F.min("_walk").over(before), F.lit(0))))
    return rows.withColumn("success", down & (F.col("_prev") == F.col("_low"))).drop("_walk", "_prev", "_low")


def coverage_gaps(log: DataFrame, min_hits: int = 1) -> DataFrame:
    """C1: (reason, canonical, section, hits, first_seen, last_seen, samples) of failed questions that no later success answers."""
    rows = log.where(F.col("kind").isin("chat_grounding_fallback", "chat")).withColumn("canonical", canonical_query("query"))
    rows = pending_successes(rows, "canonical", "line_no", F.col("kind") == "chat_grounding_fallback", F.col("kind") == "chat")
    good = rows.where("success").groupBy("canonical").agg(F.max("ts").alias("answered"))
    failed = rows.where((F.col("kind") == "chat_grounding_fallback") & F.element_at("kv", "reason").isin("retrieval_empty", "below_threshold", "claim_unsupported"))
    failed = failed.select("canonical", "line_no", "ts", "query", F.element_at("kv", "reason").alias("reason"))
    kv = rows.where(F.col("kind") == "chat_grounding_fallback").select("line_no", F.coalesce(F.element_at("kv", "top_section"), F.array_join(F.array_sort(F.split(F.element_at("kv", "cited"), ",")), ",")).alias("section"))
    groups = failed.join(kv, "line_no").groupBy("reason", "canonical", "section").agg(
        F.count("*").alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "query"))), lambda x: x["query"])), 1, 3).alias("samples"),
    )
    open_ = groups.join(good, "canonical", "left").where("answered IS NULL OR answered <= last_seen")
    return open_.where(F.col("hits") >= min_hits).drop("answered")


def resolution_map(pages: DataFrame) -> DataFrame:
    """(name, canonical): every slug resolves to itself; an alias that is no slug to the lexicographically first page that claims it."""
    slugs = pages.select(F.col("slug").alias("name"), F.col("slug").alias("canonical")).distinct()
    alias = pages.select(F.explode("aliases").alias("name"), "slug").join(slugs.select("name"), "name", "left_anti").groupBy("name").agg(F.min("slug").alias("canonical"))
    return slugs.unionByName(alias)


def red_links(pages: DataFrame, margin: int = 25) -> DataFrame:
    """C2: (slug, mentions, referenced_by, context) of link targets that resolve to nothing; the context is that of the first mention in page order."""
    known = resolution_map(pages).select(F.col("name").alias("target"))
    body = pages.where(F.col("dir").isin("entities", "concepts"))
    sized = lambda column: F.transform(column, lambda x: F.length(x))
    parts = F.arrays_zip(F.regexp_extract_all("body", F.lit(WIKILINK), F.lit(1)).alias("raw"), sized(F.regexp_extract_all("body", F.lit(WIKILINK), F.lit(0))).alias("n"), sized(F.split("body", WIKILINK, -1)).alias("gap"))
    links = body.select("dir", "slug", F.posexplode(parts).alias("i", "p")).where("p.raw IS NOT NULL")
    before = Window.partitionBy("dir", "slug").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("p.gap") + F.col("p.n")).over(before), F.lit(0)).cast("int") + F.col("p.gap")
    links = links.select("dir", "slug", F.trim("p.raw").alias("target"), start.alias("start"), F.col("p.n").alias("n")).where("target <> ''")
    # entities come before concepts
    place = F.struct((F.col("dir") != "entities").alias("later"), "slug", "start", "n", "dir")
    missing = links.join(known, "target", "left_anti").groupBy("target").agg(F.count("*").alias("mentions"), F.array_sort(F.collect_set("slug")).alias("referenced_by"), F.min(place).alias("first"))
    lo = F.greatest(F.lit(0), F.col("first.start") - margin)
    context = F.substring(F.col("p.body"), lo + 1, F.col("first.start") + F.col("first.n") + margin - lo)
    there = (F.col("p.slug") == F.col("first.slug")) & (F.col("p.dir") == F.col("first.dir"))
    return missing.join(pages.select("dir", "slug", "body").alias("p"), there).select(F.col("target").alias("slug"), "mentions", "referenced_by", context.alias("context"))


def failed_grounding(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """C3: (slug, reason, source, resolution) of pages whose claims failed, their sources resolved by basename to missing, resolved or ambiguous."""
    bad = pages.where("status = 'failed_grounding'").select("slug", F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("unknown")).alias("reason"), F.explode_outer("sources").alias("ref"))
    bad = bad.withColumn("source", F.element_at(F.split("ref", "#"), 1))
    count = docs.groupBy(F.col("basename").alias("source")).agg(F.count("*").alias("n"))
    how = F.when(F.col("source").isNull(), None).when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return bad.join(count, "source", "left").select("slug", "reason", "source", how.alias("resolution"))


def collisions(pages: DataFrame) -> DataFrame:
    """C4: (base, members) of two or more slugs that differ by a numeric suffix of 2 or more, unless every member's mark of separation names exactly the group."""
    rows = pages.where(F.col("dir").isin("entities", "concepts")).select("dir", "slug", F.regexp_extract("slug", r"^(.+)-(\d+)$", 1).alias("stem"), F.regexp_extract("slug", r"^(.+)-(\d+)$", 2).alias("n"), "body")
    base = F.when((F.col("stem") != "") & (F.expr("try_cast(n AS int)") >= 2), F.col("stem")).otherwise(F.col("slug"))
    mark = F.regexp_extract(F.substring("body", 1, 600), r"\(collision group: '([^']*)'\)", 1)
    names = F.array_sort(F.filter(F.transform(F.split(mark, ","), lambda x: F.trim(x)), lambda x: x != ""))
    groups = rows.select("dir", base.alias("base"), "slug", names.alias("marked")).groupBy("dir", "base").agg(F.array_sort(F.collect_set("slug")).alias("members"), F.collect_list("marked").alias("marks"))
    kept = groups.where((F.size("members") >= 2) & ~F.forall("marks", lambda m: m == F.col("members")))
    return kept.select("base", "members", F.size("members").alias("size"))


#: Pages of one source in a block: a task pairs the pages of two blocks.
PAIRED = 2048


def shared_source_pairs(pages: DataFrame) -> DataFrame:
    """(a, b), a < b: pages that cite a common source, each pair once.

    Pages of one source are paired by a join on it, those of a frequent one in pairs of blocks that are dealt over all tasks. A
    pair stands where its first common source is, so that no exchange of pairs has to tell equal ones. The rows are the result's.
    """
    refs = pages.where(F.col("dir").isin("entities", "concepts")).select("slug", F.explode("sources").alias("ref")).select("slug", F.element_at(F.split("ref", "#"), 1).alias("source"))
    own = refs.groupBy("slug").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    # the sources that come before this one
    cited = own.select("slug", F.posexplode("sources").alias("i", "source"), "sources").select("slug", "source", F.slice("sources", F.lit(1), F.col("i")).alias("before"))
    path = scratch(pages.sparkSession)
    cited.write.parquet(path)
    cited = pages.sparkSession.read.parquet(path)
    hot = cited.groupBy("source").count().where(F.col("count") > PAIRED).select("source", F.ceil(F.col("count") / PAIRED).cast("int").alias("blocks"))  # a row for each PAIRED rows at most
    cells = hot.agg(F.sum(F.expr("blocks * (blocks + 1) div 2"))).first()[0] or 0
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(cells), 4096))
    dealt = cited.join(sized(hot), "source", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("slug"), F.col("blocks")).cast("int"))
    to = lambda first, last: F.explode(F.sequence(first, last))
    x = dealt.select("source", F.col("block").alias("lo"), to(F.col("block"), F.col("blocks") - 1).alias("hi"), "slug", "before")
    y = dealt.select("source", to(F.lit(0), F.col("block")).alias("lo"), F.col("block").alias("hi"), "slug", "before")
    keys = ["source", "lo", "hi"]
    both = x.repartition(tasks, *keys).alias("x").join(y.repartition(tasks, *keys).alias("y"), keys)
    once = both.where(((F.col("lo") < F.col("hi")) | (F.col("x.slug") < F.col("y.slug"))) & ~F.arrays_overlap("x.before", "y.before"))
    return once.select(F.least("x.slug", "y.slug").alias("a"), F.greatest("x.slug", "y.slug").alias("b"))


def page_bodies(pages: DataFrame) -> DataFrame:
    """The bodies of pages as sections, filed answers left out, in slug order."""
    return pages.where("dir <> 'qa'").select(F.col("slug").alias("id"), F.col("slug").alias("seq"), tokenize("body").alias("tokens"))


def page_index(pages: DataFrame) -> Index:
    """A stored index of the bodies of pages, filed answers left out, in slug order."""
    return Index.build(page_bodies(pages), scratch(pages.sparkSession))


def page_neighbours(pages: DataFrame, k: int = 3, threshold: float = 1.0) -> DataFrame:
    """(query_id, id, rank, score): for each page the ``k`` others of the highest BM25 score for its whole body, at the threshold or
    above, filed answers left out. Without an index, unless pages share a slug and so ask together."""
    rows = page_bodies(pages)
    return alike.nearest(rows, k, threshold) if alike.distinct_ids(rows) else page_index(pages).neighbours(k, threshold)


def neighbour_pairs(pages: DataFrame, k: int = 3, threshold: float = 1.0) -> DataFrame:
    """(a, b), a < b: pages, filed answers left out, of which one is among the other's ``k`` best by BM25 of the whole body, at the threshold or above."""
    hits = page_neighbours(pages, k, threshold)
    return hits.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).distinct()


def contradiction_pairs(pages: DataFrame) -> DataFrame:
    """(a, b), a < b: the candidates of C5, pages that cite a common source and pages near each other by BM25. All pairs of
    a source's pages: for the most alike ones see ``contradictions``."""
    return shared_source_pairs(pages).union(neighbour_pairs(pages)).distinct()


#: Pages of one source that a task compares with as many others.
BLOCK = 512


def alike_in_source(pages: DataFrame, cap: int) -> DataFrame:
    """(a, b, similarity): among the pages of each source the ``cap`` most alike pairs of each pair of blocks.

    The pages of a source are dealt out as pairs of blocks; pairs are compared inside tasks, and only the best leave them.
    """
    own = pages.where(F.col("dir").isin("entities", "concepts")).select("slug", F.array_distinct(tokenize("body")).alias("t"), F.explode("sources").alias("ref"))
    own = own.select(F.element_at(F.split("ref", "#"), 1).alias("source"), "slug", F.coalesce("t", F.array().cast("array<string>")).alias("t")).dropDuplicates(["source", "slug"])
    size = own.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = own.join(size, "source").withColumn("block", F.pmod(F.xxhash64("slug"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("source", "slug", "t", "block", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"))

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        words: dict[str, int] = {}
        sets = [np.fromiter((words.setdefault(w, len(words)) for w in t), np.int64, len(t)) for t in rows["t"]]
        own, n = np.zeros((len(sets), max(1, len(words))), np.float32), np.array([len(s) for s in sets])
        for i, s in enumerate(sets):
            own[i, s] = 1
        block, slug = rows["block"].to_numpy(), rows["slug"].to_numpy()
        p, q = np.flatnonzero(block == rows["x"].iloc[0]), np.flatnonzero(block == rows["y"].iloc[0])
        both = own[p] @ own[q].T
        union = n[p][:, None] + n[q][None, :] - both
        i, j = np.nonzero(slug[p][:, None] < slug[q][None, :]) if rows["x"].iloc[0] == rows["y"].iloc[0] else (v.ravel() for v in np.indices(both.shape))
        exact = both[i, j].astype(np.float64) / np.maximum(union[i, j], 1)
        at = np.argsort(-exact, kind="stable")
        at = at[exact[at] >= exact[at[min(cap, len(at)) - 1]]] if len(at) else at  # ties of the last one stay
        a, b = np.minimum(slug[p][i[at]], slug[q][j[at]]), np.maximum(slug[p][i[at]], slug[q][j[at]])
        return pd.DataFrame({"a": a, "b": b, "similarity": exact[at]}).sort_values(["similarity", "a", "b"], ascending=[False, True, True]).head(cap)

    return dealt.groupBy("source", "x", "y").applyInPandas(best, "a string, b string, similarity double")


#: Words of the most pages, which come last in the order of a page's words; pairs whose estimate gives the bound of the most alike ones; words of an estimate.
FREQUENT, TRIED, SKETCH = 1024, 500, 16
#: Words from the other end that go with each of a set's first ones, at most.
LAST = 8
#: A bound below this leaves too many pairs to a join: all pairs of a source are compared in blocks instead.
LEAST_BOUND = 0.6


def page_sets(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """(slug, dir, files, len, n, key, words), written once: the files that a page cites, the number of its words and the hashes of its distinct ones, ascending."""
    words = F.array_sort(F.transform(F.array_distinct("tokens"), lambda t: F.xxhash64(t)))
    files = F.array_distinct(F.transform("sources", lambda r: F.element_at(F.split(r, "#"), 1)))
    rows = pages.withColumn("tokens", tokenize("body")).select("slug", "dir", files.alias("files"), F.coalesce(F.size("tokens"), F.lit(0)).alias("len"), F.coalesce(words, F.array().cast("array<bigint>")).alias("words"))
    path = scratch(spark)
    rows.select("slug", "dir", "files", F.greatest("len", F.lit(0)).alias("len"), F.size("words").alias("n"), F.struct(F.xxhash64("words").alias("k"), F.hash("words").alias("l"), F.size("words").alias("n")).alias("key"), "words").write.parquet(path)
    return spark.read.parquet(path)


def shared_words(x: Column, y: Column) -> Column:
    """Jaccard similarity of two sets of word hashes."""
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def pairs_from(sets: DataFrame, group: str, bound: float, frequent: list[int]) -> DataFrame:
    """(a, b, similarity) of the pairs of one ``group`` of sets(slug, group, n, words) whose similarity reaches the bound (above 0), each once for a group.

    Words stand in one order, those of most pages last: alike sets share one of the first few. With the rarer words turned round they share one of the first
    few again, which is asked where it takes no more than ``LAST`` words. Pairs that do both are compared whole.
    """
    top = F.array(*map(F.lit, frequent)) if frequent else F.array().cast("array<bigint>")
    few = (F.col("n") - F.ceil(F.col("n") * bound - 1e-6) + 1).cast("int")
    sets = sets.withColumn("rare", F.array_except("words", top)).withColumn("rest", F.array_intersect(top, F.col("words")))
    first = F.slice(F.concat("rare", "rest"), 1, few)
    last = F.when(few <= LAST, F.slice(F.concat(F.reverse("rare"), "rest"), 1, few))
    # sizes of alike sets are in one class or in neighbouring ones; the first common word leaves room for as many as the bound asks
    kind = F.floor(F.log("n") / -math.log(bound))
    heads = sets.where("n > 0").select(group, "slug", "n", kind.alias("kind"), last.alias("last"), F.posexplode(first).alias("at", "word"))
    others = heads.withColumn("kind", F.explode(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1)))
    room = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= (F.col("x.n") + F.col("y.n")) * (bound / (1 + bound)) - 1e-6
    met = heads.alias("x").join(others.alias("y"), [group, "word", "kind"]).where((F.col("x.slug") < F.col("y.slug")) & room & F.coalesce(F.arrays_overlap("x.last", "y.last"), F.lit(True))).select(F.col("x.slug").alias("a"), F.col("y.slug").alias("b")).distinct()
    path = scratch(sets.sparkSession)
    met.write.parquet(path)
    met = sets.sparkSession.read.parquet(path)
    own = sets.select("slug", "words").join(sized(met.select(F.explode(F.array("a", "b")).alias("slug")).distinct()), "slug", "left_semi").dropDuplicates(["slug"])
    whole = met.join(own.select(F.col("slug").alias("a"), F.col("words").alias("x")), "a").join(own.select(F.col("slug").alias("b"), F.col("words").alias("y")), "b")
    return whole.select("a", "b", shared_words(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= bound - 1e-9)


def alike_bound(sets: DataFrame, cap: int) -> float:
    """What the ``cap``-th most alike pair of a common source reaches at least, by exact similarities of some pairs; 0 without so many pairs.

    Pages that agree in the first or the last words of their sets are tried, each with the next one of its source.
    """
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.slice("words", 1, 3).alias("at")), F.struct(F.lit(1).alias("end"), F.slice("words", -3, 3).alias("at")))).alias("e")
    narrow = sets.where("n >= 3").select("source", "slug", "n", F.slice("words", 1, SKETCH).alias("sketch"), ends).select("source", "slug", "n", "sketch", "e.end", F.xxhash64("e.at").alias("at"))
    by = Window.partitionBy("source", "end", "at").orderBy("n", "slug")
    next_ = narrow.select("slug", "n", "sketch", *(F.lead(c).over(by).alias(f"next_{c}") for c in ("slug", "n", "sketch"))).where("next_slug IS NOT NULL")
    guess = shared_words(F.col("sketch"), F.col("next_sketch")) * F.col("n") / F.col("next_n")
    tried = next_.select(F.least("slug", "next_slug").alias("a"), F.greatest("slug", "next_slug").alias("b"), guess.alias("guess")).groupBy("a", "b").agg(F.max("guess").alias("guess")).orderBy(F.col("guess").desc(), "a", "b").limit(TRIED)
    pairs = sets.sparkSession.createDataFrame(tried.select("a", "b").collect(), "a string, b string")  # TRIED at most
    own = sets.select("slug", "words").join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("slug")).distinct()), "slug", "left_semi").dropDuplicates(["slug"])
    exact = pairs.join(own.select(F.col("slug").alias("a"), F.col("words").alias("x")), "a").join(own.select(F.col("slug").alias("b"), F.col("words").alias("y")), "b")
    best = [r.s for r in exact.select(shared_words(F.col("x"), F.col("y")).alias("s")).orderBy(F.col("s").desc()).limit(cap).collect()]
    return best[-1] if len(best) == cap else 0.0


def frequent_words(sets: DataFrame) -> list[int]:
    """Hashes of the ``FREQUENT`` words of most pages, the rarest of them first."""
    counts = sets.select(F.explode("words").alias("word")).groupBy("word").count().orderBy(F.col("count").desc(), "word").limit(FREQUENT)
    return [r.word for r in counts.collect()][::-1]


def most_alike(pages: DataFrame, cap: int, sets: DataFrame | None = None, frequent: list[int] | None = None) -> DataFrame:
    """(a, b, similarity): the ``cap`` most alike pairs of pages that cite a common source, ties by slugs.

    Pairs tried first give a bound that the last of them reaches; a join on rare words finds every pair that reaches it. Of the
    pages of a source whose words are the same only the first ``cap`` + 1 are looked at: the pair of the i-th page of such words
    and the j-th of others has i * j - 1 pairs of the same similarity before it. Where the bound is low, pages are compared in blocks.
    """
    best = lambda rows: rows.distinct().orderBy(F.col("similarity").desc(), "a", "b").limit(cap)
    sets = page_sets(pages, pages.sparkSession) if sets is None else sets
    own = sets.where(F.col("dir").isin("entities", "concepts")).select(F.explode("files").alias("source"), "slug", "n", "key", "words")
    # the words stay where they are: places are given without them, and those beyond the cap are taken out
    place = F.row_number().over(Window.partitionBy("source", "key").orderBy("slug"))
    path = scratch(pages.sparkSession)
    own.select("source", "key", "slug").distinct().withColumn("place", place).where(F.col("place") > cap + 1).drop("place").write.parquet(path)
    own = own.join(sized(pages.sparkSession.read.parquet(path)), ["source", "key", "slug"], "left_anti").select("source", "slug", "n", "key", "words")
    bound = alike_bound(own, cap)
    if bound < LEAST_BOUND:
        return best(alike_in_source(pages, cap))
    if bound == 1.0:
        x, y = own.where("n > 0").select("source", "key", "slug").alias("x"), own.select("source", "key", "slug").alias("y")
        return best(x.join(y, ["source", "key"]).where("x.slug < y.slug").select(F.col("x.slug").alias("a"), F.col("y.slug").alias("b"), F.lit(1.0).alias("similarity")))
    return best(pairs_from(own, "source", bound, frequent_words(sets) if frequent is None else frequent))


def contradictions(pages: DataFrame, cap: int = 30) -> DataFrame:
    """C5: (a, b, similarity, place) of the ``cap`` most alike candidates: ``ranked_pairs`` of ``contradiction_pairs``, without the pairs that cannot be among them.

    Only pages of pairs that come before the last of the best pairs of a common source are asked for their neighbours.
    """
    spark = pages.sparkSession
    sets = page_sets(pages, spark)
    frequent = frequent_words(sets)
    found = most_alike(pages, cap, sets, frequent).collect()  # cap at most
    shared = spark.createDataFrame([(r.a, r.b) for r in found], "a string, b string")
    if len(found) < cap or found[-1].similarity < LEAST_BOUND:
        return ranked_pairs(shared.union(neighbour_pairs(pages)).distinct(), pages, cap)
    last = found[-1]
    rows = sets.where("dir <> 'qa'").withColumn("every", F.lit(0))
    if last.similarity == 1.0:
        x, y = rows.where((F.col("n") > 0) & (F.col("slug") <= last.a)).select("key", "slug").alias("x"), rows.select("key", "slug").alias("y")
        before = x.join(y, "key").where("x.slug < y.slug").select(F.col("x.slug").alias("a"), F.col("y.slug").alias("b"), F.lit(1.0).alias("similarity"))
    else:
        before = pairs_from(rows, "every", last.similarity, frequent)
    # as good as the last by rounding: room for it, exact ranks follow
    before = before.where((F.col("similarity") > last.similarity + 1e-9) | (F.struct("a", "b") <= F.struct(F.lit(last.a), F.lit(last.b)))).select("a", "b")
    path = scratch(spark)
    before.join(F.broadcast(shared), ["a", "b"], "left_anti").write.parquet(path)
    before = spark.read.parquet(path)
    asking = before.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if before.isEmpty():
        return ranked_pairs(shared, pages, cap)
    near = neighbours_of(asking, pages, sets).select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).distinct()
    path = scratch(spark)
    before.join(near, ["a", "b"], "left_semi").write.parquet(path)
    return ranked_pairs(shared.union(spark.read.parquet(path)).distinct(), pages, cap)


def neighbours_of(asking: DataFrame, pages: DataFrame, sets: DataFrame, k: int = 3, threshold: float = 1.0) -> DataFrame:
    """The rows of ``page_neighbours`` for the pages of asking(id). Where they are few, pages are compared with them as they are read, without an index;
    frequencies and lengths are those of ``page_sets``."""
    rows = sets.where("dir <> 'qa'")
    if asking.limit(alike.MANY + 1).count() > alike.MANY or not alike.distinct_ids(rows.select(F.col("slug").alias("id"))):
        return page_index(pages).neighbours(k, threshold, asking)
    named = sized(asking.select(F.col("id").alias("slug")))
    words = sized(rows.join(named, "slug", "left_semi").select(F.explode("words").alias("word")).distinct())
    df = rows.select(F.explode("words").alias("word")).join(words, "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("average")).first()
    return alike.nearest_of(page_bodies(pages.join(named, "slug", "left_semi")), page_bodies(pages), df, stats.n, stats.average, k, threshold)


def ranked_pairs(pairs: DataFrame, pages: DataFrame, cap: int = 30) -> DataFrame:
    """(a, b, similarity, place) of the ``cap`` most alike pairs by Jaccard similarity of body tokens; ties by slugs."""
    named = sized(pairs.select(F.explode(F.array("a", "b")).alias("slug")).distinct())
    own = pages.select("slug", "body").join(named, "slug", "left_semi").select("slug", F.array_distinct(tokenize("body")).alias("t"))
    rows = pairs.join(own.select(F.col("slug").alias("a"), F.col("t").alias("ta")), "a").join(own.select(F.col("slug").alias("b"), F.col("t").alias("tb")), "b")
    best = rows.select("a", "b", jaccard("ta", "tb").alias("similarity")).orderBy(F.col("similarity").desc(), "a", "b").limit(cap)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "a", "b")))


def stale_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """C6: (slug, source, drift_days) of pages whose first citation's source changed since: another hash, and a later time."""
    first = pages.where(F.col("dir").isin("entities", "concepts")).select("slug", "updated", "hashes", F.element_at(F.split(F.get("sources", F.lit(0)), "#"), 1).alias("source"))
    joined = first.join(docs.select(F.col("basename").alias("source"), F.sha2("content", 256).alias("now_hash"), "modified"), "source")
    drift = (F.unix_micros(parse_instant("modified")) - F.unix_micros(parse_instant("updated"))) / 86400e6
    rows = joined.withColumn("was", F.element_at("hashes", F.col("source"))).where("was IS NOT NULL AND was <> now_hash").withColumn("drift_days", drift)
    return rows.where("drift_days >= 0").select("slug", "source", "drift_days")


def promotion_candidates(pages: DataFrame, top: int = 10) -> DataFrame:
    """C8: drafts that were asked for most: (slug, count, updated, place)."""
    order = [F.col("count").desc(), F.col("updated").desc(), F.col("slug")]
    rows = pages.where("dir = 'qa' AND status = 'draft'").select("slug", "count", "updated").orderBy(*order).limit(top)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def stale_answers(pages: DataFrame, grace_days: float = 3.0) -> DataFrame:
    """C9: (slug, drift_days, cited) of live answers with a cited page updated more than the grace after them; an entity wins over a concept of the same slug."""
    wiki = pages.where(F.col("dir").isin("entities", "concepts")).groupBy("slug").agg(F.max_by("updated", F.col("dir")).alias("page_updated")).withColumnRenamed("slug", "cited")
    qa = pages.where("dir = 'qa' AND status = 'live'").select("slug", "updated", F.explode("sources").alias("ref")).select("slug", "updated", F.element_at(F.split("ref", "#"), 1).alias("cited")).distinct()
    drift = F.unix_micros(parse_instant("page_updated")) - F.unix_micros(parse_instant("updated"))
    late = qa.join(wiki, "cited").withColumn("d", drift).where(F.col("d") > grace_days * 86400e6)
    return late.groupBy("slug").agg(F.round(F.max("d") / 86400e6, 1).alias("drift_days"), F.array_sort(F.collect_set("cited")).alias("cited"))


def invalid_answers(pages: DataFrame, fm: str = "fm") -> DataFrame:
    """C10: (slug, property, value) of answer pages whose frontmatter (JSON) breaks the schema; a boolean is no count."""
    v = F.parse_json(F.col(fm))
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("MISSING"))
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    missing = lambda k: kind(k) == "MISSING"
    bad = lambda cond, k, value: F.when(cond, F.struct(F.lit(k).alias("property"), value.alias("value")))
    value = lambda k: F.when(missing(k) | (kind(k) == "VOID"), "<missing>").otherwise(text(k))
    rules = [
        bad(missing("status") | ~F.coalesce(text("status").isin(*VALID_STATUS), F.lit(False)), "status", value("status")),
        bad(missing("type") | ~F.coalesce(text("type") == "qa", F.lit(False)), "type", value("type")),
        bad((kind("question") != "STRING") | (F.trim(F.coalesce(text("question"), F.lit(""))) == ""), "question", value("question")),
        bad((kind("count") != "BIGINT") | (F.coalesce(F.try_variant_get(v, "$.count", "bigint"), F.lit(0)) <= 0), "count", value("count")),
    ]
    return pages.where("dir = 'qa'").select("slug", F.explode(F.array_compact(F.array(*rules))).alias("x")).select("slug", "x.property", "x.value")


def orphans(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """C11: (slug, missing, kind): cited sources that exist nowhere; full if none of the page's sources is left, else partial."""
    refs = pages.where(F.col("dir").isin("entities", "concepts")).select("slug", F.explode("sources").alias("ref")).select("slug", F.element_at(F.split("ref", "#"), 1).alias("source")).distinct()
    live = docs.select(F.col("basename").alias("source")).distinct().withColumn("there", F.lit(True))
    rows = refs.join(live, "source", "left").groupBy("slug").agg(F.array_sort(F.collect_set(F.when(F.col("there").isNull(), F.col("source")))).alias("missing"), F.count("*").alias("n"))
    return rows.where(F.size("missing") > 0).select("slug", "missing", F.when(F.size("missing") == F.col("n"), "full").otherwise("partial").alias("kind"))


def alias_collisions(pages: DataFrame) -> DataFrame:
    """C12: (kind, alias, claimed_by, resolved_to): aliases that are a page's slug, or that two pages claim."""
    claims = pages.select(F.explode("aliases").alias("alias"), "slug").groupBy("alias").agg(F.array_sort(F.collect_set("slug")).alias("claimed_by"))
    slugs = pages.select(F.col("slug").alias("alias")).distinct().withColumn("is_slug", F.lit(True))
    rows = claims.join(slugs, "alias", "left")
    kind = F.when(F.col("is_slug"), "alias_vs_slug").when(F.size("claimed_by") >= 2, "alias_vs_alias")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", "alias", "claimed_by", F.when(F.col("is_slug"), F.col("alias")).otherwise(F.get("claimed_by", F.lit(0))).alias("resolved_to"))


def summary(findings: dict[str, DataFrame]) -> DataFrame:
    """(place, check_id, label, axis, n) in report order; checks without findings count 0."""
    spark = next(iter(findings.values())).sparkSession
    counts = None
    for name, df in findings.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_id"), "n")
        counts = part if counts is None else counts.unionByName(part)
    taxonomy = spark.createDataFrame([(i, *t) for i, t in enumerate(TAXONOMY)], "place int, check_id string, label string, axis string")
    return taxonomy.join(counts, "check_id", "left").select("place", "check_id", "label", "axis", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def edit_grounding(edits: DataFrame, sections: DataFrame) -> DataFrame:
    """(slug, failures) of edits(slug, body, sources): every inline citation must be among the page's sources, and a section that is there; without
    any citation the page must have sources. ``sections``: id."""
    rows = edits.select("slug", "sources", cited_ids("body").alias("cited"))
    each = rows.select("slug", "sources", F.explode("cited").alias("id")).join(sections.select("id").distinct().withColumn("there", F.lit(True)), "id", "left")
    why = F.when(~F.array_contains("sources", F.col("id")), F.concat(F.lit("not a source: "), "id")).when(F.col("there").isNull(), F.concat(F.lit("no such section: "), "id"))
    bad = each.withColumn("why", why).where("why IS NOT NULL").groupBy("slug").agg(F.array_sort(F.collect_set("why")).alias("failures"))
    none = F.when((F.size("cited") == 0) & (F.coalesce(F.size("sources"), F.lit(0)) <= 0), F.array(F.lit("no sources")))
    return rows.join(bad, "slug", "left").select("slug", F.coalesce("failures", none, F.expr("CAST(array() AS array<string>)")).alias("failures"))
