"""Mutations as pure functions from a table and its changes to the new table; the caller swaps the written result in.

``pages``: slug, dir, status, created, updated, sources, aliases, body, count. Every function returns whole tables,
outcomes beside them where a change can be refused.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_slug
from .bm25 import sized
from .governance import resolution_map


def upsert(pages: DataFrame, changes: DataFrame, key: str = "slug", keep: tuple[str, ...] = ("created", "aliases")) -> DataFrame:
    """Changed rows replace those of their key, but for the columns of ``keep``, which an existing row keeps; new keys are added."""
    old, new = pages.alias("o"), changes.alias("n")
    there = F.col(f"o.{key}").isNotNull()
    changed = F.col(f"n.{key}").isNotNull()
    cols = []
    for c in pages.columns:
        fresh = F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in keep else F.col(f"n.{c}")
        cols.append(F.when(changed, fresh).otherwise(F.col(f"o.{c}")).alias(c))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*cols)


def delete_orphans(pages: DataFrame, source: str, current: DataFrame) -> DataFrame:
    """Drop pages that cite ``source`` but are not among its current pages (slug)."""
    cites = F.exists("sources", lambda s: F.element_at(F.split(s, "#"), 1) == source)
    stale = pages.where(cites).join(current.select("slug"), "slug", "left_anti").select("slug")
    return pages.join(stale, "slug", "left_anti")


def promote(pages: DataFrame, slugs: DataFrame, to: str = "live") -> tuple[DataFrame, DataFrame]:
    """(new pages, outcomes) of an ordered batch(place, slug): invalid_slug, not_found, invalid_status, already_<to>, or the new status."""
    qa = pages.where("dir = 'qa'").select("slug", "status")
    already = F.lit(f"already_{to}")
    seen = F.row_number().over(Window.partitionBy("slug").orderBy("place"))
    allowed = F.col("status").isin("draft", "live")
    how = (
        F.when(~bare_slug("slug"), "invalid_slug").when(F.col("status").isNull(), "not_found").when(~allowed, "invalid_status")
        .when((F.col("status") == to) | (F.col("seen") > 1), already).otherwise(F.lit(to))
    )
    outcomes = slugs.withColumn("seen", seen).join(qa, "slug", "left").select("place", "slug", how.alias("outcome"))
    done = outcomes.where(F.col("outcome") == to).select("slug", F.lit("qa").alias("dir"), F.lit(to).alias("_to"))
    return pages.join(done, ["slug", "dir"], "left").withColumn("status", F.coalesce("_to", "status")).drop("_to").select(*pages.columns), outcomes


def edit_draft(pages: DataFrame, edits: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new pages, outcomes) of edits(slug, body): live pages conflict; every inline citation must be allowed; an edit without any needs page sources."""
    cited = F.regexp_extract_all("n.body", F.lit(r"\[Source:\s*([^\]]+?)\s*\]"), F.lit(1))
    ok = allowed.agg(F.collect_set("id").alias("ids"))
    rows = edits.alias("n").join(pages.where("dir = 'qa'").alias("o"), F.expr("n.slug = o.slug"), "left").crossJoin(F.broadcast(ok))
    how = (
        F.when(F.col("o.slug").isNull(), "not_found").when(F.col("o.status") == "live", "conflict")
        .when(F.size(F.array_except(cited, "ids")) > 0, "ungrounded").when((F.size(cited) == 0) & (F.size("o.sources") == 0), "ungrounded").otherwise("edited")
    )
    outcomes = rows.select(F.col("n.slug").alias("slug"), F.col("n.body").alias("body"), how.alias("outcome"))
    good = outcomes.where("outcome = 'edited'").select("slug", F.lit("qa").alias("dir"), F.col("body").alias("_body"))
    return pages.join(good, ["slug", "dir"], "left").withColumn("body", F.coalesce("_body", "body")).drop("_body").select(*pages.columns), outcomes.drop("body")


def delete_answers(pages: DataFrame, slugs: DataFrame) -> DataFrame:
    """Drop answers of the batch that are not live."""
    return pages.join(pages.where("dir = 'qa' AND status <> 'live'").join(slugs.select("slug"), "slug", "left_semi").select("slug", "dir"), ["slug", "dir"], "left_anti")


def refile(pages: DataFrame, results: DataFrame) -> DataFrame:
    """results(slug, passed, reason, body): a pass becomes the new draft; a content failure retires a live page to draft; else nothing changes."""
    content = F.col("reason").isin("retrieval_empty", "below_threshold", "claim_unsupported")
    rows = pages.join(results.select("slug", F.lit("qa").alias("dir"), "passed", "reason", F.col("body").alias("_body")), ["slug", "dir"], "left")
    retire = ~F.col("passed") & content & (F.col("status") == "live")
    rows = rows.withColumn("body", F.when(F.col("passed"), F.col("_body")).otherwise(F.col("body"))).withColumn("status", F.when(F.col("passed") | retire, "draft").otherwise(F.col("status")))
    return rows.select(*pages.columns)


def delete_full_orphans(pages: DataFrame, docs: DataFrame, slugs: DataFrame) -> DataFrame:
    """Drop pages of the batch none of whose sources exists (checked anew)."""
    live = docs.select(F.col("basename").alias("source")).distinct().withColumn("there", F.lit(True))
    refs = pages.join(slugs, "slug", "left_semi").select("slug", F.explode("sources").alias("ref")).select("slug", F.element_at(F.split("ref", "#"), 1).alias("source"))
    gone = refs.join(live, "source", "left").groupBy("slug").agg(F.every(F.col("there").isNull()).alias("full")).where("full")
    return pages.join(gone.select("slug"), "slug", "left_anti")


def add_alias(pages: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new pages, outcomes) of changes(slug, alias): refused where the page is missing or the name already resolves elsewhere."""
    names = resolution_map(pages).select(F.col("name").alias("alias"), "canonical")
    rows = changes.join(names, "alias", "left").join(pages.select("slug").distinct().withColumn("there", F.lit(True)), "slug", "left")
    how = F.when(F.col("there").isNull(), "not_found").when(F.col("canonical") == F.col("slug"), "unchanged").when(F.col("canonical").isNotNull(), "collision").otherwise("added")
    outcomes = rows.select("slug", "alias", how.alias("outcome"))
    new = outcomes.where("outcome = 'added'").groupBy("slug").agg(F.array_sort(F.collect_set("alias")).alias("_new"))
    out = pages.join(new, "slug", "left").withColumn("aliases", F.when(F.col("_new").isNotNull(), F.array_distinct(F.concat("aliases", "_new"))).otherwise(F.col("aliases")))
    return out.select(*pages.columns), outcomes


def remove_alias(pages: DataFrame, slug: str, alias: str) -> DataFrame:
    return pages.withColumn("aliases", F.when(F.col("slug") == slug, F.array_remove("aliases", alias)).otherwise(F.col("aliases")))


def rename_source(pages: DataFrame, old: str, new: str) -> DataFrame:
    """Repoint citations of a renamed source; anchors stay."""
    return pages.withColumn("sources", F.transform("sources", lambda s: F.when(F.element_at(F.split(s, "#"), 1) == old, F.concat(F.lit(new), F.substring(s, len(old) + 1, 1 << 20))).otherwise(s)))


def compare_and_set(pages: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """proposals(slug, seen_hash, body): applied where the page's body still has the hash that was seen, else refused."""
    rows = pages.join(proposals.select("slug", "seen_hash", F.col("body").alias("_body")), "slug", "left")
    same = F.sha2("body", 256) == F.col("seen_hash")
    outcomes = rows.where("seen_hash IS NOT NULL").select("slug", F.when(same, "applied").otherwise("stale").alias("outcome"))
    return rows.withColumn("body", F.when(F.coalesce(same, F.lit(False)), F.col("_body")).otherwise(F.col("body"))).select(*pages.columns), outcomes


def import_outcome(files: DataFrame, known: DataFrame, max_bytes: int = 10_485_760) -> DataFrame:
    """(path, outcome) of files(path, basename, ext, bytes, sha, hand_authored) in rule order: filename, collision, hand-authored, size, unchanged, imported.

    ``known`` (basename, sha) are imported sources. Names that differ by case collide; the first path wins.
    """
    first = F.row_number().over(Window.partitionBy(F.lower("basename")).orderBy("path"))
    rows = files.withColumn("_n", first).join(known.select("basename", F.col("sha").alias("known_sha")), "basename", "left")
    how: Column = (
        F.when(F.col("basename").rlike(r"[#/\\:\x00-\x1f]"), "unsafe_filename").when(~F.col("ext").isin("html", "txt", "md", "pdf"), "unsupported").when(F.col("_n") > 1, "collision")
        .when(F.col("hand_authored"), "hand_authored").when(F.col("bytes") == 0, "empty").when(F.col("bytes") > max_bytes, "too_large").when(F.col("known_sha") == F.col("sha"), "unchanged").otherwise("imported")
    )
    return rows.select("path", how.alias("outcome"))


#: Places of a batch that are ranked in one task.
SPAN = 1 << 16


def number_slugs(candidates: DataFrame, taken: DataFrame) -> DataFrame:
    """(place, base, slug) of candidates(place, base): slugs in the order of ``place``, a number of its own each, with -2, -3 ...
    where the base is taken; numbers that ``taken`` (slug) has are skipped.

    The r-th candidate of a base gets its r-th free number, which follows from its rank and the runs of taken numbers: ranks
    are counted in spans of places, so that a base of very many candidates is in no single task. Only bases that can take
    each other's names (x and x-2) are folded one after another, those of one stem together.
    """
    rows = candidates.select("place", "base", family("base").alias("family"))
    bases = rows.groupBy("family").agg(F.countDistinct("base").alias("n"))
    rows = rows.join(sized(bases), "family")
    return ranked_slugs(rows.where("n = 1").select("place", "base"), taken).unionByName(folded_slugs(rows.where("n > 1").select("family", "place", "base"), taken))


def family(slug: str) -> Column:
    """The stem of a slug without the numbers at its end."""
    return F.regexp_replace(slug, r"(-[1-9][0-9]*)+$", "")


def ranked_slugs(rows: DataFrame, taken: DataFrame) -> DataFrame:
    rows = rows.withColumn("span", F.floor(F.col("place") / SPAN))
    before = Window.partitionBy("base").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy("base", "span").agg(F.count("*").alias("n")).select("base", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("base", "span").orderBy("place"))
    rows = rows.withColumn("rank", rank).join(sized(start), ["base", "span"]).select("place", "base", (F.col("start") + F.col("rank")).alias("rank"))
    # taken numbers of each base, 1 for the base itself; a run of them moves every later rank by its length
    names = taken.select("slug").distinct()
    own = names.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("number"))
    stem, number = F.regexp_extract("slug", r"^(.+)-([1-9][0-9]{0,17})$", 1), F.regexp_extract("slug", r"^(.+)-([1-9][0-9]{0,17})$", 2)
    used = own.unionByName(names.where(stem != "").select(stem.alias("base"), number.cast("long").alias("number")).where("number >= 2")).join(sized(rows.select("base").distinct()), "base", "left_semi")
    at = F.row_number().over(Window.partitionBy("base").orderBy("number"))
    runs = used.withColumn("at", at).groupBy("base", (F.col("number") - F.col("at") + 1).alias("least")).agg(F.max("at").alias("moved"))
    runs = runs.groupBy("base").agg(F.collect_list(F.struct("least", "moved")).alias("runs"))
    moved = F.coalesce(F.array_max(F.transform(F.filter("runs", lambda r: r["least"] <= F.col("rank")), lambda r: r["moved"])), F.lit(0))
    free = F.col("rank") + moved
    return rows.join(sized(runs), "base", "left").select("place", "base", F.when(free == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), free.cast("string"))).alias("slug"))


def folded_slugs(rows: DataFrame, taken: DataFrame) -> DataFrame:
    names = taken.select(F.col("slug").alias("base"), family("slug").alias("family")).join(sized(rows.select("family").distinct()), "family", "left_semi")
    # taken names come first
    both = rows.withColumn("there", F.lit(False)).unionByName(names.select("family", F.lit(None).cast(rows.schema["place"].dataType).alias("place"), "base", F.lit(True).alias("there")))

    def fold(batches):
        stem, used, last = None, set(), {}
        for batch in batches:
            out = []
            for name, place, base, there in zip(batch["family"], batch["place"], batch["base"], batch["there"]):
                if name != stem:
                    stem, used, last = name, set(), {}
                if there:
                    used.add(base)
                    continue
                n = last.get(base, 1)
                while (slug := base if n == 1 else f"{base}-{n}") in used:
                    n += 1
                used.add(slug)
                last[base] = n
                out.append((int(place), base, slug))
            yield pd.DataFrame(out, columns=["place", "base", "slug"])

    dealt = both.repartition("family").sortWithinPartitions("family", F.col("there").desc(), "place")
    return dealt.mapInPandas(fold, f"place {rows.schema['place'].dataType.simpleString()}, base string, slug string")
