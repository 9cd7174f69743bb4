"""The link graph of web pages: names, redirects resolved along chains and cycles, links to nothing, inbound counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..sources.corpus import scratch
from .bm25 import sized

HREF = r'<a href="/([^"]*)"'


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, place, target): the slugs of the site's own paths that a page links to, in order, repeated ones too."""
    return pages.select(F.col(id_col).alias("page"), F.posexplode(F.regexp_extract_all(html_col, F.lit(HREF), F.lit(1))).alias("place", "path")).select("page", "place", slugify("path").alias("target"))


def resolve(pointers: DataFrame) -> DataFrame:
    """(name, canonical) of pointers(name, target), each name once: the end of the chain that starts at a name.

    A chain that runs into a cycle ends at the least name of the cycle. Each round doubles the steps that a pointer takes and
    keeps the least name that it passes; the rounds are logarithmic in the number of names, and each is written, so that
    the lineage ends there.
    """
    spark = pointers.sparkSession
    now = keep(pointers.select("name", F.col("target").alias("at"), F.least("name", "target").alias("low")))
    n = now.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        step = sized(now.select(F.col("name").alias("at"), F.col("at").alias("then"), F.col("low").alias("lower")))
        far = now.join(step, "at", "left").select("name", F.coalesce("then", "at").alias("at"), F.least("low", "lower").alias("low"), F.col("then").isNotNull().alias("moved"))
        far = keep(far)
        moved, now = far.where("moved"), far.select("name", "at", "low")
        if moved.isEmpty():
            break
    # who still moves after as many steps as there are names is on a cycle or has run into one: all of it has been passed
    ends = sized(now.select(F.col("name").alias("at"), F.col("low").alias("least")))
    return now.join(ends, "at", "left").select("name", F.coalesce("least", "at").alias("canonical"))


def keep(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def named_pages(pages: DataFrame, name: Column, redirect: Column | None = None, id_col: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """((name, page), (name, target)): each name with its least page, and the pointers of names all of whose pages are redirects,
    to the least target that they name. ``redirect`` is the target's name, null for a page that stays."""
    rows = pages.select(F.col(id_col).alias("page"), name.alias("name"), (F.lit(None).cast("string") if redirect is None else redirect).alias("target"))
    groups = rows.groupBy("name").agg(F.min("page").alias("page"), F.min("target").alias("target"), F.every(F.col("target").isNotNull()).alias("moved"))
    return groups.select("name", "page"), groups.where(F.col("moved") & (F.col("target") != F.col("name"))).select("name", "target")


def resolved_links(pages: DataFrame, names: DataFrame, pointers: DataFrame) -> DataFrame:
    """(page, place, target, canonical, there): each link with the name it ends at and whether a page has that name."""
    links = page_links(pages).join(sized(resolve(pointers).withColumnRenamed("name", "target")), "target", "left")
    links = links.withColumn("canonical", F.coalesce("canonical", "target"))
    return links.join(sized(names.select(F.col("name").alias("canonical"), F.lit(True).alias("there"))), "canonical", "left").select("page", "place", "target", "canonical", F.coalesce("there", F.lit(False)).alias("there"))


def red_links(links: DataFrame) -> DataFrame:
    """(target, mentions, pages): names that links end at and no page has."""
    return links.where("NOT there").groupBy(F.col("canonical").alias("target")).agg(F.count("*").alias("mentions"), F.countDistinct("page").alias("pages"))


def inbound(links: DataFrame, names: DataFrame) -> DataFrame:
    """(name, page, mentions, pages) of every name, with the links that end at it; 0 where none do."""
    counted = links.where("there").groupBy(F.col("canonical").alias("name")).agg(F.count("*").alias("mentions"), F.countDistinct("page").alias("pages"))
    return names.join(counted, "name", "left").na.fill(0, ["mentions", "pages"])
