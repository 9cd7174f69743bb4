"""Redirect chains and cycles."""

import random

from quernel.operators import links


def follow(pointers):
    out = {}
    for name in pointers:
        seen, at = [], name
        while at in pointers and at not in seen:
            seen.append(at)
            at = pointers[at]
        out[name] = min(seen[seen.index(at) :]) if at in seen else at
    return out


def test_chains_and_cycles(spark):
    rng = random.Random(1)
    cases = [{"a": "b", "b": "c", "c": "d"}, {"x": "y", "y": "z", "z": "y", "w": "x"}, {"s": "t"}, {}, {f"n{i:03d}": f"n{i + 1:03d}" for i in range(200)}]
    cases.append({f"r{i}": f"r{j}" for i in range(150) if (j := rng.randint(0, 170)) != i})
    for pointers in cases:
        df = spark.createDataFrame(list(pointers.items()), "name string, target string")
        assert {r.name: r.canonical for r in links.resolve(df).collect()} == follow(pointers)


def test_links_of_pages(spark):
    rows = [(1, '<title>Home x</title><a href="/Old">o</a><a href="/gone">g</a><a href="/gone">g</a>'), (2, '<title>Old</title><a href="/z">z</a><a href="/new">n</a>'), (3, "<title>New</title>"), (4, None)]
    from pyspark.sql import functions as F

    from quernel.functions.text import slugify

    pages = spark.createDataFrame(rows, "page_id int, html string")
    redirect = F.when(F.col("page_id") == 2, "new")
    names, pointers = links.named_pages(pages.where("html IS NOT NULL"), slugify(F.regexp_extract("html", "<title>([^ <]*)", 1)), redirect)
    found = links.resolved_links(pages, names, pointers)
    assert [tuple(r) for r in links.red_links(found).orderBy("target").collect()] == [("gone", 2, 1), ("z", 1, 1)]
    assert {r.name: (r.page, r.mentions) for r in links.inbound(found, names).collect()} == {"home": (1, 0), "old": (2, 0), "new": (3, 2)}


def test_headings_keep_the_entities_that_the_sql_keeps(spark, tmp_path):
    import duckdb

    from quernel.plans.registry import QUERIES, SQL

    heads = ["a &amp; b", "x = &quot;1", "cut &amp;&amp", "&amp;lt; &lt;b&gt; &nbsp;", "R&D &#38; &copy"]
    rows = [(i, f"/{i}", f"<html><head><title>T</title></head><body><h1>{h}</h1><p>p</p></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, QUERIES["f_36_page_headings"](spark, str(tmp_path)).collect())) == sorted(c.execute(SQL["f_36_page_headings"]).fetchall())
