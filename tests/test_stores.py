"""Files, stores, query sets, reports and candidate pairs: cases that the registered queries do not hold."""

import random

import pytest
from pyspark.sql import functions as F

from quernel.operators import dense, evaluation, governance, seams, sections
from quernel.plans import governance as P
from quernel.plans.stores import QUERIES_YAML, pdf
from quernel.sources import corpus
from quernel.streaming import stateful


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 7), ("c.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = corpus.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5007 and all(r.line.endswith(f"line {r.line_no}") for r in got)
    assert sorted(r.line for r in got if r.last) == ["a.txt line 4999", "b.txt line 6"]


@pytest.mark.parametrize(("old", "new", "message"), [("text: how long, ", "", "lacks"), ("factoid", "guess", "scenario_stratum"), ("high_overlap", "high", "overlap"), ("language: en", "language: fr", "language"), ("[a#b], key", "[], key", "no gold"), ("key_tokens: [days], gen", "key_tokens: [], gen", "no key_tokens")])
def test_query_sets_are_validated(spark, old, new, message):
    assert old in QUERIES_YAML
    with pytest.raises(ValueError, match=message):
        corpus.query_set(spark, QUERIES_YAML.replace(old, new))


def test_empty_and_broken_query_sets(spark):
    assert corpus.query_set(spark, "").count() == 0 and corpus.paraphrase_set(spark, "{}").count() == 0
    with pytest.raises(ValueError, match="lacks"):
        corpus.paraphrase_set(spark, "paraphrases: [{paraphrase_id: x}]")


def test_dense_index_tells_damage(spark, tmp_path):
    path = str(tmp_path / "i")
    assert corpus.read_vectors(spark, path) is None
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for _ in range(2):  # the second takes the place of the first
        corpus.write_vectors(rows, path, "m1")
    vectors, meta = corpus.read_vectors(spark, path, "m1")
    assert vectors.count() == 2 and meta == {"rows": 2, "files": 0, "model": "m1"}
    with pytest.raises(ValueError, match="built with"):
        corpus.read_vectors(spark, path, "m2")
    rows.write.mode("append").parquet(path + "/vectors")
    with pytest.raises(ValueError, match="does not hold"):
        corpus.read_vectors(spark, path)
    rows.write.parquet(str(tmp_path / "j" / "vectors"))
    with pytest.raises(ValueError, match="no metadata"):
        corpus.read_vectors(spark, str(tmp_path / "j"))


def test_staleness(spark):
    at = lambda *s: spark.createDataFrame([(x,) for x in s], "s int").select(F.timestamp_seconds("s").alias("modified"))
    cases = [(at(5), at(4), True), (at(5), at(5), False), (at(), at(), False), (at(5), at(), True), (at(), at(1), False)]
    assert [corpus.stale(p, i).first().stale for p, i, _ in cases] == [w for _, _, w in cases]
    assert corpus.index_stale(at(5), None) and not corpus.index_stale(at(), None)


def test_uploads(spark):
    names = {"a.md": "docs", "a.b.MD": "docs", "x.HTML": "raw", ".md": None, "md": None, "a.": None, "a/b.md": None, "p.pdf": "raw", "..txt": None, "a..txt": "raw"}
    got = {r.name: r.target for r in corpus.upload_outcome(spark.createDataFrame([(n, 1) for n in names], "name string, bytes long")).collect()}
    assert got == names


def test_outline_keeps_headings_beyond_the_budget(spark):
    text = "intro\n# A\n```\n## in a fence\n```\n####### seven\n#no\n   ### indented\nend"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(sections.outline_text("t", 2).alias("o")).collect()
    assert [r.o for r in got] == ["# A\n## in a fence\n   ### indented\nintro\n", "", None]


def test_candidates_of_a_hot_source(spark, monkeypatch):
    """The best of all pairs of a source's pages, compared in blocks, against all pairs."""
    monkeypatch.setattr(governance, "BLOCK", 8)
    rng = random.Random(2)
    words = [f"word{i}" for i in range(40)]
    rows = [(f"p{i:03}", "concepts", ["hot.md#a", f"s{i % 9}.md"] if i % 4 else [f"s{i % 9}.md"], " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(60)]
    pages = spark.createDataFrame([*rows, ("q", "qa", ["hot.md#a"], words[0])], "slug string, dir string, sources array<string>, body string")
    want = governance.ranked_pairs(governance.contradiction_pairs(pages), pages).orderBy("place").collect()
    assert [tuple(r) for r in governance.contradictions(pages).orderBy("place").collect()] == [tuple(r) for r in want]
    assert len(want) == 30


def test_red_links_of_one_long_page(spark):
    body = "see [[lost]] and [[refunds]] " * 2000 + "[[ gone |x]]"
    pages = spark.createDataFrame([("long", "concepts", body, []), ("refunds", "entities", "short [[lost]] end", [])], "slug string, dir string, body string, aliases array<string>")
    got = {r.slug: (r.mentions, r.referenced_by, r.context) for r in governance.red_links(pages).collect()}
    assert got == {"lost": (2001, ["long", "refunds"], "short [[lost]] end"), "gone": (1, ["long"], "[[lost]] and [[refunds]] [[ gone |x]]")}


def test_registered_candidates_equal_all_pairs(spark):
    p = P.pages(spark, None)
    assert governance.contradictions(p).count() == governance.ranked_pairs(governance.contradiction_pairs(p), p).count()


def test_bootstrap_against_plain_resampling(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = (rng.random(80) < 0.7).astype(int), (rng.random(80) < 0.5).astype(int)
    rows = spark.createDataFrame([("x", int(i), int(j)) for i, j in zip(a, b)], "g string, a int, b int")
    got = evaluation.bootstrap(rows, ["g"], "a", "b").first()
    drawn = np.array([(a - b)[rng.integers(0, 80, 80)].mean() for _ in range(10_000)])
    assert got.mean == pytest.approx((a - b).mean())
    assert np.allclose([got.low, got.high], np.percentile(drawn, [2.5, 97.5]), atol=0.02)
    assert got.p == pytest.approx(min(1, 2 * min((drawn <= 0).mean(), (drawn >= 0).mean())), abs=0.02)
    assert tuple(evaluation.bootstrap(rows, ["g"], "a", "b").first()) == tuple(got)


def test_queries_in_blocks(spark, monkeypatch):
    vectors = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    queries = vectors.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = sorted(map(tuple, dense.nearest(queries, vectors, 3).collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 10)
    assert sorted(map(tuple, dense.nearest(queries, vectors, 3).collect())) == want and len(want) == 43 * 3


def test_control_sample(spark):
    rows = spark.createDataFrame([(i, i % 2 == 0, i % 5) for i in range(50)], "id int, hit boolean, overlap int")
    one = lambda n, seed: {(r.id, r.hit) for r in evaluation.control_sample(rows, 2, n, seed).collect()}
    assert one(4, 1) == one(4, 1) != one(4, 2) and len(one(4, 1)) == 8 and all(not h or i % 5 > 2 for i, h in one(99, 1))


def test_pdf_that_cannot_be_opened(spark):
    assert seams.pdf_text(pdf(b"(a) Tj", b"")) == ["a"]
    for raw in (b"text", b"%PDF-1.4 /Encrypt"):
        with pytest.raises(ValueError, match="PDF"):
            seams.pdf_text(raw)


def test_heartbeats_fill_gaps_only(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 15), ("a", 46), ("b", 0)], "k string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = sorted((r.k, r.ts.second, r.kind) for r in stateful.heartbeats(rows, "k", "ts").collect())
    assert got == [("a", 0, "frame"), ("a", 15, "frame"), ("a", 30, "ping"), ("a", 45, "ping"), ("a", 46, "frame"), ("b", 0, "frame")]


def test_pdfs_of_several_pages(spark):
    from quernel.operators import seams
    from quernel.plans.stores import PDFS

    rows = spark.createDataFrame([*((i, bytearray(pdf(*pages))) for i, pages in PDFS.items()), (5, None)], "id int, content binary")
    got = {r.id: (r.has_text, r.markdown) for r in rows.select("id", seams.has_text_layer("content").alias("has_text"), seams.pdf_to_markdown("content").alias("markdown")).collect()}
    assert got == {1: (True, "Hello (world)\nsecond line"), 2: (False, ""), 3: (True, "After a very long first line of words\nHi"), 4: (False, ""), 5: (None, None)}


@pytest.mark.parametrize("copies", [0, 1, 40])
def test_candidates_by_a_bound(spark, monkeypatch, copies):
    """The best pairs by a join on rare words, with blocks forbidden, against all pairs: near copies, copies and neighbours without a common source."""
    monkeypatch.setattr(governance, "alike_in_source", None)
    monkeypatch.setattr(governance, "FREQUENT", 5)
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    bases = [rng.sample(words, 40) for _ in range(25)]
    rows = []
    for i in range(160):
        text = list(bases[rng.randrange(25)]) if copies < 40 or i % 2 else list(bases[0])
        for _ in range(0 if i < copies else rng.randint(0, 4)):
            text[rng.randrange(40)] = rng.choice(words)
        rows.append((f"p{i:03}", "concepts", [f"s{i % 3}.md#a"] if i % 5 else [], " ".join(text)))
    pages = spark.createDataFrame([*rows, ("e", "entities", ["s0.md"], ""), ("q", "qa", ["s0.md"], rows[0][3])], "slug string, dir string, sources array<string>, body string")
    want = governance.ranked_pairs(governance.contradiction_pairs(pages), pages).orderBy("place").collect()
    assert [tuple(r) for r in governance.contradictions(pages).orderBy("place").collect()] == [tuple(r) for r in want]
    shared = governance.ranked_pairs(governance.shared_source_pairs(pages), pages).orderBy("place").collect()
    got = governance.ranked_pairs(governance.most_alike(pages, 30).select("a", "b"), pages).orderBy("place").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in shared]
