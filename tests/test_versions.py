"""The versioned table: snapshots, conflicts, lost writers; the stored index against plain BM25 and against a rebuild."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.operators import bm25, postings
from quernel.operators.postings import Index
from quernel.sources.versions import Conflict, VersionedTable


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v int")


def content(df):
    return sorted(map(tuple, df.select("k", "v").collect()))


@pytest.fixture
def held(spark, tmp_path):
    return VersionedTable.create(table(spark, [("a", 1), ("b", 2), ("c", 3)]), str(tmp_path / "t"), ["k"])


def test_snapshots_stay_as_they_were(spark, held):
    before = held.snapshot()
    assert held.apply(lambda old: old.withColumn("v", F.col("v") + 10), table(spark, [("a", 0), ("zz", 0)]).select("k"), "raise") == 2
    assert held.apply(lambda old: old.where("false"), table(spark, [("b", 0)]), "drop b") == 3
    assert held.apply(lambda old: old.unionByName(table(spark, [("b", 7), ("d", 4)])), table(spark, [("b", 0), ("d", 0)])) == 4
    assert content(before) == content(held.snapshot(1)) == [("a", 1), ("b", 2), ("c", 3)]
    assert content(held.snapshot(2)) == [("a", 11), ("b", 2), ("c", 3)]
    assert content(held.snapshot(3)) == [("a", 11), ("c", 3)]
    assert content(held.snapshot()) == [("a", 11), ("b", 7), ("c", 3), ("d", 4)]
    assert held.history()[:3] == [(1, "create"), (2, "raise"), (3, "drop b")]


def test_one_of_two_writers_of_a_version_wins(spark, held):
    held.commit(table(spark, [("a", 5)]), None, 1)
    with pytest.raises(Conflict):
        held.commit(table(spark, [("a", 6)]), None, 1)
    assert content(held.snapshot())[0] == ("a", 5)


def test_a_change_is_made_again_after_a_conflict(spark, held):
    other, seen = VersionedTable(spark, held.path, ["k"]), []

    def change(old):
        if not seen:  # another writer commits between this one's read and its commit
            other.commit(table(spark, [("a", 100)]), None, 1)
        seen.append(1)
        return old.withColumn("v", F.col("v") + 1)

    assert held.apply(change, table(spark, [("a", 0)])) == 3
    assert len(seen) == 2 and content(held.snapshot())[0] == ("a", 101)


def test_a_lost_writer_is_repaired_and_its_part_vacuumed(spark, held, monkeypatch):
    held._write(table(spark, [("lost", 1)]), None)
    fs = held._fs()
    fs.create(held._at(held._manifest(2)), False).close()  # it died between making the manifest and filling it
    assert held.version() == 1 and held.repair() is None  # it may still be at work
    with pytest.raises(Conflict):
        held.commit(table(spark, [("a", 9)]), None, 1)
    monkeypatch.setattr(VersionedTable, "PATIENCE", 0.0)
    assert held.apply(lambda old: old.withColumn("v", F.lit(9)), table(spark, [("a", 0)])) == 3
    assert held.history()[1] == (2, "lost writer")
    assert held.vacuum() == 2 and content(held.snapshot()) == [("a", 9), ("b", 2), ("c", 3)]  # the parts of the lost writer and of the conflict


def test_many_commits_are_merged(spark, held, monkeypatch):
    monkeypatch.setattr(VersionedTable, "PARTS", 3)
    for i in range(4):
        held.apply(lambda old, i=i: old.withColumn("v", F.lit(i)) if i % 2 else old.where("false"), table(spark, [("abc"[i % 3], 0)]))
    assert len(held._read(held.version())["parts"]) <= 3
    assert content(held.snapshot()) == [("b", 1)]


def test_a_repeated_key_is_no_table(spark, tmp_path):
    with pytest.raises(ValueError):
        VersionedTable.create(table(spark, [("a", 1), ("a", 2)]), str(tmp_path / "t"), ["k"])


# ---------------------------------------------------------------- the stored index


def corpus(spark, n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda k: [rng.choices(words, [1 / (i + 1) for i in range(60)])[0] for _ in range(k)]
    rows = [(f"s{i}", i, text(rng.randint(0, 40)), text(rng.choice([0, 0, 3])), [f"w{rng.randint(0, 59)}", "Head"], "en" if i % 3 else "zh", "qa" if i % 4 == 0 else None) for i in range(n)]
    rows += [(f"c{i}", n + i, ["w1", "w2", "w3"], [], ["x"], "en", None) for i in range(12)]  # ties
    return [(i, s, t + q, q, h, lang, kind) for i, s, t, q, h, lang, kind in rows]


SCHEMA = "id string, seq long, tokens array<string>, question_tokens array<string>, heading_path array<string>, lang string, page_type string"
QUERIES = [(1, "w1 w2 w40"), (2, "w59"), (3, "nothing here"), (4, "w3 w3 w3 w10 w11 w12 w13 w14"), (5, "head w5"), (6, " ".join(f"w{i}" for i in range(60)))]


def hits(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize(("shard", "lane"), [(16, 2), (2048, 8)])
def test_index_equals_plain_bm25(spark, tmp_path, monkeypatch, shard, lane):
    monkeypatch.setattr(postings.in_shards, "__defaults__", (0, shard))
    monkeypatch.setattr(postings, "LANE", lane)
    monkeypatch.setattr(postings, "QUERIES", 2)
    rows, q = spark.createDataFrame(corpus(spark), SCHEMA), spark.createDataFrame(QUERIES, "query_id int, text string")
    for columns in (["id", "seq", "tokens"], rows.columns) if shard == 16 else (rows.columns,):
        own = rows.select(*columns)
        index = Index.build(own, str(tmp_path / f"{len(columns)}"))
        for k in (3, 500):
            assert hits(index.search(q, k)) == hits(bm25.bm25_search(q, own, k))
    assert hits(index.search(q, 4, F.col("lang") == "en")) == hits(bm25.bm25_search(q, rows, 4, lang="en"))
    assert hits(index.search(q, 4, ~F.col("page_type").eqNullSafe("qa"))) == hits(bm25.bm25_search(q, rows, 4, exclude_qa=True))
    stats = index.stats.first()
    assert stats.n == 132 and stats.total_len == rows.agg(F.sum(F.size("tokens"))).first()[0]


def test_neighbours_equal_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings.in_shards, "__defaults__", (0, 16))
    rows = spark.createDataFrame(corpus(spark), SCHEMA).select("id", "seq", "tokens")
    asked = rows.select(F.col("id").alias("query_id"), F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    want = bm25.top_k(bm25.scores(asked, rows).where("query_id <> id AND score >= 1.0"), 3)
    assert hits(Index.build(rows, str(tmp_path / "i")).neighbours(3, 1.0)) == hits(want)


def test_changed_index_equals_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings.in_shards, "__defaults__", (0, 16))
    old = spark.createDataFrame(corpus(spark), SCHEMA).withColumn("hash", F.xxhash64("tokens", "heading_path"))
    new = old.where("seq % 5 <> 1").withColumn("tokens", F.when(F.col("seq") % 7 == 0, F.array(F.lit("w1"), F.lit("fresh"))).otherwise(F.col("tokens"))).withColumn("question_tokens", F.when(F.col("seq") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("question_tokens")))
    new = new.unionByName(old.where("seq < 20").withColumns({"id": F.concat(F.lit("n"), "id"), "seq": F.col("seq") + 1000})).withColumn("hash", F.xxhash64("tokens", "heading_path"))
    q = spark.createDataFrame([*QUERIES, (7, "fresh w1")], "query_id int, text string")
    changed, whole = Index.build(old, str(tmp_path / "a")).refresh(new, str(tmp_path / "b")), Index.build(new, str(tmp_path / "c"))
    assert hits(changed.search(q, 7)) == hits(whole.search(q, 7))
    assert hits(changed.search(q, 7, F.col("lang") == "en")) == hits(whole.search(q, 7, F.col("lang") == "en"))
    assert sorted(map(tuple, changed.terms.collect())) == sorted(map(tuple, whole.terms.collect()))
    assert changed.stats.first()[:2] == whole.stats.first()[:2]
    again = changed.refresh(old, str(tmp_path / "d"))  # and back
    assert hits(again.search(q, 7)) == hits(Index.build(old, str(tmp_path / "e")).search(q, 7))
    same = again.refresh(old, str(tmp_path / "f"))
    assert same.spark.read.parquet(f"{same.parts[-1]}/blocks").count() == 0 and same.spark.read.parquet(f"{same.parts[-1]}/gone").count() == 0


def test_an_empty_index(spark, tmp_path):
    rows, q = spark.createDataFrame([], SCHEMA).select("id", "seq", "tokens"), spark.createDataFrame(QUERIES, "query_id int, text string")
    index = Index.build(rows, str(tmp_path / "i"))
    assert index.search(q, 3).count() == 0 and index.neighbours().count() == 0
    assert Index.build(spark.createDataFrame(corpus(spark), SCHEMA), str(tmp_path / "j")).search(q.limit(0), 3).count() == 0


def test_null_tokens_are_none(spark, tmp_path):
    rows = [("a", 1, ["w1", "w2"], None), ("b", 2, None, None), ("c", 3, [], ["w1"])]
    full = [(i, s, t or [], h or []) for i, s, t, h in rows]
    q = spark.createDataFrame(QUERIES, "query_id int, text string")
    kinds = "id string, seq long, tokens array<string>, heading_path array<string>"
    own, want = (Index.build(spark.createDataFrame(r, kinds), str(tmp_path / n)) for r, n in ((rows, "x"), (full, "y")))
    assert hits(own.search(q, 3)) == hits(want.search(q, 3)) and own.stats.first() == want.stats.first()


def test_bounds_leave_lists_out():
    """A shard whose tokens cannot reach the bar is not read, and a rare token's sections are completed alone."""
    places = [np.arange(1000), np.array([3, 500])]
    shard = postings.Shard(np.array([0, 1]), np.zeros(2, int), places, [np.full(1000, 0.1), np.array([5.0, 4.0])], np.array([0.1, 5.0]), 2)
    args = np.array([0, 1]), np.ones(2), np.ones(2)
    assert shard.best(*args, 6.0, 1, None, None)[0].size == 0
    at, scores = shard.best(*args, 1.0, 1, None, None)
    assert at.tolist() == [3] and np.allclose(scores, 5.1)
