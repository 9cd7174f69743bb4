"""What a task holds and what is exchanged, where it once grew faster than the input."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from quernel.operators import alike, bm25, governance, postings
from quernel.operators.postings import Index
from quernel.plans.registry import QUERIES
from quernel.streaming import stateful


def test_shared_source_pairs_are_dealt_in_blocks_and_stand_once(spark, monkeypatch):
    monkeypatch.setattr(governance, "PAIRED", 4, raising=False)
    rng = random.Random(3)
    rows = [(f"p{i // 2 if i % 9 == 0 else i}", ["entities", "concepts", "qa"][i % 3], [f"{rng.choice(['hot', 'hot', 'warm', f'f{i // 4}'])}.md#{i}" for _ in range(i % 4)] + [None] * (i % 7 == 0)) for i in range(90)]
    of = {}
    for slug, folder, refs in rows:
        for ref in refs if folder != "qa" else []:
            if ref:
                of.setdefault(ref.split("#")[0], set()).add(slug)
    want = sorted({(a, b) for slugs in of.values() for a in slugs for b in slugs if a < b})
    found = governance.shared_source_pairs(spark.createDataFrame(rows, "slug string, dir string, sources array<string>"))
    assert sorted(map(tuple, found.collect())) == want and len(of["hot.md"]) > 20
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in above  # no exchange of the pairs themselves


@pytest.mark.parametrize(("block", "shared"), [(8, 0.0), (8, 0.05), (16, 1.0), (2048, 0.0022)])
def test_neighbours_are_whole_and_exchange_no_query_by_lane(spark, tmp_path, monkeypatch, block, shared):
    """Blocks of pages against all pairs: copies, ties, pages without words, long pages; matrices alone, postings alone and both."""
    for name, value in (("BLOCK", block), ("SORTED", 4 * block), ("POSTINGS", 40 * block), ("SHARED", shared), ("AT_ONCE", 5), ("COLUMNS", 9)):
        monkeypatch.setattr(alike, name, value, raising=False)
    rng = random.Random(5)
    words = [f"{kind}{i}" for kind in "xyz" for i in range(60)]
    text = lambda kind, n: rng.choices(words[kind * 60 : kind * 60 + 60], [1 / (i + 1) for i in range(60)], k=n)
    rows = [(f"p{i}", f"p{i}", text(i % 3, rng.choice([0, 1, 5, 30, 200]))) for i in range(150)]
    rows += [(f"c{i}", f"c{i}", rows[7][2][: 5 + i // 10]) for i in range(30)] + [(f"t{i}", f"t{i}", ["x1", "y1", "one"]) for i in range(20)]
    rows += [("null", "null", None), ("alone", "alone", ["only", "here"])]
    sections = spark.createDataFrame(rows, "id string, seq string, tokens array<string>").repartition(3)
    asked = sections.select(F.col("id").alias("query_id"), F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    known = sections.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    hits = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 8)) for r in df.collect())
    want = hits(bm25.top_k(bm25.scores(asked, known).where("query_id <> id AND score >= 1.0"), 3))
    index = Index.build(sections, str(tmp_path / "i"))
    found = index.neighbours(3, 1.0)
    assert hits(found) == want and len(want) > 400
    assert "RepartitionByExpression" not in found._jdf.queryExecution().optimizedPlan().toString()
    if block == 8:
        pages = sections.select(F.col("id").alias("slug"), F.lit("concepts").alias("dir"), F.array_join("tokens", " ").alias("body"))
        assert hits(governance.page_neighbours(pages, 3, 1.0)) == hits(governance.page_index(pages).neighbours(3, 1.0))
        twice = sections.union(sections.where("id = 'p3'"))  # ids that are there twice ask together, as they did
        assert {r[0] for r in hits(Index.build(twice, str(tmp_path / "j")).neighbours(3, 1.0))} == {r[0] for r in want}


class Held:
    """A handle of states that counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers, self.of = 0, set(), {}

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def _state(self, name):
        held, rows = self, self.of.setdefault(name, [])

        class State:
            def call(self, *row):
                held.calls += 1
                rows.append(row)

            updateValue = call
            appendValue = lambda self, x: self.call(*x)
            update = lambda self, x: (self.clear(), self.call(*x))
            exists = lambda self: bool(rows)
            get = lambda self: rows[0] if name == "pending" else iter(list(rows))
            clear = lambda self: rows.clear()

        return State()

    getMapState = getListState = getValueState = lambda self, name, *a: self._state(name)


def test_pending_rows_wait_by_the_batch():
    rows = [(i * 1000, i // 2 * 2, i % 3 == 0) for i in range(1000)]
    random.Random(1).shuffle(rows)
    handle, processor, out = Held(), stateful.PendingFailures(), []
    processor.init(handle)
    for lo in (0, 500):
        list(processor.handleInputRows(("k",), iter([pd.DataFrame(rows[lo : lo + 500], columns=["ts_ms", "row_id", "failed"])]), TimerValues(0, -1)))
    assert handle.calls == 4  # an entry and a timer for each batch, not for each row
    for watermark in (400_500, 10**9):  # a part of them first
        while due := sorted(t for t in handle.timers if t <= watermark):
            handle.timers.remove(due[0])
            out += [tuple(r) for x in processor.handleExpiredTimer(("k",), TimerValues(0, watermark), ExpiredTimerInfo(due[0])) for r in x.itertuples(index=False)]
    n, want = 0, []
    for _, row_id, failed in sorted(rows):
        want.append(("k", row_id, not failed and n == 0))
        n = n + 1 if failed else max(0, n - 1)
    assert out == want and handle.calls < 20


def test_rows_of_one_time_and_id_all_come_out(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [(5, 1, 0, True), (5, 1, 0, True), (5, 2, 1, False), (5, 3, 2, False), (5, 4, 3, False), (6, 9, 9, False)]
        df = spark.createDataFrame(rows, "key long, row_id long, s long, failed boolean").select("key", "row_id", F.timestamp_seconds(F.col("s") + 1).alias("ts"), "failed")
        df.coalesce(1).write.parquet(str(tmp_path / "in"))
        q = stateful.pending_failures_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "0 seconds").writeStream.format("memory").queryName("twice").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        assert sorted(map(tuple, spark.table("twice").collect())) == [(5, 1, False), (5, 1, False), (5, 2, False), (5, 3, False), (5, 4, True), (6, 9, True)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_tasks_of_an_index_follow_its_shards(spark, tmp_path, monkeypatch):
    """However few partitions a shuffle has, a task sorts and writes some shards."""
    monkeypatch.setattr(postings.in_shards, "__defaults__", (0, 8))
    rows = spark.range(400).select(F.col("id"), F.col("id").alias("seq"), F.array(F.lit("w"), F.concat(F.lit("x"), F.col("id") % 50)).alias("tokens"))
    index = postings.Index.build(rows, str(tmp_path / "i"))
    shards = [r.n for r in index.sections.groupBy(F.input_file_name()).agg(F.countDistinct("shard").alias("n")).collect()]
    assert sum(shards) == 50 and len(shards) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) and max(shards) <= 10
    assert {r.token: r.df for r in index.terms.collect()} == {"w": 400} | {f"x{i}": 8 for i in range(50)}
    for shard in index.blocks.groupBy("shard").agg(F.collect_list("token").alias("t")).collect():
        assert len(set(shard.t)) == len(shard.t)


def test_touched_sections_are_counted_in_their_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings.in_shards, "__defaults__", (0, 16))
    monkeypatch.setattr(postings, "LANE", 2)
    rng = random.Random(11)
    rows = [(None if i % 10 == 3 else f"s{i // 3 if i % 4 == 0 else i}", i, [f"w{int(rng.paretovariate(0.8)) % 40}" for _ in range(i % 9)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, seq long, tokens array<string>")
    asked = spark.createDataFrame([(q, f"w{rng.randrange(40)}", rng.randint(1, 3)) for q in range(12) for _ in range(3)] + [(99, "absent", 1)], "query_id int, token string, times long").groupBy("query_id", "token").agg(F.max("times").alias("times"))

    def want(left):
        asks = asked.collect()
        met = [(a.query_id, i, t.count(a.token) * a.times) for a in asks for i, _, t in left if a.token in t]
        return sorted((q, sum(n for p, _, n in met if p == q), len({i for p, i, _ in met if p == q} - {None})) for q in {p for p, _, _ in met})

    index = postings.Index.build(df, str(tmp_path / "a"))
    found = index.touched(asked)
    assert sorted(map(tuple, found.collect())) == want(rows)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]  # no row for each posting is exchanged
    gone = [r for r in rows if r[0] is None or int(r[0][1:]) % 5]
    fewer = index.update(df.limit(0), df.where("CAST(substring(id, 2) AS INT) % 5 = 0"), str(tmp_path / "b"))
    assert sorted(map(tuple, fewer.touched(asked).collect())) == want(gone)


def test_tasks_of_a_search_follow_its_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings.in_shards, "__defaults__", (0, 8))
    monkeypatch.setattr(postings, "LANE", 1)
    rows = spark.range(400).select(F.col("id"), F.col("id").alias("seq"), F.array(F.lit("w"), F.concat(F.lit("x"), F.col("id") % 50)).alias("tokens"))
    index = postings.Index.build(rows, str(tmp_path / "i"))
    met = index._met(bm25.ask(spark.createDataFrame([(1, "w x3"), (2, "x4")], "query_id int, text string")), None, None)
    lanes = met.where("shard >= 0").groupBy(F.spark_partition_id()).agg(F.countDistinct("lane").alias("n")).collect()
    assert met.rdd.getNumPartitions() == 50 and max(r.n for r in lanes) < 8
    assert {r.id for r in index.search(spark.createDataFrame([(1, "x3")], "query_id int, text string"), 20).collect()} == {3 + 50 * i for i in range(8)}


def test_a_sweep_of_weights_is_summed_in_the_shards(spark, sf, tmp_path, monkeypatch):
    """Repeated ids, sections without one, sections that are gone; only sums leave a task, no row for a posting or for a query and a section."""
    found = QUERIES["a_21_question_weight_sweep"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "Aggregate" in found and not {"Join", "Generate"} & set(found.replace("(", " ").split())
    monkeypatch.setattr(postings.in_shards, "__defaults__", (0, 16))
    monkeypatch.setattr(postings, "LANE", 2)
    rng = random.Random(12)
    rows = [(None if i % 10 == 3 else f"s{i // 3 if i % 4 == 0 else i}", i, [f"w{int(rng.paretovariate(0.8)) % 40}" for _ in range(i % 9)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, seq long, tokens array<string>")
    asked = spark.createDataFrame([(q, f"w{rng.randrange(40)}", rng.randint(1, 3)) for q in range(12) for _ in range(3)] + [(99, "absent", 1)], "query_id int, token string, times long").groupBy("query_id", "token").agg(F.max("times").alias("times"))

    def want(left):
        asks, average = asked.collect(), sum(len(t) for _, _, t in left) / len(left)
        idf = lambda w: math.log((len(left) - (n := sum(w in t for _, _, t in left)) + 0.5) / (n + 0.5) + 1)
        out = []
        for weight in (0.2, 1.0):
            sums = {}
            for a in asks:
                for i, _, t in left:
                    if n := weight * t.count(a.token):
                        sums[a.query_id, i] = sums.get((a.query_id, i), 0) + a.times * idf(a.token) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(t) / average))
            out.append((weight, pytest.approx(max(sums.values())), pytest.approx(sum(sums.values()) / len(sums))))
        return out

    index = postings.Index.build(df, str(tmp_path / "a"))
    assert sorted(map(tuple, index.swept(asked, (0.2, 1.0)).collect())) == want(rows)
    gone = [r for r in rows if r[0] is None or int(r[0][1:]) % 5]
    fewer = index.update(df.limit(0), df.where("CAST(substring(id, 2) AS INT) % 5 = 0"), str(tmp_path / "b"))
    assert sorted(map(tuple, fewer.swept(asked, (0.2, 1.0)).collect())) == want(gone)
    assert fewer.swept(asked.where("query_id = 99"), (0.2, 1.0)).collect() == []


@pytest.mark.parametrize("block", [8, 2048])
def test_some_pages_ask_without_an_index(spark, monkeypatch, block):
    """A few pages against all, in blocks and at once, give the rows of all pages; the most alike pairs build no index and exchange no words of pages that are no candidates."""
    for name, value in (("BLOCK", block), ("SORTED", 4 * block), ("POSTINGS", 40 * block)):
        monkeypatch.setattr(alike, name, value)
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices([f"w{i}" for i in range(80)], [1 / (i + 1) for i in range(80)], k=n))
    rows = [(f"p{i}", ["entities", "concepts", "qa"][i % 3], [f"s{i % 4}.md"], text(rng.choice([0, 2, 30, 60]))) for i in range(120)]
    rows += [(f"c{i}", "concepts", [f"t{i}.md"], rows[46][3]) for i in range(6)] + [(f"d{i}", "concepts", ["s1.md"], rows[70][3] + " one" * (i % 2)) for i in range(40)] + [("null", "entities", ["s2.md"], None)]
    pages = spark.createDataFrame(rows, "slug string, dir string, sources array<string>, body string").repartition(3)
    sets = governance.page_sets(pages, spark)
    asking = spark.createDataFrame([(r[0],) for r in rows[::7]] + [("c3",), ("null",), ("none",)], "id string")
    hits = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 8)) for r in df.collect())
    names = {r.id for r in asking.collect()}
    every = governance.page_neighbours(pages).collect()
    want = sorted((r.query_id, r.rank, r.id, round(r.score, 8)) for r in every if r.query_id in names)
    if block == 8:  # ids that are there twice go by the index, as they did
        twice = pages.union(pages.where("slug = 'p7'"))
        assert {r[0] for r in hits(governance.neighbours_of(asking, twice, governance.page_sets(twice, spark)))} == {r[0] for r in want}
    pairs = governance.ranked_pairs(governance.contradiction_pairs(pages), pages).orderBy("place").collect()
    monkeypatch.setattr(governance, "page_index", None)
    assert hits(governance.neighbours_of(asking, pages, sets)) == want and len(want) > 30
    assert governance.contradictions(pages).orderBy("place").collect() == pairs
