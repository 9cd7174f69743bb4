"""Cases that the tables do not hold: literal rows and their known results."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.operators import bm25, dense, evaluation, fusion, governance, mutate, sections
from quernel.plans.registry import QUERIES
from quernel.plans.retrieval import asks
from quernel.plans.retrieval import sections as sections_of_documents
from quernel.sources import corpus
from quernel.streaming import stateful


def test_sections_close_in_order_of_their_ends():
    body = "# A\nintro\n## B\nb\n```\n# no\n```\n## B\n# C\n"
    got = [(s["heading"], s["path"], s["content"]) for s in sections.sections_of(body, "f")]
    assert got == [("B", ["A", "B"], "b\n```\n# no\n```"), ("B", ["A", "B"], ""), ("A", ["A"], "intro"), ("C", ["C"], "")]


def test_section_ids_repeat_without_probing(spark):
    rows = spark.createDataFrame([("f", "# x\n# x-2\n# x\n"), ("g", None), ("h", "plain"), ("i", "pre\n# Intro\n")], "name string, body string")
    ids = [r.id for r in sections.sections(rows).orderBy("name", "emit_seq").collect()]
    assert ids == ["f#x", "f#x-2", "f#x-2", "h", "i#intro", "i#intro-2"]


def test_nothing_of_a_body_is_lost(spark):
    rows = spark.createDataFrame([("f", "pre\n# a\nx y\n## b\n```\n# c\n```\n"), ("g", ""), ("h", "t")], "name string, body string")
    assert {r.missing for r in sections.uncarried(rows, sections.sections(rows)).collect()} == {0}


@pytest.mark.parametrize(
    ("text", "fields", "body"),
    [("---\na: 1\n---\nx", {"a": 1}, "x"), ("<!-- c\n-->\n\n---\na: 1\n---\nx", {"a": 1}, "x"), ("<!-- open\n---\na: 1\n---\nx", {}, None), ("---\n: [\n---\nx", {}, None), ("x", {}, "x"), ("", {}, "")],
)
def test_frontmatter(text, fields, body):
    assert sections.frontmatter_of(text) == (fields, text if body is None else body)


def test_writers_frontmatter_stands_anywhere():
    assert sections.first_fences("x\n---\na: 1\n---\nb") == ("a: 1", "b")
    assert sections.first_fences("x\n---\na") == (None, "x\n---\na")


def test_html_to_markdown():
    page = "<h1>T<script>x</script></h1><!-- c --><p>a <b>b</b> <a href='u'>l</a></p><ul><li>1</li><li>2</li></ul><table><tr><th>h</th></tr><tr><td>v</td></tr></table><pre>k  v</pre>"
    got = sections.html_to_markdown(page)
    assert got.startswith("# T\n\na **b** [l](u)\n\n* 1\n* 2") and "| h |\n| --- |\n| v |" in got and "```\nk  v\n```" in got and "script" not in got


def test_split_text_bounds():
    text = ("word " * 300 + "\n\n") * 3 + "x" * 1200
    parts = sections.split_text(text)
    assert max(map(len, parts)) <= 500 and all(w in " ".join(parts) for w in ("word", "x" * 500))


def test_boost_reaches_ancestors_and_repeats_count(spark):
    rows = spark.createDataFrame([("a", 1, ["Billing", "Fees"], ["fees"]), ("b", 2, ["b"], ["other"])], "id string, seq long, heading_path array<string>, tokens array<string>")
    q = spark.createDataFrame([(1, "billing billing")], "query_id int, text string")
    assert [(r.id, r.score) for r in bm25.bm25_search(q, rows, 5).collect()] == [("a", 1.0)]


def test_gates(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, 0.5), (2, 0.49)], "query_id int, score double")
    assert {(r.query_id, r.reason) for r in bm25.gate(q, hits).collect()} == {(1, None), (2, "below_threshold"), (3, "retrieval_empty")}
    far = spark.createDataFrame([(1, 1.1), (2, 1.2)], "query_id int, distance double")
    assert {(r.query_id, r.refused) for r in dense.gate(q, far).collect()} == {(1, False), (2, True), (3, True)}
    assert {(r.query_id, r.refused) for r in dense.gate(q, far, None).collect()} == {(1, False), (2, False), (3, True)}


def test_neighbours_after_the_filter_may_be_few(spark):
    vectors = spark.createDataFrame([(i, [float(i), 0.0], "x" if i < 100 else "y") for i in range(120)], "vec_id long, embedding array<double>, kind string")
    q = spark.createDataFrame([(1, [0.0, 0.0], "y")], "query_id long, vector array<double>, kind string")
    assert dense.nearest_of(q, vectors, 3, "kind").count() == 0
    assert [r.id for r in dense.nearest(q, vectors, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert dense.nearest(q.limit(0), vectors, 3).count() == 0


def test_fusion_ties_keep_the_first_list(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "w", 2)], "query_id int, id string, rank int")
    assert [r.id for r in fusion.fuse(a, b, 4).orderBy("rank").collect()] == ["x", "z", "y", "w"]


def test_coverage_gap_needs_a_real_success(spark):
    lines = [
        '## [t1] chat_grounding_fallback | "q" reason=below_threshold', '## [t2] chat | "q" top=none',
        '## [t3] chat_grounding_fallback | "p" reason=retrieval_empty', '## [t4] chat | "p" top=none', '## [t5] chat | "P?" top=a:1',
    ]
    log = governance.parse_log(spark.createDataFrame([("\n".join(lines),)], "text string"))
    assert [(r.canonical, r.hits, r.samples) for r in governance.coverage_gaps(log).collect()] == [("q", 1, ["q"])]


def test_statistics():
    assert evaluation.paired_sample_size(0.05, 0.8, 0.05, 0.85)[0] == 909
    assert evaluation.upper_gamma(1.0, 7.9512 / 2) == pytest.approx(0.0188, abs=1e-4)
    assert evaluation.upper_gamma(2.5, 1.0) == pytest.approx(0.849145, abs=1e-6)


@pytest.mark.parametrize(("b", "c", "p"), [(13, 27, 0.0385), (12, 1, 0.0034), (13, 16, 0.7111), (0, 9, 0.0039), (0, 0, 1.0), (3000, 3100, 0.2050)])
def test_mcnemar(spark, b, c, p):
    got = spark.range(1).select(evaluation.mcnemar(F.lit(b), F.lit(c)).alias("p")).first().p
    assert got == pytest.approx(p, abs=1e-4)


def test_rate_limit_window_edges(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 10), (3, "a", 20), (4, "a", 299), (5, "a", 300), (6, "b", 5)], "id int, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.request_id: (r.admitted, r.retry_after) for r in stateful.rate_limit(rows, "k", "ts", "id", 2, 300).collect()}
    assert got == {1: (True, 0.0), 2: (True, 0.0), 3: (False, 280.0), 4: (False, 1.0), 5: (True, 0.0), 6: (True, 0.0)}
    assert all(r.admitted for r in stateful.rate_limit(rows, "k", "ts", "id", 0).collect())


def test_session_gap_of_thirty_minutes_still_belongs(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1800), ("a", 3601)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.n for r in stateful.sessions(rows, "k", "ts").collect()) == [1, 2]


def test_session_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 600), ("b", 50), ("z", 100_000)], "k string, s int").withColumn("ts", F.timestamp_seconds("s")).select("k", "ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = stateful.sessions_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "ts")
    q = stream.writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.k, r.n) for r in spark.table("sessions_out").collect()}
    assert {("a", 2), ("b", 1)} <= got


def test_rate_limit_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 10), ("a", 3, 20), ("b", 4, 0)], "key string, request_id long, ts_ms long")
    rows.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = stateful.rate_limit_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 2, 300)
        q = stream.writeStream.format("memory").queryName("limited").outputMode("append").start()
        until = time.time() + 90
        while spark.table("limited").count() < 4 and time.time() < until:
            time.sleep(0.5)
        q.stop()
        assert {(r.request_id, r.admitted) for r in spark.table("limited").collect()} == {(1, True), (2, True), (3, False), (4, True)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_scans(spark, tmp_path):
    for name, text in {"concepts/b.md": "B", "concepts/a.md": "A", "qa/.x.md": "h", "other/c.txt": "C", "README.md": "r"}.items():
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_text(text)
    files = corpus.scan_markdown(spark, str(tmp_path / "w"), ["concepts"])
    assert [r.name for r in corpus.in_corpus_order(files).orderBy("seq").collect()] == ["a.md", "b.md"]
    assert [r.ext for r in corpus.scan_raw(spark, str(tmp_path / "w")).collect()] == ["txt", "md", "md"]


def test_jsonl_torn_tail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": 1}) + "\n" + '{"id": ')
    assert [r.id for r in corpus.scan_jsonl(spark, str(tmp_path / "a.jsonl"), "id int", True).collect()] == [1]
    with pytest.raises(Exception, match="bad line"):
        corpus.scan_jsonl(spark, str(tmp_path / "a.jsonl"), "id int").collect()
    (tmp_path / "b.jsonl").write_text('{"id": \n{"id": 2}\n')
    with pytest.raises(Exception, match="bad line"):
        corpus.scan_jsonl(spark, str(tmp_path / "b.jsonl"), "id int", True).collect()


def test_index_round_trip_and_swap(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "f", ["x", "y"]), (2, 2, "f", ["x"])], "id int, seq int, file string, tokens array<string>")
    corpus.write_index(rows, bm25.term_stats(rows), bm25.corpus_stats(rows), str(tmp_path / "i"))
    _, terms, stats = corpus.read_index(spark, str(tmp_path / "i"))
    assert [tuple(r) for r in terms.orderBy("token").collect()] == [("x", 2), ("y", 1)] and stats.first().n == 2
    for n in (3, 5):
        corpus.swap_in(spark.range(n), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, seq int, file string, tokens array<string>")
    q = spark.createDataFrame([(1, "x")], "query_id int, text string")
    assert bm25.bm25_search(q, none, 3).count() == 0 and bm25.corpus_stats(none).first().n == 0


def test_token_functions(spark):
    row = spark.createDataFrame([("What's 𠀀a 退款x 7",)], "t string").select(X.tokenize("t").alias("t"), X.detect_lang("t").alias("l")).first()
    assert row.t == ["𠀀", "退款", "7"] and row.l == "zh"


def folded(rows, taken):
    used, out = set(taken), {}
    for place, base in sorted(rows):
        n = 1
        while (slug := base if n == 1 else f"{base}-{n}") in used:
            n += 1
        used.add(slug)
        out[place] = slug
    return out


def test_slug_numbers_equal_the_fold(spark, monkeypatch):
    import random

    monkeypatch.setattr(mutate, "SPAN", 16)
    rng = random.Random(9)
    bases = ["section"] * 6 + ["a", "b", "b-2", "b-2-3", "c-0", "d-01", "e", "x-y", "-2"]
    for trial in range(2):
        rows = [(i * 3, rng.choice(bases)) for i in range(150)]
        taken = {f"{rng.choice(bases)}-{rng.randint(0, 40)}" for _ in range(60 * trial)} | {"a", "a-2", "a-4", "section-2", "e-02", "e-1"}
        df, known = spark.createDataFrame(rows, "place int, base string").repartition(3), spark.createDataFrame([(t,) for t in taken], "slug string")
        assert {r.place: r.slug for r in mutate.number_slugs(df, known).collect()} == folded(rows, taken)
    assert mutate.number_slugs(df.limit(0), known).count() == 0


def test_contradiction_candidates_need_no_common_source(spark):
    rows = spark.createDataFrame(
        [("a", "entities", ["x.md#1"], "shipping takes five days"), ("b", "concepts", ["y.md#1"], "shipping takes three days"), ("c", "concepts", ["x.md#2"], "unlike words"), ("d", "qa", ["z.md"], "shipping takes five days"), ("e", "entities", [], "")]
        + [(f"n{i}", "concepts", [], f"other{i} page{i}") for i in range(8)],
        "slug string, dir string, sources array<string>, body string",
    )
    assert {(r.a, r.b) for r in governance.shared_source_pairs(rows).collect()} == {("a", "c")}
    assert {(r.a, r.b) for r in governance.contradiction_pairs(rows).collect()} == {("a", "b"), ("a", "c")}


def test_registered_candidates_hold_neighbours(spark):
    ask = lambda name: QUERIES[name](spark, None).collect()  # on the literal pages, which have fewer pairs than are ranked
    pairs = {(r.a, r.b) for r in ask("j_12_shared_source")} | {tuple(sorted((r.query_id, r.neighbour))) for r in ask("j_13_bm25_neighbours")}
    assert len(pairs) > len(ask("j_12_shared_source"))
    assert {r.check_id: r.n for r in ask("a_08_findings_by_check")}["C5"] == len(pairs)
    assert {(r.a, r.b) for r in ask("x_06_judge_pairs")} == pairs


def test_whole_questions_are_asked(spark, sf):
    whole = bm25.bm25_search(asks(spark, sf), sections_of_documents(spark, sf), 5)
    want = {(r.query_id, r.id) for r in whole.collect()}
    assert {(r.query_id, r.id) for r in QUERIES["x_07_cross_encoder"](spark, sf).collect()} == want
    tokens = {r.query_id: r.n for r in bm25.ask(asks(spark, sf)).groupBy("query_id").agg(F.sum("times").alias("n")).collect()}
    assert max(tokens.values()) > 20
