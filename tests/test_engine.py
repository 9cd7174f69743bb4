"""A small corpus end to end: index, search, ask, lint."""

import pytest

from quernel.engine import Engine
from quernel.operators import seams

PAGES = {
    "entities/refunds.md": "---\nstatus: live\nsources: [refunds.md#a]\naliases: [money-back]\nupdated: '2024-01-01'\n---\n# Refunds\n\nRefunds take thirty days. See [[shipping]] and [[nowhere]].\n",
    "concepts/shipping.md": "---\nstatus: live\nsources: [gone.md#s]\n---\n# Shipping\nIntro here.\n## Cost\nShipping costs five euros.\n## Time\nThree days.\n",
    "concepts/退款.md": "---\nstatus: live\n---\n# 退款\n\n退款政策需要三十天。\n",
    "concepts/bad.md": "---\nstatus: failed_grounding\n---\n# Bad\nsecret words\n",
    "qa/how.md": "---\ntype: qa\nstatus: live\nquestion: How long is the wait\ncount: 2\n---\nThirty days in all.\n",
    "qa/draft.md": "---\ntype: qa\nstatus: draft\nquestion: Hidden\ncount: 1\n---\nNot yet.\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in PAGES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    e = Engine(spark, str(root), str(root / "store"))
    e.index()
    return e


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_index_admits(engine):
    rows = engine.sections().orderBy("seq").collect()
    assert [r.id for r in rows] == ["shipping#cost", "shipping#time", "shipping#shipping", "退款#退款", "refunds#refunds", "how"]
    assert {r.lang for r in rows if r.file == "退款"} == {"zh"}


def test_search_by_language_and_question(engine, spark):
    hits = engine.search(ask(spark, "shipping cost", "退款政策", "how long wait", "the of")).collect()
    best = {r.query_id: r.id for r in hits if r.rank == 1}
    assert best == {0: "shipping#cost", 1: "退款#退款", 2: "how"}
    assert all(r.id != "how" for r in engine.search(ask(spark, "long wait"), exclude_qa=True).collect())


def test_hybrid(engine, spark):
    rows = engine.hybrid(ask(spark, "Shipping costs five euros")).orderBy("rank").collect()
    assert rows[0].id == "shipping#cost" and rows[0].passed and len(rows) == 3


def test_ask(engine, spark):
    rows = {r.query_id: r for r in engine.ask(ask(spark, "shipping cost", "unrelated zebra")).collect()}
    assert rows[0].passed and rows[0].answer == "Shipping costs five euros." and rows[0].sources[0] == "shipping#cost"
    assert not rows[1].passed and rows[1].reason == "retrieval_empty" and rows[1].answer.startswith("I cannot confirm")


def test_lint(engine, spark):
    docs = spark.createDataFrame([("docs/refunds.md", "refunds.md", "x", "2024-02-01")], "path string, basename string, content string, modified string")
    found = engine.lint(docs)
    assert [r.slug for r in found["C2"].collect()] == ["nowhere"]
    assert [(r.slug, r.kind) for r in found["C11"].collect()] == [("shipping", "full")]
    assert "- C2 red-link: 1" in engine.report(docs)


def test_verifier_attempts():
    calls, now = [], [0.0]

    def failing():
        calls.append(1)
        raise TimeoutError

    assert seams.attempts(failing, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)) == (None, 2) and len(calls) == 3
    assert seams.attempts(lambda: True, lambda: 0.0, lambda s: None) == (True, 0)
