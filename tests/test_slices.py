"""Tasks hold a bounded part of their texts and queries as Python objects."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quernel.operators import dense, sections


def test_slices_are_bounded_and_whole():
    texts = ["x" * n for n in (5, 0, 40, 3, 3, 3, 100, 1)] + [None, "y"]
    batch = pa.record_batch({"id": list(range(10)), "text": texts})
    got = list(sections.slices(iter([batch, batch.slice(0, 0)]), "text", 10))
    assert [i for b in got for i in b.column("id").to_pylist()] == list(range(10)) and len(got) > 3
    assert max(sum(len(t or "") for t in b.column("text").to_pylist()[:-1]) for b in got) <= 10


def test_nearest_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(dense, "PAIRS", 7)
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in dense.nearest(queries, vectors, 3).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    for q, v in rows[::50]:
        assert sorted(d for d, _ in got[q]) == sorted(sum((a - b) ** 2 for a, b in zip(v, w)) for _, w in rows)[:3]
    assert len(got) == 600
