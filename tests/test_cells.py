"""The layout of cells gives what a comparison with all vectors gives, and leaves most of clustered vectors out."""

import numpy as np
import pytest

from quernel.operators import cells
from quernel.operators.cells import Cells


def brute(rows, queries, k):
    out = set()
    for q, v in queries:
        d = sorted((float(((np.array(v) - np.array(x)) ** 2).sum()), i) for i, x in rows if x is not None)
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("cell", [8, 1024])
def test_nearest_equals_all_pairs(spark, tmp_path, monkeypatch, cell):
    monkeypatch.setattr(cells, "CELL", cell)
    monkeypatch.setattr(cells, "LANE", 3)
    monkeypatch.setattr(cells, "QUERIES", 7)
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 3, (6, 5))
    rows = [(i, (middle[i % 6] + rng.normal(0, 0.3, 5)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 5)]  # a third of ties, none, the origin
    df = spark.createDataFrame([(i, v, i % 4) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    asked = [(i, rows[i][1]) for i in range(0, 300, 13)] + [(999, [50.0] * 5), (998, rows[0][1])]
    q = spark.createDataFrame(asked, "query_id long, vector array<double>")
    layout = Cells.build(df, str(tmp_path / "c"), keep=["label"])
    got = layout.nearest(q, 4, ["label"]).collect()
    assert {(r.query_id, r.id, r["rank"]) for r in got} == brute(rows, asked, 4) and all(r.label == r.id % 4 for r in got)
    share = layout.read_share(q, 4).first()
    assert share.vectors == len(asked) * 361
    if cell == 8:
        assert share.left_out > share.pieces / 2 and share.compared < share.vectors / 2


def test_few_vectors(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, vector array<double>")
    assert Cells.build(make([]), str(tmp_path / "a")).nearest(q, 3).count() == 0
    assert [(r.query_id, r.id, r.distance) for r in Cells.build(make([(5, [0.0, 0.0])]), str(tmp_path / "b")).nearest(q, 3).collect()] == [(1, 5, 1.0)]
