"""The pipeline's stages against brute force on the smallest tables, and the registered queries."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from quernel.llm import quality
from quernel.llm.common import materialize, table
from quernel.llm.queries import QUERIES, SQL


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "stage")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    q, lines, near, leaks, tokens = (kept[n] for n, _ in corpus_pipeline.STAGES)
    assert q == lines and near <= lines and leaks <= near and tokens == leaks
    model = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    want = {r.doc_id for r in quality.score(table(spark, sf, "documents"), model).where("score >= 0.3").collect()}
    assert q == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == tokens


@pytest.fixture
def odd_tables(spark, tmp_path):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows and ids, and columns that are called like the stages' own."""
    copy = " ".join(f"copied{k}" for k in range(40))
    rows = [(i, f"menu line\nplain text number {i} about {i * 7} things and {i * 11} more of them, told at some length here\nfooter", "en", f"s{i % 2}", 9) for i in range(40)]
    rows += [(40, copy, "en", "s0", 1), (41, copy, None, "s0", 1), (41, copy + " more", "en", None, None), (None, copy, "en", "s1", 1), (42, None, "en", "s0", None), (43, "", "en", "s1", 0), (None, None, None, None, None)]
    rows += [(44, "one", "en", "s0", 3)] * 3 + [(45, " ".join(f"w{k}" for k in range(50_000)), "en", "s0", 3), (46, LEAK + " and so on", "en", "s0", 3)]
    rows = [(*r, k, "x", k) for k, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, n_dropped string, score int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(47)] + [(100, 0, 0), (None, 0, None), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (None, "some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


LEAK = "which of these seven rivers crosses the largest number of borders on its way to the northern sea"


def test_stages_of_odd_tables(spark, odd_tables):
    path, rows = odd_tables
    docs = table(spark, path, "documents")
    columns = docs.columns
    (_, keep), (_, lines), (_, copies), (_, leaks), (_, tokens) = corpus_pipeline.STAGES
    kept = materialize(keep(spark, docs, path), "kept")
    assert kept.columns == columns and kept.count() == len(rows)  # all labels that have documents are good ones
    clean = materialize(lines(spark, kept, path), "lines")
    got = {r["row"]: r for r in clean.collect()}
    assert clean.columns == columns and len(got) == len(rows)
    assert got[3].text == rows[3][1].split("\n")[1] and got[3].n_chars == len(got[3].text) and got[44].text is None and got[45].text == ""
    assert all(tuple(got[k])[5:] == r[5:] for k, r in enumerate(rows))
    single = materialize(copies(spark, clean, path), "copies")
    left = {r["row"] for r in single.collect()}
    # one of the copies (40 is the least id), one of the three equal rows, all that are blank
    assert left == set(range(len(rows))) - {41, 42, 43, 48, 49} and single.columns == columns
    free = materialize(leaks(spark, single, path), "free")
    assert {r["row"] for r in free.collect()} == left - {51} and free.columns == columns
    assert tokens(spark, free, path).count() == len(left) - 1
    assert corpus_pipeline.run(spark, path).count() == len(left) - 1


def test_stages_of_empty_tables(spark, odd_tables, tmp_path):
    path = f"{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        table(spark, odd_tables[0], name).limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
    table(spark, odd_tables[0], "documents").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).count() == len(odd_tables[1]) - 5  # nothing is learned, nothing is searched for


def test_pipeline_against_plain_forms(spark, sf):
    """Each stage's decision by other means: all pairs of word sets, the library's tokens, lines counted in Python."""
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    left = {i for i, r in rows.items() if model.score(quality.places(pa.array([r.text]))[0]) >= 0.3}
    pages, seen = {}, {}
    for i in left:
        pages.setdefault(rows[i].source, set()).add(rows[i].text)
    for source, texts in pages.items():
        for t in texts:
            for x in {x.strip(" \t\r") for x in t.split("\n")}:
                seen[source, x] = seen.get((source, x), 0) + 1
    bad = {k for k, n in seen.items() if n >= 3 and n > 0.08 * len(pages[k[0]])}
    text = {i: "\n".join(x for x in rows[i].text.split("\n") if (rows[i].source, x.strip(" \t\r")) not in bad or not x.strip(" \t\r")) for i in left}
    sets = {}
    for i, t in text.items():
        w = [x for x in re.split("[\t\n\v\f\r ]+", t.lower()) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(left)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.79 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    single = {i for i in left if find(i) == i}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(got) <= single
    leaks = single - set(got)
    passages = [" ".join(r.text.split()).lower() for r in table(spark, sf, "benchmark").collect()]
    assert {i for i in single if any(p in " ".join(text[i].split()).lower() for p in passages)} <= leaks
    assert len(leaks) < 0.1 * len(single)
    for i, r in got.items():
        tokens = library.encode(text[i], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest())


def test_clean_documents_stay(spark, sf):
    good = {r.doc_id for r in table(spark, sf, "labels").where("quality = 1").collect()}
    docs = corpus_pipeline.keep_quality(spark, table(spark, sf, "documents"), sf)
    held = {r.doc_id for r in docs.collect()} & good
    assert len(held) >= 0.98 * len(good)


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) <= names and "pipeline" in names and set(SQL) <= set(__spark_entry__.oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = c.execute(SQL[name])
    names = [x[0] for x in result.description]
    want = sorted(tuple(r[names.index(k)] for k in columns) for r in result.fetchall())
    assert sorted(tuple(r[k] for k in columns) for r in df.select(*map(F.col, columns)).collect()) == want
