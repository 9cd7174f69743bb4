"""Divergence audit, exact top-k and prefix trie against brute force: nulls, ties, repeats, empty tables, clashing names, small blocks."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import divergence, prefix_trie, queries, top_products

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_divergence", "op12_top_products", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)


# ---------------------------------------------------------------- divergence


def divergence_of(rows, least_docs=30, top=50):
    count, seen, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        words = [w.translate(LOWER) for w in TERM.findall(text or "")]
        count[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    for lang in seen.keys() | {g[0] for g in count}:
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        groups = [g for g in count if g[0] == lang]

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p = {g: shares(count[g]) for g in groups}
        q = shares(sum((count[g] for g in groups), Counter()))
        for g in groups:
            pairs = sorted((-sum(abs(p[g][t] - p[h][t]) for t in kept), h[1].encode(), h[1]) for h in groups if h != g)
            terms = sorted((q[t] - p[g][t], t.encode(), t) for t in kept if count[g][t] and p[g][t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(*g, part, x, -v, i + 1) for i, (v, _, x) in enumerate(items)]
    return sorted(out)


ODD_TEXTS = [None, "", "12 34 _", "Ab aB AB", "é É é", "日本 日本語", "a" * 40000, "x\x00y\x7fz", "word " * 5000, "İ ı K", "a-b'c", "😀 a"]


def odd_documents():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "é", "日", "delta", "eps", "Zeta"]
    rows = [(" ".join(rng.choices(words, [2 ** -i for i in range(8)], k=rng.randint(0, 30))), rng.choice(["en", None, "", "fr"]), rng.choice(["a", "b", None, "", "é", "hot", "hot"])) for _ in range(120)]
    return rows + [(t, "en", s) for t in ODD_TEXTS for s in ("odd", None)] + [("same text", "en", "copies")] * 50 + [("", "empty", "one"), (None, "empty", "two"), ("12", "zz", None)]


@pytest.mark.parametrize(("block", "slice_", "gathered"), [(32, 4096, 1 << 19), (2, 2, 20)])
def test_divergence_of_odd_documents(spark, monkeypatch, block, slice_, gathered):
    for name, value in (("BLOCK", block), ("SLICE", slice_), ("GATHERED", gathered)):
        monkeypatch.setattr(divergence, name, value)
    rows = odd_documents()
    df = spark.createDataFrame([(i, *r, "x", 7) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(3)
    for least in (1, 4):
        got = sorted(map(tuple, divergence.source_divergence(df, least_docs=least).collect()))
        assert got == divergence_of(rows, least)
    assert divergence.source_divergence(df.limit(0)).collect() == []


def test_shares_stay_exact_on_large_counts(spark):
    cases = [(c + 5, n + 5) for c, n in ((0, 1), (10**12, 3 * 10**13), (10**13, 9 * 10**13), (7, 10**13), (123456789012, 123456789013))]
    assert [int(divergence.share_array(np.array([c]), n)[0]) for c, n in cases] == [1 + 10**9 * c // n for c, n in cases]
    got = spark.createDataFrame(cases, "c long, n long").select(divergence.share(F.col("c"), F.col("n"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * c // n for c, n in cases]


# ---------------------------------------------------------------- top-k


def best_of(rows, k=10):
    usable = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q is not None and q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in usable if i != q)[:k]
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored)]
    return Counter(out)


@pytest.mark.parametrize("size", [7, 2048])
def test_top_products(spark, monkeypatch, size):
    monkeypatch.setattr(top_products, "QUERIES", 3)
    monkeypatch.setattr(top_products, "LANE", 2)
    monkeypatch.setattr(top_products.segments, "__defaults__", (size,))
    monkeypatch.setattr(top_products, "SEGMENT", size)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(0, 900, 10)]
    rows += [(i + 1, rows[3][1]) for i in range(60)] + [(1000 + i, rows[0][1]) for i in range(0, 300, 50)]  # ties
    rows += [(100, None), (200, [1.0, None]), (300, [float("nan")] * 6), (400, [float("inf")] + [0.0] * 5), (None, [9.0] * 6), (500, []), (600, [0.0] * 6), (700, [3.0]), (800, [-1.0] * 9), (900, [1e-9] * 6), (100, [2.0] * 6), (100, [2.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<float>, row int, seg string").repartition(3)
    assert Counter(map(tuple, top_products.top_products(df).collect())) == best_of(rows)


def test_top_products_of_few_and_of_large(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert top_products.top_products(make([])).collect() == []
    assert top_products.top_products(make([(100, [1.0])])).collect() == []
    rows = [(0, [3e6, -7e5]), (1, [2.5e6, 1.0]), (2, [2.5e6 + 1e-3, 1.0]), (3, [-4e6, 3.0]), (4, [2.5e6, 1.0])]
    assert Counter(map(tuple, top_products.top_products(make(rows), k=3).collect())) == best_of(rows, 3)
    assert {r.score for r in top_products.top_products(make([(0, [1e300]), (1, [1e300]), (2, [-1e300])])).collect()} == {2**63 - 1, -(2**63)}


def test_lists_leave_no_better_row_out():
    rng = np.random.default_rng(7)
    for n, width in ((1, 1), (40, 3), (500, 16), (300, 1)):
        rows = rng.integers(-900, 900, (n, width))
        lists = top_products.Lists(np.arange(n), rows)
        for query in rng.integers(-900, 900, (20, width)):
            scores = rows @ query
            least = np.sort(scores)[-min(n, 5)]
            for bar in (-np.inf, float(least)):
                assert set(np.flatnonzero(scores >= least)) <= set(lists.survivors(query, bar, 5))
            assert lists.most(query[None].astype(float))[0] >= scores.max()


def test_lists_are_not_read_to_their_ends():
    """Near copies of a query end the reading early: few vectors are left to resolve."""
    rng = np.random.default_rng(2)
    rows = rng.normal(0, 40, (2000, 16)).astype(np.int64)
    rows[:12] = rows[0] * 6 + rng.integers(-3, 4, (12, 16))
    lists = top_products.Lists(np.arange(2000), rows)
    at = lists.survivors(rows[0], -np.inf, 10)
    assert len(at) < 500 and {*range(12)} <= set(at)


# ---------------------------------------------------------------- trie


def trie_of(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            conv[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    conv = {c: [t[3:] for t in sorted(ts)] for c, ts in conv.items()}
    path = {}
    for c, turns in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        path[c] = conv.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + turns[h:]
    members, children = defaultdict(set), defaultdict(set)
    for c, turns in path.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    saved = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    out = []
    for p, m in members.items():
        below = [x for x in members if x[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(path[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[x] for x in below), sum(saved[x] for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def odd_conversations():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 90), *range(-45, -1, 7), 10**12, 10**12 + 1]:
        rows += [(c, rng.choice([t, t, None]) if t == 0 else t, rng.choice(["user", None, ""]) if t < 2 else "assistant", rng.choice(["hi there", "a b  c", None, "", "hi\tthere\n"])) for t in range(rng.randint(1, 5))]
    rows += [(40, t, "user", f"long {t}") for t in range(5, 300)]  # one conversation of very many turns
    rows += [(41, 3, "user", "again")] * 30 + [(None, 1, "user", "nobody"), (5, None, None, None), (5, None, "user", "x" * 30000)]
    rows += [(c, t, "user", f"common {t}") for c in range(100, 180) for t in range(3)]  # many of one path
    return rows


@pytest.mark.parametrize("bits", [12, 2])
def test_trie_of_odd_conversations(spark, monkeypatch, bits):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits)
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, c string").repartition(5)
    assert Counter(map(tuple, prefix_trie.conversation_trie(df).collect())) == trie_of(rows)


def test_trie_of_none_and_one(spark):
    make = lambda rows: spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert prefix_trie.conversation_trie(make([])).collect() == []
    for rows in ([(7, None, None, None)], [(21, 0, "user", "a")], [(3, 0, "u", "a b"), (3, 1, "u", "c"), (3, 2, "u", "d"), (3, 3, "u", "e")]):
        assert Counter(map(tuple, prefix_trie.conversation_trie(make(rows)).collect())) == trie_of(rows)


def test_running_sums_of_a_key_in_many_pieces(spark):
    df = spark.createDataFrame([(0 if i % 3 else i, i, 1) for i in range(3000)], "k long, at long, one long").repartition(4)
    got = prefix_trie.running(df, "k", ["at"], {"n": "one"}, {"x": "at"}).where("k = 0").orderBy("at").collect()
    x, want = 0, []
    for n, i in enumerate((i for i in range(3000) if i % 3 or i == 0), 1):
        x ^= i
        want.append((i, n, x))
    assert [(r["at"], r.n, r.x) for r in got] == want
