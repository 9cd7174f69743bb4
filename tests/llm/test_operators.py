"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernel.llm import bpe, common, decontaminate, jaccard_join, line_dedup, near_vectors, pii, quality, secrets_scan, sharding, token_store

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n", "a", "<|endoftext|>x", "İ ẞ é", "日本語 12", "'s 's", "x" * 5000, "ab, cd. Ef.\nGh", "end.  two", "tab\there", "!, ?.", "😀‍👩", "\x00\x01 y", "a\x1cb\xa0c", "word " * 3000]


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (1, "")])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {f: Tokenizer.from_file(f) for f in (WORD_FILE, BYTE_FILE)}


def test_bpe_equals_the_library(odd, library):
    tok = library[WORD_FILE]
    got = {r.doc_id: r for r in bpe.round_trip(odd.where("doc_id IS NOT NULL"), WORD_FILE).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_random_texts(library):
    own, tok, rng = bpe.ForcedBoundaryBpe(bpe.read_file(WORD_FILE)), library[WORD_FILE], random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice("abÉé ß\n\t'st123½日😀́\x1c <|>!?#., ") for _ in range(rng.randint(0, 50)))
        assert own.encode(text) == tok.encode(text, add_special_tokens=False).ids


def test_bpe_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "hi there", "x", 5)], "doc_id int, text string, ids string, n_tokens int")
    got = bpe.decode(bpe.encode(rows, WORD_FILE), WORD_FILE, "ids_").first()
    assert got.n_tokens == 5 and got.ids == "x" and got.decoded == "hi</w> there</w>"
    assert bpe.round_trip(rows.limit(0), WORD_FILE).count() == 0


def test_long_merge_equals_short():
    own = bpe.ForcedBoundaryBpe(bpe.read_file(WORD_FILE))
    parts = list("abracadabra" * 20)
    short = own.merged("".join(parts), False)
    assert [own.vocab[p] for p in own.long_merge(parts)] == short


def test_store_round_trip(spark, odd, library):
    path = token_store.new_store(spark)
    rows = odd.unionByName(docs(spark, [(100 + i, "same words again " * 400) for i in range(4)]))
    token_store.write_store(rows, path, BYTE_FILE, 2)
    got = sorted((r for r in token_store.read_store(spark, path).collect()), key=lambda r: r.start)
    table = sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in table]
    start = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        texts = [t.text or "" for t in table if t.doc_id == r.doc_id]
        assert ids in [library[BYTE_FILE].encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(bytes(r.ids)))
        start += len(ids)
    # each distinct chunk is stored once, in files that ascend
    held = [bytes(k) for r in spark.read.parquet(path + "/chunks").collect() for k in r["keys"]]
    assert len(held) == len(set(held))


@pytest.mark.parametrize("ordered", [True, False])
def test_store_of_shared_chunks(spark, monkeypatch, library, ordered):
    """Chunks that hundreds of documents share, in documents of many chunks, by broadcast and by exchange with hot keys."""
    rng = random.Random(31)
    passage = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(300)) for _ in range(6)]
    rows = [(i, " ".join([f"own{i}", *rng.sample(passage, rng.randrange(5)), "x" * rng.randrange(50)])) for i in range(400)]
    rows += [(None, passage[0]), (7, passage[0] + " end")]
    if ordered:
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    else:
        rng.shuffle(rows)
    for limit in (common.BROADCAST_BYTES, -1):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(token_store, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(token_store, "heavy", lambda n: 40)
        path = token_store.new_store(spark)
        table = docs(spark, rows).coalesce(1) if ordered else docs(spark, rows)
        token_store.write_store(table, path, BYTE_FILE, 2)
        assert token_store.in_order(table.select("doc_id")) is ordered
        chunks = spark.read.parquet(path + "/chunks")
        held = [bytes(k) for r in chunks.collect() for k in r["keys"]]
        assert len(held) == len(set(held)) and chunks.where(F.size("lent") > 0).count() > 3
        got = token_store.read_store(spark, path).collect()
        want = sorted((i, tuple(library[BYTE_FILE].encode(t, add_special_tokens=False).ids + [2])) for i, t in rows if i is not None)
        assert sorted((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in got if r.doc_id is not None) == want
        got.sort(key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
        # each file of chunks ascends, and the files' ranges do not overlap
        own = chunks.select("rid", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at")).join(spark.read.parquet(path + "/recipes").select("rid", "ordinal"), "rid").collect()
        by_file = {}
        for r in sorted(own, key=lambda r: r.at):
            by_file.setdefault(r.f, []).append(r.ordinal)
        spans = sorted(by_file.values())
        assert [x for s in spans for x in s] == list(range(len(rows)))


@pytest.mark.parametrize("table, damage", [("chunks", "body"), ("chunks", "row"), ("recipes", "doc_id"), ("recipes", "start"), ("recipes", "n_tokens"), ("recipes", "keys")])
def test_store_tells_damage(spark, table, damage):
    path = token_store.new_store(spark)
    token_store.write_store(docs(spark, [(1, "some text here"), (2, "other")]), path, BYTE_FILE, 2)
    rows = spark.read.parquet(f"{path}/{table}")
    if damage == "body":
        rows = rows.withColumn("bodies", F.transform("bodies", lambda x: F.concat(F.lit(b"\x00\x00"), F.substring(x, 3, 1000))))
    elif damage == "row":
        rows = rows.limit(1)
    elif damage == "keys":
        rows = rows.withColumn("keys", F.reverse(F.transform("keys", F.reverse)))
    else:
        rows = rows.withColumn(damage, F.col(damage) + 1)
    rows.write.parquet(path + "/damaged")
    spark.read.parquet(path + "/damaged").write.mode("overwrite").parquet(f"{path}/{table}")
    with pytest.raises(Exception, match="differs from its|does not match its recipes|missing"):
        token_store.read_store(spark, path).collect()


@pytest.mark.parametrize("damage", ["root", "middle", "missing", "more"])
def test_store_tells_damage_above_the_lowest_level(spark, monkeypatch, damage):
    monkeypatch.setattr(token_store, "FAN", 3)
    path = token_store.new_store(spark)
    token_store.write_store(docs(spark, [(i, f"text {i}") for i in range(20)]), path, BYTE_FILE, 2)
    assert token_store.read_store(spark, path).count() == 20
    held = [tuple(r) for r in token_store.manifest(spark, path).collect()]
    top = max(r[0] for r in held)
    assert top == 2
    level = {"root": top, "middle": 1}.get(damage)
    bad = [(a, n, "0" * 64 if (a, n) == (level, 0) else x) for a, n, x in held if not (damage == "missing" and a == top)] + [(top + 1, 0, "0" * 64)] * (damage == "more")
    spark.createDataFrame(bad, "level int, node long, digest string").write.mode("overwrite").parquet(path + "/manifest")
    with pytest.raises(ValueError, match="does not match its recipes"):
        token_store.read_store(spark, path)


def test_store_of_nothing(spark):
    path = token_store.new_store(spark)
    token_store.write_store(docs(spark, []), path, BYTE_FILE, 2)
    assert token_store.read_store(spark, path).count() == 0


def test_chunks_follow_the_content():
    rng = np.random.default_rng(1)
    cut = lambda ids: token_store.cut_points(ids, np.array([len(ids)])).tolist()
    ids = rng.integers(0, 50_000, 20_000).astype(np.uint16)
    a, b = cut(ids), cut(np.concatenate([rng.integers(0, 9, 77).astype(np.uint16), ids]))
    assert a[-1] == len(ids) and len({x + 77 for x in a} & set(b)) > 0.9 * len(a)
    assert 64 < np.diff(a).mean() < 256
    assert max(np.diff([0, *cut(np.zeros(30_000, np.uint16))])) <= token_store.LARGEST
    # streams end to end are cut as each alone
    ends = np.cumsum([3, 0, 700, 12_000, 1, 7000])
    parts = [cut(ids[x:y]) for x, y in zip([0, *ends], ends) if y > x]
    starts = [x for x, y in zip([0, *ends], ends) if y > x]
    assert token_store.cut_points(ids[: ends[-1]], ends).tolist() == [s + c for s, p in zip(starts, parts) for c in p]


# ---------------------------------------------------------------- quality


def test_quality_on_held_out_rows(spark):
    rng, rows, labels = random.Random(2), [], []
    words = ["".join(rng.choice("aeiouthnsr") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    for i in range(1200):
        good = i % 4 > 0
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))
        kind = i % 3
        rows.append((i, text if good else (text.upper().replace(" ", "!! ") if kind == 0 else text.replace(" ", "%%% ") if kind == 1 else " ".join(w + " " + w for w in text.split()))))
        labels.append((i, int(good)))
    rows += [(5000, None), (5001, ""), (None, "x")]
    labels += [(5000, None), (None, 1), (7777, 0)]
    got = quality.classify(docs(spark, rows), docs(spark, labels, "doc_id long, quality int")).toPandas().set_index("doc_id")
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1200)}
    assert all(bool(got.held_out[i]) == out[i] for i in range(1200))
    held = [i for i in range(1200) if out[i]]
    assert np.mean([got.predicted[i] == (i % 4 > 0) for i in held]) > 0.97


def test_quality_without_labels(spark):
    got = quality.classify(docs(spark, [(1, "a b"), (2, None)]), docs(spark, [], "doc_id long, quality int")).collect()
    assert {r.score for r in got} == {0.5}


def test_quality_of_odd_tables(spark):
    """Nulls, empty and very long texts, repeated ids and rows, labels both ways, columns that are called like the operator's."""
    rows = [(i, ("good words here " if i % 2 else "BAD!! %% ") * (1 + i % 7), "x", 5) for i in range(200)]
    rows += [(300, None, "x", 5), (301, "", "x", 5), (None, "text", "x", 5), (302, "long " * 400_000, "x", 5), (5, "BAD!! %% again", "x", 5), (5, None, "x", 5), (9, rows[9][1], "x", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string, held_out int")
    labels = [(i, i % 2) for i in range(200)] + [(i, i % 2) for i in range(0, 200, 3)] + [(7, 0), (8, None), (None, 1), (999, 1), (11, 4)]
    label_table = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, text int")
    got = quality.classify(table, label_table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id not in (5, 7))
    assert len({r.score for r in got if r.doc_id == 9}) == 1
    scored = quality.score(table, quality.train(table, label_table)).first()
    assert (scored.score, scored.held_out) == ("x", 5) and 0 <= scored.score_ <= 1
    assert quality.classify(table.limit(0), label_table).count() == 0


def test_quality_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, label, totals: seen.append((len(rows), totals, max(map(len, rows), default=0))) or fit(rows, label, totals))
    table = docs(spark, [(1, f"text {i}") for i in range(20_001)] + [(2, "other" * i) for i in range(50)] + [(i, "".join(map(chr, range(32, 2000)))) for i in range(10, 40)])
    quality.train(table, docs(spark, [(1, 1), (2, 0), *((i, 1) for i in range(10, 40))], "doc_id long, quality int"), sample=5)
    ((n, totals, size),) = seen
    assert n <= 10 and size <= 1 + quality.FEATURES // 8 + 1 and sum(totals) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2, *range(10, 40)))
    at = np.unique(np.random.default_rng(1).integers(0, quality.FEATURES, 5000)).astype(np.uint32)
    assert all((quality.unpacked(quality.packed(x)) == x).all() for x in (at, at[:7], at[:0]))


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against projected gradient steps on the dual of a small problem in dense matrices."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 30, rng.integers(1, 9))).astype(np.uint32) for _ in range(60)] + [np.zeros(0, np.uint32)]
    scale, y, top = rng.standard_normal(30), np.where(rng.random(61) < 0.5, 1.0, -1.0), rng.uniform(0.2, 2, 61)
    alpha, w, bias = quality.dual_descent([quality.packed(r) for r in rows], scale, y, top, 3000, 1, 1e-9)
    x = np.zeros((61, 31))
    for i, at in enumerate(rows):
        x[i, at] = scale[at] / max(1e-12, np.linalg.norm(scale[at]))
        x[i, 30] = 1
    q = (x * y[:, None]) @ (x * y[:, None]).T
    value = lambda a: 0.5 * a @ q @ a - a.sum()
    brute = np.zeros(61)
    for _ in range(60_000):
        brute = np.clip(brute - (q @ brute - 1) / np.linalg.norm(q, 2), 0, top)
    assert (alpha >= 0).all() and (alpha <= top).all() and value(alpha) == pytest.approx(value(brute), abs=1e-4)
    assert np.allclose((alpha * y) @ x, [*w, bias])


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(3)
    rows = [np.unique(np.concatenate([rng.integers(0, 500, 20), [600 + y]])).astype(np.uint32) for y in (0, 1) * 100]
    label = np.array((0, 1) * 100)
    model = quality.fit(rows, label, (100, 100))
    assert all((model.score(r) > 0.5) == bool(y) for r, y in zip(rows, label))


# ---------------------------------------------------------------- vectors


def brute_vectors(rows):
    """(id, n_links, component_id) of each row, by all pairs."""
    unit = [np.array(v) / np.abs(v).max() if lab is not None and v and None not in v and np.isfinite(v).all() and any(v) else None for _, v, lab in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    links = [[j for j, y in enumerate(unit) if x is not None and y is not None and i != j and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y >= 0.93] for i, x in enumerate(unit)]
    out = []
    for i, (own, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j), todo.append(j)
        out.append((own, len(links[i]), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)))
    return sorted(out, key=str)


def vector_rows(rng, n, spread=(0, 0.1, 0.25), dim=16, bases=40):
    base = rng.standard_normal((bases, dim))
    return [(i, (base[i % bases] + rng.standard_normal(dim) * rng.choice(spread)).tolist(), int(i % 3)) for i in range(n)]


def test_near_vectors_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = vector_rows(rng, 600)
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None] * 8, 1), (1004, [1.0] * 16, None), (1005, [], 2), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [1e200] * 16, 0), (1009, [1e200] * 16, 0)]
    rows += [(None, rows[4][1], 1), (7, rows[5][1], 2), (7, rows[6][1], 0), (None, [3.0, -1.0], 2), (None, [3.0, -1.0], 2), (None, None, None)]
    table = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, id int, vec string, node int")
    got = near_vectors.near_vectors(table).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("bits", [4, 7, 12, 18])
def test_near_vectors_find_every_link_at_any_number_of_bits(spark, monkeypatch, bits):
    """Links close above the threshold, in tables of as many bits as large labels get, with buckets of several blocks."""
    monkeypatch.setattr(near_vectors, "BLOCK", 32)
    plan = near_vectors.plan
    monkeypatch.setattr(near_vectors, "plan", lambda n, t: plan(near_vectors.BUCKET << bits, t))
    assert near_vectors.plan(9, 0.93)[0] == bits
    rows = [(i, v, 0) for i, v, _ in vector_rows(np.random.default_rng(bits), 500, (0.2, 0.24, 0.27), bases=25)]
    want = brute_vectors(rows)
    assert sum(n for _, n, _ in want) > 500
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want


# ---------------------------------------------------------------- near-duplicate texts


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def test_jaccard_join_brute_force(spark):
    rng, rows = random.Random(6), []
    words = [f"w{k}" for k in range(400)]
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "One two"), (904, "one TWO"), (905, "one two three"), (906, "z " * 30), (907, "z " * 300)]
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(docs(spark, rows + [(None, "no copy")])).collect()}
    assert (lone := got.pop(None)).kept and lone.class_id is None and lone.n_links == 0
    sets = shingle_sets(rows)
    links = {i: {j for j in sets if j != i and a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9} for i, a in sets.items()}
    assert len(got) == len(rows)
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j), todo.append(j)
        assert (got[i].n_links, got[i].class_id, got[i].kept) == (len(links[i]), min(seen), i == min(seen)), i


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, -1])
def test_jaccard_join_of_one_large_group(spark, monkeypatch, limit):
    """In many blocks, and with its rows joined by broadcast and apart."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(common, "heavy", lambda n: 20)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    deal = jaccard_join.deal_blocks
    monkeypatch.setattr(jaccard_join, "deal_blocks", lambda rows, key, size, id_, block=16: deal(rows, key, size, id_, 16))
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(90)]
    got = jaccard_join.jaccard_join(docs(spark, rows)).collect()
    sets = shingle_sets(rows)
    for r in got:
        assert r.class_id == 0 and r.n_links == sum(len(sets[r.doc_id] & s) >= 0.8 * len(sets[r.doc_id] | s) for j, s in sets.items() if j != r.doc_id)
    assert jaccard_join.jaccard_join(docs(spark, [])).count() == 0


def test_jaccard_join_of_repeated_and_null_ids(spark):
    one, two = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(61))
    rows = [(5, one), (5, one), (5, "other words"), (None, two), (9, None), (None, "lost words"), (None, "lost words"), (9, ""), (3, two)]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_join(docs(spark, rows)).collect()), key=str)
    want = [(5, 3, 5, 3, False)] * 2 + [(5, 5, 5, 0, True), (None, 3, 3, 3, False), (9, 9, 9, 0, True), (9, 9, 9, 0, True), (3, 3, 3, 3, True)]
    want += [(None, None, None, 1, True), (None, None, None, 1, False)]
    assert got == sorted(want, key=str)
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, row string, id int")
    kept = jaccard_join.without_copies(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text, r["row"], r.id) for r in kept.collect()), key=str) == sorted([(5, "other words", "x", 7), (9, None, "x", 7), (9, "", "x", 7), (None, "lost words", "x", 7), (3, two, "x", 7)], key=str)


def test_spanning_forest_of_alike_rows():
    rng = np.random.default_rng(8)
    least = jaccard_join.needs(0.8, 1e-6)
    base = rng.integers(0, 256, (9, jaccard_join.HASHES), dtype=np.uint8)
    low = base[rng.integers(0, 9, 120)]
    low[np.arange(120), rng.integers(0, jaccard_join.HASHES, 120)] += 1
    for x, y in ((np.arange(120), None), (np.arange(50), np.arange(50, 120))):
        i, j = np.triu_indices(120, 1) if y is None else (v.ravel() for v in np.meshgrid(x, y, indexing="ij"))
        good = jaccard_join.still_alike(low, i, j, least)
        own = jaccard_join.spanning(low, x, y, least)
        groups = lambda a, b: common.forest(120, np.array(a), np.array(b))
        assert groups(*zip(*own)) == groups(i[good], j[good]) and len(own) == len(groups(i[good], j[good]))
    # what two blocks are joined by, and what each is spanned by, span all: an edge for each tree that is found in both
    x, y = np.arange(50), np.arange(50, 120)
    i, j = np.triu_indices(120, 1)
    good = jaccard_join.still_alike(low, i, j, least)
    between = jaccard_join.joining(low, x, y, least)
    every = [*between, *jaccard_join.spanning(low, x, None, least), *jaccard_join.spanning(low, y, None, least)]
    assert groups(*zip(*every)) == groups(i[good], j[good]) and len(between) <= 9


def test_posterior_bound():
    assert jaccard_join.keep_from(32, 0.8, 1e-6) < 16 < jaccard_join.keep_from(160, 0.8, 1e-6) < 128


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {n: find(n) for n in root}


def test_components_of_a_large_star(spark, monkeypatch):
    """A node with 100,000 links, beyond the size that is broadcast: its edges are joined apart."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    star = spark.range(100_000).select(F.lit(500_000).cast("long").alias("a"), (F.col("id") + 400_000).alias("b"))
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.components(star.unionByName(chain)).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {400_000: 100_001, 0: 41}


def test_hot_keys_are_joined_apart(spark):
    many = spark.range(3000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("key"))
    one = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "key long, v string")
    for how in ("inner", "left"):
        want = sorted(many.join(one, "key", how).collect(), key=str)
        for hot in ([], [(1,)], [(1,), (45,)]):
            assert sorted(common.join_unique(many, one, "key", spark.createDataFrame(hot, "key long"), how).collect(), key=str) == want


def test_tables_in_the_shared_folder(spark):
    import os

    a = common.materialize(spark.range(5), "a")
    path = a.written_to.removeprefix("file://")
    assert os.path.isdir(path) and spark.sparkContext.applicationId in path
    common.discard(a, spark.range(3))
    assert not os.path.exists(path)


# ---------------------------------------------------------------- sharding


def test_shards(spark):
    rng = random.Random(8)
    rows = [(i, "t" * rng.randint(0, 400)) for i in range(3000)] + [(5000 + i, "same text" * 10) for i in range(1500)] + [(None, None), (7, None), (8, "é"), (8, "é")]
    got = sharding.shard(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = np.zeros(16)
    for s in range(16):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
        size[s] = sum(r["size"] for r in got if r.shard == s)
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in got)
    assert size.max() - size.min() < 1000 and {(r.doc_id, r.text) for r in got} == set(rows)
    assert sharding.shard(docs(spark, [])).count() == 0
    assert {r.shard for r in sharding.shard(docs(spark, [(1, "a")])).collect()} <= set(range(16))


def test_equal_rows_and_hot_ids_in_many_cells(spark, monkeypatch):
    """Rows sorted in many cells: exact shares, neighbouring slots for equal texts, no cell with all rows of an id or a text."""
    monkeypatch.setattr(sharding, "CELL_BYTES", 500)
    rng = random.Random(3)
    rows = [(1, "a" * 9)] * 500 + [(None, f"null {i}") for i in range(500)] + [(7, f"seven {i % 250}") for i in range(500)] + [(i, f"own text {rng.randrange(700)}") for i in range(1500)]
    got = sharding.shard(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    by_shard, seen = {}, {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    total = sum(len(t) + 1 for _, t in rows)
    for k, own in by_shard.items():
        own.sort(key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 16) < 40
        for a, b in zip([None, *own], own):
            if a is None or a.text != b.text:
                assert (k, b.text) not in seen
                seen[k, b.text] = 1
    narrow = docs(spark, rows).select(F.xxhash64("text").alias("h1"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("h2"), sharding.text_size(F.col("text")).alias("size"))
    bounds = sharding.splitters(narrow, 16, 0.001, 8)
    held = {r.cell: r for r in sharding.cell_of(narrow, bounds, "cell").groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
    assert max(r.bytes for r in held.values()) < 3 * total / 128
    # splitters against the sorted keys
    keys = sorted(((r.h1 + (1 << 63)) << 64 | (r.h2 + (1 << 63)), r["size"]) for r in narrow.collect())
    for t, bound in enumerate(bounds, 1):
        below = sum(n for k, n in keys if k < bound)
        assert abs(below - total * t / 128) <= (0.5 * total / 128 if t % 8 else 0.001 * total / 16) + 20
        assert sum(r.n for c, r in held.items() if c < t) == sum(k < bound for k, _ in keys)


# ---------------------------------------------------------------- decontamination


def test_leaks(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiouthnsrlm") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    stop = ["the", "of", "and", "to", "in"]
    say = lambda n: [rng.choice(stop) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(10, 60))).capitalize() + ".") for i in range(40)] + [(90, None), (91, ""), (None, "x y z")]
    rows, leaks = [], set()
    for i in range(300):
        text = say(rng.choice([3, 40, 400]))
        if i % 10 == 0:
            k = rng.randrange(40)
            passage = items[k][1].rstrip(".").split()
            if i % 20 == 0:  # a paraphrase: a fifth of the words replaced
                for p in rng.sample(range(len(passage)), len(passage) // 5):
                    passage[p] = rng.choice(words)
            at = rng.randrange(len(text))
            text[at:at] = passage
            leaks.add((i, k))
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert got == leaks
    kept = decontaminate.decontaminate(docs(spark, rows), bench)
    assert kept.count() == len(rows) - len({i for i, _ in leaks})
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_leaks_of_many_passages(spark):
    """More passages than latent dimensions: each verbatim copy is found, whatever share of its vector the dimensions keep."""
    rng = random.Random(19)
    words = ["".join(rng.choice("aeiouthnsrlm") for _ in range(rng.randint(4, 9))) for _ in range(12000)]
    items = [" ".join(rng.choices(words, k=33)) for _ in range(4000)]
    rows, leaks = [], set()
    for i in range(200):
        k = rng.randrange(4000)
        beside = [f"other{rng.randrange(10**6)}" for _ in range(rng.choice([0, 20, 80]))]
        rows.append((i, " ".join(beside[: len(beside) // 2] + items[k].split() + beside[len(beside) // 2 :])))
        leaks.add((i, k))
    rows += [(1000 + i, " ".join(rng.choices(words, k=60))) for i in range(50)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert got == leaks


def test_leaks_among_rare_words(spark):
    """Passages of frequent words, whole and paraphrased, in texts of words that no other document holds, against all windows and passages."""
    rng = random.Random(29)
    words = ["".join(rng.choice("aeiouthnsrlm") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    items = [" ".join(rng.choices(words, k=rng.randint(12, 60))) for _ in range(60)]
    rows = [(10_000 + i, " ".join(rng.choices(words, k=60))) for i in range(200)]
    for i in range(120):
        passage = rng.choice(items).split()
        if i % 2:
            for p in rng.sample(range(len(passage)), len(passage) // 5):
                passage[p] = f"new{i}x{p}"
        around = [f"other{i}x{k}" for k in range(120)]
        rows.append((i, " ".join(around[:60] + passage + around[60:])))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    m = decontaminate.prepare(decontaminate.weights_of(docs(spark, rows)), bench)
    want, weak = set(), 0
    for id_, text in rows:
        word = common.word_hashes(pa.array([text]), common.BY_LETTER)[0]
        weight = m.idf[decontaminate.place(word)].astype(float)
        for k, own in enumerate(m.texts):
            width = int(m.width[k])
            own_weight = {w: n * float(m.idf[decontaminate.place(np.array([w], np.uint64))][0]) for w, n in zip(*np.unique(own, return_counts=True))}
            length = sum(v * v for v in own_weight.values()) ** 0.5
            for lo, hi in zip(*(x.tolist() for x in decontaminate.windows(np.array([0]), np.array([len(word)]), width)[1:])):
                held = word[max(0, lo - width // 4) : hi + width // 4]
                if np.isin(held, own).sum() < decontaminate.COMMON * len(own):
                    continue
                cosine = sum(v * own_weight.get(w, 0) for v, w in zip(weight[lo:hi], word[lo:hi])) / length / (weight[lo:hi] ** 2).sum() ** 0.5
                tail = own[-max(1, -(-len(own) // 4)) :]
                if cosine >= decontaminate.COSINE and decontaminate.common_words(own, held) >= decontaminate.COMMON * len(own) and decontaminate.common_words(tail, held) >= decontaminate.ANSWER * len(tail):
                    want.add((id_, int(m.items[k])))
                    weak += (weight[lo:hi] ** 2)[np.isin(word[lo:hi], own)].sum() < 0.3 * (weight[lo:hi] ** 2).sum()
    assert weak and len(want) > 60
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()} == want


def test_leaks_in_blocks(spark, monkeypatch):
    """A benchmark that is searched for in many blocks, with texts of one to very many words, ties and repeated rows, and other columns."""
    rng = random.Random(39)
    words = ["".join(rng.choice("aeiouthnsrlm") for _ in range(rng.randint(4, 9))) for _ in range(2000)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(50)]
    items += [(7, items[7][1]), (70, items[7][1])]
    far = " ".join(rng.choices(words, k=60_000))
    rows = [(i, items[i][1]) for i in range(20)] + [(3, items[3][1]), (None, items[4][1]), (100, far + " " + items[5][1] + " " + far), (101, items[6][1] + " x " + items[6][1])]
    want = [(i, i) for i in range(20)] + [(7, 70), (None, 4), (100, 5), (101, 6)]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, item_id int, cosine double")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    found = lambda: sorted(((r.doc_id, r.item_id) for r in decontaminate.find_leaks(table, bench).collect()), key=str)
    whole = found()
    assert sorted(set(whole), key=str) == sorted(set(want), key=str)
    assert next(r.at_word for r in decontaminate.find_leaks(table, bench).collect() if r.doc_id == 100) in range(59_960, 60_001)
    monkeypatch.setattr(decontaminate, "PASSAGES", 9)
    assert len(decontaminate.blocks(bench.select("item_id", "text"))) == 6
    assert sorted(set(found()), key=str) == sorted(set(want), key=str)
    kept = decontaminate.decontaminate(table, bench)
    assert kept.columns == table.columns and kept.count() == 0


@pytest.mark.parametrize("share, least", [(0.1, 0.99), (0.2, 0.98), (0.3, 0.95), (0.35, 0.95), (0.4, 0.95)])
def test_leaks_by_share_of_replaced_words(spark, sf, share, least):
    """Paraphrases planted in the documents: of those that meet the rule (words in order, answer) somewhere in the document, found by any cosine."""
    rng = random.Random(int(share * 100))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and len(r.text.split()) > 30]
    items = [(r.item_id, r.text) for r in bench.collect()]
    words = [w for _, t in texts for w in t.split()]
    planted, rows = {}, []
    for k in range(160):
        item, passage = items[k % len(items)]
        own = passage.split()
        for p in rng.sample(range(len(own)), int(len(own) * share)):
            own[p] = rng.choice(words)
        doc = rng.choice(texts)[1].split()
        at = rng.randrange(len(doc))
        rows.append((k, " ".join(doc[:at] + own + doc[at:])))
        planted[k] = item
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    hashed = {i: common.word_hashes(pa.array([t]), common.BY_LETTER)[0] for i, t in items}
    due = []
    for k, text in rows:
        own, word = hashed[planted[k]], common.word_hashes(pa.array([text]), common.BY_LETTER)[0]
        tail, span = own[-max(1, -(-len(own) // 4)) :], len(own)
        near = [word[a : a + span + span // 4] for a in range(0, max(1, len(word) - span // 2), max(1, span // 8))]
        if any(decontaminate.common_words(own, x) >= decontaminate.COMMON * len(own) and decontaminate.common_words(tail, x) >= decontaminate.ANSWER * len(tail) for x in near):
            due.append((k, planted[k]))
    assert len(due) > 100 and sum(x in got for x in due) >= least * len(due), (len(due), sum(x in got for x in due))


def test_common_words_equals_dynamic_programming():
    rng = np.random.default_rng(10)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 20)).astype(np.uint64)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_words(a, b) == t[-1, -1]


# ---------------------------------------------------------------- personal data and secrets


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def base_pii(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 14 <= len(s := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(s)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


PII_TEXTS = [
    None, "", "a@b.c%d@e.f @x.y a@b a@b.c.d@e.f ü@b.de", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 1 2", "4111  1111 1111 1111",
    "+1 (415) 555-0100. +49 30 1234567 +1 2 +1234567890123456", "card 😀 4111 1111 1111 1111, mail me@x.org", "1 " * 30_000, "a" * 60_000 + "@", "7" * 40_000, "x@" * 20_000, "+1" + "-" * 50_000, "1." * 30_000,
    "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432, bad GB82WEST12345698765431",
]


def test_pii_brute_force(spark):
    rng = random.Random(11)
    texts = PII_TEXTS + ["".join(rng.choice("ab1234567890.@+-% ()Ü") for _ in range(rng.randint(0, 80))) for _ in range(600)]
    got = {r.doc_id: r for r in pii.pii_digest(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = base_pii(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [want.count(k + ":") for k in pii.BASE_KINDS]
    assert got[14].spans.count("iban:") == 2 and got[7].top_score > 0.7


def test_pii_of_very_many_matches(spark):
    """The time follows the text: 200,000 matches of one kind in one text, and of several kinds."""
    texts = ["1.1.1.1 " * 200_000, "a@b.c, 1.2.3.4, +1234567890, 4111111111111111, " * 20_000]
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.pii_digest(docs(spark, list(enumerate(texts)))).collect()}
    assert time.monotonic() - began < 60
    assert got[0].n_ip == 200_000 and got[0].spans.endswith(f"ip:{8 * 199_999}:{8 * 200_000 - 1}")
    assert [got[1][f"n_{k}"] for k in pii.BASE_KINDS] == [20_000] * 4
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(base_pii(t).encode()).hexdigest()
    assert pii.redact(docs(spark, [(1, texts[1])])).first().text.startswith("[email], [ip], [phone], [card], [email]")


def test_pii_context_words(spark):
    texts = ["bitte per Telefon +49 30 12345678", "x" * 30 + " +49 30 12345678", "llame al móvil: +34 912 345 678", "phone" + " " * 43 + "+49 30 12345678", "phone" + " " * 44 + "+49 30 12345678", "phone 1.1.1.1 +49 30 12345678", "call +1 2 +1 2 x +49 30 12345678"]
    got = {r.doc_id: [x.score for x in r.pii if x.kind == "phone"] for r in pii.find_pii(docs(spark, list(enumerate(texts)))).collect()}
    assert [round(got[i][0], 3) for i in range(len(texts))] == [0.7, 0.6, 0.7, 0.7, 0.6, 0.7, 0.7]


def test_pii_redaction(spark):
    rows = spark.createDataFrame([(1, "mail a@b.co now", "x"), (2, None, "y")], "doc_id int, text string, pii string")
    got = pii.redact(rows).orderBy("doc_id").collect()
    assert [(r.text, r.pii) for r in got] == [("mail [email] now", "x"), (None, "y")]
    assert pii.redact(docs(spark, [(1, "+1 415 555 0100, 4111 1111 1111 1111, 1.2.3.4 9.9.9.999 x")])).first().text == "[phone], [card], [ip] 9.9.9.999 x"
    assert pii.pii_digest(docs(spark, [])).count() == 0


def base_secrets(x):
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(pattern, x, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 32]
    return ",".join(f"{secrets_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_brute_force(spark):
    rng = random.Random(12)
    bits = ["password", "TOKEN", "api_key", "apikey", "Secret", "=", ": ", "'", '"', "AKIA", "ABCDEF123456", "deadbeef" * 5, "abc", "x9", " ", "\n", "Ü", "ſecret", "toKen", "a" * 40]
    texts = [None, "", "token=secret=abcdefgh", "pwd = Tr0ub4dor&3xyz", "password: password123", "f" * 200_000, "token=" + "a" * 100_000] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    got = {r.doc_id: r for r in secrets_scan.secrets_digest(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = base_secrets(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in secrets_scan.BASE_KINDS] == [want.count(k + ":") for k in secrets_scan.BASE_KINDS]
    assert got[3].spans == "guess:6:20"
    assert secrets_scan.secrets_digest(docs(spark, [])).count() == 0


def test_guess_cost_with_a_vocabulary(spark):
    more = secrets_scan.vocabulary_words(WORD_FILE)
    words = secrets_scan.Words(more)
    assert len(more) > 20_000 and more.index("the") < more.index("house") < 20_000
    cost = secrets_scan.guess_cost
    assert cost("gardenhouse", words) < 8 < cost("gardenhouse") and cost("correcthorsebattery", words) < cost("xk3vq9wzt", words) + 3
    table = docs(spark, [(1, "pass: gardenhouse"), (2, "pass: gT5#kq9!Zw")])
    assert [r.spans for r in secrets_scan.secrets_digest(table).orderBy("doc_id").collect()] == ["guess:6:17", "guess:6:16"]
    assert [r.spans for r in secrets_scan.secrets_digest(table, more_words=more).orderBy("doc_id").collect()] == ["", "guess:6:16"]


def test_guess_cost():
    cost = secrets_scan.guess_cost
    assert cost("") == 0 and cost("password") < 1 < cost("password1987") < cost("gT5#kq9!Zw")
    assert cost("aaaaaaaaaaaa") < cost("qwertyuiop") + 3 < cost("x7Kp2Lq9") and cost("2024-01-31") < 6
    for value in ("abcpassword1999", "qqqq12345", "Tr0ub4dor", "x1"):
        spans, n = list(secrets_scan.spans_of(value)), len(value)
        brute, more = np.log10(secrets_scan.alphabet(value)), np.log10(2)

        def best(i, first=True):
            if i == n:
                return 0.0
            extra = 0 if first else more
            choices = [extra + c + best(j, False) for a, j, c in spans if a == i]
            choices += [extra + brute * (j - i) + best(j, False) for j in range(i + 1, n + 1)]
            return min(choices)

        assert cost(value) == pytest.approx(best(0), abs=1e-9)


# ---------------------------------------------------------------- lines


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, -1])
def test_line_dedup(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(line_dedup, "heavy", lambda n: 20)
    rows = [(i, "h", f"menu\nown line {i}\n\n footer \n") for i in range(20)] + [(30, "h", None), (31, "h", ""), (32, None, "menu\nx"), (33, "k", "menu"), (34, "k", "menu\ny")]
    rows += [(40 + i, "h", "copied page\nof one text") for i in range(30)]
    rows += [(80 + i, None, f"top\nlast {i}") for i in range(5)] + [(90, "h", "menu\n" * 3000 + "end")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.line_dedup(table).collect()}
    assert got[3].text == "own line 3\n\n" and (got[3].n_lines, got[3].n_lines_, got[3].n_dropped) == (1, 5, 2)
    assert got[30].text is None and got[31].text == "" and got[32].text == "menu\nx" and got[33].text == "menu"
    assert got[45].text == "copied page\nof one text"  # copies are one page
    assert got[82].text == "last 2" and (got[90].text, got[90].n_dropped) == ("end", 3000)
    assert len(got) == len(rows) and line_dedup.line_dedup(table.limit(0)).count() == 0


def test_clashing_columns(spark):
    """Extra columns that are called like the operators' own pass unharmed."""
    names = ["h1", "h2", "row", "of", "host", "lines", "split", "good", "gone", "base", "cell", "id", "rid", "kind", "size_", "score"]
    rows = spark.createDataFrame([(i, "h", f"some text number {i}\nmenu", *range(len(names))) for i in range(30)], ["doc_id", "source", "text", *names])
    taken = spark.createDataFrame([(1, "a\nb", "h", 7, 8, 9, 10, 11, 12)], "doc_id int, text string, source string, size int, shard int, slot int, pii int, n_lines int, n_dropped int")
    assert sharding.shard(taken).first().asDict() | {"size_": 4, "shard_": 15} == sharding.shard(taken).first().asDict() | {"shard_": 15}
    for out in (sharding.shard(taken), pii.find_pii(taken), line_dedup.line_dedup(taken)):
        assert [out.first()[c] for c in taken.columns] == list(taken.first())
    for out in (sharding.shard(rows), line_dedup.line_dedup(rows), pii.find_pii(rows), bpe.encode(rows, WORD_FILE), common.without(rows, rows.where("doc_id < 3").select("doc_id"), "doc_id")):
        got = out.where("doc_id = 7").first()
        assert [got[n] for n in names] == list(range(len(names)))
    for out in (jaccard_join.jaccard_join(rows), bpe.round_trip(rows, WORD_FILE), secrets_scan.secrets_digest(rows), pii.pii_digest(rows)):
        assert out.count() == 30


def test_word_hashes_are_local():
    import pyarrow as pa

    a = common.word_hashes(pa.array(["Ab c", None, "", "ab C d"]))
    assert a[1].tolist() == [0, 0, 3, 3, 3] and a[0][0] == a[0][2] and a[0][1] == a[0][3] and len(set(a[0].tolist())) == 3
    long = "word " * (common.SLICE_BYTES // 4)
    assert len(set(common.word_hashes(pa.array([long]))[0].tolist())) == 1
