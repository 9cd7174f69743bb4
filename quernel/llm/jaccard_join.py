"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles (five words). Texts with the same set form one class and are collapsed
before anything is compared. Classes that share a band of MinHash values are candidates; their MinHash
values are compared a chunk at a time, and a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below ``tolerance`` (uniform prior). What is left of a bucket is
spanned by a forest; inside the groups that these forests join, the rest is verified exactly.

No pair of a group is ever emitted: blocks of pairs are compared inside a task, which emits a count for
each class and the edges of a spanning forest.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, deal_blocks, discard, edges, fixed, forest, join_counted, map_text, materialize, mix, runs, shingles, unused, without

BAND, BANDS = 5, 32
HASHES = BAND * BANDS
#: MinHash values compared at a time; the low bytes of all values travel with the bands.
CHUNK = 32
#: Members of a block; buckets of up to so many members are compared many at a time.
BLOCK, FEW = 512, 12

_RNG = np.random.Generator(np.random.PCG64(20240501))
_MUL = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets of 64-bit hashes, a row each."""
    out = np.empty((len(sets), HASHES), np.uint32)
    if not sets:
        return out
    every = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets[:-1])])
    step = 1 << 16
    for j in range(HASHES):
        if len(every) <= step:
            out[:, j] = np.minimum.reduceat(((every * _MUL[j] + _ADD[j]) >> np.uint64(32)), start)
        else:
            value = np.empty(len(every), np.uint32)
            for a in range(0, len(every), step):
                value[a : a + step] = (every[a : a + step] * _MUL[j] + _ADD[j]) >> np.uint64(32)
            out[:, j] = np.minimum.reduceat(value, start)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    key = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(BAND):
        key = key * np.uint64(0xD6E8FEB86659FD93) + sig[:, j::BAND].astype(np.uint64)
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def keep_from(n: int, threshold: float, tolerance: float) -> int:
    """Least number of equal values among n with P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at the threshold is
    the chance of at most m successes in n + 1 trials.
    """
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n + 1


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(row, id, fp_hi, fp_lo, sig binary, bands array<long>) of each text; without a shingle the last four are null.

    ``row`` numbers the rows of the input as its files and their order say.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(part.column("text"), width)
        full = np.array([len(s) > 0 for s in sets], bool)
        sets = [s for s in sets if len(s)]
        sig = signature(sets)
        fp = fingerprints(sets)
        keys = band_keys(sig).view(np.int64)
        at = np.where(full, np.cumsum(full) - 1, 0)
        of_full = lambda values: values.take(pa.array(at, mask=~full))
        return pa.RecordBatch.from_arrays(
            [
                part.column("row"),
                part.column("id"),
                of_full(pa.array(fp[:, 0].copy())),
                of_full(pa.array(fp[:, 1].copy())),
                of_full(pa.array([r.tobytes() for r in sig], pa.binary())),
                of_full(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))),
            ],
            names=["row", "id", "fp_hi", "fp_lo", "sig", "bands"],
        )

    return map_text(numbered(docs, id_col, text_col), "text", run, "row long, id long, fp_hi long, fp_lo long, sig binary, bands array<bigint>")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two integers."""
    return np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)


def needs(threshold: float, tolerance: float) -> dict[int, int]:
    """Equal values that a pair must have after each chunk. Low bytes agree by chance as well, which only keeps pairs longer."""
    return {n: keep_from(n, threshold, tolerance) for n in range(CHUNK, HASHES + 1, CHUNK)}


def still_alike(low: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs of rows (a, b) survive all chunks of values, compared a chunk at a time."""
    left, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, need in least.items():
        step = slice(n - CHUNK, n)
        equal = equal + np.count_nonzero(low[a[left], step] == low[b[left], step], axis=1)
        good = equal >= need
        left, equal = left[good], equal[good]
    return left


def spanning(low: np.ndarray, x: np.ndarray, y: np.ndarray | None, least: dict[int, int]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the alike pairs among rows x, or between rows x and rows y.

    Each row that is reached is compared with the rows that are not reached yet: a group of copies takes one
    comparison a member, not one a pair.
    """
    out = []
    free = [x, x if y is None else y]
    while len(free[0]):
        todo = [(0, free[0][0])]
        free[0] = free[0][1:]
        while todo:
            side, row = todo.pop()
            other = 0 if y is None else 1 - side
            hit = np.zeros(len(free[other]), bool)
            hit[still_alike(low, np.full(len(hit), row), free[other], least)] = True
            for r in free[other][hit].tolist():
                out.append((int(row), r))
                todo.append((other, r))
            free[other] = free[other][~hit]
    return out


def joining(low: np.ndarray, x: np.ndarray, y: np.ndarray, least: dict[int, int]) -> list[tuple[int, int]]:
    """Edges between rows x and rows y that join what the alike pairs among x, and among y, leave apart: these are spanned elsewhere."""
    every = np.concatenate([x, y])
    own = [*spanning(low, x, None, least), *spanning(low, y, None, least)]
    place = {r: i for i, r in enumerate(every.tolist())}
    root = np.arange(len(every))
    if own:
        for r, s in forest(len(every), *(np.array([place[e[k]] for e in own]) for k in (0, 1))):
            root[s] = r
    root, out = root.tolist(), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in spanning(low, x, y, least):
        i, j = find(place[a]), find(place[b])
        if i != j:
            root[max(i, j)] = min(i, j)
            out.append((a, b))
    return out


def alike_in_bands(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) that span what survives the comparison of all values in each bucket of a band."""
    least = needs(threshold, tolerance)
    key = ["band", "bucket", "bi", "bj"]

    def run(batches):
        for part in runs(batches, key):
            ids, blk, bi, bj = (part.column(k).to_numpy(zero_copy_only=False) for k in ("id", "blk", "bi", "bj"))
            low = fixed(part.column("low"), np.uint8, HASHES)
            cut = np.append(edges(part, key), part.num_rows)
            first, size = cut[:-1], np.diff(cut)
            a, b = [], []
            for n in range(2, FEW + 1):  # all pairs of the small buckets at once
                at = first[size == n]
                i, j = (at[:, None] + k for k in np.triu_indices(n, 1))
                i, j = i.ravel(), j.ravel()
                apart = (bi[i] == bj[i]) | (blk[i] != blk[j])
                i, j = i[apart], j[apart]
                good = still_alike(low, i, j, least)
                for r, s in forest(part.num_rows, i[good], j[good]) if n > 2 and len(good) else zip(i[good].tolist(), j[good].tolist()):
                    a.append(r), b.append(s)
            for at, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
                rows = np.arange(at, at + n)
                of = blk[rows]
                found = spanning(low, rows, None, least) if bi[at] == bj[at] else joining(low, rows[of == bi[at]], rows[of == bj[at]], least)
                for r, s in found:
                    a.append(r), b.append(s)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return deal_blocks(members, ["band", "bucket"], "size", "id").mapInArrow(run, "a long, b long")


def common_shingles(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[x[i]] and sets[y[j]], by one matrix product where there are many."""
    if len(i) <= 4 * (len(x) + len(y)):
        return np.array([len(np.intersect1d(sets[x[p]], sets[y[q]], assume_unique=True)) for p, q in zip(i, j)], np.int64)
    own = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(own, return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(x), len(y)), np.float64)
    step = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        p, q = np.searchsorted(col, [lo, lo + step])
        m = np.zeros((len(sets), step), np.float32)
        m[row[p:q], col[p:q] - lo] = 1
        total += m[x] @ m[y].T
    return np.rint(total[i, j]).astype(np.int64)


def verify(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Rows (a, b, links): a link of the spanning forest where b is set, else a count of texts linked to class a."""
    least = needs(threshold, tolerance)
    key = ["component", "bi", "bj"]

    def linked(sig, count, sets, x, y, within):
        if len(x) == 1 and len(y) == 1 and not within:
            i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        elif within:
            i, j = np.triu_indices(len(x), 1)
        else:
            i, j = (v.ravel() for v in np.indices((len(x), len(y))))
        # the smaller set must hold at least the threshold of the larger
        small, large = np.minimum(count[x[i]], count[y[j]]), np.maximum(count[x[i]], count[y[j]])
        ok = small >= threshold * large - 1e-9
        i, j = i[ok], j[ok]
        equal = np.zeros(len(i), np.int32)
        for lo in range(0, HASHES, CHUNK):
            for c in range(lo, lo + CHUNK):
                equal += sig[x[i], c] == sig[y[j], c]
            ok = equal >= least[lo + CHUNK]
            i, j, equal = i[ok], j[ok], equal[ok]
        both = common_shingles(sets, x, y, i, j)
        ok = both >= threshold * (count[x[i]] + count[y[j]] - both) - 1e-9
        return i[ok], j[ok]

    def run(batches):
        for part in runs(batches, key):
            ids = part.column("id").to_numpy(zero_copy_only=False)
            copies = part.column("copies").to_numpy(zero_copy_only=False)
            blk = part.column("blk").to_numpy(zero_copy_only=False)
            bi, bj = (part.column(k).to_numpy(zero_copy_only=False) for k in ("bi", "bj"))
            every = fixed(part.column("sig"), np.uint32, HASHES)
            cut = np.append(edges(part, key), part.num_rows)
            a, b, links = [], [], []
            for at, to in zip(cut[:-1], cut[1:]):
                n = to - at
                own, within = blk[at:to], bi[at] == bj[at]
                x = np.arange(n) if within else np.flatnonzero(own == bi[at])
                y = x if within else np.flatnonzero(own == bj[at])
                if not len(x) or not len(y):
                    continue
                sets = [np.frombuffer(part.column("shingles")[r].as_py(), np.uint64) for r in range(at, to)]
                count = np.array([len(s) for s in sets])
                i, j = linked(every[at:to], count, sets, x, y, within)
                if not len(i):
                    continue
                p, q, c = x[i], y[j], copies[at:to]
                more = np.bincount(p, c[q], n) + np.bincount(q, c[p], n)
                for r in np.flatnonzero(more):
                    a.append(int(ids[at + r])), b.append(None), links.append(int(more[r]))
                for r, s in forest(n, p, q):
                    a.append(int(ids[at + r])), b.append(int(ids[at + s])), links.append(0)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    return deal_blocks(members, ["component"], "size", "id", BLOCK).mapInArrow(run, "a long, b long, links long")


def classes_of_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """(row, id, class_id, copy_of, n_links, kept) of each row, ``row`` its number by the input's files and their order.

    See ``jaccard_join``. ``docs`` must read alike each time, as files do; it is an error if it does not.
    """
    rows = materialize(sketch(docs, id_col, text_col, width), "sketch")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    own = rows.where("sig IS NOT NULL").groupBy("fp_hi", "fp_lo").agg(least.alias("first"), F.count("*").alias("copies"), F.first(F.struct("sig", "bands")).alias("own"))
    classes = materialize(own.select(F.monotonically_increasing_id().alias("node"), "fp_hi", "fp_lo", "first", "copies", "own.sig", "own.bands"), "classes")

    keys = classes.select(F.col("node").alias("id"), F.posexplode("bands").alias("band", "bucket"))
    full = materialize(keys.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    busy = materialize(keys.join(full, ["band", "bucket"]), "candidates")
    low = low_bytes(classes.join(busy.select(F.col("id").alias("node")).distinct(), "node", "left_semi"))
    coarse = components(alike_in_bands(busy.join(low, "id"), threshold, tolerance))
    coarse = materialize(coarse, "coarse")
    sizes = materialize(coarse.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    coarse = join_counted(coarse, sizes, "component", "size")
    discard(full, busy)

    wanted = coarse.join(classes.select("node", "first.row", "copies", "sig", "fp_hi", "fp_lo"), "node")
    sets = text_sets(numbered(docs, id_col, text_col).join(coarse.join(classes, "node").select("first.row"), "row", "left_semi"), width)
    same = F.col("fp_hi").eqNullSafe(F.col("hi")) & F.col("fp_lo").eqNullSafe(F.col("lo"))
    members = wanted.join(sets, "row", "left").select(
        F.col("node").alias("id"), "component", "size", "copies", "sig", F.when(same, F.col("shingles")).otherwise(F.raise_error(F.lit("the documents were read in another order the second time"))).alias("shingles")
    )
    checked = materialize(verify(members, threshold, tolerance), "verified")
    joined = components(checked.where("b IS NOT NULL").select("a", "b"))
    counts = checked.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))

    of_class = (
        classes.select("fp_hi", "fp_lo", "node", "first", "copies")
        .join(joined, "node", "left")
        .join(counts.withColumnRenamed("a", "node"), "node", "left")
        .select("fp_hi", "fp_lo", "first", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    # a class alone is its own least
    of_class = materialize(of_class, "joined")
    least = materialize(of_class.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1"), "least")
    of_class = join_counted(of_class, least, "component", "n", 96, "left").select("fp_hi", "fp_lo", "first", F.coalesce("least", "first").alias("least"), "n_links")
    discard(classes, checked)
    out = rows.select("row", "id", "fp_hi", "fp_lo").join(of_class, ["fp_hi", "fp_lo"], "left")
    alone = F.col("first").isNull()
    return out.select(
        "row",
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("row") == F.col("least.row"))).alias("kept"),
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """Near-duplicate classes of texts: (id, class_id, copy_of, n_links, kept), one row for each row of ``docs``.

    Two texts are linked if the Jaccard similarity of their sets of lower-case, white-space separated word
    5-grams is at least ``threshold``. ``class_id`` is the least id reachable by links, ``copy_of`` the least id
    with the very same set, ``n_links`` the number of other rows linked directly, ``kept`` whether the row is the
    one of its class that stays: that of the least id, among equal ids the first. Texts of one to four words are
    compared as one shingle. Null, empty and blank texts link with nothing (class of their own, no links, kept).
    Rows that repeat an id are rows of their own; null ids rank last, and are the class id only where no row
    of the class has an id. The id is any integer column; other columns are ignored.
    """
    return classes_of_rows(docs, id_col, text_col, threshold, width, tolerance).drop("row").withColumnRenamed("id", id_col)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without those that are not ``kept``: one row of each class stays, with all its columns."""
    name = unused("row", docs)
    gone = classes_of_rows(docs, id_col, text_col, threshold, width).where(~F.col("kept")).select("row")
    return without(docs.withColumn(name, F.monotonically_increasing_id()), gone, name).drop(name)


def low_bytes(classes: DataFrame) -> DataFrame:
    """(id, low): the low byte of each MinHash value."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                low = fixed(batch.column("sig"), np.uint32, HASHES).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in low], pa.binary())], names=["id", "low"])

    return classes.select(F.col("node").alias("id"), "sig").mapInArrow(run, "id long, low binary")


def text_sets(texts: DataFrame, width: int) -> DataFrame:
    """(row, hi, lo, shingles binary) of texts: their fingerprint and their shingles."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(part.column("text"), width)
        fp = fingerprints(sets)
        return pa.RecordBatch.from_arrays([part.column("row"), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["row", "hi", "lo", "shingles"])

    return map_text(texts.select("row", "text"), "text", run, "row long, hi long, lo long, shingles binary")
