"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, distributed components.

Equal vectors of a label are collapsed first. The bits of a table follow the size of the largest label, the
number of tables follows from the bits and the wanted chance to miss a link. Only ids and sign bits travel through
the tables; members of a bucket that have a partner with few enough differing bits fetch their vectors, and their
cosines are computed in blocks inside tasks. A pair counts in the first table that holds both, so no pair is emitted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, deal_blocks, discard, edges, fixed, forest, join_counted, materialize, runs

#: Wanted members of a bucket; chance to miss a link at the very threshold, for the tables and for the bits' comparison.
BUCKET, MISS, MISS_BITS = 64, 1e-5, 1e-6
#: Rows of one block of a bucket; least bits that are compared.
BLOCK, LEAST_BITS = 1024, 256


def plan(largest: int, threshold: float) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, largest) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same)))


def most_differing(bits: int, threshold: float) -> int:
    """Least number of differing bits that a link at the threshold exceeds with a chance under ``MISS_BITS`` only."""
    p, below = math.acos(threshold) / math.pi, 0.0
    for k in range(bits + 1):
        below += math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log(1 - p)) if p else 1.0
        if below >= 1 - MISS_BITS:
            return k
    return bits


def planes(dim: int, count: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([dim, 97])).standard_normal((count, dim))


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of length one, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes_of(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The code of each table, a column each, of rows of packed sign bits."""
    each = np.unpackbits(signs, axis=1, count=bits * tables, bitorder="little").reshape(len(signs), tables, bits)
    return (each.astype(np.int64) << np.arange(bits)).sum(2)


def first_here(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
    """Which pairs of rows share no table before this one."""
    left = np.arange(len(i))
    for e in range(table):
        if not len(left):
            break
        left = left[codes[i[left], e] != codes[j[left], e]]
    return left


def sides(blk: np.ndarray, bi: int, bj: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a dealt group; the same rows twice where it is one block."""
    p = np.arange(len(blk)) if bi == bj else np.flatnonzero(blk == bi)
    return p, p if bi == bj else np.flatnonzero(blk == bj)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row of ``rows``.

    Vectors are linked if their labels are equal and not null and their cosine is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of other lengths,
    link with nothing. ``n_links`` counts the other rows linked directly, ``component_id`` is the least id
    reachable, ``kept`` whether it is the row's own. Rows that repeat an id are vectors of their own. A null id
    is never the least; a component of null ids alone has a null component and stays. Other columns are ignored.
    """
    good = (
        F.col("label").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.col(label_col).alias("label"))
    every = every.select("id", "vec", F.when(good, F.xxhash64("label", F.size("vec"))).alias("kind"))
    classes = every.where("kind IS NOT NULL").groupBy("kind", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    largest = classes.groupBy("kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan(largest, threshold)
    every_bit = -(-max(bits * tables, LEAST_BITS) // 64) * 64
    most = most_differing(every_bit, threshold)

    def hashed(batches):
        for batch in batches:
            size = np.array([len(v) for v in batch.column("vec")])
            for dim in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == dim)))
                signs = np.packbits(unit(part.column("vec")) @ planes(int(dim), every_bit).T > 0, axis=1, bitorder="little")
                off = pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("kind"), pa.ListArray.from_arrays(off, pa.array(codes_of(signs, bits, tables).ravel())), pa.array([r.tobytes() for r in signs], pa.binary())], names=["id", "kind", "codes", "signs"])

    coded = materialize(classes.select("node", "kind", "vec").mapInArrow(hashed, "id long, kind long, codes array<long>, signs binary"), "codes")
    places = coded.select("id", "signs", "kind", F.posexplode("codes").alias("tab", "code")).select("tab", F.xxhash64("kind", "tab", "code").alias("bucket"), "id", "signs")
    key = ["tab", "bucket", "bi", "bj"]

    def groups(part: pa.RecordBatch):
        """(first row, row after the last, table, rows of one side, rows of the other) of each group of two rows or more on its sides."""
        blk, tab, bi, bj = (part.column(k).to_numpy(zero_copy_only=False) for k in ("blk", "tab", "bi", "bj"))
        cut = [*edges(part, key).tolist(), part.num_rows]
        for at, to in zip(cut[:-1], cut[1:]):
            p, q = sides(blk[at:to], bi[at], bj[at])
            if len(p) and len(q) and to - at > 1:
                yield at, to, int(tab[at]), p, q

    def alike(batches):
        for part in runs(batches, key):
            signs = fixed(part.column("signs"), np.uint8, every_bit // 8)
            words = signs.view(np.uint64)
            hit = np.zeros(part.num_rows, bool)
            for at, to, t, p, q in groups(part):
                w, apart = words[at:to], np.zeros((len(p), len(q)), np.uint16)
                for k in range(words.shape[1]):
                    apart += np.bitwise_count(w[p, k][:, None] ^ w[q, k][None, :])
                i, j = np.nonzero(apart <= most)
                i, j = p[i], q[j]
                i, j = i[i != j], j[i != j]
                if len(i) and t:
                    new = first_here(codes_of(signs[at:to], bits, t), i, j, t)
                    i, j = i[new], j[new]
                hit[at + i] = hit[at + j] = True
            if hit.any():
                yield part.filter(pa.array(hit)).select(["tab", "bucket", "id"])

    sizes = places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    found = deal_blocks(places.join(sizes, "bucket"), ["tab", "bucket"], "size", "id", BLOCK).mapInArrow(alike, "tab int, bucket long, id long")
    found = materialize(found.distinct(), "alike")
    sizes = found.groupBy("bucket").agg(F.count("*").alias("size"))
    fetched = classes.select(F.col("node").alias("id"), "copies", "vec").join(coded.select("id", "signs"), "id")
    members = found.join(sizes, "bucket").join(fetched, "id").select("tab", "bucket", "size", "id", "copies", "signs", "vec")

    def compared(batches):
        for part in runs(batches, key):
            ids, copies = (part.column(k).to_numpy(zero_copy_only=False) for k in ("id", "copies"))
            signs = fixed(part.column("signs"), np.uint8, every_bit // 8)
            a, b, links = [], [], []
            for at, to, t, p, q in groups(part):
                n, x = to - at, unit(part.column("vec").slice(at, to - at))
                i, j = np.nonzero(x[p] @ x[q].T >= threshold)
                if p is q:
                    i, j = i[i < j], j[i < j]
                i, j = p[i], q[j]
                if len(i) and t:  # those that an earlier table holds together were counted there
                    new = first_here(codes_of(signs[at:to], bits, t), i, j, t)
                    i, j = i[new], j[new]
                if not len(i):
                    continue
                more = np.bincount(i, copies[at:to][j], n) + np.bincount(j, copies[at:to][i], n)
                for r in np.flatnonzero(more):
                    a.append(int(ids[at + r])), b.append(None), links.append(int(more[r]))
                for r, s in forest(n, i, j):
                    a.append(int(ids[at + r])), b.append(int(ids[at + s])), links.append(0)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    checked = materialize(deal_blocks(members, ["tab", "bucket"], "size", "id", BLOCK).mapInArrow(compared, "a long, b long, links long"), "links")
    discard(coded, found)
    joined = components(checked.where("b IS NOT NULL").select("a", "b"))
    counts = checked.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    of_class = (
        classes.join(joined, "node", "left")
        .join(counts.withColumnRenamed("a", "node"), "node", "left")
        .select("kind", "vec", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    # a class alone is its own least
    of_class = materialize(of_class, "joined")
    least = materialize(of_class.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where("n > 1"), "least")
    of_class = join_counted(of_class, least, "component", "n", 48, "left").select("kind", "vec", F.coalesce("component_id", "least").alias("component_id"), "n_links")
    discard(classes, checked)
    linked = every.where("kind IS NOT NULL").join(of_class, ["kind", "vec"]).select("id", "n_links", "component_id")
    alone = every.where("kind IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
