"""Exact top-k inner products by aggregation of sorted lists without random access.

Vectors are dealt into segments of similar ones. A segment keeps a sorted list of each dimension; a query reads all of them
sequentially from the end that its sign favours, holds a lower and an upper bound of the score of every vector, and stops
when the upper bound of all but a few is below the k-th best score known; the scores of those few are then resolved exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, runs

#: Vectors of a segment; queries that a task holds at once; segments that a task reads one after the other for them.
SEGMENT, QUERIES, LANE = 2048, 4096, 4
#: Signs of so many components put a vector into a cell; segments are cut from cells in order.
SIGNS = 16
#: Entries of each list that are read first; each later reading doubles them.
FIRST = 16
#: Beyond this, sums in floating point are no longer exact.
EXACT = float(1 << 52)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * component) of the vectors that are not null and hold no null or non-finite component."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", odd))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def segments(vectors: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(seg, id, v): rows dealt into segments of at most ``size``, rows of equal signs and then of near ids together."""
    vectors = materialize(vectors, "vectors")
    cell = F.aggregate(F.slice("v", 1, SIGNS), F.lit(0), lambda code, x: code * 2 + (x > 0).cast("int"))
    dealt = vectors.withColumn("cell", cell).repartitionByRange(max(1, vectors.count() // size), "cell", "id", F.xxhash64("v"))
    dealt = dealt.sortWithinPartitions("cell", "id", F.xxhash64("v")).withColumn("at", F.monotonically_increasing_id())
    low = (1 << 33) - 1  # the number's lower bits count the rows of a partition, the others are the partition
    return materialize(dealt.select((F.shiftright("at", 33) * (1 << 33) + (F.col("at").bitwiseAND(low) / size).cast("long")).alias("seg"), "id", "v"), "segments")


class Lists:
    """Sorted lists of one segment."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        """``ids`` (null: the largest number) and ``rows``, one vector each, filled with zeros to one length."""
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows.T, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(np.ascontiguousarray(rows.T), self.order, axis=1).astype(np.float64)
        self.low, self.high = self.values[:, 0], self.values[:, -1]
        self.largest = float(np.abs(self.values).max(initial=0))

    def most(self, queries: np.ndarray) -> np.ndarray:
        """What no score of each query can exceed: the sum of the first entries of its lists."""
        return np.maximum(queries, 0) @ self.high + np.minimum(queries, 0) @ self.low

    def survivors(self, query: np.ndarray, least: float, k: int) -> np.ndarray:
        """Rows whose score may be among the ``k`` best of the segment and at least ``least``, and few others.

        ``query`` has as many components as the lists. Every row that belongs to the result is among those returned.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        q = np.concatenate([query[up], query[down]])[:, None].astype(np.float64)
        worst = np.concatenate([query[up] * self.low[up], query[down] * self.high[down]])
        if not len(q):
            return np.arange(n)
        slack = 0.0 if np.abs(q).max() * self.largest * len(q) < EXACT else 1e-9 * np.abs(q).sum() * self.largest
        known, floor_, seen = np.zeros(n), np.zeros(n), []
        done, depth = 0, min(FIRST, n)
        while True:
            order = np.concatenate([self.order[up, n - depth : n - done], self.order[down, done:depth]])
            gain = q * np.concatenate([self.values[up, n - depth : n - done], self.values[down, done:depth]])
            known += np.bincount(order.ravel(), gain.ravel(), n)
            floor_ += np.bincount(order.ravel(), np.repeat(worst, depth - done), n)
            seen.append(order)
            # the next entries of a list give at most what its last one gave
            last = (q[:, 0] * np.concatenate([self.values[up, n - depth], self.values[down, depth - 1]]))[:, None]
            reached = sum(np.bincount(x.ravel(), np.broadcast_to(last, x.shape).ravel(), n) for x in seen)
            upper, lower = last.sum() + known - reached + slack, worst.sum() + known - floor_ - slack
            bar = max(least, np.partition(lower, n - k)[n - k]) if n >= k else least
            alive = np.flatnonzero(upper >= bar)
            if len(alive) <= max(k, depth) or depth == n:
                return alive
            done, depth = depth, min(2 * depth, n)

    def scores(self, query: np.ndarray, at: np.ndarray) -> list[int]:
        """The exact scores of the rows ``at``."""
        if self.largest * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, len(query)) < EXACT:
            return (self.rows[at].astype(np.float64) @ query.astype(np.float64)).astype(np.int64).tolist()
        return [sum(int(x) * int(y) for x, y in zip(r, query)) for r in self.rows[at]]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of integer lists as rows of one length, shorter ones filled with zeros."""
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(length), int(length.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = flat
    return out


def to_width(x: np.ndarray, width: int) -> np.ndarray:
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


LARGEST = (1 << 63) - 1


def below(score: int) -> float:
    """The score as a bar in floating point that lets no equal score fall under it."""
    if abs(score) < EXACT:
        return float(score)
    return -np.inf if score <= -LARGEST else float(np.nextafter(float(score), -np.inf))


def search(dealt: DataFrame, k: int, key: list[str]) -> DataFrame:
    """(query, query_row, id, score) of the rows of each ``key``: those with ``is_query`` ask all others.

    Rows come as (*key, is_query, seg, id, v, row, least): of a query, ``seg`` is the segment it does not ask and ``least`` the
    score that a row needs (null: any). A task holds the queries of a key and one segment at a time; what a query has found
    raises what the next segments have to reach.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found, now = None, [], None
        for batch in runs(batches, [*key, "kind", "seg_"]):
            cut = np.flatnonzero(np.diff(batch.column("kind").to_numpy(), prepend=-1) | np.diff(batch.column("seg_").to_numpy(), prepend=-1) | changes(batch))
            for lo, hi in zip(cut, [*cut[1:], batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if now != (now := [part.column(c)[0].as_py() for c in key]):
                    if found:
                        yield from emit(asked, found)
                    found = []
                if part.column("kind")[0].as_py() == 0:
                    asked = {c: part.column(c).to_pylist() for c in ("id", "row", "seg")} | {"v": matrix(part.column("v"))}
                    asked["least"] = np.array([-np.inf if x is None else below(x) for x in part.column("least").to_pylist()])
                    found = [[] for _ in asked["id"]]
                    asked["seg"] = np.array(asked["seg"], np.int64)
                elif found:
                    ask(asked, found, part)
                if sum(map(len, found)) > 1 << 16:
                    yield from emit(asked, found)
                    found = [[] for _ in found]
        if found:
            yield from emit(asked, found)
        release()

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, bool)
        for c in key:
            out |= np.diff(batch.column(c).to_numpy(), prepend=-1) != 0
        return out

    def ask(asked: dict, found: list, part: pa.RecordBatch) -> None:
        ids = np.array([LARGEST if x is None else x for x in part.column("id").to_pylist()], dtype=np.int64)
        lists = Lists(ids, matrix(part.column("v")))
        queries = to_width(asked["v"], lists.rows.shape[1])
        if not lists.rows.shape[1]:
            promising = np.arange(len(queries))
        else:
            most = lists.most(queries.astype(np.float64))
            promising = np.flatnonzero(most + 1e-9 * np.abs(most) >= asked["least"])
        seg = part.column("seg")[0].as_py()
        for i in promising[asked["seg"][promising] != seg]:
            at = lists.survivors(queries[i], asked["least"][i], k + 1)  # one of them may be the query itself
            rows = sorted((-score, int(x)) for score, x in zip(lists.scores(queries[i], at), ids[at]) if x != asked["id"][i] and score >= asked["least"][i])[:k]
            found[i] += rows
            if len(rows) == k:
                asked["least"][i] = max(asked["least"][i], below(-rows[-1][0]))

    def emit(asked: dict, found: list) -> Iterator[pa.RecordBatch]:
        flat = [(asked["id"][i], asked["row"][i], None if x == LARGEST else x, max(-LARGEST - 1, min(LARGEST, -s))) for i, rows in enumerate(found) for s, x in rows]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], ["query", "query_row", "id", "score"])

    # queries come before the segments that they ask
    kind = F.when(F.col("is_query"), 0).otherwise(1)
    dealt = dealt.withColumns({"kind": kind, "seg_": F.when(F.col("is_query"), F.lit(0)).otherwise(F.col("seg"))})
    return dealt.repartition(*key).sortWithinPartitions(*key, "kind", "seg_").mapInArrow(answer, "query long, query_row long, id long, score long")


def top_products(vectors: DataFrame, queries: str = "id % 100 = 0", k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The ``k`` vectors of the highest integer inner products for each query: (query_id, rank, vec_id, score).

    Components are floor(scale * x). Queries are the rows for whose ``id`` the condition holds; candidates are all rows but
    those of the query's own id. Ties go to the smaller id, rows without an id last; fewer candidates give fewer ranks.
    Vectors that are null or hold null or non-finite components take no part; where lengths differ, the shorter vector goes
    on with zeros (an empty one has score 0 with all). Rows of a repeated id are candidates of their own, and each of them
    asks as a query; scores beyond the range of long are its ends.

    A query first asks the segment that it lies in; the score of its k-th hit there is what a vector of another segment has
    to reach, so that most segments are left after the first entries of their lists.
    """
    rows = segments(quantised(vectors, id_col, vector_col, scale))
    asking = rows.where(queries).withColumn("row", F.monotonically_increasing_id())
    asking = materialize(asking, "queries")
    blank = F.lit(None).cast("long")
    others = rows.select("seg", "id", "v", blank.alias("row"), blank.alias("least"), F.lit(False).alias("is_query"))
    home = asking.select(F.lit(-1).cast("long").alias("seg"), "id", "v", "row", blank.alias("least"), F.lit(True).alias("is_query"), F.col("seg").alias("place"))
    near = materialize(search(others.withColumn("place", F.col("seg")).unionByName(home), k, ["place"]), "near")
    if rows.select("seg").distinct().limit(2).count() > 1:
        bars = near.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        bars = asking.join(bars.select(F.col("query_row").alias("row"), "least"), "row", "left")
        lanes = max(1, -(-rows.count() // (SEGMENT * LANE)))
        blocks = max(1, -(-asking.count() // QUERIES))
        every = lambda n, out: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(out)
        spread = others.select("*", F.pmod(F.xxhash64("seg"), F.lit(lanes)).cast("int").alias("lane"), every(blocks, "block"))
        asked = bars.select("seg", "id", "v", "row", "least", F.lit(True).alias("is_query"), every(lanes, "lane"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
        near = near.unionByName(search(spread.unionByName(asked), k, ["lane", "block"]))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
