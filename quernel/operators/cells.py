"""Exact nearest neighbours in a stored layout of cells.

Vectors are dealt to the nearest of some centres; a cell keeps its centre and radius, and its vectors by their distance to the
centre. By the triangle inequality no vector of a cell is nearer to a query than the query's distance to the centre less the
radius, and none in it nearer than the difference of the two distances to the centre: cells and ends of cells that cannot hold
one of the k nearest are left unread, and what is left out changes no answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors of a cell; cells that a task goes through for its queries; queries that a task holds.
CELL, LANE, QUERIES = 1024, 8, 1024
#: Centres are found on so many vectors at most, those with the least hash of their id; a vector looks for its centre among all centres.
SAMPLE, CENTRES = 20_000, 4096
#: Room for rounding, relative to the squared lengths.
ROOM = 1e-9


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), width or (len(flat) // len(column) if len(column) else 0))


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` means of the sample: spread first points, then rounds of assignment and mean."""
    rng = np.random.default_rng(0)
    out = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        own = nearest_centre(sample, out)[0]
        total, n = np.zeros_like(out), np.bincount(own, minlength=k)
        np.add.at(total, own, sample)
        out = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], out)
    return out


def nearest_centre(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the nearest centre and the distance to it, computed from the difference."""
    own = np.concatenate([np.argmin((c * c).sum(1)[None, :] - 2 * x[lo : lo + 2048] @ c.T, axis=1) for lo in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)
    return own, np.sqrt(((x - c[own]) ** 2).sum(1))


class Cells:
    """A stored layout: ``vectors`` (cell, piece, id, vector, away, further columns); pieces of a cell have ``CELL`` vectors at most."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.vectors, self.centres = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centres")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] = ()) -> Cells:
        """Null vectors take no part. The driver holds the sample that centres are found on and the centres, no vector else."""
        spark = vectors.sparkSession
        rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *keep)
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
        if not len(sample):
            middle = np.zeros((1, 0))
        else:
            x = matrix(sample)
            middle = centres(x, max(1, min(CENTRES, len(x), round(n / CELL) * 2)))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(middle)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        sent = spark.sparkContext.broadcast(middle)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own, away = nearest_centre(matrix(batch.column("vector")), sent.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(away)], [*batch.schema.names, "cell", "away"])

        extra = [rows.schema[c] for c in keep]
        schema = ", ".join(["id long", "vector array<double>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra), "cell int", "away double"])
        # a cell of very many vectors is cut by ranges of the distance to its centre, so that pieces are rings
        dealt = rows.mapInArrow(deal, schema).repartitionByRange(max(1, n // (4 * CELL)), "cell", "away", "id").sortWithinPartitions("cell", "away", "id")
        at = F.monotonically_increasing_id()
        place = F.shiftright(at, 33) * (1 << 20) + (at.bitwiseAND((1 << 33) - 1) / CELL).cast("long")
        piece = place * CENTRES + F.col("cell")  # no piece holds vectors of two cells
        dealt.withColumn("piece", piece).write.parquet(f"{path}/vectors")
        return cls(spark, path)

    def nearest(self, queries: DataFrame, k: int, keep: list[str] = ()) -> DataFrame:
        """(query_id, id, distance, keep..., rank): the ``k`` nearest vectors of each query(query_id, vector), ids break ties."""
        found, _ = self._search(queries, k, keep)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def read_share(self, queries: DataFrame, k: int) -> DataFrame:
        """(pieces, left_out, compared, vectors): how many (query, piece) pairs there are and were left out, and the vectors compared of those there are."""
        return self._search(queries, k, [])[1]

    def _search(self, queries: DataFrame, k: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
        """The hits and the counts. A query first asks the pieces of the cell it would lie in; its k-th hit there bounds the others."""
        middle = np.array([r.centre for r in self.centres.orderBy("cell").collect()])  # CENTRES at most
        sent = self.spark.sparkContext.broadcast(middle)

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = nearest_centre(matrix(batch.column("vector")), sent.value)[0] if sent.value.size else np.zeros(batch.num_rows)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "home"])

        queries = queries.where("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        queries = queries.mapInArrow(home, "query_id long, vector array<double>, home int")
        places = self.vectors.groupBy("cell", "piece").count()
        rows = self.vectors.join(F.broadcast(self.centres), "cell").select("piece", "cell", "id", "vector", "away", "centre", *keep)
        no = lambda kind: F.lit(None).cast(kind)
        near = queries.join(places.select(F.col("cell").alias("home"), "piece"), "home").select(F.col("piece").alias("lane"), F.lit(0).alias("group"), "query_id", "vector", no("int").alias("home"), no("double").alias("limit"))
        first = self._ask(near, rows.select(F.col("piece").alias("lane"), F.lit(0).alias("group"), "*"), k, keep)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance"))
        limits = first.where("query_id IS NOT NULL").withColumn("n", rank).where(F.col("n") == k).select("query_id", F.col("distance").alias("limit"))
        lanes, groups = max(1, -(-places.count() // LANE)), max(1, -(-queries.count() // QUERIES))
        every = lambda n, out: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(out)
        asked = queries.join(limits, "query_id", "left").select(every(lanes, "lane"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), "query_id", "vector", "home", "limit")
        rest = self._ask(asked.withColumn("lane", F.col("lane").cast("long")), rows.select(F.pmod(F.xxhash64("piece"), F.lit(lanes)).cast("long").alias("lane"), every(groups, "group"), "*"), k, keep)
        out = first.unionByName(rest)
        counts = out.where("query_id IS NULL").agg(*(F.sum(c).alias(c) for c in ("pieces", "left_out", "compared", "vectors")))
        return out.where("query_id IS NOT NULL").select("query_id", "id", "distance", *keep), counts

    def _ask(self, queries: DataFrame, rows: DataFrame, k: int, keep: list[str]) -> DataFrame:
        """What queries (lane, group, query_id, vector, home, limit) find in the pieces of their lane and group, those of their home cell left out."""
        extra = [self.vectors.schema[c] for c in keep]
        no = lambda kind, name: F.lit(None).cast(kind).alias(name)
        asked = queries.select("lane", "group", F.lit(-1).cast("long").alias("piece"), F.col("home").alias("cell"), F.col("query_id").alias("id"), "vector", F.col("limit").alias("away"), no("array<double>", "centre"), *(no(f.dataType, f.name) for f in extra))
        dealt = asked.unionByName(rows.select(asked.columns)).repartition("lane", "group").sortWithinPartitions("lane", "group", "piece", "away")
        kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
        return dealt.mapInArrow(searcher(k, keep), f"query_id long, id long, distance double{kinds}, pieces long, left_out long, compared long, vectors long")


def searcher(k: int, keep: list[str]):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        key = lambda b, i: tuple(b.column(c)[i].as_py() for c in ("lane", "group", "piece"))
        for batch in batches:
            if not batch.num_rows:
                continue
            k_ = np.stack([batch.column(c).to_numpy() for c in ("lane", "group", "piece")])
            cut = [0, *(np.flatnonzero((k_[:, 1:] != k_[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cut, cut[1:]):
                if held and key(held[-1], 0) != key(batch, lo):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, q, best, home, counts, found = None, None, None, None, None, np.zeros(4, np.int64), []
        for part in pieces(batches):
            lane_group = part.column("lane")[0].as_py(), part.column("group")[0].as_py()
            if lane_group != here:
                here, ids = lane_group, None
            vectors = part.column("vector").combine_chunks()
            if part.column("piece")[0].as_py() < 0:
                ids, q = part.column("id").to_numpy(), matrix(vectors)
                limit = part.column("away").to_numpy(zero_copy_only=False).astype(np.float64)
                # squared distances of the nearest so far, ascending; at first the bound that is known
                best = np.repeat(np.where(np.isnan(limit), np.inf, limit)[:, None], k, axis=1)
                home = np.array([-1 if c is None else c for c in part.column("cell").to_pylist()])
                continue
            if ids is None:
                continue
            x, away = matrix(vectors), part.column("away").to_numpy()
            centre = np.array(part.column("centre")[0].as_py())
            to_centre = np.sqrt(((q - centre) ** 2).sum(1))
            room = ROOM * (1 + (q * q).sum(1) + (x * x).sum(1).max())
            # the piece is a ring of the cell: its vectors are between the least and the largest distance from the centre
            gap = np.maximum(np.maximum(to_centre - away[-1], away[0] - to_centre), 0)
            own = home == part.column("cell")[0].as_py()
            asks = np.flatnonzero((gap * gap <= best[:, -1] + room) & ~own)
            others = len(ids) - own.sum()
            counts += [others, others - len(asks), 0, others * len(x)]
            for i in asks[np.argsort(gap[asks], kind="stable")]:
                reach = np.sqrt(best[i, -1] + room[i]) if np.isfinite(best[i, -1]) else np.inf
                lo, hi = np.searchsorted(away, to_centre[i] - reach), np.searchsorted(away, to_centre[i] + reach, "right")
                if lo >= hi:
                    continue
                distance = ((q[i] - x[lo:hi]) ** 2).sum(1)
                counts[2] += hi - lo
                at = np.flatnonzero(distance <= best[i, -1] + room[i])
                if len(at) > k:
                    edge = np.partition(distance[at], k - 1)[k - 1]
                    at = at[distance[at] <= edge]  # ties of the last one stay: ids break them
                if len(at):
                    found.append((np.full(len(at), ids[i]), part.slice(lo).take(pa.array(at)).select(["id", *keep]), distance[at]))
                    best[i] = np.sort(np.concatenate([best[i], distance[at]]))[:k]
            if found:
                yield from emit(found)
                found = []
        empty = [pa.array([None], f) for f in (pa.int64(), pa.int64(), pa.float64())]
        if counts[0]:
            names = ["query_id", "id", "distance", *keep, "pieces", "left_out", "compared", "vectors"]
            yield pa.RecordBatch.from_arrays([*empty, *(pa.nulls(1, part.schema.field(c).type) for c in keep), *(pa.array([int(c)]) for c in counts)], names)

    def emit(found: list) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables([t for _, t, _ in found])
        n = rows.num_rows
        blank = [pa.nulls(n, pa.int64())] * 4
        names = ["query_id", "id", "distance", *keep, "pieces", "left_out", "compared", "vectors"]
        out = pa.Table.from_arrays([pa.array(np.concatenate([i for i, _, _ in found])), rows.column("id"), pa.array(np.concatenate([d for _, _, d in found])), *(rows.column(c) for c in keep), *blank], names)
        yield from out.combine_chunks().to_batches()

    return run
