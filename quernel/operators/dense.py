"""Exact nearest neighbours by squared Euclidean distance, for a batch of query vectors.

Queries are the small side, a stated set; every vector is compared with them where it stands, each task keeps
its best of each query, and only those are exchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import sized

CEILING = 1.1
#: Largest set of query vectors that is sent to every task at once.
QUERY_BLOCK = 4096
#: Queries that a task compares with a part of its vectors at once, and pairs of which it holds the differences.
TASK_QUERIES, PAIRS = 256, 16384


def squared_distance(a, b):
    """Squared distance of two array columns, in double precision, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] = ()) -> DataFrame:
    """(query_id, id, distance, keep...) of the k nearest vectors of each query(query_id, vector), nearest first, ids break ties.

    Null vectors on either side take no part. The query set comes to the driver in blocks of about ``QUERY_BLOCK``,
    by a hash of the query, and each block is a pass over the vectors.
    """
    spark = vectors.sparkSession
    queries = queries.where("vector IS NOT NULL").select("query_id", "vector")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), *keep)
    extra = [rows.schema[c] for c in keep]
    schema = ", ".join(["query_id long", "id long", "distance double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])
    out = None
    for i in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").toArrow()
        sent = spark.sparkContext.broadcast((asked["query_id"].to_numpy(), np.array(asked["vector"].to_pylist(), np.float64)))

        def run(batches, sent=sent):
            own, q = sent.value
            best = None
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    if not len(own):
                        continue
                    x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    for at in range(0, len(own), TASK_QUERIES):
                        found = of_block(own[at : at + TASK_QUERIES], q[at : at + TASK_QUERIES], x, part)
                        best = found if best is None else pa.concat_tables([best, found])
                        if best.num_rows > 4 * k * len(own):
                            best = trimmed(best, k)
            if best is not None:
                yield from trimmed(best, k).combine_chunks().to_batches()

        def of_block(own, q, x, part):
            near = np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :], 0)
            take = min(k, x.shape[0])
            c = np.argpartition(near, take - 1, axis=1)[:, :take].ravel()
            r = np.repeat(np.arange(len(own)), take)
            exact = np.concatenate([((q[r[lo : lo + PAIRS]] - x[c[lo : lo + PAIRS]]) ** 2).sum(1) for lo in range(0, len(r), PAIRS)])
            columns = [pa.array(own[r]), part.column("id").take(pa.array(c)), pa.array(exact), *(part.column(n).take(pa.array(c)) for n in part.schema.names[2:])]
            return pa.Table.from_arrays(columns, names=["query_id", "id", "distance", *part.schema.names[2:]])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def trimmed(rows: pa.Table, k: int) -> pa.Table:
    rows = rows.sort_by([("query_id", "ascending"), ("distance", "ascending"), ("id", "ascending")])
    q = rows["query_id"].to_numpy()
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return rows.filter(pa.array(place < k))


def nearest_of(queries: DataFrame, vectors: DataFrame, k: int, filter_col: str, floor: int = 100, **names) -> DataFrame:
    """k nearest of the query's own ``filter_col`` value among the max(20 k, floor) nearest of all: there may be fewer."""
    return own_label(nearest(queries.select("query_id", "vector"), vectors, max(20 * k, floor), keep=[filter_col], **names), queries, k, filter_col)


def own_label(wide: DataFrame, queries: DataFrame, k: int, filter_col: str) -> DataFrame:
    """The k best of the hits that have the query's own ``filter_col`` value."""
    own = wide.join(sized(queries.select("query_id", F.col(filter_col).alias("_own"))), "query_id").where(F.col(filter_col) == F.col("_own"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).drop("_own")


def gate(queries: DataFrame, hits: DataFrame, ceiling: float | None = CEILING) -> DataFrame:
    """(query_id, best, refused): refused without hits, or with the nearest beyond the ceiling; no ceiling accepts any hit."""
    best = hits.groupBy("query_id").agg(F.min("distance").alias("best"))
    rows = queries.select("query_id").join(best, "query_id", "left")
    beyond = F.lit(False) if ceiling is None else F.col("best") > ceiling
    return rows.select("query_id", "best", (F.col("best").isNull() | beyond).alias("refused"))
