"""Shared pieces of the training-data operators.

* tables in the folder all machines share (lineage is cut there, never in a local folder);
* word spans and word hashes of whole Arrow columns, without a Python loop over words;
* blocked all-pairs work on groups of any size;
* distributed connected components.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by a Python worker (one longer text is handled alone).
SLICE_BYTES = (1 << 20) - 2
#: Largest size of a table that ``small`` lets Spark broadcast.
BROADCAST_BYTES = 48 << 20
#: Rows of one block; a larger group is dealt out as pairs of blocks.
BLOCK = 1024


# ---------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset: a temporary folder of this process on one machine, an error on a cluster."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if getattr(shared_dir, "own", None) is None:
        shared_dir.own = tempfile.mkdtemp(prefix="quernel-")
        atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return "file://" + shared_dir.own


def new_folder(spark: SparkSession) -> str:
    """A new folder for tables of this application; all of them go when the application ends."""
    root = f"{shared_dir(spark)}/quernel-{spark.sparkContext.applicationId}"
    if root not in _FOLDERS:
        _FOLDERS.add(root)
        atexit.register(remove_at_end, spark, root)
    return f"{root}/{uuid.uuid4().hex}"


_FOLDERS: set[str] = set()


def remove_at_end(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended before
        with contextlib.suppress(Exception):
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{new_folder(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            remove(t.sparkSession, path)


def small(df: DataFrame, row_bytes: int, size: int | None = None) -> DataFrame:
    """A materialised table, with a broadcast hint if its bytes, by ``size`` or else by its count of rows, are few enough; else it is joined by shuffle."""
    return F.broadcast(df) if (df.count() * row_bytes if size is None else size) <= BROADCAST_BYTES else df


def heavy(total: int) -> int:
    """Rows of one key beyond which it is no longer left to one task: fewer than a thousand keys can have as many."""
    return max(1000, total // 1000)


def join_unique(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has each key once. The keys of ``hot`` (fewer than a thousand, see ``heavy``) are
    joined by broadcast, so that no task gets all rows of one of them; the others by exchange."""
    if hot.isEmpty():
        return many.join(one, key, how)
    hot = F.broadcast(hot.select(key))
    few = F.broadcast(one.join(hot, key, "left_semi"))
    return many.join(hot, key, "left_semi").join(few, key, how).unionByName(many.join(hot, key, "left_anti").join(one, key, how))


def unused(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is not in the one-column table ``gone``, which is written once; null ids match nulls."""
    key = unused("gone", docs)
    gone = materialize(gone.toDF(key).distinct(), "gone")
    return docs.join(small(gone, 16), F.col(id_col).eqNullSafe(F.col(key)), "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Arrow batches


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``limit`` bytes of ``column`` each (one row at least)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_text(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with bounded slices; nothing is kept between slices."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, column, limit):
                if (out := fn(part)) is not None and out.num_rows:
                    yield out
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give a worker's free memory back to the machine at the end of a task: the next stage may run in the same worker."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries know it
        ctypes.CDLL(None).malloc_trim(0)


class Remembered(dict):
    """A bounded memory of computed values: a young and an old generation of at most ``limit`` entries each.

    What is asked again moves to the young generation, so that frequent keys stay. ``make`` computes a value;
    a key for which ``keep`` is false is not remembered.
    """

    def __init__(self, limit: int, make: Callable, keep: Callable = lambda key: True):
        super().__init__()
        self.limit, self.make, self.keep, self.old = limit, make, keep, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if not self.keep(key):
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


# ---------------------------------------------------------------- words and word hashes

#: Bytes that separate words: ASCII white space.
SPACES = (9, 10, 11, 12, 13, 32)
BY_SPACE = np.ones(256, bool)
BY_SPACE[list(SPACES)] = False
#: Letters, digits and every byte of a non-ASCII character.
BY_LETTER = np.zeros(256, bool)
BY_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[key] = np.multiply.accumulate(step)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, end to end, and the offset of each row (null: empty)."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_hashes(column: pa.Array, kind: np.ndarray = BY_SPACE, lower: bool = True):
    """Words of a text column: (hash, row, start byte, end byte), in order.

    A word is a maximal run of bytes of ``kind``; case is folded by Unicode's simple mapping. Null and
    empty texts have no words. The hash is a polynomial over the word's bytes, the same on every machine.
    """
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    data, off = text_bytes(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    inside = kind[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[off[off < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends_of_rows = off[1:]
    after[ends_of_rows[ends_of_rows > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(off, start, "right") - 1
    if not len(start):
        return np.zeros(0, np.uint64), row, start, end
    # positions count from the piece's first word, so that the tables of powers stay small
    piece = np.zeros(len(start), np.int64)
    if n > SLICE_BYTES:
        first = np.flatnonzero(np.diff(start // SLICE_BYTES, prepend=-1))
        piece = np.repeat(start[first], np.diff(np.append(first, len(start))))
        shift = np.zeros(n, np.int64)
        shift[start[first]] = np.diff(start[first], prepend=0)
        at = np.maximum(np.arange(n) - np.cumsum(shift), 0)
        up, down = _powers(int(max(at.max(), (end - piece).max())) + 1)
        total = np.cumsum(data * up[at], dtype=np.uint64)
    else:
        up, down = _powers(n + 1)
        total = np.cumsum(data * up[:n], dtype=np.uint64)
    low = np.where(start > 0, total[np.maximum(start - 1, 0)], np.uint64(0))
    return mix((total[end - 1] - low) * down[start - piece] + (end - start).astype(np.uint64)), row, start, end


def shingles(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles.

    A text of fewer words than ``width``, but of one at least, has one shingle made of all its words;
    a text without words (or null) has none.
    """
    word, row, _, _ = word_hashes(column)
    bounds = np.searchsorted(row, np.arange(len(column) + 1))
    n = len(word) - width + 1
    if n > 0:
        run = np.zeros(n, np.uint64)
        for j in range(width):
            run = run * np.uint64(0xD6E8FEB86659FD93) + word[j : j + n]
        run = mix(run)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            few = np.zeros(1, np.uint64)
            for w in word[a:b]:
                few = few * np.uint64(0xA0761D6478BD642F) + w
            out.append(mix(few + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ---------------------------------------------------------------- groups in blocks


def deal_blocks(rows: DataFrame, key: list[str], size: str, row_id: str, block: int = BLOCK) -> DataFrame:
    """Deal the members of each group out to pairs of blocks, so that no task holds a whole large group.

    ``size`` holds the group's number of members. Adds ``blk`` (the member's block), ``bi`` <= ``bj``
    (the pair of blocks), and returns the rows partitioned and sorted by ``key, bi, bj``. A group of at
    most ``block`` members is one block.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    dealt = (
        rows.withColumn("_n", n)
        .withColumn("blk", F.pmod(F.xxhash64(row_id), F.col("_n")).cast("int"))
        .withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("bi", F.least("blk", "_p"))
        .withColumn("bj", F.greatest("blk", "_p"))
        .drop("_n", "_p")
    )
    return dealt.repartition(*key, "bi", "bj").sortWithinPartitions(*key, "bi", "bj")


def runs(batches, key: list[str]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal ``key`` of a sorted stream of Arrow batches, several whole groups at a time.

    Yields record batches that hold whole groups only; a group that crosses batches is joined first.
    """
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cut = edges(batch, key)
        if held and same(held[-1], batch, key):
            if len(cut) == 1:
                held.append(batch)
                continue
            held.append(batch.slice(0, cut[1]))
            yield joined()
            batch, cut = batch.slice(cut[1]), cut[1:] - cut[1]
        elif held:
            yield joined()
        if len(cut) > 1:
            yield batch.slice(0, cut[-1])
        held = [batch.slice(cut[-1])]
    if held:
        yield joined()


def edges(batch: pa.RecordBatch, key: list[str]) -> np.ndarray:
    """First row of each run of equal keys (integer columns)."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in key:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def same(a: pa.RecordBatch, b: pa.RecordBatch, key: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1] == b.column(k)[0] for k in key)


def fixed(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return np.frombuffer(data.tobytes(), dtype).reshape(len(column), width)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links a[i]-b[i] among n nodes: the least node of each tree to each other."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        if (ra == rb).all():
            break
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root != root[root]).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(n))
    return list(zip(root[other].tolist(), other.tolist()))


def join_counted(many: DataFrame, one: DataFrame, key: str, count: str, row_bytes: int = 64, how: str = "inner") -> DataFrame:
    """``many`` joined with the materialised table ``one``, which has each key once and its rows in ``many`` as ``count``: by
    broadcast if it is small, else with the keys of very many rows apart."""
    rows, total = one.agg(F.count("*"), F.sum(count)).first()
    if rows * row_bytes <= BROADCAST_BYTES:
        return many.join(F.broadcast(one), key, how)
    return join_unique(many, one, key, one.where(F.col(count) > heavy(total)), how)


# ---------------------------------------------------------------- connected components


def with_minimum(edges_: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and of all v of their u.

    The minima are combined before they are exchanged. Where they are few enough they are broadcast; else those of
    the nodes with very many edges are, and only the edges of all other nodes are exchanged.
    """
    low = edges_.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    if rows * 32 <= BROADCAST_BYTES:  # there are no more nodes than rows
        return edges_.join(F.broadcast(low), "u")
    low = materialize(low, "minima")
    return join_unique(edges_, low, "u", low.where(F.col("n") > heavy(rows)))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)``: rows (node, component), component the least node reachable.

    Large-star and small-star steps alternate until the edges no longer change, each written to the shared folder
    in place of the one before. Nodes without links are not returned; self links, nulls and repeated links do no
    harm. The steps are logarithmic in the number of nodes; more than ``rounds`` of them are an error.
    """

    def seen(pair: DataFrame) -> tuple:
        return tuple(pair.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum((F.xxhash64("v", "u") % 1000003))).first())

    pair = materialize(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    now = seen(pair)
    for _ in range(rounds):
        before, last = now, pair
        both = pair.select("u", "v").unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_minimum(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large if now[0] * 64 <= BROADCAST_BYTES else materialize(large, "large")
        least = with_minimum(large, 2 * now[0])
        pair = materialize(
            least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links"
        )
        now = seen(pair)
        discard(last, large)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pair.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pair.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
