"""For every section the sections of the highest BM25 score for its own whole tokens, exactly: all blocks of sections meet all blocks.

Sections are packed into blocks where they are read, with numbers for tokens, and stored once; nothing of them is exchanged but
each block's distinct tokens, for their frequencies, and the block itself, once. The blocks meet by a plain cross join of the
stored table with itself, which reads the files again and exchanges nothing. A task compares one block of answers with one of
queries: tokens that many sections of both hold by a product of matrices in single precision, the others by their postings.
What can be among the best is then scored again in double precision, and only the best of each query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import scratch
from . import bm25

#: Sections of a block, and distinct tokens of its sections together; sections that a task sorts before it cuts them into blocks.
BLOCK, POSTINGS, SORTED = 2048, 1 << 20, 8192
#: A token goes into the matrices if more than this share of the pairs of two blocks have it in common; columns of a matrix, at most.
SHARED, COLUMNS = 0.0022, 2048
#: Queries whose postings, or whose pairs, a task goes through at once.
AT_ONCE = 128
#: Stored blocks of a file, about; parts that the answers are read in: a task goes through one of them, and what it has seen is the bar for the rest.
WRITTEN, PARTS = 2, 4
#: Queries of ``nearest_of``, at most.
MANY = 1 << 12


def nearest(sections: DataFrame, k: int = 3, least: float = 1.0) -> DataFrame:
    """(query_id, id, rank, score): for each of ``sections`` (id, seq, tokens) the ``k`` others of the highest score for its own
    tokens, of ``least`` or more, ranked as ``bm25.top_k`` does. Ids are distinct; a section without an id does not ask."""
    spark = sections.sparkSession
    path = scratch(spark)
    packed(sections).write.parquet(f"{path}/packed")
    raw = spark.read.parquet(f"{path}/packed")
    stats = raw.agg(F.count("*").alias("blocks"), F.sum(F.size("ids")).alias("n"), F.sum("total_len").alias("total_len")).first()
    if not stats.blocks:
        empty = sections.select(F.col("id").alias("query_id"), "id").limit(0)
        return empty.select("query_id", "id", F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
    numbered(raw, stats.n, stats.total_len / stats.n, stats.blocks).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    side = lambda s, *columns: blocks.select(*(F.col(c).alias(f"{s}_{c}") for c in ("block", "ids", "sizes", "codes", "index", "tf", *columns)))
    kinds = {c: sections.schema[c].dataType.simpleString() for c in ("id", "seq")}
    met = side("y", "seqs", "norm").coalesce(PARTS).crossJoin(side("x", "idf"))
    found = met.mapInArrow(comparer(k, least), f"query_id {kinds['id']}, id {kinds['id']}, seq {kinds['seq']}, score double")
    return bm25.top_k(found, k).select("query_id", "id", "rank", "score")


def nearest_of(queries: DataFrame, sections: DataFrame, frequencies: DataFrame, n: int, average: float, k: int = 3, least: float = 1.0) -> DataFrame:
    """The rows of ``nearest`` for some of its sections, ``queries``, which are few (``MANY`` at most) and go to every task. The others are packed and compared
    as they are read: nothing of them is stored, and the best of each query alone leave a task. ``frequencies`` (word, df) has the hashes of the queries' tokens,
    ``n`` and ``average`` are the number of ``sections`` and their mean length."""
    path = scratch(sections.sparkSession)
    packed(queries.repartition(1)).write.parquet(path)
    raw = sections.sparkSession.read.parquet(path)
    each = raw.select("block", F.posexplode("words").alias("pos", "token")).select("block", "pos", F.xxhash64("token").alias("word"))
    known = each.join(bm25.sized(frequencies), "word").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "df"))).alias("known"))
    asking = raw.join(known, "block").withColumn("df", F.transform("known", lambda w: w["df"]))
    asking = asking.select(*(F.col(c).alias(f"x_{c}") for c in ("block", "ids", "sizes", "index", "tf", "words", "df"))).toArrow()
    kinds = {c: sections.schema[c].dataType.simpleString() for c in ("id", "seq")}
    compare, pack = comparer(k, least, (n, average)), packer(BLOCK, POSTINGS, BLOCK, 16 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs = [asking.slice(i, 1).combine_chunks().to_batches()[0] for i in range(asking.num_rows)]
        yield from compare(pa.RecordBatch.from_arrays([*y.columns, *x.columns], [*(f"y_{c}" for c in y.schema.names), *x.schema.names]) for y in pack(batches) for x in xs)

    found = sections.select("id", "seq", "tokens").mapInArrow(run, f"query_id {kinds['id']}, id {kinds['id']}, seq {kinds['seq']}, score double")
    return bm25.top_k(found, k).select("query_id", "id", "rank", "score")


def distinct_ids(sections: DataFrame) -> bool:
    return sections.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty()


def packed(sections: DataFrame) -> DataFrame:
    """(block, ids, seqs, lens, sizes, index, tf, total_len, words, held): blocks of sections as they are read. ``words`` are a block's distinct tokens
    with the number of its sections that hold them; ``index`` and ``tf`` are those of the sections, ``sizes`` how many each has."""
    kinds = {c: sections.schema[c].dataType.simpleString() for c in ("id", "seq")}
    schema = f"block long, ids array<{kinds['id']}>, seqs array<{kinds['seq']}>, lens binary, sizes binary, index binary, tf binary, total_len long, words array<string>, held array<int>"
    return sections.select("id", "seq", "tokens").mapInArrow(packer(BLOCK, POSTINGS, SORTED, 64 << 20), schema)


def packer(block: int, postings: int, chunk: int, room: int):
    """The task of ``packed``: blocks of up to ``block`` sections and ``postings`` tokens, from ``chunk`` sections or ``room`` bytes at once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows, size = TaskContext.get().partitionId() << 16, [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, chunk):
                part = batch.slice(lo, chunk)
                if held and (rows + part.num_rows > chunk or size + part.nbytes > room):
                    for out in cut(pa.Table.from_batches(held)):
                        yield of_block(number, *out)
                        number += 1
                    held, rows, size = [], 0, 0
                held.append(part)
                rows, size = rows + part.num_rows, size + part.nbytes
        if rows:
            for out in cut(pa.Table.from_batches(held)):
                yield of_block(number, *out)
                number += 1

    def cut(part: pa.Table) -> Iterator[tuple]:
        """Sections that share their most frequent token (not those of nearly all) stand together, so that blocks of one language meet few others in many tokens."""
        part = part.combine_chunks()
        tokens = part.column("tokens").combine_chunks() if isinstance(part.column("tokens"), pa.ChunkedArray) else part.column("tokens")
        lens = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.list_flatten(tokens).dictionary_encode()
        key = np.repeat(np.arange(len(lens)), lens) * max(1, len(words.dictionary)) + words.indices.to_numpy(zero_copy_only=False)
        key, tf = np.unique(key, return_counts=True)
        row, code = key // max(1, len(words.dictionary)), key % max(1, len(words.dictionary))
        df = np.bincount(code, minlength=len(words.dictionary))
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(np.where(df > 0.9 * len(lens), 0, -df), kind="stable")] = np.arange(len(df))
        first = np.full(len(lens), len(df))
        np.minimum.at(first, row, rank[code])
        start = np.searchsorted(row, np.arange(len(lens) + 1))
        own, total = [], 0
        for i in np.argsort(first, kind="stable").tolist():
            if own and (len(own) == block or total + start[i + 1] - start[i] > postings):
                yield part, words.dictionary, np.array(own), lens, start, code, tf
                own, total = [], 0
            own.append(i)
            total += start[i + 1] - start[i]
        yield part, words.dictionary, np.array(own), lens, start, code, tf

    def of_block(number: int, part: pa.Table, words: pa.Array, own: np.ndarray, lens: np.ndarray, start: np.ndarray, code: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        sizes = start[own + 1] - start[own]
        at = np.repeat(start[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        there, index, held = np.unique(code[at], return_inverse=True, return_counts=True)
        one = lambda x: pa.array([x])
        many = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        take = lambda c: part.column(c).take(pa.array(own)).combine_chunks()
        whole = lambda x: x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)
        columns = {
            "block": one(number), "ids": many(whole(take("id"))), "seqs": many(whole(take("seq"))), "lens": one(lens[own].astype(np.int32).tobytes()), "sizes": one(sizes.astype(np.int32).tobytes()),
            "index": one(index.astype(np.int32).tobytes()), "tf": one(tf[at].astype(np.int32).tobytes()), "total_len": one(int(lens[own].sum())),
            "words": many(words.take(pa.array(there))), "held": many(pa.array(held.astype(np.int32))),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return pack


def numbered(raw: DataFrame, n: int, average: float, blocks: int) -> DataFrame:
    """(block, ids, seqs, sizes, codes, idf, index, tf, norm): the blocks with tokens numbered alike everywhere, without those of a single section.

    A token's number is the least place of its own in all blocks."""
    each = raw.select("block", F.posexplode(F.arrays_zip("words", "held"))).select("block", "pos", "col.words", "col.held")
    same = Window.partitionBy("words")
    words = each.select("block", "pos", F.sum("held").over(same).alias("df"), F.min(F.shiftleft("block", 24) + F.col("pos")).over(same).alias("code")).where("df > 1")

    def finish(key: tuple, part: pa.Table, words: pa.Table) -> pa.Table:
        sizes, index, tf, lens = (np.frombuffer(part.column(c)[0].as_buffer(), np.int32) for c in ("sizes", "index", "tf", "lens"))
        pos, code, df = (words.column(c).to_numpy() for c in ("pos", "code", "df"))
        order = np.argsort(code)
        to = np.full(int(index.max(initial=-1)) + 1, -1, np.int32)
        to[pos[order]] = np.arange(len(order), dtype=np.int32)
        index, row = to[index], np.repeat(np.arange(len(sizes)), sizes)
        kept = index >= 0
        tf, row, index = tf[kept], row[kept], index[kept]
        again = np.lexsort((index, row))  # sums go in the order of the tokens' numbers, whatever block it is
        idf = np.log((n - df[order] + 0.5) / (df[order] + 0.5) + 1)
        norm = 1 - bm25.B + bm25.B * lens / average if average > 0 else np.ones(len(lens))
        sizes = np.bincount(row, minlength=len(sizes)).astype(np.int32)
        stored = {"sizes": sizes, "codes": code[order].astype(np.int64), "idf": idf, "index": index[again], "tf": tf[again], "norm": norm}
        columns = [part.column("block"), part.column("ids"), part.column("seqs"), *(pa.array([x.tobytes()]) for x in stored.values())]
        return pa.Table.from_arrays(columns, ["block", "ids", "seqs", *stored])

    tasks = max(1, -(-blocks // WRITTEN))
    kinds = {c: raw.schema[c].dataType.simpleString() for c in ("ids", "seqs")}
    left = raw.select("block", "ids", "seqs", "lens", "sizes", "index", "tf").repartition(tasks, "block")
    return left.groupBy("block").cogroup(words.repartition(tasks, "block").groupBy("block")).applyInArrow(finish, f"block long, ids {kinds['ids']}, seqs {kinds['seqs']}, sizes binary, codes binary, idf binary, index binary, tf binary, norm binary")


class Block:
    """A block as a task holds it; ``weight`` are those of queries (times and idf) or of answers (saturated), section by section."""

    def __init__(self, ids: pa.Array, sizes: np.ndarray, codes: np.ndarray, index: np.ndarray, weight: np.ndarray):
        self.ids, self.n, self.codes, self.index, self.weight = ids, len(sizes), codes, index, weight
        self.start = np.append(0, np.cumsum(sizes, dtype=np.int64))
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.held = np.bincount(index, minlength=len(codes))

    def by_token(self) -> None:
        order = np.argsort(self.index, kind="stable")
        self.token_rows, self.token_weight, self.token_start = self.row[order].astype(np.int64), self.weight[order], np.cumsum(self.held) - self.held

    def matrix(self, column: np.ndarray, columns: int) -> np.ndarray:
        out, at = np.zeros((self.n, columns), np.float32), column[self.index]
        kept = np.flatnonzero(at >= 0)
        out[self.row[kept], at[kept]] = self.weight[kept]
        return out


def candidates(x: Block, y: Block, bar: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries of ``x``, answers of ``y``, scores) of all pairs that can be among the ``k`` best of their query in ``y`` and reach its bar, in a few queries at a time."""
    at = np.minimum(np.searchsorted(y.codes, x.codes), max(0, len(y.codes) - 1))
    xs = np.flatnonzero(y.codes[at] == x.codes) if len(y.codes) else np.zeros(0, np.int64)
    ys = at[xs]
    both = x.held[xs] * y.held[ys]
    dense = np.zeros(len(xs), bool)
    dense[np.argsort(-both, kind="stable")[:COLUMNS]] = True
    dense &= both > SHARED * x.n * y.n
    column_x, column_y = np.full(len(x.codes), -1, np.int32), np.full(len(y.codes), -1, np.int32)
    column_x[xs[dense]] = column_y[ys[dense]] = np.arange(dense.sum(), dtype=np.int32)
    to_y = np.full(len(x.codes), -1, np.int64)
    to_y[xs[~dense]] = ys[~dense]
    token = to_y[x.index]
    kept = np.flatnonzero(token >= 0)
    token, row, weight = token[kept], x.row[kept].astype(np.int64), x.weight[kept]
    first = np.searchsorted(row, np.arange(0, x.n + AT_ONCE, AT_ONCE))
    room = (dense.sum() + 16) * 2.0**-23  # sums of positive numbers in single precision are off by no larger share
    left, right = x.matrix(column_x, dense.sum()), y.matrix(column_y, dense.sum()).T
    same = equal(x.ids, y.ids)
    full_to_y = np.full(len(x.codes), -1, np.int64)
    full_to_y[xs] = ys
    for c, lo in enumerate(range(0, x.n, AT_ONCE)):
        hi = min(x.n, lo + AT_ONCE)
        total = left[lo:hi] @ right
        part = slice(first[c], first[c + 1])
        size = y.held[token[part]]
        if size.sum():
            at = np.repeat(y.token_start[token[part]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cell = np.repeat((row[part] - lo) * y.n, size) + y.token_rows[at]
            total += np.bincount(cell, np.repeat(weight[part], size) * y.token_weight[at], (hi - lo) * y.n).reshape(hi - lo, y.n).astype(np.float32)
        own = slice(*np.searchsorted(same[0], [lo, hi]))
        total[same[0][own] - lo, same[1][own]] = -1
        need = bar[lo:hi] * (1 - 2 * room) - 1e-8
        many = np.flatnonzero((total >= need[:, None].astype(np.float32)).sum(axis=1) > k)
        if len(many) and y.n > k:  # those below the k-th of the block are not among the best either
            need[many] = np.maximum(need[many], np.partition(total[many], y.n - k, axis=1)[:, y.n - k] * (1 - 2 * room) - 1e-8)
        i, j = np.nonzero((total >= need[:, None].astype(np.float32)) & (total > 0))
        if len(i):
            yield i + lo, j, scored(x, y, i + lo, j, full_to_y)


def scored(x: Block, y: Block, i: np.ndarray, j: np.ndarray, to_y: np.ndarray) -> np.ndarray:
    """The scores of pairs in double precision; pairs of one query stand together."""
    out, q = np.empty(len(i)), np.zeros(len(y.codes))
    cut = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(i)]):
        own = slice(x.start[i[lo]], x.start[i[lo] + 1])
        to = to_y[x.index[own]]
        q[to[to >= 0]] = x.weight[own][to >= 0]
        for at in range(lo, hi, 512):
            some = j[at : min(hi, at + 512)]
            size = y.start[some + 1] - y.start[some]
            begin = np.cumsum(size) - size
            place = np.repeat(y.start[some] - begin, size) + np.arange(size.sum())
            out[at : at + len(some)] = np.add.reduceat(q[y.index[place]] * y.weight[place], begin)  # each has a token
        q[to[to >= 0]] = 0
    return out


def equal(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places with equal values, by the first; nulls are equal to nothing."""
    code = pa.concat_arrays([a, b]).dictionary_encode().indices
    code = pc.fill_null(code, -1).to_numpy(zero_copy_only=False)
    one, other = code[: len(a)], code[len(a) :]
    order = np.argsort(other, kind="stable")
    lo, hi = np.searchsorted(other[order], one), np.searchsorted(other[order], one, "right")
    size = np.where(one < 0, 0, hi - lo)
    return np.repeat(np.arange(len(a)), size), order[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def comparer(k: int, least: float, stats: tuple[int, float] | None = None):
    """The task of ``nearest``: rows are pairs of blocks. The best of each query so far are the bar for what comes. With ``stats``, the number of
    sections and their mean length, that of ``nearest_of``: tokens have the numbers that the block of queries gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        bars: dict[int, np.ndarray] = {}
        names: dict[int, pa.Array] = {}
        held, y = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("y_block")[i].as_py()
                if stats is None and number != held:
                    held, y = number, answers(batch, i)
                at = batch.column("x_block")[i].as_py()
                x, y = (queries(batch, i), y) if stats is None else (queries_of(batch, i, *stats), answers_to(batch, i, stats[1]))
                if at not in bars:
                    bars[at], names[at] = np.full(x.n, least), x.ids
                found = []
                for q, a, score in candidates(x, y, bars[at], k):
                    enough = score >= least
                    q, a, score = q[enough], a[enough], score[enough]
                    rows = pa.table({"q": pa.array(q), "order": pa.array(-np.round(score, 9)), "seq": y.seqs.take(pa.array(a)), "id": y.ids.take(pa.array(a)), "score": pa.array(score)})
                    found.append(trimmed(rows))
                if found:
                    best[at] = trimmed(pa.concat_tables([*([best[at]] if at in best else []), *found]))
                    q = best[at]["q"].to_numpy()
                    last = place_of(q) == k - 1
                    bars[at][q[last]] = -best[at]["order"].to_numpy()[last]
        for at, rows in best.items():
            rows = rows.append_column("query_id", names[at].take(rows["q"].combine_chunks()))
            rows = rows.filter(pc.is_valid(rows["query_id"])).select(["query_id", "id", "seq", "score"])
            yield from rows.combine_chunks().to_batches()

    def trimmed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("q", "ascending"), ("order", "ascending"), ("seq", "ascending")])
        return rows.filter(pa.array(place_of(rows["q"].to_numpy()) < k)).combine_chunks()

    def place_of(q: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        return np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))

    def queries(batch: pa.RecordBatch, i: int) -> Block:
        sizes, index, tf = (numbers(batch, f"x_{c}", i, np.int32) for c in ("sizes", "index", "tf"))
        return Block(batch.column("x_ids")[i].values, sizes, numbers(batch, "x_codes", i, np.int64), index, tf * numbers(batch, "x_idf", i, np.float64)[index])

    def answers(batch: pa.RecordBatch, i: int) -> Block:
        sizes, index, tf = (numbers(batch, f"y_{c}", i, np.int32) for c in ("sizes", "index", "tf"))
        norm = np.repeat(numbers(batch, "y_norm", i, np.float64), sizes)
        out = Block(batch.column("y_ids")[i].values, sizes, numbers(batch, "y_codes", i, np.int64), index, tf * (bm25.K1 + 1) / (tf + bm25.K1 * norm))
        out.seqs = batch.column("y_seqs")[i].values
        out.by_token()
        return out

    def queries_of(batch: pa.RecordBatch, i: int, n: int, average: float) -> Block:
        sizes, index, tf = (numbers(batch, f"x_{c}", i, np.int32) for c in ("sizes", "index", "tf"))
        df = batch.column("x_df")[i].values.to_numpy()
        return Block(batch.column("x_ids")[i].values, sizes, np.arange(len(df)), index, tf * np.log((n - df + 0.5) / (df + 0.5) + 1)[index])

    def answers_to(batch: pa.RecordBatch, i: int, average: float) -> Block:
        sizes, index, tf, lens = (numbers(batch, f"y_{c}", i, np.int32) for c in ("sizes", "index", "tf", "lens"))
        to = pc.fill_null(pc.index_in(batch.column("y_words")[i].values, value_set=batch.column("x_words")[i].values), -1).to_numpy(zero_copy_only=False)
        row, code = np.repeat(np.arange(len(sizes)), sizes), to[index]
        kept = np.flatnonzero(code >= 0)
        kept = kept[np.lexsort((code[kept], row[kept]))]  # sums go in the order of the tokens' numbers, whatever block it is
        row, tf = row[kept], tf[kept]
        codes, index = np.unique(code[kept], return_inverse=True)
        norm = 1 - bm25.B + bm25.B * lens / average if average > 0 else np.ones(len(lens))
        out = Block(batch.column("y_ids")[i].values, np.bincount(row, minlength=len(sizes)), codes, index, tf * (bm25.K1 + 1) / (tf + bm25.K1 * norm[row]))
        out.seqs = batch.column("y_seqs")[i].values
        out.by_token()
        return out

    def numbers(batch: pa.RecordBatch, column: str, i: int, kind: type) -> np.ndarray:
        return np.frombuffer(batch.column(column)[i].as_buffer(), kind)

    return run
