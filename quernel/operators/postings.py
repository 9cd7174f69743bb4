"""A stored BM25 index: sections tokenised once, postings in blocks with bounds, exact top-k that leaves blocks unread.

Sections are dealt into shards of some thousand. A posting block holds a token's sections within a shard, with the largest
weight count and the least length in it: whatever the statistics of the corpus are when it is asked, no section of the
block can add more. A task holds a set of queries and goes through shards one after the other. A query's tokens are taken in
descending order of what they can add; once the rest cannot lift a section to the k-th best score that is known, only the
sections met so far are completed, and a shard whose tokens together cannot reach it is not read at all. Rows leave a task
for the best sections of a query only, not for every section that shares a word with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from . import alike, bm25

#: Sections of a shard; shards that a task goes through for its queries; queries that a task holds; shards that a task writes.
SHARD, LANE, QUERIES, WRITTEN = 2048, 8, 4096, 2
#: Tasks that a search is dealt to, at most.
CELLS = 20_000
#: Scores closer than this may change places by rounding; bounds leave as much room.
ROOM = 1e-7
BODY, HEADING = 0, 1


def in_shards(sections: DataFrame, first: int = 0, size: int = SHARD) -> DataFrame:
    """``sections`` with ``shard``, by a hash of the id, and ``place``, the rank by ``seq`` within it.

    The tasks follow the shards, so that what one sorts does not grow with the input."""
    shards = max(1, -(-sections.count() // size))
    dealt = sections.withColumn("shard", (F.pmod(F.xxhash64("id"), F.lit(shards)) + first).cast("int")).repartition(max(1, -(-shards // WRITTEN)), "shard")
    return dealt.withColumn("place", (F.row_number().over(Window.partitionBy("shard").orderBy("seq")) - 1).cast("int"))


def blocks_of(sections: DataFrame, question_weight: float = bm25.QUESTION_WEIGHT) -> DataFrame:
    """(shard, token, kind, places, tf, len, most, shortest): posting blocks of stored sections, built in Arrow batches."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SHARD):  # a part of a shard gives blocks of its own
                yield from of_part(batch.slice(lo, SHARD))

    def of_part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shard, place, length = (batch.column(c).to_numpy() for c in ("shard", "place", "len"))
        body = counted(batch.column("tokens"))
        if body is not None and "question_tokens" in batch.schema.names and (asked := counted(batch.column("question_tokens"))) is not None:
            at = {key: i for i, key in enumerate(zip(body[0].tolist(), body[1].to_pylist()))}
            for row, token, n in zip(asked[0].tolist(), asked[1].to_pylist(), asked[2].tolist()):
                body[2][at[row, token]] -= n * (1 - question_weight)
        for kind, part in ((BODY, body), (HEADING, counted(batch.column("heading_tokens")) if "heading_tokens" in batch.schema.names else None)):
            if part is not None:
                row, token, tf = part
                order = np.lexsort((place[row], rank_of(token.dictionary)[token.indices.to_numpy(zero_copy_only=False)], shard[row]))
                row, code, tf = row[order], token.indices.to_numpy(zero_copy_only=False)[order], tf[order]
                at = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (shard[row][1:] != shard[row][:-1])]))
                off = pa.array(np.append(at, len(row)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (place[row].astype(np.int32), tf, length[row].astype(np.int32))]
                columns = [pa.array(shard[row][at].astype(np.int32)), token.dictionary.take(pa.array(code[at])), pa.array(np.full(len(at), kind, np.int32)), *lists, pa.array(np.maximum.reduceat(tf, at)), pa.array(np.minimum.reduceat(length[row], at).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "token", "kind", "places", "tf", "len", "most", "shortest"])

    def rank_of(words: pa.Array) -> np.ndarray:
        """Each word's place in order: blocks of a shard are written by token."""
        rank = np.empty(len(words), np.int32)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words), dtype=np.int32)
        return rank

    def counted(column: pa.Array) -> tuple | None:
        """(row, token, times) of each row's distinct tokens."""
        tokens = pc.list_flatten(column).dictionary_encode()
        if not len(tokens):
            return None
        key = pc.list_parent_indices(column).to_numpy().astype(np.int64) * len(tokens.dictionary) + tokens.indices.to_numpy(zero_copy_only=False)
        key, times = np.unique(key, return_counts=True)
        code = pa.array((key % len(tokens.dictionary)).astype(np.int32))
        return key // len(tokens.dictionary), pa.DictionaryArray.from_arrays(code, tokens.dictionary), times.astype(np.float64)

    kept = [c for c in ("shard", "place", "len", "tokens", "question_tokens", "heading_tokens") if c in sections.columns]
    return sections.select(*kept).mapInArrow(build, "shard int, token string, kind int, places array<int>, tf array<double>, len array<int>, most double, shortest int")


class Index:
    """A stored index: ``sections`` (with shard, place, len), ``blocks``, ``terms`` (token, df) and one row of ``stats`` (n, total_len, shards).

    An index has parts, the one that was built and those of later changes; ``gone`` are (shard, place) of sections that were
    taken out. Terms and stats are those of the sections that are left.
    """

    def __init__(self, spark: SparkSession, parts: list[str]):
        self.spark, self.parts = spark, parts
        self.sections = self._all("sections")
        self.blocks = self._all("blocks")
        self.terms, self.stats = spark.read.parquet(f"{parts[-1]}/terms"), spark.read.parquet(f"{parts[-1]}/stats")
        self.gone = self._all("gone", parts[1:]) if len(parts) > 1 else None

    def _all(self, name: str, parts: list[str] | None = None) -> DataFrame:
        return self.spark.read.parquet(*(f"{p}/{name}" for p in (parts or self.parts)))

    # ------------------------------------------------------------ writing

    @classmethod
    def build(cls, sections: DataFrame, path: str, question_weight: float = bm25.QUESTION_WEIGHT) -> Index:
        """``sections``: id, seq, tokens and any of question_tokens, heading_path and further columns to filter by."""
        spark = sections.sparkSession
        write_part(sections, path, 0, question_weight)
        blocks = spark.read.parquet(f"{path}/blocks")
        write_terms(document_frequencies(blocks), path)
        totals(spark.read.parquet(f"{path}/sections")).coalesce(1).write.parquet(f"{path}/stats")
        return cls(spark, [path])

    def update(self, added: DataFrame, removed: DataFrame, path: str, question_weight: float = bm25.QUESTION_WEIGHT) -> Index:
        """The index without the ids of ``removed`` and with the sections of ``added``, as a further part at ``path``.

        A changed section is in both. Only added sections are tokenised and written; the frequencies and lengths of removed
        ones, which the index holds, are taken off its terms and statistics.
        """
        left = self.live().join(removed.select("id").distinct(), "id", "left_semi")
        left.select("shard", "place").write.parquet(f"{path}/gone")
        out = left.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg((-F.count("*")).alias("df"))
        shards = self.stats.first().shards
        write_part(added, path, shards, question_weight)
        fresh = self.spark.read.parquet(f"{path}/sections")
        change = self.terms.unionByName(out).unionByName(document_frequencies(self.spark.read.parquet(f"{path}/blocks")))
        write_terms(change.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0"), path)
        sums = self.stats.select("n", "total_len", F.lit(0).alias("shards")).unionByName(totals(left).select((-F.col("n")).alias("n"), (-F.col("total_len")).alias("total_len"), F.lit(0).alias("shards"))).unionByName(totals(fresh))
        # the part's own shards end where the next part's begin
        sums.agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len"), F.greatest(F.lit(shards), F.max("shards")).alias("shards")).coalesce(1).write.parquet(f"{path}/stats")
        return Index(self.spark, [*self.parts, path])

    def refresh(self, sections: DataFrame, path: str) -> Index:
        """The index of ``sections`` by way of what has changed: sections are compared by ``id`` and ``hash``, a column that both
        have; those with another hash are taken out and added, the others are neither tokenised nor written."""
        held = self.live().select("id", F.col("hash").alias("was"))
        both = sections.select("id", "hash").join(held, "id", "full").where("NOT (hash <=> was)")
        removed, added = both.where("was IS NOT NULL").select("id"), both.where("hash IS NOT NULL").select("id")
        return self.update(sections.join(bm25.sized(added), "id", "left_semi"), removed, path)

    # ------------------------------------------------------------ reading

    def live(self) -> DataFrame:
        return self.sections if self.gone is None else self.sections.join(self.gone, ["shard", "place"], "left_anti")

    def postings(self, words: DataFrame | None = None) -> DataFrame:
        """(id, seq, token, tf, len), a row for each posting of the sections that are there; only of the tokens of ``words`` if given."""
        blocks = self.blocks.where(F.col("kind") == BODY)
        if words is not None:
            blocks = blocks.join(bm25.sized(words), "token", "left_semi")
        each = blocks.select("shard", "token", F.explode(F.arrays_zip("places", "tf", "len")).alias("p"))
        each = each.select("shard", F.col("p.places").alias("place"), "token", "p.tf", "p.len")
        return each.join(self.live().select("shard", "place", "id", "seq"), ["shard", "place"]).select("id", "seq", "token", "tf", "len")

    def idf(self) -> DataFrame:
        """(token, df, idf) as scores use it."""
        return self.terms.crossJoin(F.broadcast(self.stats.select("n"))).select("token", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))

    def search(self, queries: DataFrame, k: int = 10, keep: Column | None = None) -> DataFrame:
        """(query_id, id, rank, score) of the ``k`` best sections of each query(query_id, text), as ``bm25.bm25_search`` ranks them.

        ``keep`` is a condition on the columns of the sections that a result has to meet; statistics are those of all.
        """
        return self.best(bm25.ask(queries), k, keep)

    def neighbours(self, k: int = 3, least: float = 1.0, asking: DataFrame | None = None) -> DataFrame:
        """(query_id, id, rank, score): for each section that is there, the ``k`` others of the highest score for its own whole
        tokens, of ``least`` or more. ``asking``, a table of ids, limits the sections that ask, not those that answer. Where all of
        them ask by bodies alone, blocks of sections meet blocks (``alike``), and no query is sent to every lane."""
        plain = not {"question_tokens", "heading_tokens"} & set(self.sections.columns)
        if asking is None and plain and alike.distinct_ids(self.live()):
            return alike.nearest(self.live(), k, least)
        own = self.live() if asking is None else self.live().join(bm25.sized(asking), "id", "left_semi")
        asked = own.select(F.col("id").alias("query_id"), F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
        return self.best(asked, k, None, least, own.select(F.col("id").alias("query_id"), F.col("shard").alias("own_shard"), F.col("place").alias("own_place")))

    def best(self, asked: DataFrame, k: int, keep: Column | None = None, least: float | None = None, own: DataFrame | None = None) -> DataFrame:
        """(query_id, id, rank, score) for asked(query_id, token, times); ``own`` names the section that a query stands for and does not find."""
        stats = self.stats.first()
        average = stats.total_len / stats.n if stats.n else 0.0
        kind = asked.schema["query_id"].dataType
        run = searcher(k, average, least, keep is not None or self.gone is not None, kind)
        found = self._met(asked, keep, own).mapInArrow(run, f"query_id {kind.simpleString()}, shard int, place int, score double")
        found = found.join(self.sections.select("shard", "place", "id", "seq"), ["shard", "place"])
        return bm25.top_k(found, k).select("query_id", "id", "rank", "score")

    def touched(self, asked: DataFrame) -> DataFrame:
        """(query_id, matches, touched) for asked(query_id, token, times): how often a query's tokens meet those of the sections, and in how many
        distinct ids. Counted in each shard, which holds all sections of an id; only the counts of a query and a shard leave a task."""
        kind = asked.schema["query_id"].dataType
        counts = self._met(asked, more=self._twins(False)).mapInArrow(searcher(0, 0.0, None, self.gone is not None, kind, True), f"query_id {kind.simpleString()}, matches long, touched long")
        return counts.groupBy("query_id").agg(F.sum("matches").alias("matches"), F.sum("touched").alias("touched"))

    def swept(self, asked: DataFrame, weights: tuple[float, ...]) -> DataFrame:
        """(weight, best, mean) for asked(query_id, token, times): the highest and the mean score of all queries and the ids that they touch, with each of
        ``weights`` in turn as the factor of how often a section has a token. Scores are summed in each shard, which holds all sections of an id;
        a shard's peaks and sums alone leave a task."""
        stats = self.stats.first()
        average = stats.total_len / stats.n if stats.n else 0.0
        run = searcher(0, average, None, self.gone is not None, asked.schema["query_id"].dataType, sweep=tuple(map(float, weights)))
        sums = self._met(asked, more=self._twins(True)).mapInArrow(run, "weight double, best double, total double, n long")
        return sums.groupBy("weight").agg(F.max("best").alias("best"), (F.sum("total") / F.sum("n")).alias("mean"))

    def _twins(self, none: bool) -> DataFrame:
        """Places of a shard whose sections share an id, each with the first of them; sections without an id are one with ``none``, else they stand for no place."""
        twins = self.live().groupBy("shard", "id").agg(F.array_sort(F.collect_list("place")).alias("places")).where("id IS NULL OR size(places) > 1")
        first = F.transform("places", lambda p: F.when(F.col("id").isNull() & F.lit(not none), -1).otherwise(F.get("places", F.lit(0))))
        return twins.select("shard", "places", first.alias("len"), F.lit(3).alias("step"))

    def _met(self, asked: DataFrame, keep: Column | None = None, own: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
        """Queries, the blocks of their words and masks, dealt and sorted as ``searcher`` reads them; ``more`` are further rows of shards."""
        weighed = asked.join(self.idf(), "token").select("query_id", "token", "times", (F.col("times") * F.col("idf")).alias("w"))
        if "heading_tokens" in self.sections.columns:  # a heading's words need no section that holds them
            weighed = asked.join(self.idf(), "token", "left").select("query_id", "token", "times", F.coalesce(F.col("times") * F.col("idf"), F.lit(0.0)).alias("w"))
        packed = weighed.groupBy("query_id").agg(*(F.collect_list(c).alias(c) for c in ("token", "w", "times")))
        packed = packed.join(own, "query_id") if own is not None else packed.withColumns({"own_shard": F.lit(None).cast("int"), "own_place": F.lit(None).cast("int")})
        stats = self.stats.first()
        lanes, groups = max(1, -(-stats.shards // LANE)), max(1, -(-packed.count() // QUERIES))
        every = lambda n, out: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(out)
        none = lambda kind: F.lit(None).cast(kind)
        question = packed.select(every(lanes, "lane"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), F.lit(-1).alias("shard"), F.lit(0).alias("step"), "query_id", "token", "w", F.col("times").cast("array<double>").alias("times"), "own_shard", "own_place", none("string").alias("word"), none("int").alias("kind"), none("array<int>").alias("places"), none("array<double>").alias("tf"), none("array<int>").alias("len"), none("double").alias("most"), none("int").alias("shortest"))
        shape = {f.name: f.dataType for f in question.schema}
        fill = lambda rows: rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in shape.items()))
        lane = F.pmod(F.xxhash64("shard"), F.lit(lanes)).cast("int").alias("lane")
        words = bm25.sized(asked.select("token").distinct())
        blocks = self.blocks.join(words, "token", "left_semi").select("shard", F.col("token").alias("word"), "kind", "places", "tf", "len", "most", "shortest", lane, F.lit(1).alias("step"), every(groups, "group"))
        rows = question.unionByName(fill(blocks))
        if keep is not None or self.gone is not None:
            left = self.live() if keep is None else self.live().where(keep)
            masks = left.groupBy("shard").agg(F.collect_list("place").alias("places")).select("shard", "places", lane, F.lit(2).alias("step"), every(groups, "group"))
            rows = rows.unionByName(fill(masks))
        if more is not None:
            rows = rows.unionByName(fill(more.withColumns({"lane": F.pmod(F.xxhash64("shard"), F.lit(lanes)).cast("int"), "group": every(groups, "group")})))
        # the tasks follow the cells: what one sorts does not grow with the input
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(lanes * groups, CELLS))
        return rows.repartition(tasks, "lane", "group").sortWithinPartitions("lane", "group", "shard", "step")


def write_part(sections: DataFrame, path: str, first_shard: int, question_weight: float) -> None:
    """Sections and their blocks; a section without tokens (null) is an empty one."""
    empty = F.expr("CAST(array() AS array<string>)")
    sections = sections.withColumns({c: F.coalesce(c, empty) for c in ("tokens", "question_tokens") if c in sections.columns})
    if "heading_path" in sections.columns:
        sections = sections.withColumn("heading_tokens", F.array_distinct(tokenize(F.array_join("heading_path", " "))))
    sections = in_shards(sections.withColumn("len", F.size("tokens")), first_shard)
    sections.write.parquet(f"{path}/sections")  # as the ranks leave them: by shard and place
    stored = sections.sparkSession.read.parquet(f"{path}/sections")
    blocks_of(stored, question_weight).write.parquet(f"{path}/blocks")


def document_frequencies(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("kind") == BODY).groupBy("token").agg(F.sum(F.size("places")).alias("df"))


def write_terms(terms: DataFrame, path: str) -> None:
    """Terms in token order, so that equal indices are equal files."""
    terms.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/terms")


def totals(sections: DataFrame) -> DataFrame:
    return sections.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("total_len"), (F.coalesce(F.max("shard"), F.lit(-1)) + 1).alias("shards"))


class Shard:
    """The asked tokens' posting lists of one shard, end to end."""

    def __init__(self, code: np.ndarray, kind: np.ndarray, places: list[np.ndarray], weight: list[np.ndarray], bound: np.ndarray, tokens: int):
        size = np.array([len(p) for p in places])
        self.start, self.size = np.cumsum(size) - size, size
        self.places = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.weight = np.concatenate(weight) if weight else np.zeros(0)
        self.bound, self.kind = bound, kind
        self.n = int(self.places.max(initial=-1)) + 1
        order = np.argsort(code, kind="stable")
        self.by_code, self.at = order, np.searchsorted(code[order], np.arange(tokens + 1))

    def lists_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the query's tokens, and of each the position of its token in the query."""
        lo, n = self.at[codes], self.at[codes + 1] - self.at[codes]
        which = np.repeat(np.arange(len(codes)), n)
        return self.by_code[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], which

    def met(self, codes: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every posting of the query's tokens in a body, and the factor of its token."""
        lists, which = self.lists_of(codes)
        lists, which = lists[self.kind[lists] == BODY], which[self.kind[lists] == BODY]
        size = self.size[lists]
        at = np.repeat(self.start[lists] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return at, np.repeat(factor[which], size)

    def add(self, total: np.ndarray, lists: np.ndarray, factor: np.ndarray) -> None:
        size = self.size[lists]
        at = np.repeat(self.start[lists] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        total += np.bincount(self.places[at], self.weight[at] * np.repeat(factor, size), self.n)

    def best(self, codes: np.ndarray, w: np.ndarray, times: np.ndarray, bar: float, k: int, allowed: np.ndarray | None, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all sections that can be among the ``k`` best and reach ``bar``; scores are whole."""
        lists, which = self.lists_of(codes)
        factor = np.where(self.kind[lists] == HEADING, times[which] * bm25.HEADING_BOOST, w[which])
        most = factor * self.bound[lists]
        order = np.argsort(-most, kind="stable")
        lists, factor = lists[order], factor[order]
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)  # what the lists from here on can add
        none = np.zeros(0, np.int64), np.zeros(0)
        if rest[0] < bar - ROOM or not len(lists):
            return none
        total, done = np.zeros(self.n), 0
        shut = np.zeros(self.n, bool) if allowed is None else ~np.isin(np.arange(self.n), allowed)
        if own is not None and own < self.n:
            shut[own] = True
        while True:
            need = int(np.searchsorted(-rest, -(bar - ROOM), "right")) if bar > -np.inf else len(lists)
            to = min(len(lists), max(need, done) if bar > -np.inf else max(8, 2 * done))
            if to > done:
                self.add(total, lists[done:to], factor[done:to])
                done = to
            seen = np.where(shut, -np.inf, total)
            if self.n > k:
                bar = max(bar, float(np.partition(seen, self.n - k)[self.n - k]))
            if done == len(lists) or bar > -np.inf and rest[done] < bar - ROOM:
                break
        alive = np.flatnonzero((seen + rest[done] >= bar - ROOM) & (total > 0) & ~shut)
        if not len(alive):
            return none
        if done < len(lists):
            self.add(total, lists[done:], factor[done:])
        alive = alive[total[alive] >= bar - ROOM]
        return alive, total[alive]


def searcher(k: int, average: float, least: float | None, masked: bool, query_type, count: bool = False, sweep: tuple[float, ...] = ()):
    """The task of ``Index.best``: queries of a lane come first, then one shard after the other, its blocks before its mask. With ``count`` that of ``Index.touched``, with ``sweep`` that of ``Index.swept``."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(query_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, held = None, None, []
        for part in groups(batches):
            here = (part.column("lane")[0].as_py(), part.column("group")[0].as_py())
            if here != key:
                key, queries = here, None
            if part.column("shard")[0].as_py() < 0:
                queries = Queries(part)
            elif queries is not None:
                held = queries.ask(part)
                if held and count:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), (arrow_type, pa.int64(), pa.int64()))], ["query_id", "matches", "touched"])
                elif held and sweep:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), (pa.float64(), pa.float64(), pa.float64(), pa.int64()))], ["weight", "best", "total", "n"])
                elif held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), (arrow_type, pa.int32(), pa.int32(), pa.float64()))], ["query_id", "shard", "place", "score"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of one lane, group and shard at a time."""
        held = []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("lane", "group", "shard")])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cut, cut[1:]):
                if hi > lo:
                    if held and not all(held[-1].column(c)[0].as_py() == batch.column(c)[lo].as_py() for c in ("lane", "group", "shard")):
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held)

    class Queries:
        def __init__(self, part: pa.Table):
            self.ids = part.column("query_id").to_pylist()
            words = part.column("token").combine_chunks().flatten().dictionary_encode()
            words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            self.code = {t: i for i, t in enumerate(words.dictionary.to_pylist())}
            n = part.column("token").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            cut = np.cumsum(n)[:-1]
            flat = lambda c: part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            self.codes, self.w, self.times = (np.split(x, cut) for x in (words.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat("w"), flat("times")))
            self.own = list(zip(part.column("own_shard").to_pylist(), part.column("own_place").to_pylist()))
            self.top = [np.full(k, -np.inf if least is None else least) for _ in self.ids]

        def ask(self, part: pa.Table) -> list[tuple]:
            number, step = part.column("shard")[0].as_py(), part.column("step").to_numpy()
            allowed = None
            if masked:
                allowed = part.filter(pa.array(step == 2)).column("places").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            twins = part.filter(pa.array(step == 3)) if count or sweep else None
            part = part.filter(pa.array(step == 1))
            if not part.num_rows:
                return []
            code = np.array([self.code.get(t, -1) for t in part.column("word").to_pylist()])
            part, code = part.filter(pa.array(code >= 0)), code[code >= 0]
            if not len(code):
                return []
            kind = part.column("kind").to_numpy()
            split = lambda c: np.split(part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.cumsum(part.column("places").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))[:-1])
            norm = (lambda n: 1 - bm25.B + bm25.B * n / average) if average > 0 else (lambda n: np.ones(len(n)))
            weigh = lambda tf, n: tf if count or sweep else tf * (bm25.K1 + 1) / (tf + bm25.K1 * norm(n))
            weight = [np.ones(len(t)) if h == HEADING else weigh(t, n) for t, n, h in zip(split("tf"), split("len"), kind)]
            bound = np.where(kind == HEADING, 1.0, weigh(part.column("most").to_numpy(), part.column("shortest").to_numpy()))
            shard = Shard(code, kind, split("places"), weight, bound, len(self.code))
            out = []
            if count or sweep:
                first = np.arange(shard.n)
                for places, firsts in zip(twins.column("places").to_pylist(), twins.column("len").to_pylist()):
                    for p, q in zip(places, firsts):
                        if p < shard.n:  # others hold no asked word
                            first[p] = min(q, p)
                there = np.ones(shard.n, bool) if allowed is None else np.isin(np.arange(shard.n), allowed)
            if sweep:
                length = np.concatenate(split("len"))
                parts = [w * shard.weight * (bm25.K1 + 1) / (w * shard.weight + bm25.K1 * norm(length)) for w in sweep]
                best, total, n = np.full(len(sweep), -np.inf), np.zeros(len(sweep)), 0
                for i, codes in enumerate(self.codes):
                    at, w = shard.met(codes, self.w[i])
                    at, w = (x[there[shard.places[at]]] for x in (at, w))
                    if len(at):
                        to = first[shard.places[at]]
                        seen = np.unique(to)
                        sums = np.stack([np.bincount(to, part[at] * w)[seen] for part in parts])
                        best, total, n = np.maximum(best, sums.max(axis=1)), total + sums.sum(axis=1), n + len(seen)
                return [(w, float(b), float(t), n) for w, b, t in zip(sweep, best, total)] if n else []
            if count:
                for i, codes in enumerate(self.codes):
                    at, times = shard.met(codes, self.times[i])
                    at, times = (x[there[shard.places[at]]] for x in (at, times))
                    places, tf = shard.places[at], shard.weight[at]
                    seen = np.unique(first[places])
                    if len(places):
                        out.append((self.ids[i], int(np.trunc(tf * times).sum()), int((seen >= 0).sum())))
                return out
            for i, codes in enumerate(self.codes):
                own = self.own[i][1] if self.own[i][0] == number else None
                places, scores = shard.best(codes, self.w[i], self.times[i], float(self.top[i].min()), k, allowed, own)
                if len(places):
                    order = np.lexsort((places, -np.round(scores, 9)))[:k]
                    out += [(self.ids[i], number, int(places[j]), float(scores[j])) for j in order]
                    self.top[i] = np.sort(np.concatenate([self.top[i], scores[order]]))[-k:]
            return out

    return run
