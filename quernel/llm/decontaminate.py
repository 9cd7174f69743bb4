"""Benchmark decontamination by latent semantic retrieval.

Inverse document frequencies come from all documents. A distributed randomised singular value decomposition
of the benchmark's TF-IDF passages gives a latent space. Windows of every document, as wide as the
passages of a width class, that hold as many of a passage's rarest words as a leak must, are projected into it and
compared by cosine with that passage. What the latent dimensions leave out of the window and of the passage is
bounded, so that no pair is lost whatever their number; candidates are checked by their longest common subsequence
of words, by that of the passage's answer, its last quarter, and by the cosine of all words. So paraphrases are found
as well as verbatim copies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BY_LETTER, by_bytes, map_text, runs, without, word_hashes

#: Hashed places of document frequencies: the size of all that comes to the driver from the corpus.
PLACES = 1 << 16
#: Latent dimensions, and further ones of the random sketch.
RANK, MORE = 192, 16
#: Least cosine, least shares of words in order.
COSINE, COMMON, ANSWER = 0.2, 0.6, 0.5
NARROWEST = 8
#: Most passages, and bytes of passages, that are searched for at once: they bound what a search sends to each worker.
PASSAGES, PASSAGE_BYTES = 4096, 1 << 20
#: Of a passage's n words, n // FEW + 1 of the rarest must be found by whoever finds the share COMMON of all.
FEW = 7


def place(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(48)).astype(np.int64)


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold a word of each hashed place, and documents with a word, over the whole table."""

    def run(batches):
        count, rows = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            for part in by_bytes(batch, "text"):
                word, row, _, _ = word_hashes(part.column("text"), BY_LETTER)
                own = np.unique(row * PLACES + place(word))
                count += np.bincount(own % PLACES, minlength=PLACES)
                rows += len(np.unique(row))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*count[at].tolist(), rows], pa.int64())], names=["place", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    count, at = np.zeros(PLACES, np.int64), got["place"].to_numpy()
    n = got["n"].to_numpy()
    count[at[at >= 0]] = n[at >= 0]
    return count, int(n[at < 0].sum())


@dataclass
class Latent:
    """The search side: benchmark words, their latent vectors, and the passages."""

    idf: np.ndarray  # by place, float32
    words: np.ndarray  # sorted hashes of the benchmark's words
    basis: np.ndarray  # words x rank, float32
    items: np.ndarray  # item ids
    texts: list[np.ndarray]  # word hashes of each item
    vectors: np.ndarray  # items x rank, projections of the items' vectors of length one
    width: np.ndarray  # width class of each item

    def __post_init__(self):
        #: What the latent space leaves out of each item's vector, its length, with room for rounding.
        self.left_out = np.sqrt(np.maximum(0, 1 - (self.vectors.astype(np.float64) ** 2).sum(1)) + 1e-6)
        #: Each item's words as places in ``words`` and weights of length one.
        self.weights = []
        rare, self.need = [], np.zeros(len(self.texts), np.int64)
        for i, text in enumerate(self.texts):
            at, n = np.unique(np.searchsorted(self.words, text), return_counts=True)
            weight = n * self.idf[place(self.words[at])].astype(np.float64)
            self.weights.append((at, weight / max(1e-12, np.linalg.norm(weight))))
            found, self.need[i] = rare_words(self.words, self.idf, text)
            rare.append(found)
        #: The items of each of the words that is among their rarest.
        word = np.concatenate([*rare, np.zeros(0, np.int64)])
        item = np.repeat(np.arange(len(rare)), [len(r) for r in rare])
        order = np.argsort(word, kind="stable")
        self.rare_item = item[order]
        self.rare_from = np.searchsorted(word[order], np.arange(len(self.words) + 1))


def rare_words(words: np.ndarray, idf: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of a passage's rarest words, and how many of them a text must hold that holds the share COMMON of the passage.

    Of n words at least m are found; n - m + k of them are taken, so at least k of these are among the found ones.
    """
    n = len(text)
    m = int(np.argmax(np.arange(n + 1) / n >= COMMON))
    k = min(m, n // FEW + 1)
    order = np.lexsort((text, -idf[place(text)]))
    return np.unique(np.searchsorted(words, text[order[: n - m + k]])), k


def latent_space(benchmark: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Words (sorted hashes) and an orthonormal basis (words x rank) of the leading right singular space of the passages.

    Each partition of passages A multiplies its rows by a random matrix and by their own transpose, so that
    the sum over partitions is A'A times the random matrix: one power iteration, with sums combined by word.
    """

    def sketch(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            word, row, _, _ = word_hashes(batch.column("text"), BY_LETTER)
            for r in np.unique(row):
                own, n = np.unique(word[row == r], return_counts=True)
                weight = n * idf[place(own)]
                weight = weight / max(1e-12, np.linalg.norm(weight))
                y = weight @ random_rows(own, rank + MORE)
                for w, v in zip(own.tolist(), weight):
                    total[w] = total.get(w, 0) + v * y
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), np.uint64).view(np.int64)), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["word", "part"])

    def added(batches):
        for part in runs(batches, ["word"]):
            word = part.column("word").to_numpy()
            value = np.stack([np.frombuffer(v, np.float64) for v in part.column("part").to_pylist()])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            value = np.add.reduceat(value, first)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array([v.tobytes() for v in value], pa.binary())], names=["word", "part"])

    rows = benchmark.select("text").where("text IS NOT NULL")
    sums = rows.mapInArrow(sketch, "word long, part binary").repartition("word").sortWithinPartitions("word").mapInArrow(added, "word long, part binary").toArrow()
    word = sums["word"].to_numpy().view(np.uint64)
    order = np.argsort(word)
    if not len(word):
        return word, np.zeros((0, 1), np.float32)
    y = np.stack([np.frombuffer(v, np.float64) for v in sums["part"].to_pylist()])[order]
    value, side = np.linalg.eigh(y.T @ y)
    keep = np.flatnonzero(value > 1e-12 * value[-1])[::-1][:rank]
    return word[order], (y @ side[:, keep] / np.sqrt(value[keep])).astype(np.float32)


def random_rows(word: np.ndarray, width: int) -> np.ndarray:
    """The random matrix's rows of some words: signs drawn from the words' hashes, the same everywhere."""
    out = np.empty((len(word), width))
    with np.errstate(over="ignore"):
        for j in range(0, width, 64):
            x = (word + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(32))
            take = min(64, width - j)
            out[:, j : j + take] = ((x[:, None] >> np.arange(take, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of words, by bits."""
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        if (m := at.get(w)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def weights_of(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Inverse document frequency by hashed place, over all documents."""
    count, n = document_frequency(docs, text_col)
    return np.log((n + 1) / (count + 1) + 1e-9).clip(0.01).astype(np.float32)


def prepare(idf: np.ndarray, benchmark: DataFrame) -> Latent:
    """The search side of one block of benchmark(item_id, text)."""
    words, basis = latent_space(benchmark, idf)
    items, texts, vectors = [], [], []
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("id"), "text").toArrow()
    for i, text in zip(rows["id"].to_pylist(), rows["text"].to_pylist()):
        word = word_hashes(pa.array([text]), BY_LETTER)[0]
        if len(word):
            own, n = np.unique(word, return_counts=True)
            weight = n * idf[place(own)]
            items.append(i), texts.append(word), vectors.append(weight @ basis[np.searchsorted(words, own)] / max(1e-12, np.linalg.norm(weight)))
    width = [max(NARROWEST, 1 << max(0, len(t) - 1).bit_length()) for t in texts]
    return Latent(idf, words, basis, np.array(items, np.int64), texts, np.array(vectors, np.float32).reshape(len(items), basis.shape[1]), np.array(width, np.int64))


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """Parts of benchmark(item_id, text), by a hash of their rows, of about the bound's passages and bytes; one longer passage is a part of its own size."""
    rows, size = benchmark.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, -(-rows // PASSAGES), -(-(size or 0) // PASSAGE_BYTES))
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [benchmark]


def windows(start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the windows of each row's words start..end: every quarter of the width, the last one flush with the end."""
    step = max(1, width // 4)
    n = end - start
    count = np.where(n > 0, np.maximum(1, -(-(n - width) // step) + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    lo = start[row] + np.minimum(k * step, np.maximum(0, n[row] - width))
    return row, lo, np.minimum(lo + width, end[row])


def places_with(pos: np.ndarray, item: np.ndarray, row: np.ndarray, need: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first, last) of each ``need[item]`` successive finds of an item's words in one row that lie within a span."""
    order = np.argsort(item, kind="stable")
    pos, item = pos[order], item[order]
    to = np.arange(len(pos)) + need[item] - 1
    at = np.flatnonzero(to < len(pos))
    to = to[at]
    ok = (item[at] == item[to]) & (row[pos[at]] == row[pos[to]]) & (pos[to] - pos[at] < span)
    return item[at[ok]], pos[at[ok]], pos[to[ok]]


def search(part: pa.RecordBatch, m: Latent) -> list[tuple[int, int, int, float, float, float]]:
    """(row, item id, first word, cosine, share of the item's words in order, share of its answer's) of one batch; the best of each row and item."""
    word, row, _, _ = word_hashes(part.column("text"), BY_LETTER)
    if not len(word) or not len(m.items):
        return []
    bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
    weight = m.idf[place(word)]
    at = np.minimum(np.searchsorted(m.words, word), len(m.words) - 1)
    known = m.words[at] == word
    total = np.append(0, np.cumsum(weight.astype(np.float64) ** 2))
    place_of = np.flatnonzero(known)
    known_at, idf = at[place_of], m.idf[place(m.words)].astype(np.float64)
    # finds of the items' rarest words, in order of place
    count = m.rare_from[known_at + 1] - m.rare_from[known_at]
    pos = np.repeat(place_of, count)
    item = m.rare_item[np.repeat(m.rare_from[known_at] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    best: dict[tuple[int, int], tuple] = {}
    for width in np.unique(m.width).tolist():
        beside, step = width // 4, max(1, width // 4)
        r, lo, hi = windows(bounds[:-1], bounds[1:], width)
        first_of = np.searchsorted(r, np.arange(part.num_rows + 1))
        # the windows that see those finds with a quarter of the width on each side: no other can hold the wanted share of an item
        ours = m.width[item] == width
        j, first, last = places_with(pos[ours], item[ours], row, m.need, width + 2 * beside)
        doc = row[first]
        from_ = first_of[doc] + np.maximum(0, (last - beside - width - bounds[doc]) // step)
        many = width // step + 4
        w = (from_[:, None] + np.arange(many)).ravel()
        j, first, last, end = (np.repeat(x, many) for x in (j, first, last, first_of[doc + 1]))
        ok = w < end
        w, j, first, last = w[ok], j[ok], first[ok], last[ok]
        ok = (lo[w] - beside <= first) & (last < hi[w] + beside)
        pair = np.unique(w[ok] * len(m.items) + j[ok])
        w, j = pair // len(m.items), pair % len(m.items)
        mass = total[hi] - total[lo]
        for a in range(0, len(w), 8192):
            some, back = np.unique(w[a : a + 8192], return_inverse=True)
            z, left_out = np.zeros((len(some), m.basis.shape[1]), np.float32), np.zeros(len(some))
            for i, (p, q) in enumerate(zip(np.searchsorted(place_of, lo[some]).tolist(), np.searchsorted(place_of, hi[some]).tolist())):
                own, n = np.unique(known_at[p:q], return_counts=True)
                tf_idf = n * idf[own]
                z[i] = tf_idf.astype(np.float32) @ m.basis[own]
                left_out[i] = tf_idf @ tf_idf
            left_out = np.sqrt(np.maximum(0, left_out - (z.astype(np.float64) ** 2).sum(1)) + 1e-6 * left_out)
            b = j[a : a + 8192]
            near = np.einsum("ij,ij->i", z[back], m.vectors[b]) + left_out[back] * m.left_out[b]
            for i in np.flatnonzero(near >= (COSINE - 1e-6) * np.sqrt(mass[some][back])).tolist():
                at_, own = int(w[a + i]), int(b[i])
                doc, id_, text = int(r[at_]), int(m.items[own]), m.texts[own]
                if (old := best.get((doc, id_))) is not None and old[4] == 1:
                    continue
                from_, to = max(bounds[doc], lo[at_] - beside), min(bounds[doc + 1], hi[at_] + beside)
                share = common_words(text, word[from_:to]) / len(text)
                if share < COMMON:
                    continue
                tail = text[-max(1, math.ceil(len(text) / 4)) :]
                answer = common_words(tail, word[from_:to]) / len(tail)
                if answer < ANSWER:
                    continue
                cosine = exact_cosine(at[lo[at_] : hi[at_]][known[lo[at_] : hi[at_]]], idf, mass[at_], *m.weights[own])
                if cosine >= COSINE and (old is None or (share, answer, cosine) > (old[4], old[5], old[3])):
                    best[doc, id_] = (doc, id_, int(from_ - bounds[doc]), cosine, share, answer)
    return list(best.values())


def exact_cosine(window: np.ndarray, idf: np.ndarray, mass: float, own: np.ndarray, weight: np.ndarray) -> float:
    """Of a window's known words, as places of words, with an item's words and weights; ``mass`` is the window's squared weight."""
    at = np.minimum(np.searchsorted(own, window), len(own) - 1)
    held = own[at] == window
    return float(idf[window[held]] @ weight[at[held]] / max(1e-12, math.sqrt(mass)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents that hold a benchmark passage: (id, item_id, at_word, cosine, common, answer), a row for each document and passage.

    ``common`` is the share of the passage's words found in order, ``answer`` that of its last quarter. Words
    are runs of letters and digits in lower case. Of several places of a passage in a document that of the
    greatest shares, then of the greatest cosine, then the first is told. Null and empty texts and passages
    match nothing; null item ids are left out, null ids kept. Repeated rows give one row each, of either side
    (passages of equal id and text one); an empty table on either side gives none; other columns are ignored.
    A large benchmark is searched for in blocks, each a pass over all documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    idf = weights_of(docs, text_col)

    def found(block: DataFrame) -> DataFrame:
        model = spark.sparkContext.broadcast(prepare(idf, block))

        def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
            got = search(part, model.value)
            if not got:
                return None
            r, item, at, cosine, common, answer = zip(*got)
            return pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(r)), pa.array(item, pa.int64()), pa.array(at, pa.int64()), pa.array(cosine, pa.float64()), pa.array(common, pa.float64()), pa.array(answer, pa.float64())],
                names=["id", "item_id", "at_word", "cosine", "common", "answer"],
            )

        return map_text(rows, "text", run, f"id {kind}, item_id long, at_word long, cosine double, common double, answer double")

    parts = blocks(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")))
    return reduce(DataFrame.unionByName, map(found, parts)).withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that hold a benchmark passage; all columns, null ids included, stay."""
    return without(docs, find_leaks(docs, benchmark, id_col, text_col).select(id_col), id_col)
