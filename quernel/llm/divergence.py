"""How far the sources of a language differ in their words, by joint count histograms.

Terms are counted once, in Arrow batches. For two sources only how often each pair (count here, count there) occurs among the
kept terms is needed: the difference of their shares is evaluated once for each such pair and taken as often as it occurs.
All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, deal_blocks, join_counted, materialize, release, runs, small, text_bytes, word_hashes

#: Bytes of a term: ASCII letters and every byte of a non-ASCII character.
BY_TERM = np.zeros(256, bool)
BY_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Distinct (group, term) counts that a task gathers before it passes them on.
GATHERED = 1 << 19
#: Sources of a block and terms of a slice: a task compares two blocks over one slice at a time.
BLOCK, SLICE = 32, 4096
UNIT, PRIOR = 1_000_000_000, 5


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total) without overflow: the factor is taken in two steps, the remainder kept between them."""
    first, rest = 10_000, UNIT // 10_000
    div = lambda x: F.call_function("div", x, total)
    return div(count * first) * rest + div((count * first % total) * rest) + 1


def share_array(count: np.ndarray, total: int) -> np.ndarray:
    first, rest = 10_000, UNIT // 10_000
    whole, left = np.divmod(count * first, total)
    return whole * rest + left * rest // total + 1


# ---------------------------------------------------------------- counting


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a row with null term for each group.

    A term is a maximal run of ASCII letters and non-ASCII characters, A to Z in lower case. Nulls are empty strings; each row
    is a document. Counts are gathered in a task before they are exchanged, so that a source of very many rows is no hot key.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held, size = [], 0
        for batch in batches:
            for part in by_bytes(batch, "text"):
                number = np.array([groups.setdefault(g, len(groups)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())], dtype=np.int64)
                held.append(of_slice(part.column("text"), number))
                size += len(held[-1][0])
                if size > GATHERED:
                    held, size = [merged(held)], 0
                    if len(held[0][0]) > GATHERED // 2:
                        yield rows(held[0], list(groups))
                        held, groups = [], {}
                    else:
                        size = len(held[0][0])
        if groups:
            yield rows(merged(held), list(groups))
        release()

    def of_slice(texts: pa.Array, number: np.ndarray) -> tuple:
        """(group, hash, occurrences, documents, term) of each distinct pair of group and term; groups themselves as hash 0, no term."""
        texts = pc.ascii_lower(texts)
        word, row, start, end = word_hashes(texts, BY_TERM, lower=False)
        own = np.unique(number)
        if not len(word):
            return own, np.zeros(len(own), np.uint64), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), pa.array([None] * len(own), pa.string())
        order = np.lexsort((row, word))
        word, row, start, end = word[order], row[order], start[order], end[order]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(word)))  # of each document and term
        word, group, start, end = word[at], number[row[at]], start[at], end[at]
        order = np.lexsort((word, group))
        word, group, start, end, n = word[order], group[order], start[order], end[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (group[1:] != group[:-1])]))
        data, _ = text_bytes(texts)
        terms = spans(data, start[at], end[at])
        none = np.zeros(len(own), np.int64)
        return (
            np.concatenate([own, group[at]]),
            np.concatenate([none.astype(np.uint64), word[at]]),
            np.concatenate([none, np.add.reduceat(n, at)]),
            np.concatenate([none, np.diff(np.append(at, len(word)))]),
            pa.concat_arrays([pa.array([None] * len(own), pa.string()), terms]),
        )

    def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The strings data[start:end], without a loop."""
        size = end - start
        off = np.concatenate([[0], np.cumsum(size)])
        chars = data[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
        return pa.StringArray.from_buffers(len(start), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(chars.tobytes()))

    def merged(parts: list[tuple]) -> tuple:
        if len(parts) == 1:
            return parts[0]
        group, word, n, seen = (np.concatenate([p[i] for p in parts]) for i in range(4))
        terms = pa.concat_arrays([p[4] for p in parts])
        order = np.lexsort((word, group))
        group, word = group[order], word[order]
        at = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (group[1:] != group[:-1])]))
        return group[at], word[at], np.add.reduceat(n[order], at), np.add.reduceat(seen[order], at), terms.take(pa.array(order[at]))

    def rows(part: tuple, groups: list[tuple[str, str]]) -> pa.RecordBatch:
        lang, source = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(part[0])) for i in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, part[4], pa.array(part[2]), pa.array(part[3])], ["lang", "source", "term", "n", "docs"])

    plain = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text")))
    parts = docs.select(*plain).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- pairs of sources


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, other, value), g < other: the summed difference of the shares of all kept terms, for the groups of each language.

    ``counts``: (lang_id, g, term, n); ``groups``: (lang_id, g, terms, total, sources), every group, those without counts
    included. The terms of a language are cut into slices and its groups into blocks; a task has the counts of two blocks in
    one slice, tallies the joint counts of each pair and evaluates the difference once for each. Where a term is counted in
    neither source, its share of zero counts is added once for all such terms.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, ["lang_id", "slice", "bi", "bj"]):
            keys = np.stack([batch.column(c).to_numpy() for c in ("lang_id", "slice", "bi", "bj")])
            cut = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            for lo, hi in zip(cut, [*cut[1:], batch.num_rows]):
                if (out := block(batch.slice(lo, hi - lo))) is not None:
                    yield out
        release()

    def block(part: pa.RecordBatch) -> pa.RecordBatch | None:
        g, n, blk = (part.column(c).to_numpy() for c in ("g", "n", "blk"))
        bi, bj = part.column("bi")[0].as_py(), part.column("bj")[0].as_py()
        member, first, row = np.unique(g, return_index=True, return_inverse=True)
        kept = np.flatnonzero(n > 0)  # rows without a count only name the group
        coded = part.column("term").take(pa.array(kept)).dictionary_encode()
        width = len(coded.dictionary)
        table = np.zeros((len(member), width), np.int64)
        table[row[kept], coded.indices.to_numpy(zero_copy_only=False)] = n[kept]
        terms, total = part.column("terms")[0].as_py(), part.column("total").to_numpy()
        marks = np.flatnonzero(n == 0)
        mass = np.zeros(len(member), np.int64)
        mass[row[marks]] = total[marks] + PRIOR * terms
        # each count of the slice is a code, so that a pair of counts is one small number
        level, code = np.unique(table, return_inverse=True)
        code = code.reshape(table.shape)
        shares = np.stack([share_array(level + PRIOR, int(m)) for m in mass]) if terms else np.zeros((len(member), len(level)), np.int64)
        side = blk[first]
        out = []
        for x in range(len(member)):
            for y in range(x + 1, len(member)):
                if bi != bj and side[x] == side[y]:
                    continue
                pairs, times = np.unique(code[x] * len(level) + code[y], return_counts=True)
                cx, cy = pairs // len(level), pairs % len(level)
                some = (level[cx] > 0) | (level[cy] > 0)
                value = int((np.abs(shares[x, cx] - shares[y, cy]) * times)[some].sum())
                out.append((member[x], member[y], value, int(times[some].sum())))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["g", "other", "value", "nonzero"])

    slices = F.greatest(F.ceil(F.col("terms") / F.lit(SLICE)), F.lit(1)).cast("int")
    marks = groups.select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    about = groups.select("lang_id", "g", "terms", "total", "sources")
    own = counts.join(small(about, 64), ["lang_id", "g"]).withColumn("slice", F.pmod(F.xxhash64("term"), slices).cast("int"))
    dealt = deal_blocks(own.unionByName(marks.select(own.columns)), ["lang_id", "slice"], "sources", "g", BLOCK)
    parts = dealt.select("lang_id", "slice", "bi", "bj", "blk", "g", "term", "n", "terms", "total").mapInArrow(compared, "g long, other long, value long, nonzero long")
    parts = parts.groupBy("g", "other").agg(F.sum("value").alias("value"), F.sum("nonzero").alias("nonzero"))
    mass = small(about.select("g", "terms", (F.col("total") + PRIOR * F.col("terms")).alias("mass")), 40)
    parts = parts.join(mass, "g").join(mass.select(F.col("g").alias("other"), F.col("mass").alias("other_mass")), "other")
    neither = F.abs(share(F.lit(PRIOR).cast("long"), F.col("mass")) - share(F.lit(PRIOR).cast("long"), F.col("other_mass")))
    rest = F.when(F.col("terms") > 0, (F.col("terms") - F.col("nonzero")) * neither).otherwise(0)
    return parts.select("g", "other", (F.col("value") + rest).alias("value"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its language, and by which terms.

    A language keeps the terms that stand in at least ``least_docs`` of its documents. A group (lang, source) and a language
    give a kept term the share 1 + floor(10**9 * (count + 5) / (N + 5 V)) of its N kept occurrences and V kept terms. Part
    ``pair``: for each other source of the language the difference of shares summed over all kept terms (0 without kept
    terms). Part ``term``: the terms that the group counts and has a larger share of than the language, the ``top`` largest
    differences. Ranks ascend by value descending, then item in the order of UTF-8 bytes. Null text, language and source are
    empty strings; each row is a document, repeated ones too; groups without terms take part; an empty table has no rows.
    """
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count("*").alias("rows"))
    kept = materialize(kept.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n", "rows"), "kept")
    langs = counts.where("term IS NULL").groupBy("lang").agg(F.count("*").alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    langs = materialize(langs.na.fill(0, ["terms", "lang_total"]).withColumn("lang_id", F.monotonically_increasing_id()), "langs")
    own = join_counted(counts.where("term IS NOT NULL").select("lang", "source", "term", "n"), kept, ["lang", "term"], "rows")
    own = materialize(own.select("lang", "source", "term", "n", "lang_n"), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = join_counted(counts.where("term IS NULL").select("lang", "source"), langs, "lang", "sources").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    groups = materialize(groups.withColumn("g", F.monotonically_increasing_id()), "groups")
    about = small(groups.select("lang", "source", "lang_id", "g", "terms", "total", "lang_total"), 128)
    own = own.join(about, ["lang", "source"])

    value = pair_values(own.select("lang_id", "g", "term", "n"), groups.select("lang_id", "g", "terms", "total", "sources"))
    value = value.select(F.explode(F.array(F.struct("g", "other"), F.struct(F.col("other").alias("g"), F.col("g").alias("other")))).alias("p"), "value").select("p.g", "p.other", "value")
    names = small(groups.select("g", "lang", "source"), 96)
    pairs = value.join(names, "g").join(names.select(F.col("g").alias("other"), F.col("source").alias("item")), "other")

    mass = lambda total: F.col(total) + PRIOR * F.col("terms")
    excess = share(F.col("n") + PRIOR, mass("total")) - share(F.col("lang_n") + PRIOR, mass("lang_total"))
    terms = own.where("n > 0").select("lang", "source", F.col("term").alias("item"), excess.alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))
