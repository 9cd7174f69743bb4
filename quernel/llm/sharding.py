"""Sharding by histogram sort, in DataFrame functions only.

Rows are sorted by a 128-bit key (hash of the text, then hash of the id and the row's number), so that equal texts
stand side by side. Exact bytes below candidate key boundaries are counted across all partitions, the probes are
refined inside the one bin that holds each wanted splitter, until every splitter meets the tolerance. Splitters bound
the shards, and cells inside them, so that no task sorts a whole shard, nor all copies of one text or all rows of
one id. Then the rows are exchanged once, by cell, and numbered in key order. The counting rounds read a narrow table
(16 bytes of key and a size for each row), and a round returns a number of bins bounded by the number of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

#: Bits of the key that each round refines: 64 of the first hash, then 64 of the second.
STEPS = [14] + [8] * 6 + [2] + [8] * 8
#: Wanted bytes of a cell, which one task sorts; most cells, whatever the size of the table.
CELL_BYTES, CELLS = 8 << 20, 8192


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _digit(step: int) -> Column:
    """Digit of the key (columns h1, h2) that a round refines, in key order."""
    used = sum(STEPS[:step])
    column, used = ("h1", used) if used < 64 else ("h2", used - 64)
    shift = 64 - used - STEPS[step]
    moved = F.shiftrightunsigned(F.expr(f"{column} ^ (-9223372036854775807L - 1)"), shift)
    return moved.bitwiseAND(F.lit((1 << STEPS[step]) - 1)).cast("int")


def _path(step: int) -> Column:
    """The digits before a round's, as text."""
    return F.concat_ws(".", *(_digit(i) for i in range(step))) if step else F.lit("")


def splitters(rows: DataFrame, parts: int, tolerance: float = 0.001, inside: int = 1) -> list[int]:
    """Ascending 128-bit splitters of rows(h1, h2, size) into ``parts`` ranges of near-equal size, each of ``inside`` cells.

    The boundary of a part is off its exact share by at most ``tolerance`` of a part, that of a cell inside a part by
    at most half a cell, or each by half of the rows whose whole key is equal, where that is more.
    """
    total, found, cells = None, {}, parts * inside
    open_targets = {"": list(range(1, cells))}  # path of digits: targets inside its bin
    below = {"": 0}
    for step, bits in enumerate(STEPS):
        if not open_targets:
            break
        path = _path(step)
        near = rows if step == 0 else rows.where(path.isin(sorted(open_targets)))
        counts: dict[str, dict[int, int]] = {}
        for r in near.groupBy(path.alias("path"), _digit(step).alias("digit")).agg(F.sum("size").alias("bytes")).collect():
            counts.setdefault(r.path, {})[r.digit] = r.bytes
        if step == 0:
            total = sum(counts.get("", {}).values())
            if not total:
                return [0] * (cells - 1)
        deeper: dict[str, list[int]] = {}
        deeper_below = {}
        left = 128 - sum(STEPS[: step + 1])
        for p, targets in open_targets.items():
            prefix = 0
            for i, d in enumerate(p.split(".") if p else []):
                prefix = prefix << STEPS[i] | int(d)
            edges, at = [(below[p], 0)], below[p]
            for d in sorted(counts.get(p, {})):
                edges.append((at, d))
                at += counts[p][d]
                edges.append((at, d + 1))
            k = 0
            for t in targets:  # ascending, as the edges
                want = total * t / cells
                while k + 1 < len(edges) and edges[k + 1][0] <= want:
                    k += 1
                got, digit = min(edges[max(0, k - 1) : k + 2], key=lambda e: abs(e[0] - want))
                room = 0.5 * total / cells if t % inside else tolerance * total / parts
                if abs(got - want) <= room or step == len(STEPS) - 1:
                    found[t] = ((prefix << bits) + digit) << left
                    continue
                start = edges[k if k % 2 else max(0, k - 1)]
                q = f"{p}.{start[1]}" if p else str(start[1])
                deeper.setdefault(q, []).append(t)
                deeper_below[q] = start[0]
        open_targets, below = deeper, deeper_below
    return [found[t] for t in range(1, cells)]


def cell_of(rows: DataFrame, bounds: list[int], out_col: str) -> DataFrame:
    """Adds the number of splitters at or below the key of rows(h1, h2, ...).

    The splitters are looked up by the key's first digit; their number, and so that of the rows that are broadcast, is bounded.
    """
    high, low = (lambda b: min(b >> 64, (1 << 64) - 1) - (1 << 63)), (lambda b: (b & ((1 << 64) - 1)) - (1 << 63))
    bins: dict[int, tuple[int, list]] = {}
    at = 0
    for digit in sorted({min(b >> 128 - STEPS[0], (1 << STEPS[0]) - 1) for b in bounds}):
        own = [b for b in bounds if min(b >> 128 - STEPS[0], (1 << STEPS[0]) - 1) == digit]
        # a splitter beyond the last key is above every row
        bins[digit] = (at, [(high(b), low(b)) for b in own if not b >> 128])
        at += len(own)
    table, before, seen = [], 0, sorted(bins)
    for digit in range(1 << STEPS[0]):
        if digit in bins:
            table.append((digit, *bins[digit]))
            before = bins[digit][0] + len([b for b in bins[digit][1]])
        elif seen:
            table.append((digit, before, []))
    table = rows.sparkSession.createDataFrame(table, "bin int, before int, own array<struct<h:long,l:long>>")
    passed = F.filter("own", lambda s: (F.col("h1") > s["h"]) | ((F.col("h1") == s["h"]) & (F.col("h2") >= s["l"])))
    found = rows.join(F.broadcast(table), _digit(0) == F.col("bin"), "left")
    return found.withColumn(out_col, F.coalesce(F.col("before") + F.size(passed), F.lit(0))).drop("bin", "before", "own")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> DataFrame:
    """Adds size, shard (0 to shards - 1) and slot (gapless from 0 in each shard) to all rows, exchanged once.

    The law is ``bytes``: the sizes of the shards are near equal. Slots ascend by the key: equal texts (null texts,
    of size 1, too) have neighbouring slots, in one shard unless a splitter falls among them. Rows that repeat an
    id, or an id and a text, are rows of their own, and null ids are ids. An empty table stays empty. All columns pass: where
    one has a new name, the new column is called with further underscores. ``docs`` must read alike each time,
    as files do; it is an error if it does not.
    """
    new = {n: unused(n, docs) for n in ("size", "shard", "slot")}
    # the row travels as one column, so that its names cannot meet those of the keys
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        text_size(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("h1"),
        F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("h2"),
    )
    narrow = materialize(keyed.select("h1", "h2", "size"), "keys")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    inside = max(1, min(CELLS // shards, -(-total // (shards * CELL_BYTES))))
    bounds = splitters(narrow, shards, tolerance, inside)
    # a row for each cell: bounded by their number
    counts = cell_of(narrow, bounds, "cell").groupBy("cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.expr(f"cell div {inside}")).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(counts.select("cell", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "cells")
    numbered = cell_of(keyed, bounds, "cell").withColumn("in_cell", F.row_number().over(Window.partitionBy("cell").orderBy("h1", "h2")) - 1)
    slot = F.when(F.col("in_cell") < F.col("n"), F.col("base") + F.col("in_cell")).otherwise(F.raise_error(F.lit("the documents were read in another order the second time")))
    return numbered.join(F.broadcast(base), "cell").select("row.*", F.col("size").alias(new["size"]), F.expr(f"int(cell div {inside})").alias(new["shard"]), slot.alias(new["slot"]))


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    rows = shard(docs.select("doc_id", "text"), shards)
    return rows.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
