"""Conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of first turns; it is owned by its member of the smallest id. A conversation that owns a node
owns all of its path below it, so that ownership is one depth for each conversation, and what a node's subtree saves is the
sum over its members of the tokens between the node and the depth from which the member owns its path. No subtree is walked
and no member list is held: every figure of a node is a sum over its members, combined before it is exchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Ids of 2**BLOCK_BITS consecutive numbers are listed together, before the lists of a node are hashed in order.
BLOCK_BITS = 12
NODE = ["depth", "a", "b"]


def running(rows: DataFrame, key: str, order: list, sums: dict[str, str], xors: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with running sums and xors of columns down each key: ``{result: column}``, the row itself included.

    Rows are dealt out by ranges of (key, order), so that a key of very many rows is cut over tasks; a window adds up each
    piece, and the few keys that cross a boundary (two for each task at most) get what stands before the piece by broadcast.
    ``order`` should tell all rows of a key apart.
    """
    kinds = [(out, F.sum, F.col(of)) for out, of in sums.items()] + [(out, F.bit_xor, F.col(of)) for out, of in (xors or {}).items()]
    rows = materialize(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), "ranges")
    edge = rows.groupBy("part").agg(F.array(F.min(key), F.max(key)).alias("ends")).select(F.explode("ends").alias(key)).distinct()
    pieces = rows.join(F.broadcast(edge), key, "left_semi").groupBy(key, "part").agg(*(fold(of).alias(f"_{out}") for out, fold, of in kinds))
    above = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(key, "part", *(fold(f"_{out}").over(above).alias(f"_{out}") for out, fold, _ in kinds)).where(F.col(f"_{kinds[0][0]}").isNotNull())
    down = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(fold(of).over(down).alias(out) for out, fold, of in kinds)).join(F.broadcast(pieces), [key, "part"], "left")
    joined = lambda out, fold: (F.col(out).bitwiseXOR if fold is F.bit_xor else F.col(out).__add__)(F.coalesce(F.col(f"_{out}"), F.lit(0)))
    return rows.withColumns({out: joined(out, fold) for out, fold, _ in kinds}).drop("part", *(f"_{out}" for out, _, _ in kinds))


def numbered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, idx, turn, words): each conversation's turns numbered from 1, by digest of role and text, with their words.

    Null turns come first; equal turns follow the digest of role and text, repeated rows are turns of their own. Null roles
    and texts are empty; rows without a conversation id belong to none.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("c"),
        F.col(f"`{turn_col}`").alias("at"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.lit(1).cast("long").alias("one"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = running(materialize(rows, "turns"), "c", [F.col("at").asc_nulls_first(), F.col("turn"), F.col("row")], {"idx": "one"})
    return materialize(rows.select("c", "idx", "turn", "words"), "numbered")


def rebuilt(turns: DataFrame, group: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another one's turns: (c, depth, turn, words, length) and one row (c, length) for each.

    Conversation c starts with the first h turns of c - c % group (remainder with the sign of c, as in SQL; fewer, if it has
    fewer; none, if it is absent) and goes on with its own turns after its first h; h = crc32(c in decimal) % shared.
    """
    taken = F.crc32(F.col("c").cast("string")) % F.lit(shared)
    heads = turns.where(F.expr(f"c % {group} = 0 AND idx < {shared}")).groupBy(F.col("c").alias("donor")).agg(F.sort_array(F.collect_list(F.struct("idx", "turn", "words"))).alias("head"))
    convs = turns.groupBy("c").agg(F.count("*").alias("n")).withColumns({"donor": F.expr(f"c - c % {group}"), "h": taken}).join(heads, "donor", "left")
    convs = convs.withColumn("g", F.least("h", F.coalesce(F.size("head"), F.lit(0)).cast("long")).cast("int"))
    convs = convs.select("c", "n", "h", "g", (F.col("g") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), F.when(F.col("g") > 0, F.slice("head", F.lit(1), F.col("g"))).alias("head"))
    convs = materialize(convs, "conversations")
    own = join_counted(turns.where(F.col("idx") > taken), convs.select("c", "n", "h", "g", "length"), "c", "n")
    own = own.select("c", (F.col("idx") - F.col("h") + F.col("g")).alias("depth"), "turn", "words", "length")
    lent = convs.select("c", "length", F.posexplode("head").alias("i", "t")).select("c", (F.col("i") + 1).cast("long").alias("depth"), "t.turn", "t.words", "length")
    return materialize(own.unionByName(lent), "rebuilt"), convs.select("c", "length")


def listed_ends(ends: DataFrame) -> DataFrame:
    """(depth, a, b, digest): SHA-256 of the ids that end at each node, ascending in decimal, comma-joined.

    Ids of one block are listed together; a node's lists are then hashed one after the other as they are read, so that a node
    where very many conversations end needs the memory of one list. Only the digest itself goes on in order.
    """
    decimal = F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string"))
    lists = ends.groupBy(*NODE, F.shiftright("c", BLOCK_BITS).alias("block")).agg(F.array_join(decimal, ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for *node, ids in zip(*(batch.column(k).to_pylist() for k in NODE), batch.column("ids").to_pylist()):
                if node == key:
                    state.update(b",")
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = node, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                out = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), types)], names)

    names, types = [*NODE, "digest"], [pa.int64()] * 3 + [pa.string()]
    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(digests, "depth long, a long, b long, digest string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns``: (c, depth, turn, words, length), a table that is read several times; ``convs``: (c, length) for every
    conversation, those without turns included. ``conv_id`` is the smallest member; the node's path is the first ``depth``
    turns of that conversation, ``parent_conv_id`` the smallest member of the path without its last turn (root: null). A path
    is told by two running xors of 64-bit hashes of (depth, turn). Without conversations there is no root.
    """
    own_hash = lambda seed: F.xxhash64(F.lit(seed), F.col("depth"), F.col("turn"))
    at = running(turns.withColumns({"ha": own_hash("a"), "hb": own_hash("b")}), "c", ["depth"], {"upto": "words"}, {"a": "ha", "b": "hb"})
    at = at.select("c", *NODE, F.col("a").bitwiseXOR(F.col("ha")).alias("up_a"), F.col("b").bitwiseXOR(F.col("hb")).alias("up_b"), (F.col("upto") - F.col("words")).alias("before"), "words", "length")
    zero = F.lit(0).cast("long")
    at = materialize(at.unionByName(convs.select("c", *(zero.alias(x) for x in (*NODE, "up_a", "up_b", "before", "words")), "length")), "paths")

    # the owner of each node: a minimum over its members, combined before the exchange; the root and common first turns have very many
    member = F.struct("c", "before", "up_a", "up_b")
    nodes = at.groupBy(*NODE).agg(F.min(member).alias("first"), F.count("*").alias("n_convs"), F.max(F.col("depth") < F.col("length")).alias("deeper"))
    nodes = materialize(nodes.select(*NODE, "first.*", "n_convs", "deeper"), "nodes")
    since = F.min(F.struct("depth", "before", "up_a", "up_b")).alias("since")
    owners = nodes.groupBy("c").agg(since, F.max((~F.col("deeper")).cast("long")).alias("leaf"))
    owners = materialize(owners.select("c", F.col("since.depth").alias("owned"), F.col("since.before").alias("unowned"), (F.col("since.depth") - 1).alias("depth"), F.col("since.up_a").alias("a"), F.col("since.up_b").alias("b"), "leaf"), "owners")
    above = join_counted(owners.where("owned > 0"), nodes.select(*NODE, F.col("c").alias("parent"), "n_convs"), NODE, "n_convs")
    totals = at.groupBy("c").agg(F.sum("words").alias("total"), F.count("*").alias("rows"))
    info = totals.join(owners.select("c", "owned", "unowned", "leaf"), "c", "left").join(above.select("c", "parent"), "c", "left")
    info = materialize(info.select("c", "rows", F.coalesce("owned", "rows").alias("owned"), F.coalesce("unowned", "total").alias("unowned"), F.coalesce("leaf", zero).alias("leaf"), "parent"), "ownership")

    # a member adds to a node: its tokens from there on less those it owns, its leaf, and the child that it owns
    both = join_counted(at, info, "c", "rows")
    child = (F.col("owned") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    parent: Column = F.when(F.col("depth") > 0, F.when(F.col("owned") < F.col("depth"), F.col("c")).otherwise(F.col("parent")))
    out = both.groupBy(*NODE).agg(
        F.min(F.struct("c", parent.alias("parent"))).alias("first"),
        F.count("*").alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("unowned") - F.col("before"), zero)).alias("saved_tokens"),
    )
    ends = listed_ends(at.where(F.col("depth") == F.col("length")).select("c", *NODE))
    return out.join(ends, NODE, "left").select(
        F.col("first.c").alias("conv_id"), "depth", F.col("first.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """The trie of the conversations as ``rebuilt`` makes them; nulls, ties and repeats as in ``numbered_turns``."""
    return prefix_trie(*rebuilt(numbered_turns(conversations), group, shared))
