"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's id stream into chunks wherever the content says so; a
chunk is stored once, under the digest of its ids. A document is a recipe (its chunks' digests in order),
and Merkle trees over the recipes, in ascending document order, verify what is read back.

Files of a store (Parquet, in one folder):

``chunks``    a row for each document: rid, kept (positions of its chunks that are stored here), keys and bodies
              (their digests and ids, little-endian, two bytes each if the vocabulary allows, else four), lent
              (which of these, from 0, other documents refer to). Within a file documents ascend by id, and the
              files' ranges of ids do not overlap
``recipes``   rid, doc_id, ordinal, start, n_tokens, keys (digests of all its chunks), absent (positions of those
              that are stored with another document)
``manifest``  level, node, digest: level 0 joins the digests of ``FAN`` recipes each, the last level is the root
"""

from __future__ import annotations

import hashlib
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters, read_file
from .common import BROADCAST_BYTES, by_bytes, discard, edges, heavy, join_unique, materialize, new_folder, release, remove, runs, small

#: Ids under the rolling hash's window; average (a power of two) and largest ids of a chunk.
WINDOW, AVERAGE, LARGEST = 8, 128, 4096
FAN = 1024
#: Remembered pieces of a worker, up to a length. Bytes of text encoded at once.
REMEMBERED, LONG, AT_ONCE = 1_000_000, 64, 4 << 20

#: Texts that are not cut at spaces: other characters, adjoining white space, special tokens; and texts whose marks stay in place.
WHOLE = "[^\n -~À-ÖØ-öø-ÿ]|  |\n | \n|<\\|"
KEEP_MARKS = "[^A-Za-z0-9À-ÖØ-öø-ÿ][.,][ \n]|\n\n"
#: Begins a piece that has no space before it.
BARE = "\x01"


class LibraryEncoder:
    """Byte-level BPE by the library, asked once for each distinct space-separated piece of many texts.

    In plain text a single space followed by another character always starts a word of the byte-level
    pattern, so pieces can be encoded apart. Other texts go to the library whole. Known pieces and their ids
    are two Arrow columns.
    """

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker is one of many
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.unit = unit_of(self.library)
        self.type = f"<u{self.unit}"
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with a space
        self.spaced[[i for t, i in vocab.items() if t[0] == letters[32]]] = True
        self.words, self.coded = pa.array([], pa.string()), pa.array([], pa.binary())

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def word(self, before: str, word: str) -> list[int]:
        """One word of letters: the library's model alone, without its bookkeeping."""
        body = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.library.model.tokenize(before + body)]

    def pieces(self, names: list[str]) -> list[list[int]]:
        """Ids of pieces of plain text: with a space before them, unless they are marked as bare."""
        out: list = [None] * len(names)
        space, marked = self.letters[32], []
        for i, p in enumerate(names):
            if p.isalpha():
                out[i] = self.word(space, p)
            elif p[:1] == BARE:
                out[i] = self.word("", p[1:]) if p[1:].isalpha() else self.whole(p[1:])
            elif not p or "\n" in p:
                out[i] = self.whole(" " + p)
            else:
                marked.append(i)
        if marked:  # no space inside: their ids are told apart by the tokens that begin with one
            ids = self.whole(" " + " ".join([names[i] for i in marked]))
            cut = np.append(np.flatnonzero(self.spaced[ids]), len(ids)).tolist()
            for i, a, b in zip(marked, cut, cut[1:], strict=False):
                out[i] = ids[a:b]
        return out

    def packed(self, rows: list[list[int]]) -> pa.Array:
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), self.type, int(size.sum()))
        off = np.append(0, np.cumsum(size) * self.unit).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(flat)])

    def coded_pieces(self, names: pa.Array) -> pa.Array:
        """Ids of distinct pieces, those that are not known from the library; what is short is remembered."""
        # the known ones are looked up among these few, not the other way round
        place = pc.fill_null(pc.index_in(self.words, value_set=names), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(place >= 0)
        at = np.full(len(names), -1)
        at[place[known]] = known
        new = names.filter(pa.array(at < 0))
        ids = self.packed(self.pieces(new.to_pylist()))
        at[at < 0] = len(self.words) + np.arange(len(new))
        out = pa.concat_arrays([self.coded, ids]).take(pa.array(at))
        short = pc.less_equal(pc.utf8_length(new), LONG)
        new, ids = new.filter(short), ids.filter(short)
        # where they do not fit, the older half stays: frequent pieces are met first
        keep = len(self.words) if len(self.words) + len(new) <= REMEMBERED else REMEMBERED // 2
        self.words = pa.concat_arrays([self.words[:keep], new])
        self.coded = pa.concat_arrays([self.coded[:keep], ids])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), end to end, and where each text ends."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)
        fast, slow = np.flatnonzero(~odd), np.flatnonzero(odd)
        plain = texts.take(pa.array(fast)) if len(slow) else texts
        # marks and line ends after a word become pieces of their own, so that more pieces are known ones
        apart = plain
        for old, new in ((", ", " \x01, "), (". ", " \x01. "), (".\n", " \x01. \x01\n \x01")):
            apart = pc.replace_substring(apart, old, new)
        plain = pc.binary_join_element_wise(BARE, pc.if_else(pc.match_substring_regex(plain, KEEP_MARKS), plain, apart), "")
        pieces = pc.split_pattern(plain, " ")
        coded = pieces.flatten().dictionary_encode()
        done = self.coded_pieces(coded.dictionary).take(coded.indices)
        off = np.frombuffer(done.buffers()[1], np.int32, len(done) + 1, done.offset * 4).astype(np.int64) // self.unit
        flat = np.frombuffer(done.buffers()[2] or b"", self.type)[off[0] : off[-1]]
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        ends = (off - off[0])[bounds[1:] - bounds[0]] if len(pieces) else np.zeros(0, np.int64)
        if not len(slow):
            return flat, ends
        parts: list = [None] * len(texts)
        for i, a, b in zip(fast, np.append(0, ends), ends):
            parts[i] = flat[a:b]
        for i in slow:
            parts[i] = np.array(self.whole(texts[int(i)].as_py()), self.type)
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])


def unit_of(library) -> int:
    """Bytes of an id in the store."""
    return 2 if library.get_vocab_size() <= 1 << 16 else 4


_LOADED: dict[int, LibraryEncoder] = {}


def loaded(text: str) -> LibraryEncoder:
    key = hash(text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = LibraryEncoder(text)
    return _LOADED[key]


_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def cut_points(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of id streams that stand end to end, each up to one of ``ends`` (ascending).

    A chunk ends where the hash of the last ``WINDOW`` ids, all of one stream, has its high bits clear, at
    each stream's end, and every ``LARGEST`` ids. Empty streams have no chunk.
    """
    n = len(ids)
    gear = _GEAR[ids & 0xFFFF]
    roll = np.zeros(n, np.uint32)
    for j in range(min(WINDOW, n)):
        roll[j:] += gear[: n - j] << np.uint32(j)
    found = np.flatnonzero(roll >> np.uint32(33 - AVERAGE.bit_length()) == 0) + 1
    starts = np.append(0, ends)[np.searchsorted(ends, found, "left")]
    cut = np.union1d(found[found - starts >= WINDOW], ends[ends > 0])
    size = np.diff(cut, prepend=0)
    if (size > LARGEST).any():
        more = [np.arange(c - s + LARGEST, c, LARGEST) for c, s in zip(cut[size > LARGEST], size[size > LARGEST])]
        cut = np.union1d(cut, np.concatenate(more))
    return cut


def keys_of(data, bounds: list[int]) -> bytes:
    """Digests of the pieces of ``data`` between bounds, 16 bytes each, end to end."""
    view, blake = memoryview(data), hashlib.blake2b
    return b"".join([blake(view[a:b], digest_size=16).digest() for a, b in zip(bounds, bounds[1:])])


def key_array(keys: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(keys) // 16, [None, pa.py_buffer(np.arange(0, len(keys) + 1, 16, dtype=np.int32)), pa.py_buffer(keys)])


def keys_digest(keys):
    """Of a recipe's keys: SHA-256 of their hexadecimal forms end to end."""
    return F.sha2(F.array_join(F.transform(keys, F.hex), ""), 256)


def recipe_digest():
    """The leaf of a recipe: its document, place and chunks."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "ordinal", "start", "n_tokens")]
    return F.sha2(F.concat_ws("|", *fields, F.array_join(F.transform("keys", F.hex), "")), 256)


# ---------------------------------------------------------------- writing

STAGED = "rid long, first long, ascends boolean, doc_id long, n_tokens long, before long, keys array<binary>, offs array<int>, payload binary"
CHUNKS = "rid long, kept array<int>, keys array<binary>, bodies array<binary>, lent array<int>"
RECIPES = "rid long, doc_id long, ordinal long, start long, n_tokens long, keys array<binary>, absent array<int>"


def in_order(rows: DataFrame) -> bool:
    """Whether each partition of rows(doc_id) ascends and no two overlap (nulls first); one row of each comes to the driver."""

    def look(batches):
        low = high = None
        ok, n = True, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(0)
            nulls = v.null_count
            ok &= v.slice(0, nulls).null_count == nulls and not (nulls and high is not None)
            v = v.slice(nulls).to_numpy(zero_copy_only=False) if ok else np.zeros(0, np.int64)
            if len(v):
                ok &= bool((v[1:] >= v[:-1]).all()) and (high is None or v[0] >= high)
                low = int(v[0]) if low is None and not n and not nulls else low
                high = int(v[-1])
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([ok]), pa.array([low], pa.int64()), pa.array([high], pa.int64())], names=["ok", "low", "high"])

    parts = sorted(((r.low, r.high, r.ok) for r in rows.mapInArrow(look, "ok boolean, low long, high long").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0))
    return all(r[2] for r in parts) and all(b[0] is not None and (a[1] is None or a[1] <= b[0]) for a, b in zip(parts, parts[1:]))


def encoded(rows: DataFrame, spec, end_id: int) -> DataFrame:
    """Rows of ``STAGED`` from rows(part, doc_id, text) whose partitions ascend: what each document's ids are cut into.

    rid numbers the documents of a partition, first the chunks, before the ids.
    """

    def run(batches):
        enc = loaded(spec.value)
        at = tokens = chunks = 0
        last = None
        for batch in batches:
            for part in by_bytes(batch, "text", AT_ONCE):
                ids, ends = enc.encode(part.column("text"))
                n = part.num_rows
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, n + 1)
                cut = cut_points(ids, ends)
                of = np.searchsorted(cut, ends, "left") + 1  # chunks up to each document's end
                start, own = np.append(0, ends[:-1]), np.diff(of, prepend=0)
                keys = keys_of(ids.data.cast("B"), [0, *(cut * enc.unit).tolist()])
                # a document's offsets: its start, then the end of each of its chunks, in bytes from its start
                offs = np.insert(cut, of - own, start) - np.repeat(start, own + 1)
                base = part.column("part")[0].as_py() << 33
                lists = pa.array(np.append(0, of).astype(np.int32))
                doc = part.column("doc_id").to_pylist()
                up = [b is not None and (a is None or a <= b) or a is b for a, b in zip([last, *doc], doc)]
                last = doc[-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(base + at + np.arange(n)),
                        pa.array((base << 7) + chunks + np.append(0, of[:-1])),
                        pa.array(up),
                        part.column("doc_id"),
                        pa.array(ends - start),
                        pa.array(tokens + start),
                        pa.ListArray.from_arrays(lists, key_array(keys)),
                        pa.ListArray.from_arrays(pa.array((np.append(0, of) + np.arange(n + 1)).astype(np.int32)), pa.array((offs * enc.unit).astype(np.int32))),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.append(0, ends) * enc.unit).astype(np.int32)), pa.py_buffer(ids)]),
                    ],
                    names=["rid", "first", "ascends", "doc_id", "n_tokens", "before", "keys", "offs", "payload"],
                )
                at, tokens, chunks = at + n, tokens + len(ids), chunks + len(cut)
        release()

    return rows.mapInArrow(run, STAGED)


def partitions(staged: DataFrame) -> list:
    """A row for each partition, whatever its rows, in ascending order of documents."""
    parts = (
        staged.groupBy(F.shiftright("rid", 33).alias("part"))
        .agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.bool_and("ascends").alias("ascends"))
        .collect()
    )
    return sorted(parts, key=lambda r: (r.nulls == 0, r.low is not None, r.low or 0, r.high or 0, r.part))


def overlap(a, b) -> bool:
    return a.high is not None and (b.nulls > 0 or b.low < a.high)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), append ``end_id`` to each, and write the store into ``path`` (a shared folder).

    Documents are ordered by id (nulls first), rows that repeat an id by their place in the input. Texts are
    exchanged by ranges of ids before they are encoded, unless the input's partitions already ascend and do not
    overlap. Other columns are ignored. An empty table makes an empty store.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_file(tokenizer))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # the row number is fixed by the input's files and their order
    dealt = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first(), F.col("row"))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").drop("row")
    for way in [rows, dealt] if in_order(rows.select("doc_id")) else [dealt]:
        made = encoded(way.select(F.spark_partition_id().alias("part"), "doc_id", "text"), spec, end_id)
        made.write.mode("overwrite").option("parquet.enable.dictionary", "false").parquet(f"{path}/staged")
        staged = spark.read.schema(made.schema).parquet(f"{path}/staged")
        parts = partitions(staged)
        if all(r.ascends for r in parts) and not any(overlap(a, b) for a, b in zip(parts, parts[1:])):
            break  # else the input's partitions were others when its order was looked at

    places = staged.select("rid", "first", F.posexplode("keys").alias("pos", "key")).select("rid", "pos", "key", (F.col("first") + F.col("pos")).alias("place"))
    shared = materialize(places.groupBy("key").agg(F.min("place").alias("holder"), F.count("*").alias("n")).where("n > 1"), "shared")
    count, total = shared.agg(F.count("*"), F.sum("n")).first()
    if count * 64 <= BROADCAST_BYTES:
        found = places.join(F.broadcast(shared), "key")
    else:
        found = join_unique(places, shared, "key", shared.where(F.col("n") > heavy(total)))
    own = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("place") == F.col("holder")).alias("lent")))).alias("own"))
    ranked = F.filter(F.transform("own", lambda x, i: F.struct(x["pos"].alias("pos"), x["lent"].alias("lent"), i.alias("i"))), lambda x: x["lent"])
    marks = own.select(
        "rid",
        F.transform(F.filter("own", lambda x: ~x["lent"]), lambda x: x["pos"]).alias("absent"),
        # the k-th that is lent has as many absent ones before it as shared ones that are not lent
        F.transform(ranked, lambda x, k: x["pos"] - x["i"] + k).alias("lent"),
    )
    marks = materialize(marks, "marks")
    size = marks.agg(F.sum(F.size("absent") + F.size("lent")) * 4 + F.count("*") * 64).first()[0] or 0
    discard(shared)
    marked = staged.join(small(marks, 64, size), "rid", "left")
    none = F.expr("CAST(array() AS array<int>)")
    every = F.sequence(F.lit(0), F.size("keys") - 1)
    stored = marked.withColumn("kept", F.when(F.size("absent") > 0, F.array_except(every, F.col("absent"))).otherwise(every))
    stored.select(
        "rid",
        "kept",
        F.transform("kept", lambda i: F.get("keys", i)).alias("keys"),
        F.transform("kept", lambda i: F.substring("payload", F.get("offs", i) + 1, F.get("offs", i + 1) - F.get("offs", i))).alias("bodies"),
        F.coalesce("lent", none).alias("lent"),
    ).write.option("parquet.enable.dictionary", "false").parquet(f"{path}/chunks")

    part = F.shiftright("rid", 33)
    before_n, before_t, base = 0, 0, []
    for r in parts:
        base.append((r.part, before_n, before_t))
        before_n, before_t = before_n + r.rows, before_t + r.tokens
    base = spark.createDataFrame(base, "part long, rows_before long, tokens_before long")
    recipes = (
        staged.withColumn("part", part)
        .join(F.broadcast(base), "part")
        .join(small(marks, 64, size), "rid", "left")
        .select(
            "rid",
            "doc_id",
            (F.col("rows_before") + F.col("rid") - F.shiftleft("part", 33)).alias("ordinal"),
            (F.col("tokens_before") + F.col("before")).alias("start"),
            "n_tokens",
            "keys",
            F.coalesce("absent", none).alias("absent"),
        )
    )
    recipes.write.parquet(f"{path}/recipes")
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    remove(spark, f"{path}/staged")
    level, nodes, count = 0, recipes.select("ordinal", recipe_digest().alias("leaf")), before_n
    while True:
        nodes = merkle_level(nodes).select(F.lit(level).alias("level"), F.col("ordinal").alias("node"), F.col("leaf").alias("digest"))
        nodes.write.mode("append").parquet(f"{path}/manifest")
        count = -(-count // FAN)
        if count <= 1:
            return
        nodes = manifest(spark, path).where(F.col("level") == level).select(F.col("node").alias("ordinal"), F.col("digest").alias("leaf"))
        level += 1


def merkle_level(nodes: DataFrame) -> DataFrame:
    """The next level over (ordinal, leaf): the digest of each ``FAN`` neighbours in order."""
    return (
        nodes.groupBy(F.expr(f"ordinal div {FAN}").alias("up"))
        .agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "leaf"))), lambda x: x["leaf"]), ""), 256).alias("leaf"))
        .withColumnRenamed("up", "ordinal")
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level int, node long, digest string").parquet(f"{path}/manifest")


# ---------------------------------------------------------------- reading


def check_manifest(spark: SparkSession, path: str, recipes: DataFrame) -> None:
    """Every level of the manifest, up to the root, against the one below, the lowest against the recipes; an error where they differ."""
    held = manifest(spark, path)
    level, nodes, below = 0, recipes.select("ordinal", recipe_digest().alias("leaf")), recipes.count()
    while True:
        own = held.where(F.col("level") == level).select(F.col("node").alias("ordinal"), "digest")
        got = merkle_level(nodes).join(own, "ordinal", "full").agg(F.count("*").alias("n"), F.count_if(F.expr("NOT (leaf <=> digest)")).alias("broken")).first()
        if got.broken or got.n != -(-below // FAN):
            raise ValueError(f"the manifest of {path} does not match its recipes at level {level}")
        if got.n <= 1:
            break
        level, nodes, below = level + 1, own.withColumnRenamed("digest", "leaf"), got.n
    if not held.where(~F.col("level").between(0, level)).isEmpty():
        raise ValueError(f"the manifest of {path} does not match its recipes: it has levels above the root")


def flat(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a binary column end to end, and their bounds."""
    if not len(column):
        return memoryview(b""), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return memoryview(column.buffers()[2] or b"")[off[0] : off[-1]].cast("B"), off - off[0]


def rebuilt(rid: pa.Array, bounds: np.ndarray, keys: pa.Array, bodies: pa.Array, unit: int, with_ids: bool) -> pa.RecordBatch:
    """Documents from their chunks in order, ``bounds`` the chunks of each: every digest is checked, then the ids are counted."""
    if bodies.null_count:
        raise ValueError("a chunk is missing from the store")
    data, at = flat(bodies)
    wanted = bytes(flat(keys)[0])
    if keys_of(data, at.tolist()) != wanted:
        raise ValueError("a chunk differs from its digest")
    ids = np.frombuffer(data, f"<u{unit}").astype("<u4")
    ends = at[bounds] // unit
    view, spans = ids.data.cast("B"), list(zip((ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist()))
    names = wanted.hex().upper().encode()
    texts = pa.Array.from_buffers(pa.binary(), len(rid), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)]) if with_ids else pa.nulls(len(rid), pa.binary())
    return pa.RecordBatch.from_arrays(
        [rid, pa.array([hashlib.sha256(names[32 * a : 32 * b]).hexdigest() for a, b in zip(bounds.tolist(), bounds[1:].tolist())], pa.string()), pa.array(np.diff(ends)), pa.array([zlib.crc32(view[a:b]) for a, b in spans], pa.int64()), texts],
        names=["rid", "keys_read", "n_read", "ids_crc32", "ids"],
    )


def read_store(spark: SparkSession, path: str, unit: int = 2, with_ids: bool = True) -> DataFrame:
    """Read a store back: (doc_id, start, n_tokens, ids_crc32, ids binary little-endian unsigned 32-bit), verified.

    Recipes are checked against the manifest, level by level up to the root, and each chunk's digest and each
    document's chunks and ids against its recipe as they are put together; a mismatch or a missing chunk is an
    error. ``unit`` is the bytes of an id in the store. Without ``with_ids`` the ids themselves are left null
    once they are checked and counted.
    """
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    check_manifest(spark, path, recipes)

    def whole(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                bounds = part.column("keys").offsets.to_numpy().astype(np.int64)
                yield rebuilt(part.column("rid"), bounds - bounds[0], part.column("keys").flatten(), part.column("bodies").flatten(), unit, with_ids)

    def pieces(batches):
        for part in runs(batches, ["rid"]):
            cut = edges(part, ["rid"])
            yield rebuilt(part.column("rid").take(pa.array(cut)), np.append(cut, part.num_rows), part.column("key"), part.column("body"), unit, with_ids)

    out = "rid long, keys_read string, n_read long, ids_crc32 long, ids binary"
    # documents that hold all their chunks are read where they stand; only the others are put together
    partial = materialize(recipes.where(F.size("absent") > 0).select("rid", "keys", "absent"), "partial")
    count, wants = partial.agg(F.count("*"), F.sum(F.size("absent"))).first()
    ids = small(partial.select(F.col("rid").alias("gone")), 16, count * 16)
    is_partial = F.col("rid") == F.col("gone")
    own = chunks.join(ids, is_partial, "left_anti").select("rid", "keys", "bodies").mapInArrow(whole, out)
    held = chunks.join(ids, is_partial, "left_semi").select("rid", F.explode(F.arrays_zip("kept", "keys", "bodies")).alias("c")).select("rid", F.col("c.kept").alias("pos"), F.col("c.keys").alias("key"), F.col("c.bodies").alias("body"))
    want = partial.select("rid", F.explode("absent").alias("pos"), "keys").select("rid", "pos", F.get("keys", F.col("pos")).alias("key"))
    lent = chunks.where(F.size("lent") > 0).select(F.explode(F.transform("lent", lambda p: F.struct(F.get("keys", p).alias("key"), F.get("bodies", p).alias("body")))).alias("c")).select("c.key", "c.body")
    uses = materialize(want.groupBy("key").agg(F.count("*").alias("uses")).where(F.col("uses") > heavy(wants or 0)), "uses")
    found = join_unique(want, lent, "key", uses, "left")
    built = held.unionByName(found.select("rid", "pos", "key", "body")).repartition("rid").sortWithinPartitions("rid", "pos").select("rid", "key", "body").mapInArrow(pieces, out)
    ok = (F.col("keys_of") == F.col("keys_read")) & (F.col("n_tokens") == F.col("n_read"))
    return (
        recipes.select("rid", "doc_id", "start", "n_tokens", keys_digest("keys").alias("keys_of"))
        .join(own.unionByName(built), "rid", "left")
        .select("doc_id", "start", F.when(ok, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document differs from its recipe"))).alias("n_tokens"), "ids_crc32", "ids")
    )


def new_store(spark: SparkSession) -> str:
    return f"{new_folder(spark)}/store"
