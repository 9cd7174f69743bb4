"""BPE encoding by forced boundaries, and decoding.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can never be merged into
one token, so a word is cut there for certain. The fragments are encoded independently (and remembered,
within a bound), and their ids are concatenated. The result equals that of the ``tokenizers`` library.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, map_text, unused

#: Remembered pieces, and fragments, of each of a worker's two generations.
REMEMBERED = 240_000
#: Pieces longer than this are encoded, but not remembered.
LONG = 64

#: Texts of these characters alone need no normalisation but lower case, and white space separates their words.
PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
#: A comma or full stop that may belong to a run of marks.
MARK_RUN = re.compile(r"[^A-Za-z0-9À-ÖØ-öø-ÿ][.,][ \n]")
#: The vocabulary's own word pattern over lower-case plain text.
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next letter from 256 on."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class ForcedBoundaryBpe:
    """Encoder and decoder of a tokenizer file with word ends, lower case and dropped white space."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        model = spec["model"]
        self.library = Tokenizer.from_str(text)
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.letters = byte_letters()
        byte = {c: b for b, c in enumerate(self.letters)}
        self.byte = byte
        inside = np.zeros((256, 256), bool)
        for token in self.vocab:
            body = token.removesuffix(self.end) if self.end else token
            if len(body) > 1 and all(c in byte for c in body):
                b = [byte[c] for c in body]
                inside[b[:-1], b[1:]] = True
        #: cuts[a, b]: no token holds byte a followed by byte b.
        self.cuts = ~inside
        #: The same for pairs of ASCII letters, as text.
        self.cut_pairs = {chr(a) + chr(b) for a, b in zip(*np.nonzero(self.cuts[:128, :128]))}
        top = max([*self.vocab.values(), *self.added.values()]) + 1
        self.names = [""] * top
        for token, i in [*self.vocab.items(), *self.added.items()]:
            self.names[i] = token
        short = lambda key: len(key) <= LONG
        self.pieces = Remembered(REMEMBERED, self.piece, short)
        self.ends = Remembered(REMEMBERED // 6, lambda x: self.merged(x, True), short)
        self.inner = Remembered(REMEMBERED // 6, lambda x: self.merged(x, False), short)
        self.marks = {m: np.array(self.word(m.encode()), "<u4").tobytes() for m in ".,"}

    # -- encoding

    def merged(self, letters: str, last: bool) -> list[int]:
        """Ids of one fragment (of stand-in letters); ``last``: it ends its word."""
        parts = list(letters)
        if last:
            parts[-1] += self.end
        rank = self.rank
        if len(parts) > 256:
            parts = self.long_merge(parts)
        else:
            none = 1 << 60
            ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
            while ranks and (least := min(ranks)) < none:
                i = ranks.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
                if i < len(ranks):
                    ranks[i] = rank.get((parts[i], parts[i + 1]), none)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def piece(self, piece: str) -> bytes:
        """Ids of a white-space separated piece of lower-case plain text."""
        if piece.isalpha():
            if piece.isascii() and self.cut_pairs.isdisjoint(map(str.__add__, piece, piece[1:])):
                ids = self.merged(piece, True)  # one word without a cut
            else:
                ids = self.word(piece.encode())
        elif piece[-1] in self.marks and piece[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.marks[piece[-1]]
        else:
            ids = []
            for word in PLAIN_WORD.findall(piece):
                ids += self.word(word.encode())
        return np.array(ids, "<u4").tobytes()

    def long_merge(self, parts: list[str]) -> list[str]:
        """The same merges by a heap over linked symbols, for fragments of any length."""
        import heapq

        n, rank = len(parts), self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        heapq.heapify(heap)
        sym: list[str | None] = list(parts)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i] if sym[i] is not None else -1
            if j < 0 or (sym[i], sym[j]) != pair:
                continue
            sym[i] += sym[j]
            sym[j] = None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                if (p := (sym[i], sym[right[i]])) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if left[i] >= 0 and (p := (sym[left[i]], sym[i])) in rank:
                heapq.heappush(heap, (rank[p], left[i], p))
        return [s for s in sym if s is not None]

    def word(self, data: bytes) -> list[int]:
        """Ids of one word: cut where two bytes never meet inside a token, fragments apart, ids together."""
        if len(data) > 1:
            b = np.frombuffer(data, np.uint8)
            at = np.flatnonzero(self.cuts[b[:-1], b[1:]]) + 1
        else:
            at = ()
        letters = "".join(map(self.letters.__getitem__, data))
        if not len(at):
            return self.ends[letters]
        ids, start = [], 0
        for cut in at:
            ids += self.inner[letters[start:cut]]
            start = cut
        return ids + self.ends[letters[start:]]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not PLAIN.search(text) and "<|" not in text:
            text = text.lower()
            if not MARK_RUN.search(text):  # marks stand apart from words, so that more pieces are known ones
                text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
            return b"".join(map(self.pieces.__getitem__, text.split()))
        out, at = [], 0
        for m in self.special.finditer(text):
            out.append(self.any_part(text[at : m.start()]))
            out.append(self.added[m[0]].to_bytes(4, "little"))
            at = m.end()
        return b"".join([*out, self.any_part(text[at:])])

    def any_part(self, text: str) -> bytes:
        if not text:
            return b""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        ids: list[int] = []
        for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
            ids += self.word(bytes(map(self.byte.__getitem__, word)))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), "<u4").tolist()

    # -- decoding

    def decode(self, ids) -> str:
        """The tokens' names with a space between, as the library joins them for a file without a decoder; unknown ids vanish."""
        if self.library.decoder is not None:
            return self.library.decode(list(ids), skip_special_tokens=False)
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except IndexError:
            return " ".join(self.names[i] for i in ids if 0 <= i < len(self.names))


_LOADED: dict[int, ForcedBoundaryBpe] = {}


def loaded(text: str) -> ForcedBoundaryBpe:
    """The encoder of a tokenizer file's text, built once for each worker."""
    key = hash(text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ForcedBoundaryBpe(text)
    return _LOADED[key]


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds the ids (array<int>) of each whole text; a null text is an empty one, repeated rows stay.

    ``tokenizer`` is the path of a tokenizer file on the driver; its text (a few MB, whatever the corpus) is
    broadcast. All columns pass: where one has the new name, the new column is called with further underscores.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer))
    name = unused(out_col, docs)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(spec.value)
        ids = [np.frombuffer(bpe.encode_bytes(t or ""), "<i4") for t in part.column(text_col).to_pylist()]
        off = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        return pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(off), flat)], names=[*part.schema.names, name])

    return map_text(docs, text_col, run, schema)


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of an id column; null ids give a null text, no ids an empty one. Columns pass as in ``encode``."""
    spec = rows.sparkSession.sparkContext.broadcast(read_file(tokenizer))
    name = unused(out_col, rows)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        for batch in batches:
            bpe = loaded(spec.value)
            text = [None if x is None else bpe.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text in one pass: (id, n_tokens, ids_sha256, decoded_sha256).

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8.
    Null texts count as empty (no ids); null ids and repeated rows stay; other columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(spec.value)
        n, ids_sha, text_sha = [], [], []
        for text in part.column("text").to_pylist():
            raw = bpe.encode_bytes(text or "")
            ids = np.frombuffer(raw, "<u4").tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(raw).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_text(rows, "text", run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

