"""Secret scans: patterns for tokens and keys, and a guess cost for values that stand in a credential context.

The guess cost of a value is that of its cheapest segmentation into common words, dates, repeats, keyboard
walks and brute-force spans, found by dynamic programming: the logarithm (base 10) of the guesses that an
attacker who knows these habits needs.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text
from .pii import count_of
from .pii import span_text as joined

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Further credential contexts; their values count only by guess cost.
CONTEXT = re.compile(r"""(?ai)\b(?:pwd|pass(?:phrase|code)?|credentials?|auth|access_key|private_key|client_key|login)["']?\x20*[:=]\x20*["']?([^\s"',;]+)""")
KINDS = ("assign", "access", "hex", "guess")
BASE_KINDS = KINDS[:3]
#: A value in a further context is a secret from this many characters and this guess cost on.
LEAST, STRONG = 8, 8.0

#: Common parts of passwords and of placeholders, commonest first (fixed values).
WORDS = (
    "password 123456 qwerty admin welcome letmein login secret dragon monkey master sunshine princess football "
    "shadow iloveyou trustno1 hello freedom whatever starwars superman batman pass test user root guest default "
    "change changeme example sample dummy token key api null none true false your here insert placeholder value "
    "string abc the and you love god money summer winter spring autumn january february march april may june july "
    "august september october november december monday friday sunday server database production staging local"
).split()
#: Rows of a keyboard (fixed values).
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', r"`1234567890-=[]\;',./"))
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("@4310$57", "aaeiosst")

#: Letters of a dictionary's words.
SHORTEST_WORD, LONGEST_WORD = 3, 16


class Words:
    """A ranked dictionary: ``WORDS``, then further words, commonest first."""

    def __init__(self, more=()):
        self.rank: dict[str, int] = {}
        for w in (*WORDS, *more):
            if len(w) <= LONGEST_WORD:
                self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))


COMMON_WORDS = Words()


def vocabulary_words(path: str) -> list[str]:
    """The whole words of a public tokenizer's vocabulary (a file with word ends), in the order in which its merges formed them.

    Frequent words are formed first, so that the order is a rank.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    words = (t.removesuffix(end) for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1]) if t.endswith(end))
    return [w for w in words if w.isascii() and w.isalpha() and SHORTEST_WORD <= len(w) <= LONGEST_WORD]


def _near() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, c in enumerate(row):
            for dy, dx in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)):
                if 0 <= y + dy < len(ROWS) and 0 <= x + dx < len(ROWS[y + dy]):
                    near.setdefault(c, set()).add(ROWS[y + dy][x + dx])
    return near


_NEAR = _near()


def spans_of(value: str, words: Words = COMMON_WORDS):
    """(start, end, cost) of every cheap span: words, dates, repeats, keyboard walks. Their number grows with the value's length only."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + SHORTEST_WORD, min(n, i + words.longest) + 1):
            for form, extra in ((low, 0.0), (plain, 0.5)):
                if (rank := words.rank.get(form[i:j])) is not None:
                    case = 0.0 if value[i:j] in (low[i:j], low[i:j].upper(), low[i:j].capitalize()) else 1.0
                    yield i, j, math.log10(rank + 1) + extra + case + (0.3 if value[i].isupper() else 0)
                    break
    for m in DATE.finditer(value):
        yield m.start(), m.end(), math.log10(365 * 120 if m.end() - m.start() > 4 else 120)
    i = 0
    while i < n:  # maximal repeats of one character, and of two
        j = i + 1
        while j < n and value[j] == value[i]:
            j += 1
        if j - i >= 3:
            yield i, j, math.log10(95 * (j - i))
        i = j
    i = 0
    while i + 3 < n:
        j = i + 2
        while j < n and value[j] == value[j - 2]:
            j += 1
        if j - i >= 6:
            yield i, j, math.log10(95 * 95 * (j - i))
        i = max(i + 1, j - 1)
    for kind in (lambda a, b: abs(ord(a) - ord(b)) == 1, lambda a, b: SHIFTED.get(b, b) in _NEAR.get(SHIFTED.get(a, a), ())):
        i = 0
        while i < n:
            j = i + 1
            while j < n and kind(low[j - 1], low[j]):
                j += 1
            if j - i >= 3:
                yield i, j, math.log10(47 * 6 * (j - i))
            i = j


def alphabet(value: str) -> int:
    """Size of the brute-force alphabet that holds the value's characters."""
    size = 0
    for test, n in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)):
        size += n * any(c.isascii() and test(c) for c in value)
    size += 33 * any(c.isascii() and not c.isalnum() for c in value)
    return max(10, size + 100 * any(not c.isascii() for c in value))


def guess_cost(value: str, words: Words = COMMON_WORDS) -> float:
    """Minimum over segmentations of the sum of the spans' costs, each further span costing a factor of two; 0 for an empty value."""
    n = len(value)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in spans_of(value, words):
        ends[j].append((i, cost))
    brute, more = math.log10(alphabet(value)) if n else 0.0, math.log10(2)
    best, forced = [0.0] * (n + 1), [0.0] * (n + 1)  # forced: the last span is brute force
    for j in range(1, n + 1):
        forced[j] = min(best[j - 1] + more, forced[j - 1]) + brute if j > 1 else brute
        best[j] = forced[j]
        for i, cost in ends[j]:
            best[j] = min(best[j], best[i] + cost + (more if i else 0))
    return best[n]


def find_secrets(text: str, words: Words = COMMON_WORDS) -> list[tuple[int, int, int, float]]:
    """(start, rank of kind, end, guess cost) of a text's secrets, ordered; ends exclusive, in code points.

    A span of ``assign`` is the whole assignment, one of ``guess`` the value alone; the cost of ``access`` and ``hex`` is that of brute force.
    """
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low or not text.isascii():
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                out.append((m.start(), 0, m.end(), guess_cost(m[2], words)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                out.append((m.start(), 1, m.end(), (m.end() - m.start() - 4) * math.log10(36)))
    for m in HEX.finditer(text):
        out.append((m.start(), 2, m.end(), (m.end() - m.start()) * math.log10(16)))
    if "=" in text or ":" in text:
        for m in CONTEXT.finditer(text):
            if len(m[1]) >= LEAST and (cost := guess_cost(m[1], words)) >= STRONG:
                out.append((m.start(1), 3, m.end(1), cost))
    return sorted(out)


def span_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_words: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: (id, secrets array<struct<kind, start, end, cost>>), in order of start, then kind.

    ``more_words`` are words for the guess cost, commonest first, after the built-in ones; they are broadcast,
    their number does not follow the corpus. Null and empty texts have no secrets; null ids and repeated rows
    stay; an empty table gives none; other columns are ignored.
    """
    words = docs.sparkSession.sparkContext.broadcast(Words(more_words or ()))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": KINDS[k], "start": a, "end": b, "cost": c} for a, k, b, c in find_secrets(t or "", words.value)] for t in part.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, kind)], names=["id", "secrets"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_text(rows, "text", run, f"id {rows.schema['id'].dataType.simpleString()}, secrets array<struct<kind:string,start:int,end:int,cost:double>>").withColumnRenamed("id", id_col)


def secrets_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_words: list[str] | None = None) -> DataFrame:
    rows = scan_secrets(docs, id_col, text_col, more_words)
    counts = [count_of("secrets", k).alias(f"n_{k}") for k in BASE_KINDS]
    return rows.select(
        id_col,
        *counts,
        F.sha2(joined(F.filter("secrets", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.coalesce(F.array_max(F.transform("secrets", lambda x: x["cost"])), F.lit(0.0)).alias("top_cost"),
    )


def redact(text: str, spans) -> str:
    """The text with each secret replaced by a mark that carries the kind and a short digest of the value."""
    out, at = [], 0
    for a, k, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}:{hashlib.sha256(text[a:b].encode()).hexdigest()[:8]}]"]
            at = b
    return "".join([*out, text[at:]])
