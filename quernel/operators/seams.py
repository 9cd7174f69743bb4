"""Model calls as injected functions with deterministic stand-ins, and the pure logic around them.

A model is a plain function over one input; it runs in Arrow batches on the executors. Stand-ins need no network and
give the same results everywhere, so that plans around them can be tested.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REFUSAL, kangxi
from .sections import slices

DIM = 64
#: Waits before the second and third attempt, and the time that all attempts may take, in seconds (fixed values).
BACKOFF, BUDGET = (0.2, 0.8), 5.0


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def hashed_embedding(text: str) -> list[float]:
    """A bag of hashed words of length one."""
    v = [0.0] * DIM
    for w in _words(text):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % DIM] += 1.0 if h >> 63 else -1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


def embed(text: Column | str, model: Callable[[str], list[float]] = hashed_embedding) -> Column:
    return F.pandas_udf(lambda s: s.map(model), "array<double>")(text)


def overlap_score(query: str, content: str) -> float:
    q = set(_words(query))
    return len(q & set(_words(content))) / len(q) if q else 0.0


def cross_encode(query: Column | str, content: Column | str, model: Callable[[str, str], float] = overlap_score) -> Column:
    return F.pandas_udf(lambda a, b: pd.Series([float(model(x, y)) for x, y in zip(a, b)]), "double")(query, content)


def first_sentence(question: str, sections: list[str]) -> str:
    """A draft: the first sentence of the best section, or the refusal."""
    best = max(sections or [""], key=lambda s: overlap_score(question, s))
    return re.split(r"(?<=[.!?])\s", best)[0] if best else REFUSAL


def supported_by_words(answer: str, sections: list[str]) -> bool:
    known = {w for s in sections for w in _words(s)}
    return bool(sections) and all(w in known for w in _words(answer))


def attempts(call: Callable[[], bool], clock: Callable[[], float], sleep: Callable[[float], None]) -> tuple[bool | None, int]:
    """(result, retries): three attempts with backoff inside the budget; null, and so not grounded, if all fail."""
    start = clock()
    for n in range(len(BACKOFF) + 1):
        try:
            return call(), n
        except Exception:  # noqa: BLE001  any failure of a model counts as one
            if n == len(BACKOFF) or clock() - start + BACKOFF[n] > BUDGET:
                return None, n
            sleep(BACKOFF[n])
    return None, len(BACKOFF)


def answer(passed: DataFrame, draft: Callable = first_sentence, verify: Callable = supported_by_words) -> DataFrame:
    """(query_id, answer, passed, reason) of rows(query_id, question, sections): drafted, then verified; what fails becomes the refusal."""

    def run(batches):
        for rows in batches:
            out = []
            for q, question, sections in zip(rows["query_id"], rows["question"], rows["sections"]):
                texts = list(sections) if sections is not None else []
                text = draft(question, texts)
                ok = text != REFUSAL and verify(text, texts)
                out.append((q, text if ok else REFUSAL, ok, None if ok else ("retrieval_empty" if not texts else "claim_unsupported")))
            yield pd.DataFrame(out, columns=["query_id", "answer", "passed", "reason"])

    kind = passed.schema["query_id"].dataType.simpleString()
    return passed.select("query_id", "question", "sections").mapInPandas(run, f"query_id {kind}, answer string, passed boolean, reason string")


def same_subject(a: str, b: str) -> str:
    """A stand-in judge: numbers that differ in otherwise alike texts contradict."""
    na, nb = re.findall(r"\d+", a), re.findall(r"\d+", b)
    return "contradiction" if na != nb and overlap_score(re.sub(r"\d+", "", a), b) > 0.5 else "consistent"


def judge(a: Column | str, b: Column | str, model: Callable[[str, str], str] = same_subject) -> Column:
    return F.pandas_udf(lambda x, y: pd.Series([model(p, q) for p, q in zip(x, y)]), "string")(a, b)


def rewrite(question: Column | str, history: Column | str, model: Callable[[str, list[str]], str] = lambda q, h: f"{h[-1]} / {q}") -> Column:
    """The first turn passes as it is; later ones are rewritten over their history."""
    return F.pandas_udf(lambda q, h: pd.Series([x if y is None or not len(y) else model(x, list(y)) for x, y in zip(q, h)]), "string")(question, history)


def transcribe(pages: DataFrame, model: Callable[[bytes], str] = lambda page: page.decode("utf-8", "replace")) -> DataFrame:
    """(doc, page, text) of rows(doc, page, image); order is the page's number, whatever finishes first."""

    def run(batches):
        for rows in slices(batches, "image"):
            text = [None if x is None else model(x) for x in rows.column("image").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("page"), pa.array(text, pa.string())], names=["doc", "page", "text"])

    return pages.select("doc", "page", "image").mapInArrow(run, "doc string, page int, text string")


def classify_source(text: Column | str) -> Column:
    """A stand-in classifier: a page about one capitalised name is an entity, else a concept."""
    return F.when(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"\b[A-Z][a-z]+")) >= 3, "entity").otherwise("concept")


# ---------------------------------------------------------------- judge replies and chapters


def judge_reply(reply: str) -> tuple[bool, str]:
    """(answers, reasoning) of a judge's JSON reply, in a code fence or not; an unreadable reply counts as no, with its beginning as the reason."""
    text = reply.strip()
    if text.startswith("```"):
        text = re.sub(r"^(?i:json)", "", text.strip("`")).strip()
    try:
        fields = json.loads(text)
        return bool(fields.get("answers", False)), str(fields.get("reasoning", "")).strip()
    except (ValueError, AttributeError):
        return False, f"unparseable judge reply: {reply[:120]}"


def overlap_reply(query: str, content: str) -> str:
    """A stand-in judge: a content that holds most of the query's words answers it."""
    share = overlap_score(query, content)
    return json.dumps({"answers": share >= 0.5, "reasoning": f"{share:.2f} of the words"})


def judged(items: DataFrame, model: Callable[[str, str], str] = overlap_reply) -> DataFrame:
    """Adds ``answers`` and ``reasoning`` to items(query, content, ...): whether a judge finds that the content answers the query."""
    reply = F.pandas_udf(lambda q, c: pd.DataFrame([judge_reply(model(x, y)) for x, y in zip(q, c)], columns=["answers", "reasoning"]), "answers boolean, reasoning string")
    return items.withColumn("_reply", reply("query", "content")).select(*items.columns, "_reply.answers", "_reply.reasoning")


def sentence_chapters(text: str, size: int = 2000) -> list[tuple[str, str]]:
    """A stand-in proposal: a chapter at the first line, and at each line some ``size`` characters after the last, titled by its first words."""
    out, at, due = [], 0, 0
    for line in text.splitlines(keepends=True):
        if line.strip() and at >= due:
            words = line.split()
            out.append((" ".join(words[:5]), " ".join(words[:12])))
            due = at + size
        at += len(line)
    return out


def propose_chapters(docs: DataFrame, model: Callable[[str], list[tuple[str, str]]] = sentence_chapters) -> DataFrame:
    """(id, place, title, anchor) of rows(id, text): proposed chapters in order; a proposal of none is an error, a null text has none."""

    def run(batches):
        for rows in batches:
            out = []
            for i, text in zip(rows["id"], rows["text"]):
                if text is None:
                    continue
                chapters = model(text)
                if not chapters:
                    raise ValueError(f"no chapters were proposed for {i}")
                out += [(i, k, title, anchor) for k, (title, anchor) in enumerate(chapters)]
            yield pd.DataFrame(out, columns=["id", "place", "title", "anchor"])

    return docs.select("id", "text").mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, place int, title string, anchor string")


# ---------------------------------------------------------------- PDF

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]+>|T\*|TD|Td|ET")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_text(raw: bytes) -> list[str]:
    """The text that each content stream of a plain PDF shows, as a stand-in for a converter's.

    Streams are plain or deflated, strings of one byte a character; an encrypted file, or none, is an error.
    """
    if not raw.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    if b"/Encrypt" in raw:
        raise ValueError("the PDF is encrypted")
    out = []
    for head, body in _STREAM.findall(raw):
        if b"/FlateDecode" in head:
            with contextlib.suppress(zlib.error):
                body = zlib.decompress(body)
        if b"BT" not in body:
            continue
        parts: list[bytes] = []
        for token in _SHOWN.findall(body):
            if token[:1] == b"(":
                parts.append(re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1]))
            elif token[:1] == b"<":
                digits = re.sub(rb"\s", b"", token[1:-1])
                parts.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
            elif parts and parts[-1] != b"\n":
                parts.append(b"\n")
        out.append(b"".join(parts).decode("latin-1").strip())
    return out


def has_text_layer(content: Column | str, model: Callable[[bytes], list[str]] = pdf_text) -> Column:
    """Whether any page of a PDF (binary) shows text that is not blank; null for null, an error for a file that cannot be opened."""
    return F.pandas_udf(lambda s: s.map(lambda raw: None if raw is None else any(t.strip() for t in model(raw))), "boolean")(content)


def pdf_to_markdown(content: Column | str, model: Callable[[bytes], list[str]] = pdf_text) -> Column:
    """The text of a PDF's pages, a blank line between them, with Kangxi radicals unified; empty where there is no text layer."""
    text = F.pandas_udf(lambda s: s.map(lambda raw: None if raw is None else "\n\n".join(t for t in model(raw) if t)), "string")
    return kangxi(text(content))
