"""Markdown to sections, frontmatter, HTML to Markdown, splitting, long-form and furniture.

Parsing one document into many rows has no built-in form: it runs as a batched Arrow map. What follows from
the rows stays in DataFrame functions.
"""

from __future__ import annotations

import html.parser
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, furniture_key, slugify, tokenize

HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
FENCE = "```"

#: Bytes of text that a task holds as Python objects at once.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in consecutive slices of about ``limit`` bytes of ``column`` (one row at least); an empty batch stays one."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)


# ---------------------------------------------------------------- frontmatter


def frontmatter_of(text: str) -> tuple[dict, str]:
    """Frontmatter as a dict, and the body. A leading HTML comment is skipped; malformed or absent frontmatter gives {} and the whole text."""
    import yaml

    rest = text
    if rest.startswith("<!--") and (end := rest.find("-->")) >= 0:
        rest = rest[end + 3 :].lstrip("\n")
    m = re.match(r"---\n(.*?)(?:^|\n)---[ \t]*(?:\n|$)", rest, re.S)
    if not m:
        return {}, text
    try:
        fields = yaml.safe_load(m[1])
    except yaml.YAMLError:
        return {}, text
    return (fields, rest[m.end() :]) if isinstance(fields, dict) else ({}, text)


def first_fences(text: str) -> tuple[str | None, str]:
    """The writers' dialect: the text between the first two lines that are ``---``, wherever they stand, and what follows; null without both."""
    lines = text.splitlines()
    marks = [i for i, line in enumerate(lines) if line.strip() == "---"][:2]
    if len(marks) < 2:
        return None, text
    return "\n".join(lines[marks[0] + 1 : marks[1]]), "\n".join(lines[marks[1] + 1 :])


def with_frontmatter(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``frontmatter`` (JSON text; ``{}`` where absent or malformed) and ``body``. Null texts give nulls."""

    def run(batches):
        for batch in slices(batches, text_col):
            fm, body = [], []
            for t in batch.column(text_col).to_pylist():
                fields, rest = frontmatter_of(t) if t is not None else (None, None)
                fm.append(None if fields is None else json.dumps(fields, default=str, ensure_ascii=False))
                body.append(rest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fm, pa.string()), pa.array(body, pa.string())], names=[*batch.schema.names, "frontmatter", "body"])

    files = files.drop("frontmatter", "body")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), "frontmatter string", "body string"])
    return files.mapInArrow(run, schema)


# ---------------------------------------------------------------- sections


def outline(body: str) -> tuple[list[tuple[int, int, str]], list[str]]:
    """Headings (line, depth, text) outside fences, and the lines with their ends."""
    lines = body.splitlines(keepends=True)
    fenced, found = False, []
    for i, line in enumerate(lines):
        if line.startswith(FENCE):
            fenced = not fenced
        elif not fenced and (m := HEADING.match(line.rstrip("\n"))):
            found.append((i, len(m[1]), m[2]))
    return found, lines


def sections_of(body: str, name: str, stem: str | None = None) -> list[dict]:
    """Sections in emission order: a heading is emitted where it closes, so parents follow their children.

    Each heading owns the lines up to the next heading. It is a section if no deeper heading follows at once
    (a leaf), or if its own lines are not blank. Text before the first heading is a section of its own.
    A body without headings is one section. ``slug`` is null there; otherwise ids are made of it later.
    """
    found, lines = outline(body)
    if not found:
        return [{"heading": name, "path": [name], "content": body.strip(), "slug": None, "leaf": True}]
    out = []
    before = "".join(lines[: found[0][0]]).strip()
    if before:
        out.append({"heading": stem or name, "path": [stem or name], "content": before, "slug": "intro", "leaf": True})
    ends = [i for i, _, _ in found[1:]] + [len(lines)]
    rows, open_ = [], []
    for k, ((at, depth, text), end) in enumerate(zip(found, ends)):
        open_ = [h for h in open_ if h[0] < depth]
        closes = next((j for j in range(k + 1, len(found)) if found[j][1] <= depth), len(found))
        leaf = k + 1 == len(found) or found[k + 1][1] <= depth
        content = "".join(lines[at + 1 : end]).strip()
        if leaf or content:
            rows.append((closes, -k, {"heading": text, "path": [h[1] for h in open_] + [text], "content": content, "slug": "", "leaf": leaf}))
        open_.append((depth, text))
    return out + [r for _, _, r in sorted(rows, key=lambda r: r[:2])]


def sections(files: DataFrame, name_col: str = "name", body_col: str = "body") -> DataFrame:
    """(name, emit_seq, heading, heading_path, content, leaf, id): the sections of each body.

    Ids are ``name#slug``; a slug seen before in the same file gets -2, -3 ... in emission order, without a look at
    literal slugs of that form. A null body has no sections, an empty one has one without content.
    """

    def run(batches):
        for batch in slices(batches, "body"):
            out = [[], [], [], [], [], [], []]
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                if body is None:
                    continue
                for k, s in enumerate(sections_of(body, name or "")):
                    for c, v in zip(out, (name, k, s["heading"], s["path"], s["content"], s["leaf"], s["slug"])):
                        c.append(v)
            kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["name", "emit_seq", "heading", "heading_path", "content", "leaf", "slug"])

    rows = files.select(F.col(name_col).alias("name"), F.col(body_col).alias("body")).mapInArrow(
        run, "name string, emit_seq int, heading string, heading_path array<string>, content string, leaf boolean, slug string"
    )
    slug = F.when(F.col("slug") == "", slugify("heading")).otherwise(F.col("slug"))
    place = F.row_number().over(Window.partitionBy("name", "_slug").orderBy("emit_seq"))
    ident = F.when(F.col("_slug").isNull(), F.col("name")).otherwise(
        F.concat(F.col("name"), F.lit("#"), F.col("_slug"), F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""))
    )
    return rows.withColumn("_slug", slug).withColumn("_n", place).withColumn("id", ident).drop("slug", "_slug", "_n")


def with_tokens(rows: DataFrame) -> DataFrame:
    """Heading tokens, then content tokens."""
    return rows.withColumn("tokens", F.concat(F.when(F.col("id") == F.col("name"), F.array().cast("array<string>")).otherwise(tokenize("heading")), tokenize("content")))


def uncarried(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, missing): non-blank characters of each body, headings aside, that no section carries; 0 at least."""

    def count(batches):
        for batch in slices(batches, "body"):
            n = []
            for body in batch.column("body").to_pylist():
                found, lines = outline(body or "")
                heads = {i for i, _, _ in found}
                n.append(sum(len("".join(line.split())) for i, line in enumerate(lines) if i not in heads))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(n, pa.int64())], names=["name", "chars"])

    body = files.select("name", "body").mapInArrow(count, "name string, chars long")
    held = rows.groupBy("name").agg(F.sum(F.length(F.regexp_replace("content", r"(?U)\s", ""))).alias("held"))
    return body.join(held, "name", "left").select("name", F.greatest(F.lit(0), F.col("chars") - F.coalesce("held", F.lit(0))).alias("missing"))


def longform(files: DataFrame, rows: DataFrame, min_chars: int = 2000, max_headings: int = 1, per_heading: int = 8000, preamble: float = 0.5, cap: int = 6000) -> DataFrame:
    """(name, longform): long bodies with few headings, many characters for each heading, a large preamble, or a section beyond the token cap."""
    size = files.select("name", F.length("body").alias("chars"))
    agg = rows.groupBy("name").agg(
        F.count_if(F.col("id") != F.col("name")).alias("heads"),
        F.sum(F.when(F.col("id") == F.concat("name", F.lit("#intro")), F.length("content")).otherwise(0)).alias("intro"),
        F.max(estimate_tokens("content")).alias("most"),
    )
    test = (F.col("heads") <= max_headings) | (F.col("chars") / F.greatest("heads", F.lit(1)) > per_heading) | (F.col("intro") / F.col("chars") > preamble) | (F.col("most") > cap)
    return size.join(agg, "name").select("name", ((F.col("chars") >= min_chars) & test).alias("longform"))


# ---------------------------------------------------------------- page furniture


def furniture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = 3, prefix_repeats: int = 2, min_chars: int = 5) -> DataFrame:
    """(id, key): line forms that repeat in a document, and forms repeated twice that begin one of those.

    Prefixes are matched inside each document among its repeated forms only.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.explode(F.split(text_col, "\n")).alias("line")).select("id", furniture_key("line").alias("key")).where("key <> ''")
    counts = lines.groupBy("id", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min(repeats, prefix_repeats))
    shape = (F.length("key") >= min_chars) | F.col("key").rlike(r"^#\s*/\s*#$")
    full = counts.where((F.col("n") >= repeats) & shape).select("id", "key")
    parts = counts.where((F.col("n") >= prefix_repeats) & (F.length("key") >= min_chars)).select("id", "key")
    begun = parts.join(full.withColumnRenamed("key", "whole"), "id").where(F.col("whole").startswith(F.col("key"))).select("id", "key")
    return full.unionByName(begun).distinct().withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- HTML

#: Elements dropped with their contents, and void ones (fixed values).
STRIPPED = {"script", "style", "noscript", "iframe", "form", "button"}
VOID = {"input", "meta", "link"}


class _Markdown(html.parser.HTMLParser):
    """Markdown events of a page: headings as #, lists, emphasis, links, tables; comments and stripped elements vanish."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.links: list[str] = []
        self.pre = 0
        self.cells: list[str] | None = None
        self.ruled = False

    def handle_starttag(self, tag, attrs):
        if tag in STRIPPED:
            self.skip += 1
        if self.skip or tag in VOID:
            return
        a = dict(attrs)
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "article", "section", "blockquote", "table"):
            self.out.append("\n\n" + ("> " if tag == "blockquote" else ""))
            self.ruled = self.ruled and tag != "table"
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            mark = "*"
            if self.lists:
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}." if self.lists[-1][0] == "ol" else "*"
            self.out.append(f"\n{'  ' * depth}{mark} ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "tr":
            self.cells = []
            self.out.append("\n|")
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(tag)
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in STRIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag) or tag in ("p", "blockquote", "article", "section"):
            self.out.append("\n\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n" if self.lists else "\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "a":
            self.out.append(f"]({self.links.pop() if self.links else ''})")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag == "tr" and self.cells is not None:
            if not self.ruled:
                self.out.append("\n|" + " --- |" * len(self.cells))
                self.ruled = True
            self.cells = None

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(page: str) -> str:
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    text = "".join(parser.out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", lambda m: m[0] if m[0].startswith("  \n") else "\n", text)).strip()


def convert_pages(pages: DataFrame, html_col: str = "html", out_col: str = "markdown") -> DataFrame:
    """Adds the Markdown of each page; null stays null."""
    pages = pages.drop(out_col)

    def run(batches):
        for batch in slices(batches, html_col):
            text = [None if h is None else html_to_markdown(h) for h in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, out_col])

    return pages.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), f"{out_col} string"]))


# ---------------------------------------------------------------- outline and fences


def outline_text(text: Column | str, max_tokens: int = 2000) -> Column:
    """All heading lines, whatever fences they stand in, then the first ``3 * max_tokens`` characters of the other lines.

    A heading is one to six number signs and a space, after any white space. Null stays null.
    """
    text = F.col(text) if isinstance(text, str) else text
    lines = F.split(text, "\n")
    ended = F.transform(lines, lambda x, i: F.when(i < F.size(lines) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    is_heading = lambda x: x.rlike(r"^\s*#{1,6} ")
    heads = F.transform(F.filter(ended, is_heading), lambda x: F.rtrim(x, F.lit("\n")))
    body = F.substring(F.array_join(F.filter(ended, lambda x: ~is_heading(x)), ""), 1, 3 * max_tokens)
    return F.array_join(F.filter(F.concat(heads, F.array(body)), lambda x: x != ""), "\n")


def fence_parity(lines: DataFrame, key: str = "name", order: str = "line", text_col: str = "x") -> DataFrame:
    """Adds ``inside``: whether an odd number of fence lines of the same text stand before a line."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("inside", F.coalesce(F.sum(F.col(text_col).startswith(FENCE).cast("int")).over(before), F.lit(0)) % 2 == 1)


# ---------------------------------------------------------------- splitting

#: From coarse to fine (fixed values).

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that allows it; a piece repeats up to ``overlap`` characters of the one before."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out: list[str] = []
    held: list[str] = []

    def flush():
        if piece := "".join(held).strip():
            out.append(piece)

    for part in parts:
        if len(part) > size:
            flush()
            held.clear()
            out += split_text(part, size, overlap, finer)
            continue
        if sum(map(len, held)) + len(part) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def chunks(sections: DataFrame, id_col: str = "id", text_col: str = "content", size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk, content): each section's pieces; a section without text has none."""

    def run(batches):
        for batch in slices(batches, "text"):
            out = [(i, k, c) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) if t for k, c in enumerate(split_text(t, size, overlap))]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("id").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["id", "chunk", "content"])

    rows = sections.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, chunk int, content string")


def pack_paragraphs(text: Column, cap: int) -> Column:
    """Paragraphs packed greedily, in order, into parts of at most ``cap`` estimated tokens (a longer paragraph stands alone)."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    zero = F.struct(F.lit("").alias("cur"), F.expr("CAST(array() AS array<string>)").alias("out"))

    def step(acc, p):
        joined = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        fits = (acc["cur"] == "") | (F.floor(F.length(joined) / 3) <= cap)
        return F.struct(F.when(fits, joined).otherwise(p).alias("cur"), F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))).alias("out"))

    return F.aggregate(paragraphs, zero, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))
