"""Text functions, Column to Column: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for retrieval (fixed values).
STOP_WORDS = "a an and are as at by can do does for from how i in is it my of on the to what when which with".split()
#: Ranges of Han characters as a regular-expression class body (fixed values).
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"
WORD_OR_HAN = rf"[{HAN}]+|[a-z0-9]+"
HAN_RATIO = 0.20
#: ASCII punctuation, links between pages, inline citations and the refusal (fixed values).
PUNCTUATION = r"[!-/:-@\[-`{-~]"
WIKILINK = r"\[\[([^\]|#]+?)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"
CITATION_TRIMMED = r"\[Source:\s*([^\]]+?)\s*\]"
CITATION = r"\[Source:\s*([^\]]+)\]"
REFUSAL = "I cannot confirm from the knowledge base."


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text: Column | str) -> Column:
    """Retrieval tokens in order: bigrams of Han runs (a lone character stays), lower-case words without stop words and single letters.

    Null gives null, empty gives an empty array.
    """
    runs = F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_OR_HAN), F.lit(0))

    def split(run):
        bigrams = F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))
        return F.when(run.rlike("^[a-z0-9]"), F.array(run)).otherwise(bigrams)

    return F.filter(F.flatten(F.transform(runs, split)), lambda t: ~t.isin(STOP_WORDS) & ~t.rlike("^[a-z]$"))


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def slugify(text: Column | str, empty: str = "section") -> Column:
    """Letters of any script and ASCII digits; only ASCII letters are lowered; other runs become one dash, none at the ends."""
    dashed = F.regexp_replace(ascii_lower(_col(text)), r"[^\p{L}0-9]+", "-")
    return F.coalesce(F.nullif(F.trim(dashed, F.lit("-")), F.lit("")), F.lit(empty))


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{HAN}]"))


def detect_lang(text: Column | str) -> Column:
    """``zh`` if Han characters are a fifth or more of Han and other letters, else ``en``."""
    text = _col(text)
    han = han_count(text)
    other = F.regexp_count(text, F.lit(rf"[\p{{L}}&&[^{HAN}]]"))
    return F.when((han + other > 0) & (han >= HAN_RATIO * (han + other)), "zh").otherwise("en")


def script_ratio(text: Column | str) -> Column:
    """Share of Han characters among Han characters and ASCII letters; 0 if there are none."""
    text = _col(text)
    han = han_count(text)
    both = han + F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(both > 0, han / both).otherwise(0.0)


def is_han(char: Column | str) -> Column:
    return F.regexp_like(_col(char), F.lit(f"^[{HAN}]$"))


def normalize_question(text: Column | str) -> Column:
    spaced = F.regexp_replace(F.lower(_col(text)), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def question_slug(text: Column | str) -> Column:
    """The first 40 characters of the slug and six digits of the normalised question's SHA-1."""
    slug = slugify(text)
    slug = F.when(slug == "section", "qa").otherwise(F.substring(slug, 1, 40))
    return F.concat(slug, F.lit("-"), F.substring(F.sha1(normalize_question(text)), 1, 6))


def canonical_query(text: Column | str) -> Column:
    """Lower case, no ASCII punctuation or white space at the ends, single spaces."""
    low = F.regexp_replace(F.lower(_col(text)), r"^\s+|\s+$", "")
    bare = F.regexp_replace(low, rf"^{PUNCTUATION}+|{PUNCTUATION}+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"\s+", " ")


def parse_kv(summary: Column | str) -> Column:
    """key=value pairs of a log summary after its quoted query; the last of a key wins."""
    rest = F.regexp_replace(_col(summary), r'"[^"]*"', "")
    pairs = F.arrays_zip(F.regexp_extract_all(rest, F.lit(r"(\w+)=(\S+)"), F.lit(1)).alias("k"), F.regexp_extract_all(rest, F.lit(r"(\w+)=(\S+)"), F.lit(2)).alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def wikilinks(body: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_col(body), F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x))


def citations(text: Column | str, trimmed: bool = True) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(CITATION_TRIMMED if trimmed else CITATION), F.lit(1))


def cited_ids(text: Column | str) -> Column:
    """Distinct cited ids, trimmed, ascending."""
    return F.array_sort(F.array_distinct(F.transform(citations(text, False), lambda x: F.trim(x))))


def estimate_tokens(text: Column | str) -> Column:
    return F.floor(F.length(_col(text)) / 3).cast("long")


def furniture_key(line: Column | str) -> Column:
    """A line's form for counting repeats: single spaces, l and I as 1, digit runs as #."""
    line = F.trim(F.regexp_replace(_col(line), r"(?U)\s+", " "))
    return F.regexp_replace(F.translate(line, "lI", "11"), r"(?U)\d+", "#")


def kangxi(text: Column | str) -> Column:
    """Kangxi radicals (U+2F00 to U+2FD5) as the unified characters that compatibility normalisation gives."""
    import unicodedata

    radicals = [chr(c) for c in range(0x2E80, 0x2FE0)]
    pairs = [(c, n) for c in radicals if (n := unicodedata.normalize("NFKC", c)) != c and len(n) == 1]
    return F.translate(_col(text), "".join(c for c, _ in pairs), "".join(n for _, n in pairs))


def normalize_anchor(text: Column | str) -> Column:
    """No white space; full-width punctuation as ASCII."""
    return F.translate(F.regexp_replace(_col(text), r"(?U)\s+", ""), "，。：；！？（）", ",.:;!?()")


def truncated(text: Column | str, limit: int, mark: str = "") -> Column:
    text = _col(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def log_safe(text: Column | str, limit: int = 60) -> Column:
    """Bounded, without line breaks, double quotes as single."""
    return F.translate(F.substring(_col(text), 1, limit), "\"\r\n", "'")


def wrap_untrusted(content: Column | str, open_mark: str = "<<<UNTRUSTED>>>", close_mark: str = "<<<END>>>") -> Column:
    return F.concat(F.lit(open_mark + "\n"), _col(content), F.lit("\n" + close_mark))


def client_ip(forwarded: Column | str, peer: Column | str) -> Column:
    """Last hop of X-Forwarded-For, else the peer, else ``unknown``."""
    hop = F.nullif(F.trim(F.element_at(F.split(_col(forwarded), ","), -1)), F.lit(""))
    return F.coalesce(hop, F.nullif(_col(peer), F.lit("")), F.lit("unknown"))


#: Templates of paths with parameters, tried in order (fixed values).
PATH_TEMPLATES = [
    (r"^/wiki/qa/[^/]+/refile$", "/wiki/qa/{slug}/refile"),
    (r"^/wiki/qa/[^/]+/promote$", "/wiki/qa/{slug}/promote"),
    (r"^/wiki/qa/[^/]+/demote$", "/wiki/qa/{slug}/demote"),
    (r"^/wiki/pages/[^/]+/aliases/[^/]+$", "/wiki/pages/{slug}/aliases/{alias}"),
    (r"^/wiki/pages/[^/]+/aliases$", "/wiki/pages/{slug}/aliases"),
    (r"^/wiki/pages/(?!reconcile$|collision$)[^/]+$", "/wiki/pages/{slug}"),
    (r"^/wiki/qa/(?!promote-batch$)[^/]+$", "/wiki/qa/{slug}"),
]


def canonical_path(path: Column | str) -> Column:
    path = F.regexp_replace(_col(path), r"(?<=.)/+$", "")
    out = None
    for pattern, template in PATH_TEMPLATES:
        out = F.when(path.rlike(pattern), template) if out is None else out.when(path.rlike(pattern), template)
    return out.otherwise(path)


def jaccard(a: Column | str, b: Column | str, empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays as sets; ``empty`` if both are empty."""
    a, b = _col(a), _col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_ratio(query: Column | str, text: Column | str) -> Column:
    """Share of the distinct query tokens that the text holds; an empty query is an error."""
    q = F.array_distinct(_col(query))
    return F.when(F.size(q) == 0, F.raise_error(F.lit("the query has no tokens")).cast("double")).otherwise(F.size(F.array_intersect(q, _col(text))) / F.size(q))


def is_refusal(answer: Column | str) -> Column:
    return F.trim(_col(answer)) == REFUSAL


def embed_text(heading_path: Column | str, content: Column | str, section_id: Column | str) -> Column:
    """Breadcrumb and body; whichever is there; else the id."""
    crumb, body = F.array_join(_col(heading_path), " > "), F.trim(_col(content))
    return F.when((crumb != "") & (body != ""), F.concat(crumb, F.lit("\n"), body)).when(body != "", body).when(crumb != "", crumb).otherwise(_col(section_id))


def parse_instant(text: Column | str) -> Column:
    """ISO-8601 text as an instant, naive ones as UTC; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(_col(text), "Z$", "+00:00"))


def iso_valid(text: Column | str) -> Column:
    return parse_instant(text).isNotNull()


def bare_slug(slug: Column | str) -> Column:
    """Whether a name is one safe path component."""
    slug = _col(slug)
    return (slug != "") & ~slug.rlike(r"[/\\\x00-\x1f]") & ~slug.isin(".", "..") & ~slug.startswith(".")


def safe_filename(name: Column | str) -> Column:
    """No separators, anchors, drive colons, control characters or text-direction marks."""
    name = _col(name)
    return (F.trim(name) != "") & ~name.rlike(r"[#/\\:\x00-\x1f\x7f\x{202A}-\x{202E}\x{2066}-\x{2069}]")


def safe_path(path: Column | str, roots: list[str]) -> Column:
    """A relative path below one of the roots, without parent steps."""
    path = _col(path)
    parts = F.split(path, r"[/\\]")
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(parts, "..") & F.element_at(parts, 1).isin(roots)
