"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. The patterns are written so that Java's matcher runs in linear time and without
recursion on any text: possessive loops, and look-behinds in place of starts that cannot succeed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unused

#: Kinds in the order of ties. pattern: of a candidate; gate: a cheap test that must hold; base: score before context.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
SCORES = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}
#: Words that raise the score of a kind where they stand within ``WINDOW`` characters before a span, in English, German,
#: French and Spanish (fixed values).
CONTEXT = {
    "email": "mail|contact|write to|kontakt|schreib|courriel|écri|correo|escrib",
    "ip": "address|host|server|client|login|adresse|rechner|serveur|dirección|servidor",
    "card": "card|visa|mastercard|credit|payment|cvv|karte|kredit|zahlung|carte|crédit|paiement|tarjeta|crédito|pago",
    "phone": "phone|call|tel|mobile|fax|contact|telefon|anruf|handy|mobil|appel|portable|llam|teléfono|móvil",
    "iban": "iban|bank|account|transfer|konto|überweis|compte|virement|banque|cuenta|banco|transferencia",
}
WINDOW, RAISE = 48, 0.1
#: Least characters of a match; so many matches before one reach back over the window.
SHORTEST = {"email": 5, "ip": 7, "card": 14, "phone": 4, "iban": 15}
#: Members of an array that are summed one after another; a longer one is summed in parts of so many.
PART = 128


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + _doubled(F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48, i),
    )
    return total % 10 == 0


def _doubled(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)


def mod97(code: Column) -> Column:
    """Whether an account code, its first four characters moved behind, leaves 1 modulo 97."""
    plain = F.regexp_replace(code, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    at = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(moved)),
        F.lit(0),
        lambda acc, i: (acc * F.when(at(F.substring(moved, i, F.lit(1))) > 9, 100).otherwise(10) + at(F.substring(moved, i, F.lit(1)))) % 97,
    )
    return (rest == 1) & F.length(plain).between(15, 34)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits_of(match)).between(14, 19) & luhn(digits_of(match))
    if kind == "phone":
        return F.length(digits_of(match)).between(10, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def gate(kind: str, text: Column) -> Column:
    """A test that any text with a candidate passes."""
    if kind == "email":
        return F.instr(text, F.lit("@")) > 0
    if kind == "phone":
        return text.rlike(r"\+[0-9]")
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
    return text.rlike(r"[A-Z][A-Z][0-9][0-9][\x20A-Z0-9]")


def _sums(values: Column) -> Column:
    """(total, the sums before each member) of an array of integers; its steps copy what they have so far."""
    zero = F.struct(F.lit(0).alias("total"), F.expr("CAST(array() AS array<int>)").alias("before"))
    return F.aggregate(values, zero, lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")))


def sums_before(values: Column) -> Column:
    """The sum of all members before each member of an array of integers, in time that follows the array's length.

    Parts of ``PART`` members are summed apart, then the parts' totals.
    """

    def whole(v):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda k: _sums(F.slice(v, k * PART + 1, PART)))
        return let(parts, lambda p: F.flatten(F.zip_with(p, _sums(F.transform(p, lambda x: x["total"]))["before"], lambda x, base: F.transform(x["before"], lambda y: y + base))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.expr("CAST(array() AS array<int>)")))


PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}


def matches(kind: str, text: Column, use) -> Column:
    """``use`` of the matches of a kind, array<struct<m, g>> (g: the text between the match and the one before), and of the text after the last.

    The matches and the text between them are taken by the same pattern, leftmost and not overlapping.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))

    def paired(both):
        return let(F.zip_with(both["m"], F.slice(both["g"], 1, F.size(both["m"])), lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda pairs: use(pairs, F.get(both["g"], F.size(both["m"]))))

    return let(F.struct(found.alias("m"), F.split(text, PATTERNS[kind], -1).alias("g")), paired)


def proposed(kind: str, text: Column) -> Column:
    """Confirmed spans of a kind: array<struct<start, rank, end, kind, match, score>>, ends exclusive, in code points."""
    rank, back = KINDS.index(kind), -(-WINDOW // SHORTEST[kind])

    def spans(pairs, _):
        sized = F.transform(pairs, lambda p: F.struct(p["m"].alias("m"), F.length(p["m"]).alias("n"), F.length(p["g"]).alias("g"), F.right(p["g"], F.lit(WINDOW)).alias("tail")))

        def placed(all_, before):
            def one(p, i):
                start = F.get(before, i) + p["g"]
                first = F.greatest(i - back, F.lit(0))
                # what stands before the match: the ends of the texts between matches, and the matches among them
                near = F.concat(F.array_join(F.transform(F.slice(all_, first + 1, i - first), lambda q: F.concat(q["tail"], q["m"])), ""), p["tail"])
                score = F.lit(SCORES[kind]) + F.when(F.lower(F.right(near, F.lit(WINDOW))).rlike(CONTEXT[kind]), RAISE).otherwise(0.0)
                return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + p["n"]).alias("end"), F.lit(kind).alias("kind"), p["m"].alias("match"), score.alias("score"))

            return F.filter(F.transform(all_, one), lambda x: confirmed(kind, x["match"]))

        return let(sized, lambda all_: let(sums_before(F.transform(all_, lambda p: p["n"] + p["g"])), lambda before: placed(all_, before)))

    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string,match:string,score:double>>)")
    return F.when(gate(kind, text), matches(kind, text, spans)).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """Adds ``out_col``: array<struct<start, rank, end, kind, match, score>> in order of start, then kind.

    Emails, IP addresses (parts at most 255), cards (14 to 19 digits, Luhn), phones (10 to 15 digits), and
    account codes (mod 97). The score is the kind's, raised where a context word stands shortly before.
    A null or empty text has no spans; ties of start are ordered by kind; repeated rows stay. The time follows
    the text's length, however many matches it has. All columns pass: where one has the new name, the new
    column is called with further underscores.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(unused(out_col, docs), F.array_sort(F.concat(*(proposed(k, text) for k in KINDS))))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The text with each span of at least the score ``least`` replaced by its kind in brackets; all other columns pass.

    One kind after another, in the order of ``KINDS``, each in the text that those before it have left.
    """
    for kind in KINDS:
        text = F.col(f"`{text_col}`")
        if SCORES[kind] < least:
            continue

        def put(pairs, rest, kind=kind):
            marked = F.transform(pairs, lambda p: F.concat(p["g"], F.when(confirmed(kind, p["m"]), F.lit(f"[{kind}]")).otherwise(p["m"])))
            return F.concat(F.array_join(marked, ""), rest)

        docs = docs.withColumn(text_col, F.when(gate(kind, text), matches(kind, text, put)).otherwise(text))
    return docs


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = find_pii(docs.select(F.col(id_col), F.col(text_col)), text_col)
    counts = [count_of("pii", k).alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("pii", lambda x: x["rank"] < len(BASE_KINDS))
    return rows.select(
        id_col,
        *counts,
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda x: x["score"])), F.lit(0.0)).alias("top_score"),
    )
