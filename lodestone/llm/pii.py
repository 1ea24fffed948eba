"""Operator 2: personal data in texts, in DataFrame functions only.

Regular expressions propose spans, validators confirm them, and words nearby adjust the score.

Base kinds (leftmost, not overlapping within a kind; what fails is dropped and not retried):
email; ip (parts at most 255); card (16 to 19 digits that pass Luhn); phone (8 to 15 digits).
Base spans stay whatever their score. Added kinds are kept from ``least_score`` on: iban
(passes mod-97) and card_short (13 to 15 digits that pass Luhn; a tenth of all numbers
does, so only words nearby bring it over the line).

The patterns are written so that a match costs time linear in the text: possessive
quantifiers (what follows never matches what they took), and a look-behind that lets a match
begin only where its run of characters begins or where the last match ended, which are
the places where the plain pattern's leftmost match can begin. The card patterns match
whole digit chains of the right length; other chains give no span.

Positions come from the pieces between matches: a match begins where the lengths before it
end. The running sums are made block by block, so that a text with very many matches
doesn't cost the square of their number. Positions are code points, the end exclusive.

Cases: a null text counts as empty and has no spans; repeated rows each get a row; ties
can't be, as spans of one kind don't overlap. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "A-Za-z0-9._%+-"
#: Kind -> pattern. The first four are the base kinds, in the order they are listed.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "card_short": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: Scores in percent of a confirmed span, and what words nearby add to it.
SCORES = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 85, "card_short": 40}
CONTEXT_ADDS, LEAST_SCORE, CONTEXT_CHARS = 40, 80, 48
#: Words that speak for a kind, in lower case.
CONTEXT = {
    "email": "mail|contact|write|reply|address",
    "ip": "ip|host|server|address|network|login",
    "card": "card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|cell|fax|telefon|appel|llame",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
    "card_short": "card|visa|master|amex|credit|debit|karte|carte|tarjeta",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SPAN = "array<struct<start:int,end:int,score:int>>"
_BLOCK = 256


def _mod97(m: Column) -> Column:
    s = F.regexp_replace(m, " ", "")
    s = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    chars = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1)))
    number = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: ((a * F.when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(100)) + number(c)) % 97).cast("int")
    return F.aggregate(chars, F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind in ("card", "card_short"):
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


def _placed(parts: Column) -> Column:
    """parts: array of (gap, len, ok, score) -> array of (start, end, score) where ok."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int")), lambda b: F.slice(parts, b * _BLOCK + 1, F.lit(_BLOCK)))
    total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + x["len"])
    none = F.array().cast("array<int>")
    bases = F.aggregate(
        F.transform(blocks, total), F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def walk(block: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + x["gap"]
            span = F.struct(begin.alias("start"), (begin + x["len"]).alias("end"), x["score"].alias("score"))
            return F.struct((begin + x["len"]).alias("at"), F.when(x["ok"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        return F.aggregate(block, start, step)["out"]

    return F.flatten(F.zip_with(blocks, bases, walk))


def find(docs: DataFrame, least_score: int = LEAST_SCORE) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, score in percent), by kind as in
    PATTERNS, then start."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    nothing = F.array().cast("array<string>")
    found = {}
    for k, p in PATTERNS.items():
        there = (F.col("text").contains("@") & F.col("text").rlike(p)) if k == "email" else F.col("text").rlike(p)
        found[k] = F.when(there, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(nothing).alias(f"m_{k}")
    rows = rows.select("doc_id", "text", *found.values())
    rows = rows.select("doc_id", *[f"m_{k}" for k in PATTERNS], *[
        F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(nothing).alias(f"s_{k}") for k, p in PATTERNS.items()])

    def parts(k: str) -> Column:
        pieces = F.col(f"s_{k}")

        def part(m: Column, i: Column) -> Column:
            near = F.concat_ws(" ", F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS)), F.left(F.get(pieces, i + 1), F.lit(CONTEXT_CHARS // 2)))
            helped = F.lower(near).rlike(rf"(?:^|[^a-z])(?:{CONTEXT[k]})")
            score = F.when(helped, F.lit(min(100, SCORES[k] + CONTEXT_ADDS))).otherwise(F.lit(SCORES[k]))
            ok = _confirmed(k, m)
            return F.struct(
                F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"),
                (ok if k in BASE else ok & (score >= least_score)).alias("ok"), score.alias("score"))

        return F.when(F.size(f"m_{k}") > 0, _placed(F.transform(f"m_{k}", part))).otherwise(F.array().cast(_SPAN))

    rows = rows.select("doc_id", *[parts(k).alias(k) for k in PATTERNS])
    named = lambda k: F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return rows.select("doc_id", F.concat(*[named(k) for k in PATTERNS]).alias("spans"))


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (string), n_added, scores."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, text), ",")
    of = lambda k: lambda s: s["kind"] == k
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return spans.select(
        "doc_id", *[F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin(*BASE))).cast("long").alias("n_added"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


