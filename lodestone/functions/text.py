"""Column expressions on text: identities, cleaning, normalising, parsing.

Classes of characters are ASCII unless ``unicode=True``, so that results do not depend on the
engine that evaluates them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, further CJK punctuation, English articles.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‛„‟…‧﹏."
ARTICLES = ("a", "an", "the")
BLANKS = " \t\n\r\f\x0b"
#: All that Unicode counts as white space, the ideographic space among it.
WHITE = BLANKS + "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entities that have a name in XML.
XML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
KEPT_SIGNS = r".,;:!?'\"()\[\]{}/\\@#$%&*+=<>-"


def hash_id(c: Column, prefix: str = "") -> Column:
    """Prefix and the MD5 of the UTF-8 text."""
    return F.concat(F.lit(prefix), F.md5(c))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def upper(c: Column) -> Column:
    """Upper case with the sharp s spelled out, as Unicode's full mapping has it."""
    return F.upper(F.replace(c, F.lit("ß"), F.lit("SS")))


def clean_control(c: Column) -> Column:
    """Strip, decode the XML entities, delete control characters."""
    out = strip(c)
    for name, char in XML_ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.regexp_replace(out, r"[\x00-\x1f\x7f-\x9f]", "")


def split_markers(c: Column, markers: list[str]) -> Column:
    """Parts between any of the markers, stripped, empty ones dropped."""
    if not markers:
        return F.array(c)
    pattern = "|".join("".join("\\" + x if not x.isalnum() and x.isascii() else x for x in m) for m in markers)
    return F.filter(F.transform(F.split(c, pattern, -1), strip), lambda x: x != "")


def is_float(c: Column) -> Column:
    return c.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def clean_content(c: Column, unicode: bool = False) -> Column:
    """One line of words, digits and basic punctuation."""
    flag = "(?U)" if unicode else ""
    out = F.replace(c, F.lit("\n"), F.lit(" "))
    out = F.regexp_replace(out, "-{2,}", " ")
    out = F.regexp_replace(out, rf"{flag}[^\w\s{KEPT_SIGNS}]", "")
    return strip(F.regexp_replace(out, rf"{flag}\s+", " "))


def words(c: Column) -> Column:
    """Words between ASCII blanks, none empty."""
    return F.filter(F.split(c, r"[ \t\n\r\f\x0b]+", -1), lambda x: x != "")


def _delete(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def normalize_answer(c: Column) -> Column:
    """Lower case, no punctuation (deleted first), no articles, single spaces."""
    kept = F.filter(words(_delete(F.lower(c), PUNCTUATION)), lambda w: ~w.isin(*ARTICLES))
    return F.array_join(kept, " ")


def normalize_zh(c: Column) -> Column:
    """Lower case without punctuation and white space."""
    return _delete(F.lower(c), PUNCTUATION + CJK_PUNCTUATION + WHITE)


def unquote_once(c: Column) -> Column:
    """Strip, then take one surrounding pair of double quotes off."""
    s = strip(c)
    quoted = s.startswith(F.lit('"')) & s.endswith(F.lit('"')) & (F.length(s) >= 2)
    return F.when(quoted, F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def match_key(c: Column) -> Column:
    """Upper case, stripped, without any surrounding double quotes."""
    return F.btrim(strip(upper(c)), F.lit('"'))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens, in upper case; 0 if a side has none."""
    x, y = F.array_distinct(words(upper(a))), F.array_distinct(words(upper(b)))
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def bracketed(c: Column, left: str, right: str) -> Column:
    """From the first ``left`` to the last ``right``; null if they aren't there in this order."""
    start = F.locate(left, c)
    stop = F.length(c) - F.locate(right, F.reverse(c)) + 1
    there = (start > 0) & (F.locate(right, c) > 0) & (stop >= start)
    return F.when(there, F.substr(c, start, stop - start + 1))


def verdict(c: Column, schema: str) -> Column:
    """The fields of the outermost braces in an answer, by ``schema``; null if they don't parse."""
    return F.from_json(F.regexp_extract(c, r"(\{[\s\S]*\})", 1), schema)


def numbers(c: Column, pattern: str = r"(\d+)") -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def first_line(c: Column) -> Column:
    return F.split(F.ltrim(c, F.lit("\n")), "\n", 2)[0]


def first_code_line(c: Column) -> Column:
    """The first line that looks like code, empty if none does."""
    lines = F.filter(F.split(F.ltrim(c, F.lit("\n")), "\n", -1), lambda x: ~x.contains("`") & ~x.contains("#") & ~x.contains("//"))
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def truncate_words(c: Column, most: int) -> Column:
    return F.array_join(F.slice(words(c), 1, most), " ")


def token_count(c: Column) -> Column:
    """Tokens of a text where no tokenizer is at hand: words over 0.75, rounded down."""
    return F.floor(F.size(words(c)) / F.lit(0.75)).cast("long")


def message_tokens(values: Column) -> Column:
    """Tokens of a list of messages: four and its values for each, and two."""
    return (F.aggregate(F.transform(values, lambda v: token_count(v) + 4), F.lit(0).cast("long"), lambda a, x: a + x) + 2).cast("long")


def entity_view(name: Column, kind: Column, description: Column) -> Column:
    """An entity as prompts show it: no quotes around name and type, the description in a list."""
    bare = lambda c: F.btrim(c, F.lit('"'))
    return F.struct(
        bare(F.coalesce(name, F.lit(""))).alias("name"), bare(F.coalesce(kind, F.lit("Unknown"))).alias("type"), F.array(F.coalesce(description, F.lit(""))).alias("descriptions"))


def fill(template: Column, **values: Column) -> Column:
    """A template's ``{name}`` places filled."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def token_f1(prediction: Column, truth: Column) -> Column:
    """Harmonic mean of the shares of shared tokens, repeats counted on both sides; 0 if nothing is
    shared. Arrays of tokens: both are sorted together and read once, so the time of a row grows
    with its tokens and not with their square, and neither array is evaluated again."""
    side = lambda tokens, s: F.transform(tokens, lambda x: F.struct(x.alias("t"), F.lit(s).alias("s")))
    start = F.struct(F.lit(None).cast("string").alias("t"), *[F.lit(0).alias(n) for n in ("p", "g", "same", "n")])

    def read(a: Column, x: Column) -> Column:
        new = ~x["t"].eqNullSafe(a["t"])
        p, g = F.lit(1) - x["s"], x["s"]
        return F.struct(
            x["t"].alias("t"), F.when(new, p).otherwise(a["p"] + p).alias("p"), F.when(new, g).otherwise(a["g"] + g).alias("g"),
            F.when(new, a["same"] + F.least(a["p"], a["g"])).otherwise(a["same"]).alias("same"), (a["n"] + 1).alias("n"))

    def score(a: Column) -> Column:
        same = a["same"] + F.least(a["p"], a["g"])
        return F.when(same == 0, F.lit(0.0)).otherwise(F.lit(2.0) * same / a["n"])

    return F.aggregate(F.sort_array(F.concat(side(prediction, 0), side(truth, 1))), start, read, score)


def qa_f1(prediction: Column, truth: Column) -> Column:
    return token_f1(words(normalize_answer(prediction)), words(normalize_answer(truth)))


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def qa_f1_zh(prediction: Column, truth: Column, segment=characters) -> Column:
    """Over the words that ``segment`` makes of a text (its characters, where no segmenter is at hand),
    each normalised, those that vanish dropped."""
    parts = lambda c: F.filter(F.transform(segment(c), normalize_zh), lambda x: x != "")
    return token_f1(parts(prediction), parts(truth))


def hit_share(prediction: Column, truth_id: Column) -> Column:
    """The share of an answer's numbers that are the true one; 0 if it has none."""
    found = numbers(prediction)
    hits = F.size(F.filter(found, lambda x: x == truth_id.cast("string")))
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(hits / F.size(found))


def classification(prediction: Column, truth: Column, classes: Column) -> Column:
    """1 / n if the truth is among the n classes that the prediction names, else 0. Named
    classes that are a proper part of the truth don't count."""
    named = F.filter(classes, lambda c: prediction.contains(c) & ~(truth.contains(c) & (c != truth)))
    return F.when(F.array_contains(named, truth), F.lit(1.0) / F.size(named)).otherwise(F.lit(0.0))
