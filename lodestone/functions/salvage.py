"""JSON inside the answers of language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import bracketed, strip, upper


def json_strings(c: Column) -> Column:
    """The strings of the JSON array between the first [ and the last ], in upper case and
    stripped; other members are dropped, and what doesn't parse has none."""
    parsed = F.try_parse_json(bracketed(c, "[", "]"))
    members = F.try_variant_get(parsed, "$", "array<variant>")
    texts = F.transform(members, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.coalesce(F.transform(F.filter(texts, lambda x: x.isNotNull()), lambda x: strip(upper(x))), F.array().cast("array<string>"))


def json_object(c: Column) -> Column:
    """The JSON text from the first { or [ to the last } or ], without a code fence around it."""
    body = F.when(c.startswith("```"), F.regexp_replace(F.regexp_replace(c, r"^```[^\n]*\n?", ""), r"\n[ \t]*```[ \t\n]*$", "")).otherwise(c)
    return F.regexp_extract(body, r"([\{\[][\s\S]*[\}\]])", 1)


def confusing_questions(c: Column, most: int, field: str = "confusing_questions") -> Column:
    """At most so many of the questions in an answer; none if it doesn't parse."""
    found = F.try_variant_get(F.try_parse_json(json_object(c)), f"$.{field}", "array<string>")
    return F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, most)
