"""Operator 9: chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn of a conversation becomes an example of its own: all turns before it are
its context, and only its text is trainable. A conversation that doesn't end with an assistant
turn gets one example more, of its whole text with nothing trainable, so that the
output holds every turn.

Template: a turn is ``<s>`` role ``[INST]`` text ``</s>``, and an example is its turns end to end.
Control strings (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) inside roles and texts are escaped by a
backslash after their first character, and those that have backslashes there already get
one more; that is undone by taking one away. So no control string of a formatted example
comes from a text, and reading back splits on them.

An example holds all turns before it: its conversation's formatted size grows with the
square of its turns, which is what the method asks for. A conversation is gathered as one
array; conversations are the unit here and the groups are as large as conversations are.

Cases: null roles and texts count as empty; turns are ordered by (turn, role, text), null
first, so ties and repeated rows have one order; rows with a null conv_id are one
conversation. An empty table has no examples. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed strings of the template.
OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "</s>"
_CONTROL = r"([<\[])(\\*)((?:/?s>)|(?:/?INST\]))"
_ESCAPED = r"([<\[])\\(\\*)((?:/?s>)|(?:/?INST\]))"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2$3")


def examples(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, example (0, 1, ... in order), formatted, loss_start, loss_chars: the code points
    [loss_start, loss_start + loss_chars) of formatted are trainable (loss_chars 0 and
    loss_start null for an example without a target)."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))
    rows = rows.withColumn("parts", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained_role).alias("trained"))))
    rows = rows.withColumn("ends", F.expr("filter(transform(parts, (p, i) -> IF(p.trained OR i = size(parts) - 1, i, -1)), i -> i >= 0)"))
    rows = rows.select("conv_id", "parts", F.posexplode("ends").alias("example", "end"))
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))
    last = F.element_at("parts", F.col("end") + 1)
    context = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("end")), whole), "")
    rows = rows.select("conv_id", "example", context.alias("context"), last.alias("last"))
    return rows.select(
        "conv_id", "example", F.concat("context", whole(F.col("last"))).alias("formatted"),
        F.when(F.col("last.trained"), F.length("context") + F.length("last.head")).cast("long").alias("loss_start"),
        F.when(F.col("last.trained"), F.length("last.body")).otherwise(0).cast("long").alias("loss_chars"))


def turns_of(formatted: Column) -> Column:
    """The (role, text) turns of a formatted example, read back."""
    parts = F.split(formatted, CLOSE, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    read = lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, MIDDLE) + F.lit(len(MIDDLE)))).alias("text"))
    return F.transform(parts, read)


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.when(chars > 0, unescape(F.substr(formatted, (start + 1).cast("int"), chars.cast("int")))).otherwise(F.lit(""))


def digests(made: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = made.select(
        "conv_id", "example", "formatted",
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"))
    per = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    per = per.withColumn("turns", turns_of(F.col("whole")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")
