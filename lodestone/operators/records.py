"""Delimited extraction records: parsing, and mentions and relations from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import clean_control, is_float, split_markers, strip, upper

#: Fixed values of the record format.
RECORD, COMPLETE, FIELD, SET = "##", "<|COMPLETE|>", "<|>", "<SEP>"
ENTITY, RELATION = '"entity"', '"relationship"'


def records(chunks: DataFrame, keys: list[str], text: str = "records") -> DataFrame:
    """keys, rec_ord, attrs: what each record's outermost brackets on one line hold, by field."""
    rows = chunks.select(*keys, F.posexplode(split_markers(F.col(text), [RECORD, COMPLETE])).alias("rec_ord", "r"))
    rows = rows.select(*keys, F.col("rec_ord").cast("long").alias("rec_ord"), F.regexp_extract("r", r"\(([^\n]*)\)", 1).alias("r"))
    return rows.where("r <> ''").select(*keys, "rec_ord", split_markers(F.col("r"), [FIELD]).alias("attrs"))


def _field(i: int):
    return F.get("attrs", F.lit(i))


def mentions(parsed: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Entity records with a name: four fields or more, names in upper case, quotes kept."""
    rows = parsed.where((F.size("attrs") >= 4) & (_field(0) == ENTITY))
    rows = rows.select(
        *keys, "rec_ord", clean_control(upper(_field(1))).alias("entity_name"), clean_control(upper(_field(2))).alias("entity_type"),
        clean_control(_field(3)).alias("description"), F.col(source).cast("string").alias("source_id"))
    return rows.where(strip(F.col("entity_name")) != "")


def relations(parsed: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Relationship records: five fields or more; the last is the weight if it is a number, else 1."""
    last = F.element_at("attrs", -1)
    rows = parsed.where((F.size("attrs") >= 5) & (_field(0) == RELATION))
    return rows.select(
        *keys, "rec_ord", clean_control(upper(_field(1))).alias("src_id"), clean_control(upper(_field(2))).alias("tgt_id"),
        F.when(is_float(last), F.expr("try_cast(element_at(attrs, -1) AS double)")).otherwise(F.lit(1.0)).alias("weight"),
        clean_control(_field(3)).alias("description"), F.col(source).cast("string").alias("source_id"))
