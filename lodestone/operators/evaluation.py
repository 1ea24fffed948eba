"""Scores of answers: registries, batch scores, runs, pairwise comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.functions.arrow import code_similarity, rouge_l
from lodestone.functions.scratch import saved

#: The benchmark datasets with their metric, token limit and category.
DATASETS = {
    "narrativeqa": ("qa_f1", 128, "EN Single-Doc QA"),
    "qasper": ("qa_f1", 128, "EN Single-Doc QA"),
    "multifieldqa_en": ("qa_f1", 64, "EN Single-Doc QA"),
    "multifieldqa_zh": ("qa_f1_zh", 64, "CN Single-Doc QA"),
    "hotpotqa": ("qa_f1", 32, "EN Multi-Doc QA"),
    "2wikimqa": ("qa_f1", 32, "EN Multi-Doc QA"),
    "musique": ("qa_f1", 32, "EN Multi-Doc QA"),
    "dureader": ("rouge_zh", 128, "CN Multi-Doc QA"),
    "gov_report": ("rouge", 512, "EN Summarization"),
    "qmsum": ("rouge", 512, "EN Summarization"),
    "multi_news": ("rouge", 512, "EN Summarization"),
    "vcsum": ("rouge_zh", 512, "CN Summarization"),
    "trec": ("classification", 64, "EN Few-Shot Learning"),
    "triviaqa": ("qa_f1", 32, "EN Few-Shot Learning"),
    "samsum": ("rouge", 128, "EN Few-Shot Learning"),
    "lsht": ("classification", 64, "CN Few-Shot Learning"),
    "passage_retrieval_en": ("retrieval", 32, "EN Synthetic Task"),
    "passage_count": ("count", 32, "EN Synthetic Task"),
    "passage_retrieval_zh": ("retrieval_zh", 32, "CN Synthetic Task"),
    "lcc": ("code", 64, "Code Completion"),
    "repobench-p": ("code", 64, "Code Completion"),
}
#: Datasets of which only an answer's first line counts.
FIRST_LINE = ("trec", "triviaqa", "samsum", "lsht")


def _spaced(c):
    return F.array_join(F.split(c, ""), " ")


def _known(c, pattern: str):
    """The number a truth names; raises if it names none."""
    found = F.regexp_extract(c, pattern, 1)
    return F.when(found == "", F.raise_error(F.lit(f"the truth has no {pattern}"))).otherwise(found)


METRICS = {
    "qa_f1": lambda p, g, c: t.qa_f1(p, g),
    "qa_f1_zh": lambda p, g, c: t.qa_f1_zh(p, g),
    "rouge": lambda p, g, c: rouge_l(p, g),
    "rouge_zh": lambda p, g, c: rouge_l(_spaced(p), _spaced(g)),
    "classification": lambda p, g, c: t.classification(p, g, c),
    "retrieval": lambda p, g, c: t.hit_share(p, _known(g, r"Paragraph (\d+)")),
    "retrieval_zh": lambda p, g, c: t.hit_share(p, _known(g, r"段落(\d+)")),
    "count": lambda p, g, c: t.hit_share(p, g),
    "code": lambda p, g, c: code_similarity(t.first_code_line(p), g),
}


def registry(spark) -> DataFrame:
    """dataset, metric, max_new_tokens, category."""
    return spark.createDataFrame([(k, *v) for k, v in DATASETS.items()], "dataset string, metric string, max_new_tokens long, category string")


def batch_score(rows: DataFrame, dataset: str, key: str) -> DataFrame:
    """score: for each answer (key, prediction) the best over its references (a row each, column
    reference, and classes where the metric wants them), the mean in percent, two decimals."""
    p = t.first_line(F.col("prediction")) if dataset in FIRST_LINE else F.col("prediction")
    classes = F.col("classes") if "classes" in rows.columns else F.array().cast("array<string>")
    scored = rows.withColumn("s", METRICS[DATASETS[dataset][0]](p, F.col("reference"), classes))
    return scored.groupBy(key).agg(F.max("s").alias("s")).agg(F.round(100 * F.avg("s"), 2).alias("score"))


def run_scores(results: DataFrame) -> DataFrame:
    """dataset, model, total_samples, f1_score (four decimals) of (dataset, model, f1)."""
    return results.groupBy("dataset", "model").agg(F.count("*").alias("total_samples"), F.round(F.avg("f1"), 4).alias("f1_score"))


def overall(scores: DataFrame) -> DataFrame:
    """The mean of the datasets' means."""
    return scores.groupBy("model").agg(F.round(F.avg("f1_score"), 4).alias("overall_f1"))


def running_mean(rows: DataFrame, value: str, order: str, by: list[str], every: int = 10) -> DataFrame:
    """Every so many rows, the sum so far over the position (rows without a value have a position).
    Within ``by``: an order over all rows at once is no one task's to make."""
    w = Window.partitionBy(*by).orderBy(order)
    out = rows.withColumn("position", F.row_number().over(w).cast("long")).withColumn(
        "running", F.round(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("position"), 6))
    return out.where(F.col("position") % every == 0).select(*by, order, "position", "running")


def running_mean_of_all(rows: DataFrame, value: str, order: str, every: int = 10, ranges: int = 64) -> DataFrame:
    """order, position, running (four decimals): the sum so far over the position, at every so many rows and at the last, in
    one order over all rows. Rows are dealt to ranges of the order, each summed by a task of its own; what
    came before a range is a sum of at most ``ranges`` rows. ``order`` has no repeats."""
    dealt = saved(rows.select(order, value).repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()), "ranges")
    each = dealt.groupBy("_range").agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("s"))
    w = Window.orderBy("_range")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    here = Window.partitionBy("_range").orderBy(order)
    out = dealt.join(F.broadcast(base), "_range")  # a row for each range
    out = out.withColumn("position", (F.col("n0") + F.row_number().over(here)).cast("long"))
    out = out.withColumn("running", F.round((F.col("s0") + F.coalesce(F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))) / F.col("position"), 4))
    return out.where((F.col("position") % every == 0) | (F.col("position") == F.col("total"))).select(order, "position", "running")


def winners(judged: DataFrame, answer: str = "verdict") -> DataFrame:
    """winner: 1 if the verdict names Answer 1, else 2 if it names Answer 2, else 0 (a tie)."""
    v = F.col(answer)
    return judged.withColumn("winner", F.when(v.contains("Answer 1"), 1).when(v.contains("Answer 2"), 2).otherwise(0).cast("long"))


def pairwise_summary(won: DataFrame, by: list[str]) -> DataFrame:
    n = F.count("*")
    rate = lambda k: F.round(F.count_if(F.col("winner") == k) / n, 4)
    return won.groupBy(*by).agg(
        n.alias("total_samples"), F.count_if(F.col("winner") == 1).alias("wins_model1"), F.count_if(F.col("winner") == 2).alias("wins_model2"),
        F.count_if(F.col("winner") == 0).alias("ties"), rate(1).alias("win_rate_model1"), rate(2).alias("win_rate_model2"), rate(0).alias("tie_rate"))


def positional_pairs(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Rows of two result tables with the same ordinal; the longer one's rest goes."""
    cols = lambda df, n: df.select(ordinal, *[F.col(c).alias(f"{c}{n}") for c in df.columns if c != ordinal])
    return cols(left, 1).join(cols(right, 2), ordinal)
