"""Labelled questions against verdicts: a confusion matrix, accuracy, and whether expected pages were found."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators.answer import ask


def outcomes(cases: DataFrame, found: DataFrame) -> DataFrame:
    """cases (question_id, expected_answerable, expected_pages) with what was predicted; page_hit is null where no page is expected."""
    rows = cases.withColumn("question_id", F.col("question_id").cast("string")).join(found, "question_id")
    said = F.col("status") != "not_supported"
    hit = F.when(F.coalesce(F.size("expected_pages"), F.lit(0)) > 0, F.arrays_overlap("expected_pages", "supporting_pages"))
    return rows.withColumn("predicted", said).withColumn("correct", said == F.col("expected_answerable")).withColumn("page_hit", F.when(said, hit))


def metrics(rows: DataFrame) -> DataFrame:
    """One row, from expected_answerable, predicted and page_hit; accuracy is 0 of no rows, page_accuracy null of no checks."""
    e, p = F.col("expected_answerable"), F.col("predicted")
    out = rows.agg(F.count("*").alias("total"), F.count_if(e & p).alias("true_positives"), F.count_if(~e & ~p).alias("true_negatives"), F.count_if(~e & p).alias("false_positives"), F.count_if(e & ~p).alias("false_negatives"), F.count("page_hit").alias("pages_checked"), F.count_if("page_hit").alias("pages_hit"))
    right = F.col("true_positives") + F.col("true_negatives")
    return out.withColumn("correct", right).withColumn("accuracy", F.coalesce(F.try_divide(right, F.col("total")), F.lit(0.0))).withColumn("page_accuracy", F.try_divide("pages_hit", "pages_checked"))


def evaluate(cases: DataFrame, pages: DataFrame, k: int = 5, **models) -> tuple[DataFrame, DataFrame]:
    """Outcomes and metrics of cases (question_id, doc_id, question, expected_answerable, expected_pages) on pages."""
    rows = outcomes(cases, ask(cases.select("question_id", "doc_id", "question"), pages, k, **models)["verdicts"])
    return rows, metrics(rows)


def table(rows: DataFrame) -> DataFrame:
    """A line of text for each outcome."""
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    return rows.select("question_id", F.concat_ws(" | ", F.rpad(F.substring("question", 1, 48), 48, " "), F.rpad(yes("expected_answerable"), 8, " "), F.rpad("status", 19, " "), F.rpad(yes("correct"), 3, " "), F.array_join(F.transform("supporting_pages", lambda p: p.cast("string")), ",")).alias("line"))


def contained(left: DataFrame, right: DataFrame, a: str, b: str, share: float, k: int = 4) -> DataFrame:
    """a, b, shared and overlap for rows (key, words) of two sides of which the smaller set has `share` of its words, or more, in the other.

    Of the smaller set's rarest n - ceil(share n) + k words then k are in the other, for any k up to ceil(share n): so only those of each set are joined to
    the other side's words, which spares the common ones, and the few pairs with k of them are compared whole. The sets are persisted, as all steps read them.
    """
    left, right = (df.persist(StorageLevel.MEMORY_AND_DISK) for df in (left, right))
    rows = lambda df, key: df.where(F.size("words") > 0).select(F.col(key), F.explode("words").alias("word"), F.size("words").alias("n"))
    every = {a: rows(left, a), b: rows(right, b)}
    count = lambda key, name: every[key].groupBy("word").agg(F.count("*").alias(name))
    common = count(a, "of").join(count(b, "also"), "word").select("word", (F.col("of") * F.col("also")).alias("cost"))  # words of one side only join nothing

    def prefix(key: str) -> DataFrame:
        held = every[key].join(common, "word").withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("cost", "word"))).withColumn("held", F.count("*").over(Window.partitionBy(key)))
        least = F.ceil(F.col("n") * share - 1e-9)
        held = held.withColumn("k", F.least(F.lit(k), least)).where((F.col("held") >= least) & (F.col("place") <= F.col("held") - least + F.col("k")))
        return held.select(key, "word", "n", "k")

    pairs = None
    for small, large in ((a, b), (b, a)):
        met = prefix(small).join(every[large].withColumnRenamed("n", "m"), "word").where(F.col("n") <= F.col("m"))
        met = met.groupBy(a, b).agg(F.count("*").alias("met"), F.max("k").alias("k")).where("met >= k").select(a, b)
        pairs = met if pairs is None else pairs.unionByName(met)
    both = pairs.distinct().join(left.select(a, F.col("words").alias("_x")), a).join(right.select(b, F.col("words").alias("_y")), b)
    found = both.select(a, b, F.size(F.array_intersect("_x", "_y")).cast("long").alias("shared"), T.containment(F.col("_x"), F.col("_y")).alias("overlap"))
    return found.where(F.col("overlap") >= share)
