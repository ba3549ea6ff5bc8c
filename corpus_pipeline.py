"""A corpus pipeline over `documents`: language, near duplicates, repeated passages, source mix, packed sequences.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir), works on all rows that the stage before it left,
and gives a DataFrame that is written as Parquet and read again as the next stage's docs. All but the last give the columns of
documents; other columns of the input are dropped by the first stage.

Empty tables pass all stages empty. Null texts go with the first stage, and null sources are a source. Rows that are alike count each, but for near
duplicates: a row stays or goes with its doc_id, so of rows with one id all or none stay, and rows without an id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import language, mixing, neardup, packing, substrings
from leafloom.llm.tables import bounded, cleared, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and those without a letter. The others get the predicted language as lang."""
    bounded(spark)
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    said = language.identify(docs.select(COLUMNS), model)
    return said.where(F.col("lang_pred") != language.UND).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each near-duplicate class; of rows with equal ids, all or none stay."""
    bounded(spark)
    classes = written(neardup.near_duplicates(docs), "classes")
    gone = classes.where("class_id < doc_id").select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= neardup.MANY else gone
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that an earlier document has. Texts that lose nothing stay as they are; a document that
    loses all its words goes."""
    bounded(spark)
    cut = substrings.remove(docs.select(COLUMNS), substrings.repeats(docs))
    cut = cut.where("n_removed < n_words OR n_removed = 0")
    lost = F.col("n_removed") > 0
    cut = cut.withColumn("text", F.when(lost, F.col("kept")).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the sources' target weights, whole: a partial last repetition counts from half of the document's words on.
    Documents that the mix takes no words of go."""
    bounded(spark)
    taken = mixing.mix(docs).withColumn("copies", F.col("copies") + (2 * F.col("rest") >= F.greatest("size", F.lit(1))).cast("long"))
    by = written(taken.groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").cast("int").alias("copies")), "copies")
    by = F.broadcast(by) if by.count() <= neardup.MANY else by
    rows = docs.select(COLUMNS).join(by, F.col("doc_id").eqNullSafe(F.col("_id"))).where("copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all pieces of all documents, repetitions included, into sequences."""
    bounded(spark)
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("packed_sequences", packed_sequences),
]

#: SQL can't express the language machines or the signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage writes on its way is deleted once its result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with cleared(spark) as keep:
            docs = keep(written(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
