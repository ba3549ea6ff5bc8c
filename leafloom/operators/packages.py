"""Evidence for the fields of a summary: sections mapped to fields, and sentences that state limitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import lexicon as L
from leafloom.functions import text as T
from leafloom.operators.segment import body_sections


def _sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(values)))


def _sentences(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "section_no", "name", "pages", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


def _first_seen(rows: DataFrame, *order: str) -> DataFrame:
    """Each sentence of a document where it first stands, in order, with the pages of those sections."""
    first = rows.groupBy("doc_id", "sentence").agg(F.min(F.struct(*order)).alias("at"), F.min_by("pages", F.struct(*order)).alias("pages"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda x: x["sentence"]).alias("sentences"), _sorted(F.collect_list("pages")).alias("pages"))


def limitations(sections: DataFrame) -> DataFrame:
    """doc_id, sentences, pages: what the paper itself calls its limits, in a section on them or in its discussion or conclusion."""
    rows = _sentences(body_sections(sections).where(F.col("name").isin("limitations", "discussion", "conclusion")))
    return _first_seen(rows.where(T.is_limitation(F.col("sentence"), F.col("name") == "limitations")), "section_no", "n")


def packages(sections: DataFrame, fields: dict[str, tuple[str, ...]] = L.FIELDS) -> DataFrame:
    """doc_id, field, text, pages, headings: one row for each field that has evidence."""
    body = body_sections(sections).where("trim(text) <> ''")
    wanted = [(field, name, i) for field, names in fields.items() for i, name in enumerate(names)]
    mapped = sections.sparkSession.createDataFrame(wanted, "field string, name string, priority int")
    parts = body.join(F.broadcast(mapped), "name").withColumn("part", F.struct("priority", "section_no", F.trim("text").alias("text"), "heading", "pages"))
    kept = parts.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    of = lambda c: F.transform("parts", lambda p: p[c])
    direct = kept.select("doc_id", "field", F.array_join(of("text"), "\n\n").alias("text"), _sorted(of("pages")).alias("pages"), of("heading").alias("headings"))
    asked = direct.where("field = 'research_question'").select("doc_id")
    order = F.when(F.col("name") == "abstract", 0).when(F.col("name") == "introduction", 1).otherwise(2)
    cued = _sentences(body.where(F.col("name").isin("abstract", "introduction", "background")).join(asked, "doc_id", "left_anti")).where(T.found(F.col("sentence"), L.STATED_QUESTION)).withColumn("part", order)
    inferred = _first_seen(cued, "part", "section_no", "n").select("doc_id", F.lit("research_question").alias("field"), F.array_join("sentences", " ").alias("text"), "pages", F.array(F.lit("(inferred from abstract/introduction)")).alias("headings"))
    limits = limitations(sections).select("doc_id", F.lit("limitations").alias("field"), F.array_join("sentences", "\n").alias("text"), "pages", F.array(F.lit("limitations")).alias("headings"))
    return direct.unionByName(inferred).unionByName(limits)


def uncovered(docs: DataFrame, found: DataFrame, core: tuple[str, ...] = ("research_question", "methods", "participants_or_data", "key_findings")) -> DataFrame:
    """doc_id and field, for core fields without a package."""
    return docs.select("doc_id").distinct().withColumn("field", F.explode(F.array(*[F.lit(c) for c in core]))).join(found.select("doc_id", "field"), ["doc_id", "field"], "left_anti")
