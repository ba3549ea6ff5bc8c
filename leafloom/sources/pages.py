"""Sources and sinks of pages, uploads, questions and evaluation sets.

Pages are rows of doc_id, page_number and text. Binary documents go through a pluggable parser, as none is bundled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = "doc_id string, page_number int, text string"
REQUEST = "filename string, pages array<struct<page_number:int,text:string>>, question string, top_k int"
EVALUATION = "paper string, questions array<struct<question:string,expected_answerable:boolean,expected_pages:array<int>>>"
MOST_BYTES = 20 * 1024 * 1024


def pages_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON documents: filename and its pages."""
    rows = spark.read.schema(REQUEST).option("multiLine", True).json(path)
    return rows.select(F.col("filename").alias("doc_id"), F.inline("pages")).select("doc_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))


def pages_from_parquet(spark: SparkSession, path: str, doc_id: str = "doc_id", page_number: str = "page_number", text: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(F.col(doc_id).cast("string").alias("doc_id"), F.col(page_number).cast("int").alias("page_number"), F.col(text).alias("text"))


def gate(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files (as binaryFile gives them; mime optional) with status and message: 200, 400 for what isn't a PDF or is empty, 413 if too large."""
    mime = F.col("mime") if "mime" in files.columns else F.lit(None).cast("string")
    wrong = ~F.lower("path").endswith(".pdf") | F.coalesce(~mime.isin("application/pdf", "application/x-pdf", "application/octet-stream"), F.lit(False))
    status = F.when(wrong | (F.col("length") == 0), 400).when(F.col("length") > most, 413).otherwise(200)
    said = F.when(wrong, "only PDF files are read").when(F.col("length") == 0, "the file is empty").when(F.col("length") > most, "the file is too large")
    return files.withColumn("status", status).withColumn("message", said)


def pages_from_files(files: DataFrame, parse: Callable[[bytes], list[str]]) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of accepted files; parse gives the pages' texts or raises. Rejects have path, status and message."""
    checked = gate(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i, text or "", None) for i, text in enumerate(parse(bytes(content)), 1)] or [(path, 0, "", "the file has no pages")]
                except Exception as e:  # a parser may fail in any way on a broken file
                    rows.append((path, 0, "", f"the file can't be read: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text", "message"])

    read = checked.where("status = 200").select("path", "content").mapInPandas(run, f"{PAGES}, message string")
    rejects = checked.where("status <> 200").select("path", "status", "message").unionByName(read.where("message IS NOT NULL").select(F.col("doc_id").alias("path"), F.lit(400).alias("status"), "message"))
    return read.where("message IS NULL").drop("message"), rejects


def request_status(requests: DataFrame) -> DataFrame:
    """requests with status: 422 where the question or all pages are blank, no page is given, or top_k isn't within 1 and 20."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    k = F.coalesce("top_k", F.lit(5))
    bad = blank(F.col("question")) | (F.coalesce(F.size("pages"), F.lit(0)) <= 0) | F.coalesce(F.forall("pages", lambda p: blank(p["text"])), F.lit(True)) | ~k.between(1, 20)
    return requests.withColumn("top_k", k).withColumn("status", F.when(bad, 422).otherwise(200))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Cases of JSON files: paper (the file's stem where it isn't given), question_no, question, expected_answerable, expected_pages.

    Each file is checked strictly where it is read, and one that can't be used ends the job with the name of the question that is wrong.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["name"], pdf["value"], strict=True):
                got = check_evaluation(text, PurePosixPath(unquote(name)).name)
                rows += [(got["paper"], i, q["question"], q["expected_answerable"], q.get("expected_pages", [])) for i, q in enumerate(got["questions"])]
            yield pd.DataFrame(rows, columns=["paper", "question_no", "question", "expected_answerable", "expected_pages"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    return files.mapInPandas(run, "paper string, question_no int, question string, expected_answerable boolean, expected_pages array<int>")


class EvaluationError(ValueError):
    """A set that can't be used, with the question that is wrong."""


def check_evaluation(text: str, name: str = "set.json") -> dict:
    """One file's set, checked strictly."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise EvaluationError(f"{name} is no JSON: {e}") from e
    if not isinstance(data, dict) or not isinstance(data.get("questions"), list) or not data["questions"]:
        raise EvaluationError(f"{name} has no questions")
    for i, q in enumerate(data["questions"], 1):
        where = f"{name}, question {i}"
        if not isinstance(q, dict) or not isinstance(q.get("question"), str) or not q["question"].strip():
            raise EvaluationError(f"{where}: no question")
        if not isinstance(q.get("expected_answerable"), bool):
            raise EvaluationError(f"{where}: expected_answerable is no boolean")
        pages = q.get("expected_pages", [])
        if not isinstance(pages, list) or any(isinstance(p, bool) or not isinstance(p, int) or p < 1 for p in pages):
            raise EvaluationError(f"{where}: expected_pages are no page numbers")
    return {"paper": data.get("paper") or PurePosixPath(name).stem, "questions": data["questions"]}


def evaluation_json(cases: DataFrame) -> DataFrame:
    """Cases back in the form of files: paper and its set as JSON."""
    q = F.struct("question", "expected_answerable", "expected_pages")
    by = cases.groupBy("paper").agg(F.transform(F.array_sort(F.collect_list(F.struct("question_no", q.alias("q")))), lambda x: x["q"]).alias("questions"))
    return by.select("paper", F.to_json(F.struct("paper", "questions")).alias("json"))


def new_only(chunks: DataFrame, stored: DataFrame, key: str = "document_key") -> tuple[DataFrame, DataFrame]:
    """(to embed, hits): content-addressed reuse of a table of embedded passages."""
    have = stored.select(key).distinct()
    return chunks.join(have, key, "left_anti"), stored.join(chunks.select(key).distinct(), key, "left_semi")


def reuse(chunks: DataFrame, stored: DataFrame, key: str = "document_key") -> DataFrame:
    """One row: hits and misses of the documents that are asked for in the table of embedded passages."""
    have = stored.select(key).distinct().withColumn("_have", F.lit(True))
    return chunks.select(key).distinct().join(have, key, "left").agg(F.count("_have").alias("hits"), F.count_if(F.col("_have").isNull()).alias("misses"))


def file_size(length: Column) -> Column:
    kb = length / 1024
    return F.when(length.isNull(), F.lit(None).cast("string")).when(length < 1024, F.concat(length.cast("string"), F.lit(" B"))).when(kb < 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", kb / 1024))


def settings(spark: SparkSession, prefix: str = "spark.leafloom.") -> dict:
    """Settings of a session; what isn't a number or a truth value is as not set."""

    def get(name: str, default, kind):
        raw = spark.conf.get(prefix + name, None)
        try:
            return default if raw is None else raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        except ValueError:
            return default

    return {"top_k": get("topK", 5, int), "evidence": get("evidence", 4, int), "pool": get("pool", 12, int), "group_chars": get("groupChars", 12_000, int), "group_pages": get("groupPages", 6, int), "timeout": get("timeout", 300.0, float), "debug": get("debug", False, bool)}


PAGE_SCHEMA = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("text", T.StringType())])
