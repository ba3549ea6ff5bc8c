"""Incremental ingest: new pages become passages, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafloom.functions import models as M
from leafloom.functions import text as T
from leafloom.operators import rank, segment
from leafloom.sources.pages import PAGES


def page_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Parquet files of pages as they come; a file holds whole documents."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(path)


def embedded(pages: DataFrame, embedder: M.Embedder | None = None) -> DataFrame:
    """Passages with vectors and their document's key."""
    rows = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))).alias("p"))
    keys = rows.select("doc_id", T.document_key(F.col("doc_id"), F.col("p")).alias("document_key"))
    return rank.embed(segment.passages(pages), embedder or M.HashingEmbedder()).join(keys, "doc_id")


def ingest(stream: DataFrame, target: str, checkpoint: str, embedder: M.Embedder | None = None) -> StreamingQuery:
    """Writes embedded passages of each micro-batch under a folder of its own number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        embedded(batch, embedder).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
