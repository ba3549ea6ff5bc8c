"""python -m leafloom evaluate|stats|trace|demo PAGES [CASES.json]: prints tables of the library's operators. PAGES are Parquet, or JSON requests (*.json)."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafloom.operators import answer, evaluate, rank, render, segment
from leafloom.sources import pages as sources


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("evaluate", "stats", "trace", "demo") or (args[0] != "stats" and len(args) < 3):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("leafloom").getOrCreate()
    pages = sources.pages_from_json(spark, args[1]) if args[1].endswith(".json") else sources.pages_from_parquet(spark, args[1])
    set_ = sources.settings(spark)
    if args[0] == "stats":
        segment.chunk_stats(segment.passages(pages)).show(truncate=False)
        return 0
    cases = sources.evaluation_set(spark, args[2]).withColumn("question_id", F.concat_ws("-", "paper", "question_no")).withColumnRenamed("paper", "doc_id")
    if args[0] == "trace":
        answer.trace(cases.select("question_id", "doc_id", "question"), pages, set_["top_k"]).show(truncate=False)
        return 0
    if args[0] == "demo":
        made = answer.ask(cases.select("question_id", "doc_id", "question"), pages, set_["top_k"], wider=set_["pool"], limit=set_["evidence"])
        lines = render.ranked_lines(rank.with_diagnostics(made["ranked"], set_["top_k"]))
        for row in lines.orderBy("question_id").toLocalIterator():
            print(row.block, end="\n\n")
        return 0
    rows, metrics = evaluate.evaluate(cases, pages, set_["top_k"])
    evaluate.table(rows).orderBy("question_id").show(1000, truncate=False)
    metrics.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
