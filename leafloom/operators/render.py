"""What people read: ranked passages with their figures, summaries as cards, and reports of verdicts. Columns throughout; nothing here decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators.summary import NOT_STATED, PAGED, TEXTS

#: What stands for a list that may well be empty.
EMPTY = {"author_stated_limitations": "The authors state no limitations.", "model_identified_considerations": "None were found."}


def snippet(text: Column, most: int = 300, dots: str = "...") -> Column:
    """A text on one line, cut after so many characters."""
    t = T.collapse(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit(dots)))


def short(text: Column) -> Column:
    """What a log may show of a text: 60 characters."""
    return snippet(text, 60)


def ranked_lines(ranked: DataFrame, question: str = "question") -> DataFrame:
    """question_id and a block of text: the question, its passages in order, and the scores' figures (see rank.with_diagnostics)."""
    number = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.4f", F.col(c)))
    section = F.when(F.coalesce("section", F.lit("")) == "", "(no section)").otherwise(F.col("section"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.format_string("%.4f", F.col("score")), F.lit("  p. "), F.col("page_number").cast("string"), F.lit("  "), section, F.lit("  "), F.col("chunk_id"), F.lit("\n   "), snippet(F.col("text")))
    figures = F.concat(F.lit("top "), number("top_score"), F.lit(", second "), number("second_score"), F.lit(", gap "), number("score_gap"), F.lit(", mean "), number("mean_top_k"))
    by = ranked.groupBy("question_id").agg(F.max(question).alias("q"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"), F.max(figures).alias("figures"))
    return by.select("question_id", F.concat_ws("\n", F.concat(F.lit("Q: "), "q"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), "figures").alias("block"))


def badges(pages: Column) -> Column:
    """Page 3, or Pages 3, 4; null where there is none."""
    listed = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    return F.when(F.size(pages) == 1, F.concat(F.lit("Page "), listed)).when(F.size(pages) > 1, F.concat(F.lit("Pages "), listed))


def cards(made: DataFrame) -> DataFrame:
    """doc_id, place, field, said and pages: a row for each section of a summary's card. A list that may be empty has words of its own for that, and
    no pages; other missing values say that they aren't stated."""
    parts = []
    none = F.array().cast("array<int>")
    for field in (*TEXTS, "key_findings", *EMPTY, "plain_english_summary", "confidence_notes"):
        listed = field in EMPTY or field == "key_findings"
        missing = (F.size(field) == 0) if listed else T.is_missing(F.col(field))
        said = F.array_join(F.col(field), "\n") if listed else F.col(field)
        pages = F.col("source_pages")[field] if field in PAGED else none
        pages = F.when(missing, none).otherwise(pages) if field in EMPTY else pages
        parts.append(F.struct(F.lit(field).alias("field"), F.when(missing, EMPTY.get(field, NOT_STATED)).otherwise(said).alias("said"), badges(pages).alias("pages")))
    return made.select("doc_id", F.posexplode(F.array(*parts)).alias("place", "x")).select("doc_id", "place", "x.*")


def reports(verdicts: DataFrame) -> DataFrame:
    """One flat row for each verdict: scalars only, lists joined."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ", ").alias(c)
    return verdicts.select("question_id", "status", "reason", "evidence_count", joined("supporting_pages"), joined("question_types"), joined("missing_evidence"), joined("matched_terms"), "top_score", "score_gap", "mean_top_k")
