"""From pages to lines, running heads, sections and passages. Pages are rows of doc_id, page_number (from 1) and text.

Folds that depend on order run once for each document, in Arrow-backed grouped functions: a group is one document's pages. Everything else is
columns. Documents are partitioned by doc_id once; running heads come in by the same key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import kernels as K
from leafloom.functions import text as T

SECTIONS = "doc_id string, section_no int, name string, heading string, text string, pages array<int>"
CHUNKS = "doc_id string, page_number int, section string, text string, start_char int, end_char int"


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no (from 0), line: white space collapsed, blank lines dropped."""
    return pages.select("doc_id", "page_number", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


def line_offsets(pages: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """Lines as cut at line feeds only, with the places of what isn't blank in the text; blank lines are dropped."""
    keys = keys or ("doc_id", "page_number")
    raw = pages.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "raw"))
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    raw = raw.withColumn("at", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)))
    left, right = F.regexp_replace("raw", r"^(?U)[\s\x1c-\x1f]+", ""), F.regexp_replace("raw", r"(?U)[\s\x1c-\x1f]+$", "")
    rows = raw.select(*keys, "line_no", T.collapse(F.col("raw")).alias("line"), (F.col("at") + F.length("raw") - F.length(left)).cast("long").alias("start_char"), (F.col("at") + F.length(right)).cast("long").alias("end_char"))
    return rows.where("line <> ''")


def running_heads(pages: DataFrame, ratio: float = 0.4, least: int = 2, shortest: int = 4, longest: int = 100) -> DataFrame:
    """doc_id, key (lower case), line (as first seen), n_pages: short lines, no headings, that stand on many of a document's pages."""
    # A line with more than `longest` characters that aren't blanks can't be short, and isn't looked at closely.
    rough = F.filter(F.split(F.col("text"), T.BREAK, -1), lambda x: (F.length(x) >= shortest) & (F.length(F.replace(x, F.lit(" "), F.lit(""))) <= longest))
    seen = pages.select("doc_id", "page_number", F.posexplode(F.transform(F.array_distinct(rough), T.collapse)).alias("line_no", "line")).where(F.length("line").between(shortest, longest))
    counts = seen.groupBy("doc_id", F.lower("line").alias("key")).agg(F.countDistinct("page_number").alias("n_pages"), F.min_by("line", F.struct("page_number", "line_no")).alias("line"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("total"))
    enough = F.greatest(F.lit(least), F.ceil(F.lit(float(ratio)) * F.col("total")))
    return counts.join(total, "doc_id").where((F.col("n_pages") >= enough) & T.heading_name(F.col("line")).isNull()).select("doc_id", "key", "line", "n_pages")


def body_lines(pages: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """page_lines() without running heads and page numbers."""
    heads = running_heads(pages) if heads is None else heads
    rows = page_lines(pages).where(~T.is_page_number(F.col("line"))).withColumn("key", F.lower("line"))
    return rows.join(heads.select("doc_id", "key"), ["doc_id", "key"], "left_anti").drop("key")


def with_heads(pages: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """One row a document: its pages in order, and its running heads."""
    heads = (running_heads(pages) if heads is None else heads).groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("heads"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))).alias("pages"))
    return docs.join(heads, "doc_id", "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<string>")))


def _each(docs: DataFrame, make, schema: str) -> DataFrame:
    """make(pages, heads) -> rows, for each document."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [{"doc_id": r.doc_id, **x} for r in pdf.itertuples() for x in make([(p["page_number"], p["text"]) for p in r.pages], set(r.heads))]
            yield pd.DataFrame(rows, columns=columns)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "pages", "heads").mapInPandas(run, schema)


def sections(pages: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    return _each(with_heads(pages, heads), K.sections, SECTIONS)


def body_sections(found: DataFrame, terminal: tuple[str, ...] = ("references", "acknowledgements")) -> DataFrame:
    """Sections before a document's first terminal one."""
    ends = F.min(F.when(F.col("name").isin(*terminal), F.col("section_no"))).over(Window.partitionBy("doc_id"))
    return found.withColumn("_end", ends).where("_end IS NULL OR section_no < _end").drop("_end")


def passages(pages: DataFrame, heads: DataFrame | None = None, sizes: K.Sizes = K.Sizes(), document: Column | None = None) -> DataFrame:
    """Balanced, overlapping passages inside one page and one section, with content-addressed ids."""

    def make(pages, heads):
        for page, section, held in K.units(pages, heads):
            for a, b in K.ranges([len(x[0].split()) for x in held], sizes):
                yield {"page_number": page, "section": section, "text": " ".join(x[0] for x in held[a:b]), "start_char": held[a][1], "end_char": held[b - 1][2]}

    rows = _each(with_heads(pages, heads), make, CHUNKS).where("trim(text) <> ''")
    return rows.withColumn("chunk_id", T.passage_id(F.col("doc_id") if document is None else document, *map(F.col, ("page_number", "section", "start_char", "end_char", "text"))))


def page_groups(pages: DataFrame, chars: int = 12_000, most: int = 6) -> DataFrame:
    """doc_id, group_no, pages, text: runs of pages for one call of a model each."""
    make = lambda pages, _: ({"group_no": i, "pages": p, "text": t} for i, (p, t) in enumerate(K.page_groups(pages, chars, most)))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))).alias("pages"))
    return _each(docs.withColumn("heads", F.array().cast("array<string>")), make, "doc_id string, group_no int, pages array<int>, text string")


def hints(pages: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """title_candidates, author_candidates, author_names (the names in those), title_confidence, headings (to the pages where they begin) and repeated_lines of each document."""
    heads = running_heads(pages) if heads is None else heads

    def make(pages, heads):
        titles, authors, sure = K.title_and_authors(pages[0][1] if pages else "", heads)
        begins: dict[str, list[int]] = {}
        for s in K.sections(pages, heads):
            if s["pages"][0] not in begins.setdefault(s["name"], []):
                begins[s["name"]].append(s["pages"][0])
        yield {"title_candidates": titles, "author_candidates": authors, "author_names": list(dict.fromkeys(n for a in authors for n in K.names(a)[0])), "title_confidence": sure, "headings": begins}

    made = _each(with_heads(pages, heads), make, "doc_id string, title_candidates array<string>, author_candidates array<string>, author_names array<string>, title_confidence string, headings map<string,array<int>>")
    repeated = heads.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list("line")).alias("repeated_lines"))
    return made.join(repeated, "doc_id", "left").withColumn("repeated_lines", F.coalesce("repeated_lines", F.array().cast("array<string>")))


def document_envelope(pages: DataFrame, preview: int = 3000) -> DataFrame:
    """page_count, character_count, text_preview, and status 200, or 422 with a message where no page has text."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"])
    docs = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.array_join(texts, "\n").alias("_text"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("character_count"))
    blank = T.collapse(F.col("_text")) == ""
    return docs.select("doc_id", "page_count", "character_count", F.substring("_text", 1, preview).alias("text_preview"), F.when(blank, 422).otherwise(200).alias("status"), F.when(blank, "no readable text; the pages may need character recognition").alias("message"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    words = F.size(F.split(T.collapse(F.col("text")), " "))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.countDistinct("page_number").alias("pages"), F.min(words).alias("min_words"), F.max(words).alias("max_words"), F.floor(F.avg(words)).alias("mean_words"), F.array_sort(F.collect_set(F.when(F.col("section") != "", F.col("section")))).alias("sections"))
