"""Summaries of documents from packages, model drafts and condensers, and the repair of their parts.

A summary is a wide row of doc_id: texts and arrays, null or empty where nothing is known. Sentinels are written by render() only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import lexicon as L
from leafloom.functions import text as T
from leafloom.operators import condense, packages, segment

NOT_STATED = "Not stated in the paper"
TEXTS = ("research_question", "background", "methods", "participants_or_data")
PAGED = {"research_question": "research_question", "methods": "methods", "key_findings": "key_findings", "author_stated_limitations": "limitations"}


def attributable(entry: Column, sources: Column, share: float = 0.6) -> Column:
    """Whether one source sentence has so much of an entry's words."""
    words = T.content_words(entry)
    return (F.size(words) > 0) & F.exists(sources, lambda s: F.size(F.array_intersect(words, T.content_words(s))) >= share * F.size(words))


def covered(entry: Column, source: Column) -> Column:
    return T.coverage(T.finding_words(entry), T.finding_words(source))


def keeps_meaning(old: Column, new: Column) -> Column:
    """A rewrite may add at most a quarter of the words, or two."""
    words = T.content_words(old)
    return F.size(F.array_except(T.content_words(new), words)) <= F.greatest(F.lit(2), F.floor(F.size(words) / 4))


def distinct_findings(items: Column, alike: float = 0.8) -> Column:
    """Without near repeats: of two findings whose words are alike by the shorter, the longer stands, in the place of the first."""

    def near(a: Column, b: Column) -> Column:
        return T.containment(T.finding_words(a), T.finding_words(b)) >= alike

    def put(kept: Column, x: Column) -> Column:
        same = F.filter(F.transform(kept, lambda k, i: F.when(near(k, x), i)), lambda i: i.isNotNull())
        at = F.get(same, F.lit(0))
        longer = F.transform(kept, lambda k, i: F.when((i == at) & (F.length(x) > F.length(k)), x).otherwise(k))
        return F.when(at.isNull(), F.concat(kept, F.array(x))).otherwise(longer)

    return F.aggregate(items, F.array().cast("array<string>"), put)


def tighten(findings: Column, condensed: Column, most: int = 6) -> Column:
    """No prescriptions and no near repeats; refilled from the condensed findings if that leaves none."""
    some = lambda x: distinct_findings(F.filter(x, lambda f: (F.trim(f) != "") & ~T.is_prescriptive(f)))
    first = some(F.coalesce(findings, F.array().cast("array<string>")))
    return F.slice(F.when(F.size(first) > 0, first).otherwise(some(condensed)), 1, most)


def split_limitations(entries: Column, sources: Column) -> tuple[Column, Column]:
    """What the authors state, and what only a model says."""
    return F.filter(entries, lambda e: attributable(e, sources)), F.filter(entries, lambda e: ~attributable(e, sources))


def prune_considerations(items: Column, stated: Column, most: float = 0.3) -> Column:
    """Without talk about the summary itself, and without what the stated limitations already have."""
    return F.filter(items, lambda x: ~T.is_meta(x) & ~F.exists(stated, lambda s: covered(x, s) >= most))


def align_notes(notes: Column, has_limitations: Column) -> Column:
    """Without claims that limitations were inferred, where the paper states them."""
    inferred = lambda s: T.found(s, L.INFERRED) & T.found(s, "(?i)\\blimitation")
    kept = F.array_join(F.filter(T.sentences(notes), lambda s: ~inferred(s)), " ")
    return F.when(has_limitations, kept).otherwise(notes)


def disclose(notes: Column, missing: Column) -> Column:
    """Names the fields without evidence, once."""
    said = F.concat(F.lit("No evidence was found for: "), F.array_join(missing, ", "), F.lit("."))
    return F.when((F.size(missing) == 0) | F.contains(F.coalesce(notes, F.lit("")), F.lit("No evidence was found for")), notes).otherwise(F.trim(F.concat_ws(" ", notes, said)))


def clamp(pages: Column, most: Column) -> Column:
    return F.filter(pages, lambda p: p.between(1, most))


def most_specific(notes: Column) -> Column:
    """Of (value, evidence) notes: one with evidence, then the longest, then the first."""
    order = F.transform(notes, lambda n, i: F.struct((F.length(F.coalesce(n["evidence"], F.lit(""))) > 0).alias("quoted"), F.length(n["value"]).alias("size"), (-i).alias("at"), n["value"].alias("value")))
    return F.array_max(F.filter(order, lambda n: ~T.is_missing(n["value"])))["value"]


def first_known(*values: Column) -> Column:
    """The first that isn't missing, in order of trust."""
    return F.coalesce(*[F.when(~T.is_missing(v), v) for v in values])


def summaries(pages: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """One summary a document. drafts (doc_id and any of the summary's columns: what a model proposed) come before condensers where they say
    something; without drafts all is condensed from the paper."""
    heads = segment.running_heads(pages)
    found = packages.packages(segment.sections(pages, heads))
    by = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("text", "pages")))).alias("p"))
    docs = pages.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max("page_number").alias("page_count"))
    rows = docs.join(by, "doc_id", "left").join(segment.hints(pages, heads), "doc_id", "left")
    have = set(drafts.columns) - {"doc_id"} if drafts is not None else set()
    if drafts is not None:
        rows = rows.join(drafts.select(F.col("doc_id").cast("string").alias("doc_id"), *[F.col(c).alias(f"_{c}") for c in have]), "doc_id", "left")
    draft = lambda c: F.col(f"_{c}") if c in have else F.lit(None).cast("string")
    drafted = lambda c: F.coalesce(F.filter(F.col(f"_{c}"), lambda x: ~T.is_missing(x)), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    text = lambda f: F.coalesce(F.col("p")[f]["text"], F.lit(""))
    condensed = {f: F.when(text(f) != "", make(text(f))) for f, make in condense.TEXTS.items()}
    rows = rows.withColumns({f: first_known(draft(f), c) for f, c in condensed.items()})
    title = F.when(F.col("title_confidence") == "high", F.get("title_candidates", F.lit(0)))
    sources = F.filter(F.split(text("limitations"), "\n"), lambda s: s != "")
    condensed_findings = condense.findings(text("key_findings"))
    stated, said = split_limitations(drafted("author_stated_limitations"), sources)
    rows = rows.withColumns({
        "title": first_known(draft("title"), title, F.get("title_candidates", F.lit(0))),
        "authors": F.when(F.size(drafted("authors")) > 0, drafted("authors")).otherwise(F.col("author_candidates")),
        "key_findings": tighten(drafted("key_findings"), condensed_findings),
        "author_stated_limitations": F.when(F.size(stated) > 0, stated).otherwise(F.slice(F.transform(sources, lambda s: T.cut(s, 300)), 1, 5)),
        "_considered": F.array_distinct(F.concat(drafted("model_identified_considerations"), said)),
    })
    rows = rows.withColumn("model_identified_considerations", prune_considerations(F.col("_considered"), F.col("author_stated_limitations")))
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in TEXTS], F.when(F.size("key_findings") == 0, F.lit("key_findings"))))
    plain = F.concat_ws(" ", "research_question", "participants_or_data", "methods", F.array_join(F.slice("key_findings", 1, 2), " "))
    rows = rows.withColumn("missing_fields", missing).withColumn("plain_english_summary", first_known(draft("plain_english_summary"), plain))
    rows = rows.withColumn("confidence_notes", disclose(align_notes(draft("confidence_notes"), F.size("author_stated_limitations") > 0), F.col("missing_fields")))
    paged = [clamp(F.coalesce(F.col("p")[field]["pages"], F.array().cast("array<int>")), F.col("page_count")).alias(name) for name, field in PAGED.items()]
    return rows.select("doc_id", "page_count", "title", "authors", *TEXTS, "key_findings", "author_stated_limitations", "model_identified_considerations", "plain_english_summary", "confidence_notes", "missing_fields", F.struct(*paged).alias("source_pages"))


def render(made: DataFrame) -> DataFrame:
    """With the sentinel for texts that are missing, and for findings where there are none."""
    texts = {c: F.coalesce(c, F.lit(NOT_STATED)) for c in ("title", *TEXTS, "plain_english_summary")}
    return made.withColumns(texts).withColumn("key_findings", F.when(F.size("key_findings") > 0, F.col("key_findings")).otherwise(F.array(F.lit(NOT_STATED))))


def render_hints(hints: DataFrame) -> DataFrame:
    """doc_id and a text of its hints, for prompts."""
    begins = F.array_join(F.transform(F.array_sort(F.map_entries("headings")), lambda e: F.concat(e["key"], F.lit(" (p. "), F.array_join(F.transform(e["value"], lambda p: p.cast("string")), ", "), F.lit(")"))), "; ")
    said = F.concat_ws("\n", F.concat(F.lit("Title candidates: "), F.array_join("title_candidates", " | ")), F.concat(F.lit("Author candidates: "), F.array_join("author_candidates", " | ")), F.concat(F.lit("Sections: "), begins))
    return hints.select("doc_id", said.alias("hints"))


