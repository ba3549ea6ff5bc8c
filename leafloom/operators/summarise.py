"""Summaries with a generator, from condensed sections to recovery: condense, notes on what no section covers, reduce, recover, repair.

A document's evidence is made once: packages of its sections, hints of its front matter, and groups of its pages. A generator sees only documents that
have packages (condense), groups of documents with core fields that have none (notes), and one prompt a document (reduce). What it gives never
stands alone: what is missing comes from the next source in the order of trust, and pages always from packages where there are any.

Errors. A malformed answer costs its row: a group's pages are then named in the notes on confidence. Any other error of a generator ends the job, as the next
call would fail alike. A document fails, and is given apart with status and message, where it has no text (400), where all its groups came back
malformed, or where the reduced draft is malformed and no package is there to fall back on (502).
"""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import lexicon as L
from leafloom.functions import models as M
from leafloom.functions import text as T
from leafloom.operators import condense, drafts, packages, segment
from leafloom.operators import summary as S

#: Names that notes use, and the summary's fields.
NOTED = {"research_question": "research_question", "background": "background", "methods": "methods", "participants_or_data": "participants_or_data", "key_findings": "key_findings", "limitations": "author_stated_limitations"}
NOTE = "struct<field:string,value:string,evidence:string,pages:array<int>>"
NOTES = f"doc_id string, group_no int, page_start int, page_end int, title_candidates array<string>, author_candidates array<string>, notes array<{NOTE}>, error_kind string, error string"
LISTS = ("key_findings", "author_stated_limitations", "model_identified_considerations")
ATTRIBUTION = "Considerations are the model's own and not the authors'."
SOUND = "All fields rest on text of the paper; the wording should be checked against it."


def page_range(pages: Column) -> Column:
    return F.concat_ws("-", F.array_min(pages), F.array_max(pages))


def notes(groups: DataFrame, need: DataFrame, hints: DataFrame, generator: M.Generator) -> DataFrame:
    """A row of notes for each group of pages of documents with uncovered fields, about those fields only."""
    wanted = need.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("need"))
    rows = groups.join(wanted, "doc_id").join(hints.select("doc_id", "hints"), "doc_id", "left")
    asked = F.concat_ws("\n", F.lit("Take notes on these pages alone, as JSON: for each wanted field its value, a quote as evidence, and pages. Invent nothing."), F.concat(F.lit("Wanted: "), "need"), "hints", F.concat(F.lit("Pages "), page_range(F.col("pages"))), F.lit("TEXT:"), "text")
    rows = rows.select("doc_id", "group_no", F.array_min("pages").alias("page_start"), F.array_max("pages").alias("page_end"), asked.alias("prompt"))
    names = [c.split()[0] for c in NOTES.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                row = dict.fromkeys(names) | {"doc_id": r.doc_id, "group_no": r.group_no, "page_start": r.page_start, "page_end": r.page_end}
                try:
                    got, _ = M.read_json(generator.generate(r.prompt))
                    row |= {c: M.as_texts(got.get(c)) for c in ("title_candidates", "author_candidates")} | {"notes": M.as_notes(got, NOTED)}
                except M.ModelError as e:
                    if e.kind != "malformed":
                        raise
                    row |= {"error_kind": e.kind, "error": f"{e.status}: {e}"}
                out.append(row)
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, NOTES)


def gathered(rows: DataFrame) -> DataFrame:
    """A row a document: its notes with their pages (those of the group where none are named), candidates, groups, and ranges that were lost."""
    fields = lambda n: F.struct(n["field"].alias("field"), n["value"].alias("value"), F.coalesce(n["evidence"], F.lit("")).alias("evidence"), F.when(F.size(n["pages"]) > 0, n["pages"]).otherwise(F.array_distinct(F.array("page_start", "page_end"))).alias("pages"))
    own = rows.withColumn("own", F.transform(F.coalesce("notes", F.array().cast(f"array<{NOTE}>")), fields))
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    by = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("group_no", "own", texts("title_candidates"), texts("author_candidates"), "error_kind", "page_start", "page_end"))).alias("g"))
    of = lambda c: F.flatten(F.transform("g", lambda x: x[c]))
    lost = F.transform(F.filter("g", lambda x: x["error_kind"].isNotNull()), lambda x: F.concat_ws("-", x["page_start"], x["page_end"]))
    return by.select("doc_id", of("own").alias("notes"), of("title_candidates").alias("noted_titles"), of("author_candidates").alias("noted_authors"), F.size("g").alias("groups"), lost.alias("skipped"))


def _of(field: str) -> Column:
    return F.filter("notes", lambda n: (n["field"] == field) & ~T.is_missing(n["value"]))


def _known(values: Column) -> Column:
    """Distinct texts with white space collapsed, in order, without missing ones."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), T.collapse), lambda x: ~T.is_missing(x)))


def _listing(*parts: Column) -> Column:
    """The first list that isn't empty."""
    return F.coalesce(*[F.when(F.size(p) > 0, p) for p in parts], F.array().cast("array<string>"))


def reduce_prompts(rows: DataFrame) -> DataFrame:
    """doc_id, group_no and prompt: what sections verify, apart from notes that nothing verifies."""
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), value)
    verified = F.concat_ws("\n", *[F.when(F.col("p")[f].isNotNull() & ~T.is_missing(F.col(f"c_{f}")), line(f, F.col(f"c_{f}"))) for f in S.TEXTS], F.when(F.size("c_key_findings") > 0, line("key_findings", F.array_join("c_key_findings", " | "))))
    said = F.array_join(F.transform("notes", lambda n: F.concat(F.lit("- "), n["field"], F.lit(" (pages "), F.array_join(F.transform(n["pages"], lambda p: p.cast("string")), ", "), F.lit("): "), n["value"])), "\n")
    ask = F.lit("Merge what follows into one summary of the paper, as JSON with the fields " + ", ".join(drafts.REQUIRED) + ". Keep to it; prefer what sections verify.\n")
    prompt = F.concat(ask, F.lit("VERIFIED FROM SECTIONS\n"), verified, F.lit("\nUNVERIFIED NOTES\n"), said)
    return rows.select("doc_id", F.lit(0).alias("group_no"), prompt.alias("prompt"))


def align(said: Column, stated: Column, considered: Column) -> tuple[Column, Column]:
    """Notes on confidence and considerations: sentences on the study's limits move to the considerations unless the authors state them, and
    claims that limitations were inferred go."""
    parts = F.filter(T.sentences(F.when(T.is_missing(said), F.lit("")).otherwise(said)), lambda s: ~(T.found(s, L.INFERRED) & T.found(s, "(?i)\\blimitation")))
    critique = F.filter(parts, lambda s: T.found(s, L.LIMITATION))
    known = F.transform(stated, T.collapse)
    more = _known(F.concat(considered, F.filter(critique, lambda s: ~F.array_contains(known, T.collapse(s)))))
    kept = F.array_join(F.filter(parts, lambda s: ~T.found(s, L.LIMITATION)), " ")
    told = F.trim(F.concat_ws(" ", kept, F.when(F.size(more) > 0, F.lit(ATTRIBUTION))))
    return F.when(told == "", F.lit(ATTRIBUTION)).otherwise(told), more


def summarise(pages: DataFrame, generator: M.Generator | None = None, model: str = "extractive", keep: bool = True) -> dict[str, DataFrame]:
    """summaries (an envelope a document: doc_id, model, page_count, chunk_count and the fields), notes, and failed (doc_id, status, message)."""
    generator = generator or M.ExtractiveDrafter()
    kept = (lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)) if keep else (lambda df: df)
    pages = pages.withColumn("doc_id", F.col("doc_id").cast("string"))
    state = segment.document_envelope(pages).select("doc_id", F.col("status").alias("readable"))
    heads = kept(segment.running_heads(pages))
    found = kept(packages.packages(segment.sections(pages, heads)))
    hints = kept(segment.hints(pages, heads))
    groups = segment.page_groups(pages)
    # What a generator says, each row once.
    own = kept(drafts.condense(found, generator))
    noted = kept(notes(groups, packages.uncovered(pages, found), S.render_hints(hints), generator))
    counts = groups.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    docs = pages.groupBy("doc_id").agg(F.max("page_number").alias("page_count")).join(state, "doc_id").join(counts, "doc_id", "left")
    by = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("text", "pages")))).alias("p"))
    texts = lambda df, mark: df.where("error_kind IS NULL").select("doc_id", *[F.col(t).alias(f"{mark}_{t}") for t in drafts.TEXTS], *[_known(F.col(t)).alias(f"{mark}_{t}") for t in drafts.LISTS], F.col("source_pages").alias(f"{mark}_pages"))
    rows = docs.join(by, "doc_id", "left").join(hints, "doc_id", "left").join(gathered(noted), "doc_id", "left").join(texts(own, "c"), "doc_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("noted_titles", "noted_authors", "skipped", *[f"c_{x}" for x in drafts.LISTS])} | {"notes": F.coalesce("notes", F.array().cast(f"array<{NOTE}>")), "p": F.coalesce("p", F.create_map().cast("map<string,struct<text:string,pages:array<int>>>"))})
    rows = kept(rows.withColumn("c_key_findings", F.filter("c_key_findings", lambda x: ~T.is_prescriptive(x))))
    merged = kept(drafts._drafted(reduce_prompts(rows.where("readable = 200")), "prompt", generator))
    rows = rows.join(texts(merged, "r"), "doc_id", "left").join(merged.select("doc_id", F.col("error_kind").alias("_broken")), "doc_id", "left")
    rows = rows.withColumns({f"r_{x}": F.coalesce(f"r_{x}", none) for x in drafts.LISTS})
    lost = (F.size("skipped") > 0) & (F.size("skipped") == F.col("groups"))
    bare = F.col("_broken").isNotNull() & (F.size("p") == 0)
    status = F.when(F.col("readable") != 200, 400).when(lost | bare, 502)
    said = F.when(F.col("readable") != 200, "the paper has no text").when(lost, "no group of pages gave a usable answer").when(bare, "the summary is malformed and no section can stand for it")
    failed = rows.where(status.isNotNull()).select("doc_id", status.alias("status"), said.alias("message"))
    good = recovered(rows.where(status.isNull()))
    good = drafts.repaired_question(good, generator, condense.NO_QUESTION)
    columns = ["doc_id", F.lit(model).alias("model"), "page_count", F.greatest(F.coalesce("chunk_count", F.lit(0)), F.lit(1)).cast("int").alias("chunk_count")]
    return {"summaries": good.select(*columns, "title", "authors", *S.TEXTS, *LISTS, "plain_english_summary", "confidence_notes", "missing_fields", "source_pages"), "notes": noted, "failed": failed}


def recovered(rows: DataFrame) -> DataFrame:
    """The fields of rows (p: packages by field; c_ and r_: condensed and reduced drafts; notes; hints), each from the first source that has it."""
    sure = F.col("title_confidence") == "high"
    first = lambda c: F.get(c, F.lit(0))
    text = lambda f: F.coalesce(F.col("p")[f]["text"], F.lit(""))
    candidates = lambda a, b, c, d: _known(F.concat(a, F.when(sure, b).otherwise(F.array().cast("array<string>")), c, d))
    titles = candidates(F.when(T.is_missing(F.col("c_title")), F.array().cast("array<string>")).otherwise(F.array("c_title")), F.col("title_candidates"), F.col("noted_titles"), F.col("title_candidates"))
    people = F.slice(candidates(F.col("c_authors"), F.col("author_candidates"), F.col("noted_authors"), F.col("author_candidates")), 1, 3)
    authors = F.when(F.size("r_authors") == 0, people).when(sure & (F.size("author_names") > F.size("r_authors")), F.col("author_names")).otherwise(F.col("r_authors"))
    scalars = {f: S.first_known(F.col(f"r_{f}"), F.col(f"c_{f}"), S.most_specific(_of(f)), F.when(text(f) != "", condense.TEXTS[f](text(f)))) for f in S.TEXTS}
    lists = {}
    for f in LISTS:
        package = {"author_stated_limitations": "limitations"}.get(f, f)
        told = _known(F.transform(_of(f), lambda n: n["value"]))
        own = F.when(text(package) != "", _listing(F.col(f"c_{f}"), told)).otherwise(_listing(told, F.col(f"c_{f}")))
        lists[f] = _listing(F.col(f"r_{f}"), own)
    rows = rows.withColumns({"title": S.first_known(F.col("r_title"), first(titles)), "authors": authors, **scalars, **lists})
    sources = F.filter(F.split(text("limitations"), "\n"), lambda s: s != "")
    stated, other = S.split_limitations(F.col("author_stated_limitations"), sources)
    rows = rows.withColumn("key_findings", S.tighten(F.col("key_findings"), condense.findings(text("key_findings"))))
    rows = rows.withColumns({"author_stated_limitations": _listing(stated, F.slice(F.transform(sources, lambda s: T.cut(s, 300)), 1, 5)), "model_identified_considerations": _known(F.concat("model_identified_considerations", other))})
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in S.TEXTS], F.when(F.size("key_findings") == 0, F.lit("key_findings"))))
    rows = rows.withColumn("missing_fields", missing)
    prose = F.filter(F.concat(F.array("research_question", "methods", "participants_or_data"), F.slice("key_findings", 1, 2)), lambda x: ~T.is_missing(x))
    plain = F.array_join(F.transform(prose, lambda x: F.when(F.endswith(x, F.lit(".")), x).otherwise(F.concat(x, F.lit(".")))), " ")
    unsure = F.when(F.size("missing_fields") > 0, F.concat(F.lit("The paper's text did not yield: "), F.array_join("missing_fields", ", "), F.lit("."))).otherwise(SOUND)
    rows = rows.withColumns({"plain_english_summary": S.first_known(F.col("r_plain_english_summary"), plain), "confidence_notes": S.first_known(F.col("r_confidence_notes"), unsure)})
    told, more = align(F.col("confidence_notes"), F.col("author_stated_limitations"), F.col("model_identified_considerations"))
    rows = rows.withColumns({"confidence_notes": told, "model_identified_considerations": more})
    rows = rows.withColumn("model_identified_considerations", S.prune_considerations(F.col("model_identified_considerations"), F.col("author_stated_limitations")))
    gap = F.concat(F.lit("Pages "), F.array_join("skipped", "; "), F.lit(" could not be read by the model."))
    rows = rows.withColumn("confidence_notes", F.trim(F.concat_ws(" ", "confidence_notes", F.when(F.size("skipped") > 0, gap))))
    none = F.array().cast("array<int>")
    paged = []
    for name, field in S.PAGED.items():
        held = F.array_sort(F.array_distinct(F.flatten(F.transform(_of(name), lambda n: n["pages"]))))
        pages = F.coalesce(*[F.when(F.size(x) > 0, x) for x in (F.coalesce(F.col("p")[field]["pages"], none), held)], none)
        paged.append(S.clamp(pages, F.col("page_count")).alias(name))
    return rows.withColumn("source_pages", F.struct(*paged))
