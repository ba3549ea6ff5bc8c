"""Queries over the driver's tables for the library's own operators, with their SQL twins.

Documents stand in as pages: of a source, or of the papers of leafloom.plans.papers. Rules of lines and sentences also run on fixture rows below, which
both engines get as literals, for the cases that no table has.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions import lexicon as L
from leafloom.functions import models as M
from leafloom.functions import text as T
from leafloom.operators import answer, condense, evaluate, packages, rank, render, segment, summarise, summary
from leafloom.plans import papers as P
from leafloom.sources import pages as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("doc_id"), (F.col("doc_id") + 1).cast("int").alias("page_number"), "text")


def listed(rows: list[str]) -> str:
    """Fixture rows as a relation v(id, t) in SQL."""
    return "(VALUES " + ", ".join("({}, '{}')".format(i, r.replace("'", "''")) for i, r in enumerate(rows)) + ") v(id, t)"


def fixture(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "id int, t string")


def re2(pattern: str) -> str:
    """A pattern as a SQL literal for an engine without named groups."""
    return "'" + re.sub(r"\(\?<\w+>", "(", pattern).replace("\\u2019", "’").replace("'", "''") + "'"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {re2(pattern)})"


COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
SPLIT = r"list_filter(string_split(regexp_replace(" + COLLAPSE + r", '([.!?])\s+([A-Z(\x22\x27])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')"
_MARKS = T.MARKS.replace("'", "''")
STEM = "CASE " + " ".join(f"WHEN ends_with({{0}}, '{s}') AND length({{0}}) > {len(s) + 2} THEN " + (f"substr({{0}}, 1, length({{0}}) - {len(s)})" + (" || 'y'" if s == "ies" else "")) for s in T.SUFFIXES) + " ELSE {0} END"
WORDS = "string_split(" + COLLAPSE.format(f"translate(lower(coalesce(text, '')), '{_MARKS}', '{' ' * len(T.MARKS)}')") + ", ' ')"
STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in L.STOPWORDS) + ")"
TERMS = "list_distinct(list_transform(list_filter(" + WORDS + f", lambda w: length(w) >= 3 AND w NOT IN {STOP}), lambda w: " + STEM.format("w") + "))"

# --- lines, sentences, terms -------------------------------------------------------------------------------------------


@query("line_offsets", rf"""
WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) raw, generate_subscripts(string_split(text, chr(10)), 1) n FROM documents),
s AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM r)
SELECT doc_id, CAST(n - 1 AS INTEGER) line_no, {COLLAPSE.format("raw")} line, CAST(before + length(raw) - length(ltrim(raw)) AS BIGINT) start_char,
  CAST(before + length(rtrim(raw)) AS BIGINT) end_char FROM s WHERE {COLLAPSE.format("raw")} <> ''
""")  # fmt: skip
def line_offsets(spark, sf_dir):
    return segment.line_offsets(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("sentence_split", f"""
WITH s AS (SELECT doc_id, {SPLIT.format("text")} p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) n, unnest(p) sentence FROM s
""")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


_LINES = rf"""WITH l AS (SELECT coalesce(source, '') doc_id, CAST(doc_id + 1 AS INTEGER) page_number, unnest(list_filter(list_transform(regexp_split_to_array(text, '[\n\r]'), lambda x: {COLLAPSE.format("x")}), lambda x: x <> '')) line
  FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, lower(line) key, count(DISTINCT page_number) n_pages FROM l WHERE length(line) BETWEEN 4 AND 100 GROUP BY 1, 2),
t AS (SELECT coalesce(source, '') doc_id, count(*) total FROM documents GROUP BY 1),
h AS (SELECT doc_id, key, n_pages FROM c JOIN t USING (doc_id) WHERE n_pages >= greatest(2, ceil(0.1::DOUBLE * total)))"""


@query("running_heads", _LINES + " SELECT doc_id, key, n_pages FROM h")
def running_heads(spark, sf_dir):
    return segment.running_heads(as_pages(spark, sf_dir), ratio=0.1).select("doc_id", "key", "n_pages")


@query("drop_running_heads", _LINES + r" SELECT doc_id, page_number, count(*) n_lines, CAST(sum(length(line)) AS BIGINT) n_chars FROM l ANTI JOIN h ON l.doc_id = h.doc_id AND lower(l.line) = h.key WHERE NOT regexp_matches(line, '(?i)^(page\s*)?\d{1,4}$') GROUP BY 1, 2")
def drop_running_heads(spark, sf_dir):
    p = as_pages(spark, sf_dir)
    return segment.body_lines(p, segment.running_heads(p, ratio=0.1)).groupBy("doc_id", "page_number").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("content_terms", f"SELECT DISTINCT doc_id, unnest({TERMS}) term FROM documents")
def content_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.content_terms(F.col("text"))).alias("term"))


@query("content_words", "SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 3)) word FROM documents")
def content_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.content_words(F.col("text"))).alias("word"))


@query("finding_words", "SELECT DISTINCT doc_id, lower(unnest(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: length(w) > 3 OR regexp_matches(w, '^[A-Z]{2,}$')))) word FROM documents")
def finding_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.finding_words(F.col("text"))).alias("word"))


@query("text_cuts", rf"""
WITH c AS (SELECT doc_id, {COLLAPSE.format("text")} t FROM documents)
SELECT doc_id, CASE WHEN t IS NULL THEN NULL WHEN length(t) <= 600 THEN t ELSE regexp_replace(substr(t, 1, 600), ' [^ ]*$', '') || '...' END cut_600,
  CASE WHEN t IS NULL THEN NULL WHEN length(t) <= 320 THEN t ELSE regexp_replace(substr(t, 1, 320), ' [^ ]*$', '') || '...' END cut_320 FROM c
""")
def text_cuts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cut(F.col("text"), 600).alias("cut_600"), T.cut(F.col("text"), 320).alias("cut_320"))


# --- identifiers and vectors -------------------------------------------------------------------------------------------


@query("passage_id", """
SELECT doc_id, printf('p%04d-%s', CAST(doc_id % 90 + 1 AS INTEGER), substr(sha256(concat_ws('|', source, CAST(doc_id % 90 + 1 AS VARCHAR), lang, '0', CAST(n_chars AS VARCHAR), text)), 1, 12)) chunk_id FROM documents
""")
def passage_id(spark, sf_dir):
    """Documents as passages: source, language and size stand for document, section and end, and the page is one of ninety by id. What is null adds no part."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.passage_id(F.col("source"), (F.col("doc_id") % 90 + 1).cast("int"), F.col("lang"), F.lit(0), F.col("n_chars"), F.col("text")).alias("chunk_id"))


@query("document_key", "SELECT CAST(conv_id AS VARCHAR) name, sha256(CAST(conv_id AS VARCHAR) || string_agg(chr(0) || CAST(turn AS VARCHAR) || chr(0) || coalesce(text, ''), '' ORDER BY turn)) document_key FROM conversations GROUP BY conv_id")
def document_key(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.col("turn").alias("page_number"), F.coalesce("text", F.lit("")).alias("text")).alias("p"))
    return c.groupBy(F.col("conv_id").cast("string").alias("name")).agg(F.collect_list("p").alias("p")).select("name", T.document_key(F.col("name"), F.col("p")).alias("document_key"))


@query("hash_embedding", f"""
WITH w AS (SELECT doc_id, unnest(list_filter({WORDS}, lambda x: x <> '')) w FROM documents),
k AS (SELECT doc_id, CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END w FROM w)
SELECT doc_id, CAST(CAST('0x' || substr(sha256(w), 1, 8) AS UBIGINT) % 512 AS INTEGER) bucket, CAST(count(*) AS DOUBLE) weight FROM k GROUP BY 1, 2
UNION ALL SELECT doc_id, 0, 0.001 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k)
""")
def hash_embedding(spark, sf_dir):
    return rank.hash_embedding(table(spark, sf_dir, "documents"), "doc_id")


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector asks among those of its label."""
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")).where(T.is_vector(F.col("embedding")))
    chunks = e.select(F.col("label").cast("string").alias("doc_id"), F.col("vec_id").cast("string").alias("chunk_id"), (F.col("label") + 1).alias("page_number"), F.lit("findings").alias("section"), F.lit("one two three four five six seven eight").alias("text"), F.col("vec_id").alias("start_char"), "embedding")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("label").cast("string").alias("doc_id"), "embedding")
    return asked, chunks


_RANKED = """WITH q AS (SELECT vec_id question_id, label, embedding::DOUBLE[] v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT question_id, CAST(e.vec_id AS VARCHAR) chunk_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(v, e.embedding::DOUBLE[]))) score, e.vec_id FROM q JOIN embeddings e USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, vec_id, chunk_id) rank FROM s)"""


@query("cosine_topk", _RANKED + " SELECT question_id, CAST(rank AS INTEGER) rank, chunk_id, round(score, 6) score FROM r WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    return rank.rank(*_vectors(spark, sf_dir), 5).select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("rank_diagnostics", _RANKED + " SELECT question_id, count(*) returned, round(max(score) FILTER (rank = 1), 6) top_score, round(max(score) FILTER (rank = 2), 6) second_score, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) score_gap, round(avg(score), 6) mean_top_k FROM r WHERE rank <= 5 GROUP BY 1")
def rank_diagnostics(spark, sf_dir):
    found = rank.diagnostics(rank.rank(*_vectors(spark, sf_dir), 5), 5)
    return found.select("question_id", "returned", *[F.round(c, 6).alias(c) for c in ("top_score", "second_score", "score_gap", "mean_top_k")])


_ITEM = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) > 3))"


@query("containment", f"""
WITH d AS (SELECT doc_id, {_ITEM} w FROM documents), b AS (SELECT item_id, {_ITEM} w FROM benchmark),
x AS (SELECT doc_id, item_id, len(d.w) a, len(b.w) b, len(list_intersect(d.w, b.w)) shared FROM d, b)
SELECT doc_id, item_id, shared, round(CAST(shared AS DOUBLE) / least(a, b), 9) overlap FROM x WHERE shared > 0 AND CAST(shared AS DOUBLE) / least(a, b) >= 0.8
""")
def containment(spark, sf_dir):
    """Documents that have most words of a benchmark item, or the reverse."""
    of = lambda name, key: table(spark, sf_dir, name).select(F.col(key), T.content_words(F.col("text")).alias("words"))
    found = evaluate.contained(of("documents", "doc_id"), of("benchmark", "item_id"), "doc_id", "item_id", 0.8)
    return found.select("doc_id", "item_id", "shared", F.round("overlap", 9).alias("overlap"))


@query("confusion_metrics", """
WITH r AS (SELECT quality = 1 e, toxic = 0 p FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT count(*) total, count(*) FILTER (e AND p) true_positives, count(*) FILTER (NOT e AND NOT p) true_negatives, count(*) FILTER (NOT e AND p) false_positives,
  count(*) FILTER (e AND NOT p) false_negatives, count(*) FILTER (e = p) correct, coalesce(CAST(count(*) FILTER (e = p) AS DOUBLE) / nullif(count(*), 0), 0) accuracy FROM r
""")
def confusion_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select((F.col("quality") == 1).alias("expected_answerable"), (F.col("toxic") == 0).alias("predicted"), F.lit(None).cast("boolean").alias("page_hit"))
    return evaluate.metrics(rows).select("total", "true_positives", "true_negatives", "false_positives", "false_negatives", "correct", "accuracy")


@query("page_groups", r"""
WITH RECURSIVE p AS (SELECT conv_id, turn, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) n
  FROM (SELECT conv_id, turn, substr(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), 1, 20000) t FROM conversations) WHERE t <> ''),
f AS (SELECT conv_id, n, turn, t, 0 g, length(t) size, 1 k FROM p WHERE n = 1
  UNION ALL SELECT p.conv_id, p.n, p.turn, p.t, CASE WHEN fits THEN g ELSE g + 1 END, CASE WHEN fits THEN size + length(p.t) ELSE length(p.t) END, CASE WHEN fits THEN k + 1 ELSE 1 END
  FROM (SELECT f.*, f.size + length(q.t) <= 600 AND f.k < 4 fits FROM f JOIN p q ON q.conv_id = f.conv_id AND q.n = f.n + 1) f JOIN p ON p.conv_id = f.conv_id AND p.n = f.n + 1)
SELECT CAST(conv_id AS VARCHAR) doc_id, CAST(g AS INTEGER) group_no, string_agg(CAST(turn + 1 AS VARCHAR), ',' ORDER BY turn) pages, string_agg(t, chr(10) ORDER BY turn) text FROM f GROUP BY conv_id, g
""")
def page_groups(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")
    return segment.page_groups(c, 600, 4).withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query("document_envelope", "SELECT coalesce(source, '') doc_id, count(*) page_count, CAST(sum(length(coalesce(text, ''))) AS BIGINT) character_count, CASE WHEN bool_and(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '') THEN 422 ELSE 200 END status FROM documents GROUP BY 1")
def document_envelope(spark, sf_dir):
    return segment.document_envelope(as_pages(spark, sf_dir)).select("doc_id", "page_count", "character_count", "status")


# --- rules on fixture rows ---------------------------------------------------------------------------------------------

HEADING_LINES = ["Abstract", "2. Methods", "KEYWORDS:", "Key words", "Limitations and future research", "Limitations of previous research", "Aims of the study", "III. Results and findings", "Discussion of findings", "Data collection and analysis", "- Conclusions", "Notes on contributors", "Acknowledgements", "Funding", "The results are in", "7", "Study population", "Strengths and limitations", "Summary.", "Setting and participants"]
SENTENCES = [
    "We found that walkers slept 41 minutes longer than the others.", "Clubs should offer evening walks to all of their members.", "The small sample means that the results cannot be assumed to hold elsewhere.", "Too short.",
    "Participants reported fewer wakings at night than before the trial.", "Further research is needed on light and on company.", "Sleep diaries were kept in the homes of forty gardeners.", "Results showed a mean of 7.2 hours, p < 0.05, in both groups.",
    "A weakness of the design is the single interview with each person.", "Three themes emerged: light, company and routine in the evening.", "We recommend that clinicians ask about walking at each visit.", "The weather was mild and the paths were dry in that summer.",
    "Recall bias may have coloured what people told us about their sleep.", "It is important that guidance should reflect these patterns.", "Response rates declined by 12 percent in the second year of study.",
]
QUESTION_ROWS = ["How many participants took part?", "What are the limitations of the study?", "Which questionnaire was used?", "Where was the study done?", "How were the data collected and analysed?", "What is the aim of the paper?", "Which placebo was given?", "What did the authors find?", "What was the mean age of the sample?", "Who wrote it?", "In which country were students recruited?", "What percentage improved?"]
FRONT_LINES = ["Journal of Rest, Vol. 4", "Evening Walking and Sleep", "marsh@northbay.example", "Department of Health", "12-19", "Research Article", "Lena Marsh and Ruth Calloway", "Received 3 May 2020", "Keywords: sleep", "https://rest.example/4", "Northbay Press Ltd", "A plain line of a title"]


def _rules(rows: list[str], **rules: str) -> str:
    return f"SELECT id, {', '.join(f'{sql} AS {name}' for name, sql in rules.items())} FROM {listed(rows)}"


_HEADING = COLLAPSE.format("regexp_replace(trim(regexp_replace(" + COLLAPSE.format(f"regexp_replace(t, {re2(L.NUMBERING)}, '')") + ", '^[–—-]+|[–—-]+$', '', 'g')), '[:.]+$', '')")


@query("heading_match", f"SELECT id, CASE WHEN length(h) <= 70 AND regexp_matches(h, '^[A-Za-z]') THEN CASE {' '.join(f'WHEN regexp_full_match(h, {re2("(?i)(?:" + p + ")")}) THEN {chr(39)}{n}{chr(39)}' for n, p in L.HEADINGS)} END END name FROM (SELECT id, {_HEADING} h FROM {listed(HEADING_LINES)}) x")
def heading_match(spark, sf_dir):
    return fixture(spark, HEADING_LINES).select("id", T.heading_name(F.col("t")).alias("name"))


@query("finding_filter", _rules(SENTENCES, prescriptive=has("t", L.PRESCRIPTIVE), finding=f"length(trim(t)) >= 40 AND NOT {has('t', L.PRESCRIPTIVE)} AND {has('t', L.EMPIRICAL)}"))
def finding_filter(spark, sf_dir):
    return fixture(spark, SENTENCES).select("id", T.is_prescriptive(F.col("t")).alias("prescriptive"), T.is_finding(F.col("t")).alias("finding"))


@query("limitation_filter", _rules(SENTENCES, inside=f"length(t) >= 20 AND ({has('t', L.LIMITATION)} OR NOT {has('t', L.RESULT)})", outside=f"length(t) >= 20 AND {has('t', L.LIMITATION)}"))
def limitation_filter(spark, sf_dir):
    return fixture(spark, SENTENCES).select("id", T.is_limitation(F.col("t"), True).alias("inside"), T.is_limitation(F.col("t"), False).alias("outside"))


@query("question_types", _rules(QUESTION_ROWS, types="array_to_string(list_filter([" + ", ".join(f"CASE WHEN {has('t', cue)} THEN '{name}' END" for name, _, _, cue, _ in L.QUESTION_TYPES) + "], lambda x: x IS NOT NULL), ',')", attribute=" OR ".join(has("t", p) for p in L.ASKS_ATTRIBUTE)))
def question_types(spark, sf_dir):
    return fixture(spark, QUESTION_ROWS).select("id", F.array_join(T.question_types(F.col("t")), ",").alias("types"), T.asks_attribute(F.col("t")).alias("attribute"))


@query("page_furniture", _rules(FRONT_LINES, furniture=" OR ".join(has("t", p) for p in (L.PAGE_NUMBER, L.PAGE_RANGE, L.EMAIL, L.URL, L.BIBLIOGRAPHIC, L.ARTICLE_LABEL, L.KEYWORDS, L.AFFILIATION, L.COMPANY)), affiliation=" OR ".join(has("t", p) for p in (L.AFFILIATION, L.AFFILIATION_STEM, L.GLUED_MARKER))))
def page_furniture(spark, sf_dir):
    return fixture(spark, FRONT_LINES).select("id", T.is_furniture(F.col("t")).alias("furniture"), T.is_affiliation(F.col("t")).alias("affiliation"))


@query("missing_values", "SELECT id, regexp_replace(lower(trim(t)), '\\.+$', '') IN (" + ", ".join(f"'{m}'" for m in L.EMPTY_MARKERS) + ") missing FROM " + listed(["", "N/A", "None.", "unknown...", "Not stated in the paper.", "a value", "nothing"]))
def missing_values(spark, sf_dir):
    return fixture(spark, ["", "N/A", "None.", "unknown...", "Not stated in the paper.", "a value", "nothing"]).select("id", T.is_missing(F.col("t")).alias("missing"))


WORD_ROWS = ["studies", "collections", "collection", "coding", "used", "classes", "walks", "gas", "ties", "sing", "bed", "analyses", "was"]


@query("stems", "SELECT id, " + STEM.format("t") + " stem FROM " + listed(WORD_ROWS))
def stems(spark, sf_dir):
    return fixture(spark, WORD_ROWS).select("id", T.stem(F.col("t")).alias("stem"))


@query("file_sizes", """
SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1024 * 1024 THEN printf('%.1f KB', floor(CAST(n_chars AS DOUBLE) / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(CAST(n_chars AS DOUBLE) / 1024 / 1024 * 10 + 0.5) / 10) END size,
  CASE WHEN n_chars * 4096 < 1024 THEN n_chars * 4096 || ' B' WHEN n_chars * 4096 < 1024 * 1024 THEN printf('%.1f KB', floor(CAST(n_chars * 4096 AS DOUBLE) / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(CAST(n_chars * 4096 AS DOUBLE) / 1024 / 1024 * 10 + 0.5) / 10) END pages_of_4k FROM documents
""")
def file_sizes(spark, sf_dir):
    """Of all documents, and as if each character took a page of memory, so that all units occur."""
    return table(spark, sf_dir, "documents").select("doc_id", sources.file_size(F.col("n_chars")).alias("size"), sources.file_size(F.col("n_chars") * 4096).alias("pages_of_4k"))


UPLOADS = [("/in/a.pdf", 3), ("/in/B.PDF", 20 * 1024 * 1024), ("/in/c.txt", 3), ("/in/d.pdf", 0), ("/in/e.pdf", 20 * 1024 * 1024 + 1)]


@query("upload_gate", "SELECT path, CASE WHEN NOT ends_with(lower(path), '.pdf') OR length = 0 THEN 400 WHEN length > 20971520 THEN 413 ELSE 200 END status FROM (VALUES " + ", ".join(str(u) for u in UPLOADS) + ") v(path, length)")
def upload_gate(spark, sf_dir):
    return sources.gate(spark.createDataFrame(UPLOADS, "path string, length long")).select("path", "status")


PAGE_SETS = [[], [4], [2, 3, 4], [1, 3], [5, 6, 8, 9]]


@query("page_phrases", "SELECT id, CASE WHEN len(p) = 0 THEN 'no pages' WHEN len(p) = 1 THEN 'page ' || p[1] WHEN p[-1] - p[1] + 1 = len(p) THEN 'pages ' || p[1] || '-' || p[-1] ELSE 'pages ' || array_to_string(p, ', ') END phrase FROM (VALUES " + ", ".join(f"({i}, {p}::INTEGER[])" for i, p in enumerate(PAGE_SETS)) + ") v(id, p)")
def page_phrases(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(PAGE_SETS)), "id int, p array<int>").select("id", T.page_phrase(F.col("p")).alias("phrase"))


# --- papers, end to end ------------------------------------------------------------------------------------------------


def _flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON, so that all columns are scalars."""
    return df.select(*[F.to_json(F.struct(F.col(c).alias("v"))).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def on_papers(name: str, sql: str | None = None):
    """Registers make(pages, cases)."""

    def put(make):
        query(name, sql)(lambda spark, sf_dir: _flat(make(P.pages(spark, sf_dir), P.cases(spark, sf_dir))))
        return make

    return put


def _list(column: str) -> str:
    """A list of any kind as to_json() writes it, in a field v."""
    return f"'{{\"v\":' || CAST(to_json({column}) AS VARCHAR) || '}}'"


def _json(column: str, quote: str = "") -> str:
    """A list as to_json() writes it, in a field v."""
    return "'{\"v\":[' || array_to_string(" + (f"list_transform({column}, lambda x: '\"' || x || '\"')" if quote else column) + ", ',') || ']}'"


on_papers("section_carry", f"WITH {P.SECTIONS} SELECT doc_id, section_no, name, heading, text, {_json('pages')} pages FROM sec")(lambda p, c: segment.sections(p))
on_papers("passages", f"WITH RECURSIVE {P.PASSAGES} SELECT * FROM pas")(lambda p, c: segment.passages(p))
on_papers("passage_stats", f"""
WITH RECURSIVE {P.PASSAGES}, x AS (SELECT *, len(string_split(text, ' ')) n FROM pas)
SELECT doc_id, count(*) chunks, count(DISTINCT page_number) pages, CAST(min(n) AS INTEGER) min_words, CAST(max(n) AS INTEGER) max_words, CAST(floor(avg(n)) AS BIGINT) mean_words,
  {_json("coalesce(list_sort(list(DISTINCT section) FILTER (section <> '')), [])", "q")} sections FROM x GROUP BY 1
""")(lambda p, c: segment.chunk_stats(segment.passages(p)))
on_papers("exclusion_summary", f"WITH RECURSIVE {P.PASSAGES}, {P.EXCLUDED} SELECT doc_id, excluded, count(*) n FROM ex WHERE excluded IS NOT NULL GROUP BY 1, 2")(lambda p, c: rank.exclusion_summary(segment.passages(p)))
on_papers("corpus_counts", f"""
WITH RECURSIVE {P.PASSAGES}, {P.EXCLUDED}, b AS (SELECT doc_id, excluded, count(*) n FROM ex GROUP BY 1, 2)
SELECT doc_id, CAST(coalesce(sum(n) FILTER (excluded IS NULL), 0) AS INTEGER) considered, CAST(coalesce(sum(n) FILTER (excluded IS NOT NULL), 0) AS INTEGER) excluded,
  '{{"v":{{' || coalesce(string_agg('"' || excluded || '":' || n, ',' ORDER BY excluded) FILTER (excluded IS NOT NULL), '') || '}}}}' excluded_by_reason FROM b GROUP BY 1
""")(lambda p, c: rank.corpus_counts(segment.passages(p)))

_BODY = f"""{P.SECTIONS},
bd AS (SELECT s.* FROM sec s LEFT JOIN (SELECT doc_id, min(section_no) ends FROM sec WHERE name IN ('references', 'acknowledgements') GROUP BY 1) t USING (doc_id) WHERE ends IS NULL OR section_no < ends),
se AS (SELECT doc_id, section_no, name, pages, unnest(l) s, generate_subscripts(l, 1) n FROM (SELECT *, {P.SENTENCES.format("text")} l FROM bd)),
li AS (SELECT * FROM se WHERE name IN ('limitations', 'discussion', 'conclusion') AND length(trim(s)) >= 20 AND ({P.has("trim(s)", L.LIMITATION)} OR (name = 'limitations' AND NOT {P.has("trim(s)", L.RESULT)}))),
l1 AS (SELECT doc_id, s, min(section_no * 1000000 + n) at_, arg_min(pages, section_no * 1000000 + n) pages FROM li GROUP BY 1, 2),
lm AS (SELECT doc_id, list(s ORDER BY at_) sentences, list_sort(list_distinct(flatten(list(pages)))) pages FROM l1 GROUP BY 1)"""
_PACKAGES = f"""{_BODY},
fm(field, name, priority) AS (VALUES {", ".join(f"('{f}', '{n}', {i})" for f, names in L.FIELDS.items() for i, n in enumerate(names))}),
di AS (SELECT doc_id, field, string_agg(trim(text, ' ' || chr(10)), chr(10) || chr(10) ORDER BY priority, section_no) text, list_sort(list_distinct(flatten(list(pages)))) pages, list(heading ORDER BY priority, section_no) headings
  FROM bd JOIN fm USING (name) WHERE trim(text) <> '' GROUP BY 1, 2),
cu AS (SELECT *, CASE name WHEN 'abstract' THEN 0 WHEN 'introduction' THEN 1 ELSE 2 END part FROM se WHERE name IN ('abstract', 'introduction', 'background') AND {P.has("s", L.STATED_QUESTION)} AND doc_id NOT IN (SELECT doc_id FROM di WHERE field = 'research_question')),
c1 AS (SELECT doc_id, s, min((part, section_no, n)) at_, arg_min(pages, (part, section_no, n)) pages FROM cu GROUP BY 1, 2),
pk AS (SELECT * FROM di UNION ALL SELECT doc_id, 'research_question', string_agg(s, ' ' ORDER BY at_), list_sort(list_distinct(flatten(list(pages)))), ['(inferred from abstract/introduction)'] FROM c1 GROUP BY 1
  UNION ALL SELECT doc_id, 'limitations', array_to_string(sentences, chr(10)), pages, ['limitations'] FROM lm)"""
_CORE = ("research_question", "methods", "participants_or_data", "key_findings")

on_papers("stated_limitations", f"WITH {_BODY} SELECT doc_id, CAST(len(sentences) AS INTEGER) n, array_to_string(sentences, '|') sentences, {_json('pages')} pages FROM lm")(
    lambda p, c: packages.limitations(segment.sections(p)).select("doc_id", F.size("sentences").alias("n"), F.array_join("sentences", "|").alias("sentences"), "pages")
)
on_papers("evidence_packages", f"WITH {_PACKAGES} SELECT doc_id, field, text, {_json('pages')} pages, {_json('headings', 'q')} headings FROM pk")(lambda p, c: packages.packages(segment.sections(p)))
on_papers("uncovered_fields", f"WITH {_PACKAGES} SELECT doc_id, field FROM (SELECT * FROM (SELECT DISTINCT doc_id FROM pg), (SELECT unnest([{', '.join(f"'{c}'" for c in _CORE)}]) field)) x ANTI JOIN pk USING (doc_id, field)")(
    lambda p, c: packages.uncovered(p, packages.packages(segment.sections(p)))
)

_TOP = "SELECT question_id, doc_id, CAST(rank AS INTEGER) rank, chunk_id, page_number, round(score, 6) score, round(max(score) FILTER (rank = 1) OVER w - max(score) FILTER (rank = 2) OVER w, 6) score_gap, round(avg(score) OVER w, 6) mean_top_k FROM (SELECT * FROM rk WHERE rank <= 5) WINDOW w AS (PARTITION BY question_id)"


def _ranked(p: DataFrame, c: DataFrame, k: int) -> DataFrame:
    chunks = rank.embed(segment.passages(p), M.HashingEmbedder())
    return rank.rank(rank.embed(c, M.HashingEmbedder(), "question"), chunks, k)


@on_papers("flagship_ranking", f"WITH RECURSIVE {P.RANKED} {_TOP}")
def flagship_ranking(p, c):
    """Passages of all papers ranked against users' questions."""
    found = rank.with_diagnostics(_ranked(p, c, 5), 5)
    return found.select("question_id", "doc_id", "rank", "chunk_id", "page_number", *[F.round(x, 6).alias(x) for x in ("score", "score_gap", "mean_top_k")])


_HAVE = "text || ' ' || replace(section, '_', ' ')"
on_papers("term_coverage", f"""
WITH RECURSIVE {P.RANKED}, t AS (SELECT question_id, chunk_id, {P.terms("question")} wanted, {P.terms(_HAVE)} have FROM rk WHERE rank <= 5),
m AS (SELECT *, list_sort(list_intersect(wanted, have)) matched FROM t)
SELECT question_id, chunk_id, CASE WHEN len(wanted) = 0 THEN 0 ELSE round(CAST(len(matched) AS DOUBLE) / len(wanted), 9) END coverage, array_to_string(matched, ' ') matched FROM m
""")(lambda p, c: rank.term_coverage(c, _ranked(p, c, 5).select("question_id", "chunk_id", "text", "section")).select("question_id", "chunk_id", F.round("coverage", 9).alias("coverage"), F.array_join("matched", " ").alias("matched")))
on_papers("evaluation_json", f"""
WITH {P.PAGES}, {P.CASES} SELECT doc_id paper, '{{"paper":"' || doc_id || '","questions":[' || string_agg('{{"question":' || CAST(to_json(question) AS VARCHAR) || ',"expected_answerable":' || expected_answerable ||
  ',"expected_pages":[' || array_to_string(expected_pages, ',') || ']}}', ',' ORDER BY question_id) || ']}}' json FROM qu GROUP BY doc_id
""")(lambda p, c: sources.evaluation_json(c.select(F.col("doc_id").alias("paper"), F.col("question_id").alias("question_no"), "question", "expected_answerable", "expected_pages")))
on_papers("reranked", f"WITH RECURSIVE {P.RERANKED} SELECT question_id, CAST(rank AS INTEGER) rank, CAST(cosine_rank AS INTEGER) cosine_rank, cue, chunk_id, round(score, 6) score FROM rr")(
    lambda p, c: answer.ask(c, p)["ranked"].select("question_id", "rank", "cosine_rank", "cue", "chunk_id", F.round("score", 6).alias("score"))
)
_VERDICT = ("supporting_pages", "question_types", "missing_evidence", "matched_terms")
on_papers("verdict", f"WITH RECURSIVE {P.VERDICTS} SELECT question_id, status, reason, {', '.join(_list(x) + ' ' + x for x in _VERDICT)} FROM vd")(
    lambda p, c: answer.ask(c, p)["verdicts"].select("question_id", "status", "reason", *_VERDICT)
)
_RULES = {"kind": "missing evidence of a kind", "attribute": "attribute not reported", "short": "too few terms", "weak": "no supporting passage", "noise": "low scores", "clear": "one supporting passage", "close": "one supporting passage", "several": "corroborated"}
on_papers("answer_rules", f"WITH RECURSIVE {P.VERDICTS} SELECT question_id, CASE gate {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in _RULES.items())} END rule FROM vd")(
    lambda p, c: answer.ask(c, p)["verdicts"].select("question_id", answer.responsible_rule(F.col("reason")).alias("rule"))
)
on_papers("evaluation", f"""
WITH RECURSIVE {P.VERDICTS}, o AS (SELECT expected_answerable e, status <> 'not_supported' p, len(list_intersect(expected_pages, supporting_pages)) > 0 hit, len(expected_pages) > 0 AND status <> 'not_supported' checked FROM qu JOIN vd USING (question_id))
SELECT count(*) total, count(*) FILTER (e AND p) true_positives, count(*) FILTER (NOT e AND NOT p) true_negatives, count(*) FILTER (NOT e AND p) false_positives, count(*) FILTER (e AND NOT p) false_negatives, count(*) FILTER (checked) pages_checked,
  count(*) FILTER (checked AND hit) pages_hit, count(*) FILTER (e = p) correct, coalesce(CAST(count(*) FILTER (e = p) AS DOUBLE) / nullif(count(*), 0), 0) accuracy, CAST(count(*) FILTER (checked AND hit) AS DOUBLE) / nullif(count(*) FILTER (checked), 0) page_accuracy FROM o
""")(lambda p, c: evaluate.evaluate(c, p)[1])
on_papers("evaluation_table", f"""
WITH RECURSIVE {P.VERDICTS}, y AS (SELECT *, status <> 'not_supported' p FROM qu JOIN vd USING (question_id))
SELECT question_id, rpad(substr(question, 1, 48), 48, ' ') || ' | ' || rpad(CASE WHEN expected_answerable THEN 'yes' ELSE 'no' END, 8, ' ') || ' | ' || rpad(status, 19, ' ') || ' | ' || rpad(CASE WHEN p = expected_answerable THEN 'yes' ELSE 'no' END, 3, ' ')
  || ' | ' || array_to_string(supporting_pages, ',') line FROM y
""")(lambda p, c: evaluate.table(evaluate.evaluate(c, p)[0]))

ON_PAPERS = {
    "document_hints": lambda p, c: segment.hints(p),
    "rendered_hints": lambda p, c: summary.render_hints(segment.hints(p)),
    "selected_evidence": lambda p, c: answer.ask(c, p)["selected"].withColumn("score", F.round("score", 6)),
    "answers": lambda p, c: answer.ask(c, p)["answers"],
    "sources_by_page": lambda p, c: answer.sources_by_page(answer.ask(c, p)["answers"]),
    "ask_trace": lambda p, c: answer.trace(c, p),
    "summary": lambda p, c: summary.summaries(p),
    "summarised": lambda p, c: summarise.summarise(p)["summaries"],
    "summary_notes": lambda p, c: summarise.summarise(p)["notes"],
    "summary_cards": lambda p, c: render.cards(summary.summaries(p)),
    "ranked_lines": lambda p, c: render.ranked_lines(rank.with_diagnostics(_ranked(p, c, 5).join(c.select("question_id", "question"), "question_id"), 5)),
    "verdict_reports": lambda p, c: render.reports(answer.ask(c, p)["verdicts"]),
    "rendered_summary": lambda p, c: summary.render(summary.summaries(p)),
    "condensers": lambda p, c: packages.packages(segment.sections(p)).select("doc_id", "field", *[f(F.col("text")).alias(n) for n, f in condense.TEXTS.items()], condense.findings(F.col("text")).alias("findings"), condense.limits(F.col("text")).alias("limits")),
}
for _name, _make in ON_PAPERS.items():
    on_papers(_name)(_make)
