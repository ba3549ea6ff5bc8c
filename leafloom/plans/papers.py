"""Papers made of all `documents`, and questions of all users' turns: what the queries on sections, passages, verdicts and summaries read.

A document is a page, and the pages of one source whose ids lie in one run of SPAN are a paper. As the driver's texts are invented words, a page also gets
a line on the study, and every other page begins with a heading, in the order of a paper's parts; so pages without a heading carry on the section before.
A user's turn asks one paper, numbered in order of their ids, and begins with a question of one of the kinds that verdicts know.

The SQL says the same on its own, out of the tables; only patterns and word lists are shared with the library, as they are data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.functions import lexicon as L

#: Ids of a paper's pages lie in one run of so many.
SPAN = 400
HEADINGS = ("Abstract", "1. Introduction", "Research question", "2. Methods", "Participants", "3. Results", "Discussion of findings", "Limitations", "Conclusions", "References")
LINES = (
    "We found that walkers slept 41 minutes longer than the others.", "Clubs should offer evening walks to all of their members.", "The small sample means that the results cannot be assumed to hold elsewhere.", "Too short.",
    "Participants reported fewer wakings at night than before the trial.", "Further research is needed on light and on company.", "A total of 48 adults aged 61 years were recruited from two clubs in Norway.", "Results showed a mean of 7.2 hours, p < 0.05, in both groups.",
    "A weakness of the design is the single interview with each person.", "Three themes emerged: light, company and routine in the evening.", "The aim of this study was to examine evening walks and sleep.", "Sleep was measured with the Rest Scale and with diaries.",
    "Recall bias may have coloured what people told us about their sleep.", "Interviews were analysed with thematic analysis.", "Response rates declined by 12 percent in the second year of study.",
)
QUESTIONS = (
    "How many adults were recruited?", "What are the limitations of the study?", "Which scale was used to measure sleep?", "Where was the study done?", "How were the interviews analysed?", "What is the aim of the study?", "Which placebo was given to the walkers?",
    "What did the authors find about walkers and sleep?", "What was the mean age of the adults?", "Who?", "What percentage declined in the second year?", "What was the income of the participants?",
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number and text: a page for each document, null texts too (they are empty)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("id", F.coalesce("doc_id", F.lit(0)))
    part = F.floor(F.col("id") % SPAN / (SPAN // len(HEADINGS))).cast("int")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    head = F.when(F.col("id") % 40 < 20, F.concat(pick(HEADINGS, part), F.lit("\n"))).otherwise("")
    return d.select(
        F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.floor(F.col("id") / SPAN).cast("string")).alias("doc_id"), (F.col("id") + 1).cast("int").alias("page_number"),
        F.concat(head, pick(LINES, F.col("id") % len(LINES)), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, doc_id, question, expected_answerable and expected_pages: a question for each user's turn."""
    papers = pages(spark, sf_dir).select("doc_id").distinct()
    papers = papers.withColumn("n", F.row_number().over(Window.orderBy("doc_id")) - 1).withColumn("of", F.count("*").over(Window.partitionBy(F.lit(1))))  # a row a paper
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    total = papers.agg(F.max("of")).first()[0] or 1
    c = c.withColumn("k", F.coalesce(F.col("conv_id") * 7 + F.col("turn"), F.lit(0)))
    asked = F.get(F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("k") % len(QUESTIONS)).cast("int"))
    c = c.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), (F.col("k") % total).cast("int").alias("n"), F.concat_ws(" ", asked, F.substring(F.coalesce("text", F.lit("")), 1, 60)).alias("question"), (F.col("k") % 12 < 6).alias("expected_answerable"), F.when(F.col("k") % 3 == 0, F.array((F.col("k") % 40 + 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("expected_pages"))
    return c.join(papers, "n").drop("n", "of")


# --- the same in SQL ---------------------------------------------------------------------------------------------------


def literal(pattern: str) -> str:
    """A pattern for an engine that names groups otherwise."""
    return "'" + re.sub(r"\(\?<\w+>", "(", pattern).replace("\\u2019", "’").replace("'", "''") + "'"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {literal(pattern)})"


def _array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def heading_name(x: str) -> str:
    """The name of the section that a text is the heading of, or null."""
    bare = collapsed(rf"regexp_replace(trim(regexp_replace({collapsed(f'regexp_replace({x}, {literal(L.NUMBERING)}, {chr(39) * 2})')}, '^[–—-]+|[–—-]+$', '', 'g')), '[:.]+$', '')")
    names = " ".join(f"WHEN regexp_full_match(h, {literal('(?i)(?:' + p + ')')}) THEN '{n}'" for n, p in L.HEADINGS)
    return f"(SELECT CASE WHEN length(h) <= 70 AND regexp_matches(h, '^[A-Za-z]') THEN CASE {names} END END FROM (SELECT {bare} h))"


def _opened(x: str) -> str:
    """name and rest of a line that is a heading or begins with one, as a struct, or null."""
    one = lambda mark: f"CASE WHEN contains({x}, '{mark}') AND strpos({x}, '{mark}') <= 71 AND trim(substr({x}, strpos({x}, '{mark}') + 1)) <> '' THEN {heading_name(f'''split_part({x}, '{mark}', 1)''')} END"
    rest = lambda mark: f"trim(substr({x}, strpos({x}, '{mark}') + 1))"
    return f"CASE WHEN length({x}) <= 70 AND {heading_name(x)} IS NOT NULL THEN {{'name': {heading_name(x)}, 'rest': ''}} WHEN {one(':')} IS NOT NULL THEN {{'name': {one(':')}, 'rest': {rest(':')}}} WHEN {one('.')} IS NOT NULL THEN {{'name': {one('.')}, 'rest': {rest('.')}}} END"


_BODY = f"regexp_replace(line, {literal(L.NOTE_MARKER.replace('(?=', '(').replace('(' + chr(92) + 'S)', ''))}, '')"
_NOTE = f"regexp_matches(line, {literal(L.NOTE_MARKER.replace('(?=', '('))}) AND len(string_split(trim({_BODY}), ' ')) >= 6 AND NOT {has(_BODY, L.CITATION)} AND {has(_BODY, L.NOTE_PROSE)}"

#: pg: pages; ln: lines in order with their places, without running heads and page numbers; st: what each line opens, and the section that it stands in.
PAGES = rf"""pg AS (SELECT coalesce(source, '') || '-' || CAST(coalesce(doc_id, 0) // {SPAN} AS VARCHAR) doc_id, CAST(coalesce(doc_id, 0) + 1 AS INTEGER) page_number,
  CASE WHEN coalesce(doc_id, 0) % 40 < 20 THEN ({_array(HEADINGS)})[(coalesce(doc_id, 0) % {SPAN}) // {SPAN // len(HEADINGS)} + 1] || chr(10) ELSE '' END || ({_array(LINES)})[coalesce(doc_id, 0) % {len(LINES)} + 1] || chr(10) || coalesce(text, '') t FROM documents)"""
LINED = rf"""{PAGES},
raw AS (SELECT doc_id, page_number, unnest(string_split(t, chr(10))) raw, generate_subscripts(string_split(t, chr(10)), 1) no FROM pg),
pos AS (SELECT *, {collapsed("raw")} line, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id, page_number ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM raw),
cnt AS (SELECT doc_id, lower(line) key, count(DISTINCT page_number) n FROM pos WHERE length(line) BETWEEN 4 AND 100 GROUP BY 1, 2),
tot AS (SELECT doc_id, count(*) total FROM pg GROUP BY 1),
heads AS (SELECT doc_id, key FROM cnt JOIN tot USING (doc_id) WHERE n >= greatest(2, ceil(0.4::DOUBLE * total)) AND {heading_name("key")} IS NULL),
ln AS (SELECT doc_id, page_number, no, line, CAST(before + length(raw) - length(ltrim(raw)) AS BIGINT) a, CAST(before + length(rtrim(raw)) AS BIGINT) z, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, no) n
  FROM pos ANTI JOIN heads ON heads.doc_id = pos.doc_id AND heads.key = lower(pos.line) WHERE line <> '' AND NOT regexp_matches(line, {literal(L.PAGE_NUMBER)})),
hd AS (SELECT *, {_opened("line")} o, {_NOTE} note FROM ln),
isl AS (SELECT *, count(o) OVER w island, last_value(o.name IGNORE NULLS) OVER w held FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
nt AS (SELECT *, min(CASE WHEN note AND o IS NULL AND held = 'references' THEN n END) OVER (PARTITION BY doc_id, island) first_note FROM isl),
st AS (SELECT *, coalesce(o IS NOT NULL OR n = first_note, false) opens, CASE WHEN n >= first_note THEN 'notes' ELSE held END section, CASE WHEN o IS NOT NULL THEN o.rest ELSE line END body FROM nt)"""
SECTIONS = rf"""{LINED},
sn AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY n) - 1 section_no FROM st),
sec AS (SELECT doc_id, CAST(section_no AS INTEGER) section_no, any_value(section) name, arg_min(line, n) heading, trim(coalesce(string_agg(body, chr(10) ORDER BY n) FILTER (body <> ''), ''), ' ' || chr(10)) text,
  list_sort(list_distinct(list(page_number))) pages FROM sn WHERE section_no >= 0 GROUP BY doc_id, section_no)"""
#: un: lines of units, which are parts of one page and one section; pas: passages.
PASSAGES = rf"""{LINED},
br AS (SELECT doc_id, page_number, coalesce(section, '') section, body, CASE WHEN o IS NOT NULL AND body <> '' THEN a + greatest(strpos(line, body) - 1, 0) ELSE a END a, z, n, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY n) unit FROM st),
un AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, unit ORDER BY n) - 1 j, len(string_split(body, ' ')) w FROM br WHERE body <> ''),
u AS (SELECT doc_id, page_number, unit, any_value(section) section, list(body ORDER BY j) body, list(a ORDER BY j) a, list(z ORDER BY j) z, count(*) n, CAST(sum(w) AS BIGINT) total, list_concat([0], list(acc ORDER BY j)) p
  FROM (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id, page_number, unit ORDER BY j) AS BIGINT) acc FROM un) GROUP BY 1, 2, 3),
am AS (SELECT *, CASE WHEN total <= 400 THEN total ELSE list_sort(list_transform(list_filter(list_concat([{{'c': 1, 's': total}}], list_transform(range(2, total // 60 + 2), lambda c: {{'c': c, 's': CAST(ceil((total + (c - 1) * 60)::DOUBLE / c) AS BIGINT)}})),
  lambda x: x.c = 1 OR x.s >= 120), lambda x: {{'d': abs(x.s - 350), 'c': x.c, 's': x.s}}))[1].s END aim FROM u),
en AS (SELECT *, greatest(aim, 400) room, unnest(range(0, n)) b FROM am),
e1 AS (SELECT *, coalesce(list_min(list_filter(range(b + 1, n + 1), lambda e: p[e + 1] - p[b + 1] >= aim)), n) full_,
  greatest(coalesce(list_min(list_filter(range(b + 1, n + 1), lambda e: p[e + 1] - p[b + 1] >= 300)), n + 1), list_max(list_filter(range(b, n + 1), lambda e: p[e + 1] - p[b + 1] <= room))) crowded FROM en),
e2 AS (SELECT *, least(n, greatest(b + 1, least(full_, crowded))) e FROM e1),
e3 AS (SELECT *, coalesce(list_max(list_filter(range(0, e + 1), lambda k: p[e + 1] - p[k + 1] >= 60)), 0) back FROM e2),
e4 AS (SELECT doc_id, page_number, unit, n, p, room, b, e, CASE WHEN e >= n THEN NULL WHEN back > b AND back < e THEN back WHEN e - b <= 1 THEN e ELSE b + 1 END next FROM e3),
walk AS (SELECT * FROM e4 WHERE b = 0 UNION ALL SELECT e4.* FROM walk JOIN e4 ON e4.doc_id = walk.doc_id AND e4.page_number = walk.page_number AND e4.unit = walk.unit AND e4.b = walk.next),
wk AS (SELECT *, row_number() OVER w k, count(*) OVER (PARTITION BY doc_id, page_number, unit) ks, lag(b) OVER w pb, lead(b) OVER w nb FROM walk WINDOW w AS (PARTITION BY doc_id, page_number, unit ORDER BY b)),
mg AS (SELECT doc_id, page_number, unit, b, CASE WHEN k = ks - 1 AND p[n + 1] - p[nb + 1] < 120 AND p[n + 1] - p[b + 1] <= room THEN n ELSE e END e, k = ks AND ks > 1 AND p[n + 1] - p[b + 1] < 120 AND p[n + 1] - p[pb + 1] <= room gone FROM wk),
ps AS (SELECT doc_id, page_number, section, array_to_string(list_slice(body, b + 1, e), ' ') text, a[b + 1] start_char, z[e] end_char FROM mg JOIN u USING (doc_id, page_number, unit) WHERE NOT coalesce(gone, false)),
pas AS (SELECT doc_id, page_number, section, text, CAST(start_char AS INTEGER) start_char, CAST(end_char AS INTEGER) end_char,
  printf('p%04d-%s', page_number, substr(sha256(concat_ws('|', doc_id, CAST(page_number AS VARCHAR), section, CAST(start_char AS VARCHAR), CAST(end_char AS VARCHAR), text)), 1, 12)) chunk_id FROM ps WHERE trim(text) <> '')"""
EXCLUDED = r"""ex AS (SELECT *, CASE WHEN lower(trim(section)) IN ('references', 'acknowledgements', 'keywords') THEN lower(trim(section)) WHEN len(list_filter(string_split(trim(text), ' '), lambda w: w <> '')) < 8 THEN 'too-short'
  WHEN trim(section) = '' AND page_number = 1 AND max(CAST(trim(section) <> '' AS INTEGER)) OVER (PARTITION BY doc_id) = 1 THEN 'front-matter' END excluded FROM pas)"""
CASES = rf"""pp AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 n, count(*) OVER () total FROM (SELECT DISTINCT doc_id FROM pg)),
qs AS (SELECT concat_ws('-', conv_id, turn) question_id, coalesce(conv_id * 7 + turn, 0) k, coalesce(text, '') text FROM conversations WHERE role = 'user'),
qu AS (SELECT question_id, doc_id, ({_array(QUESTIONS)})[k % {len(QUESTIONS)} + 1] || ' ' || substr(text, 1, 60) question, k % 12 < 6 expected_answerable, CASE WHEN k % 3 = 0 THEN [CAST(k % 40 + 1 AS INTEGER)] ELSE []::INTEGER[] END expected_pages FROM qs JOIN pp ON pp.n = k % pp.total)"""


# --- sentences, terms and ranking --------------------------------------------------------------------------------------

SENTENCES = r"list_filter(string_split(regexp_replace(" + collapsed("{}") + r", '([.!?])\s+([A-Z(\x22\x27])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')"
_MARKS = "?!.,;:()[]{}''\"/\\-–—"
_BLANKS = " " * (len(_MARKS) - 1)


def tokens(x: str) -> str:
    """Lower-case words, split at marks."""
    return f"string_split({collapsed(f"translate(lower(coalesce({x}, '')), '{_MARKS}', '{_BLANKS}')")}, ' ')"


_STEMS = (("ies", "y"), ("ions", ""), ("ion", ""), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""))


def stem(x: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) > {len(s) + 2} THEN substr({x}, 1, length({x}) - {len(s)}) || '{put}'" for s, put in _STEMS) + f" ELSE {x} END"


_STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in L.STOPWORDS) + ")"


def terms(x: str, shortest: int = 3) -> str:
    """Content terms of a text, sorted and distinct."""
    return f"list_sort(list_distinct(list_transform(list_filter({tokens(x)}, lambda w: length(w) >= {shortest} AND w NOT IN {_STOP}), lambda w: {stem('w')})))"


def _vector(source: str, key: str, text: str) -> str:
    """Hashed bags of words: key, bucket and weight."""
    return rf"""SELECT {key}, CAST(CAST('0x' || substr(sha256(w), 1, 8) AS UBIGINT) % 512 AS INTEGER) bucket, CAST(count(*) AS DOUBLE) w FROM (SELECT {key}, CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END w
  FROM (SELECT {key}, unnest({tokens(text)}) w FROM {source}) WHERE w <> '') GROUP BY ALL UNION ALL SELECT {key}, 0, 0.001 FROM {source} WHERE len(list_filter({tokens(text)}, lambda w: w <> '')) = 0"""


#: rk: all eligible passages of each question's paper, ranked.
RANKED = rf"""{PASSAGES}, {EXCLUDED}, {CASES},
el AS (SELECT *, row_number() OVER () cid FROM ex WHERE excluded IS NULL),
cv AS ({_vector("el", "cid", "text")}), cn AS (SELECT cid, sqrt(sum(w * w)) l FROM cv GROUP BY 1),
qv AS ({_vector("qu", "question_id", "question")}), qn AS (SELECT question_id, sqrt(sum(w * w)) l FROM qv GROUP BY 1),
pr AS (SELECT question_id, question, el.* FROM qu JOIN el USING (doc_id)),
dt AS (SELECT pr.question_id, pr.cid, sum(qv.w * cv.w) dot FROM pr JOIN qv ON qv.question_id = pr.question_id JOIN cv ON cv.cid = pr.cid AND cv.bucket = qv.bucket GROUP BY 1, 2),
sc AS (SELECT pr.*, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, coalesce(dot, 0) / (cn.l * qn.l))) score FROM pr JOIN cn USING (cid) JOIN qn USING (question_id) LEFT JOIN dt USING (question_id, cid)),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, page_number, start_char, chunk_id) rank FROM sc)"""


# --- verdicts ----------------------------------------------------------------------------------------------------------


def _shown(text: str, evidence: str | None) -> str:
    """Whether a text has what answers a kind of question; without a pattern: whether a sentence states an aim of the study."""
    if evidence is not None:
        return has(text, evidence)
    return f"len(list_filter({SENTENCES.format(text)}, lambda s: NOT {has('s', L.PRIOR_WORK)} AND ({' OR '.join(has('s', a) for a in L.AIMS)}))) > 0"


def _noun(cue: str) -> str:
    return f"lower(trim(regexp_extract(question, {literal(cue)}, 1)))" if "(?<noun>" in cue else "''"


def _kinds(text: str, precise: bool) -> str:
    """A list of the names of the question's kinds that a text shows."""
    one = lambda name, cue, evidence: f"CASE WHEN {has('question', cue)} AND ({_noun(cue)} = '' OR list_contains({terms(text)}, {stem(_noun(cue))})) AND {_shown(text, evidence)} THEN '{name}' END"
    return f"list_filter([{', '.join(one(name, cue, evidence) for name, _, p, cue, evidence in L.QUESTION_TYPES if p or not precise)}], lambda x: x IS NOT NULL)"


_ASKED = "list_filter([" + ", ".join(f"CASE WHEN {has('question', cue)} THEN '{name}' END" for name, _, _, cue, _ in L.QUESTION_TYPES) + "], lambda x: x IS NOT NULL)"
_LABEL = "CASE x " + " ".join(f"WHEN '{name}' THEN '{label}'" for name, label, *_ in L.QUESTION_TYPES) + " END"
_CLOSE = "t = w OR (length(t) >= 3 AND (starts_with(w, t) OR starts_with(t, w)) AND abs(length(w) - length(t)) <= 2)"
_ATTRIBUTE = " OR ".join(f"(t = '{a}' AND {has('together', p)})" for a, p in L.ATTRIBUTES.items())
_GENERIC = "(" + ", ".join(f"'{g}'" for g in L.GENERIC) + ")"
_REASON = {k: "'" + v.replace("'", "''").replace("{}", "' || {} || '") + "'" for k, v in L.REASONS.items()}
_COUNT = "CASE WHEN {0} = 1 THEN 'one passage' ELSE {0} || ' passages' END"
_PHRASE = "CASE WHEN len({0}) = 1 THEN 'page ' || {0}[1] WHEN {0}[-1] - {0}[1] + 1 = len({0}) THEN 'pages ' || {0}[1] || '-' || {0}[-1] ELSE 'pages ' || array_to_string({0}, ', ') END"

#: rr: the first five of twenty passages, those that show what a precise kind of question asks for first.
RERANKED = f"""{RANKED},
tw AS (SELECT *, text || ' ' || replace(section, '_', ' ') body FROM rk WHERE rank <= 20),
cu AS (SELECT *, len({_kinds("body", True)}) > 0 cue FROM tw),
rr AS (SELECT * FROM (SELECT * EXCLUDE rank, rank cosine_rank, row_number() OVER (PARTITION BY question_id ORDER BY cue DESC, rank) rank FROM cu) WHERE rank <= 5)"""
#: vd: verdicts.
VERDICTS = rf"""{RERANKED},
fg AS (SELECT question_id, max(score) FILTER (rank = 1) top, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) gap FROM rk GROUP BY 1),
rw AS (SELECT *, {terms("question")} wanted, list_intersect({terms("question")}, {terms("body")}) shared, len({_kinds("body", False)}) > 0 shows FROM rr),
tg AS (SELECT question_id, any_value(question) question, any_value(wanted) wanted, string_agg(body, chr(10) ORDER BY rank) together, count(*) n, list_sort(list_distinct(flatten(list(shared)))) matched,
  list_sort(list(DISTINCT page_number) FILTER (rank <= 2)) first_pages, list_sort(list(DISTINCT page_number) FILTER (good)) pages, coalesce(list_sort(list(DISTINCT section) FILTER (good AND section <> '')), []) parts, count(*) FILTER (good) backing
  FROM (SELECT *, coalesce(CAST(len(shared) AS DOUBLE) / nullif(len(wanted), 0), 0) >= 0.34 OR shows good FROM rw) GROUP BY 1),
ty AS (SELECT *, {_ASKED} types, {_kinds("together", False)} have, {terms("together")} known,
  CASE WHEN {" OR ".join(has("question", a) for a in L.ASKS_ATTRIBUTE)} THEN list_filter({terms("question", 2)}, lambda t: t NOT IN {_GENERIC}) ELSE [] END focus FROM tg),
la AS (SELECT *, list_transform(list_filter(types, lambda x: NOT list_contains(have, x)), lambda x: {_LABEL}) lacking, len(focus) > 0 AND len(list_filter(focus, lambda t: len(list_filter(known, lambda w: {_CLOSE})) > 0 OR {_ATTRIBUTE})) = 0 absent FROM ty JOIN fg USING (question_id)),
wh AS (SELECT *, {_COUNT.format("backing")} || ' on ' || {_PHRASE.format("pages")} at_, CASE WHEN len(parts) > 1 THEN {_REASON["across"].format("array_to_string(parts, ' and ')")} ELSE '' END across FROM la),
gt AS (SELECT *, CASE WHEN len(lacking) > 0 THEN 'kind' WHEN absent THEN 'attribute' WHEN len(wanted) < 2 THEN 'short' WHEN backing = 0 THEN 'weak' WHEN coalesce(top, 0) < 0.15 THEN 'noise' WHEN backing > 1 THEN 'several'
  WHEN gap IS NOT NULL AND top > 0 AND gap / top >= 0.15 THEN 'clear' ELSE 'close' END gate FROM wh),
vd AS (SELECT question_id, gate, CASE WHEN gate IN ('kind', 'attribute', 'weak') THEN 'not_supported' WHEN gate = 'several' THEN 'supported' ELSE 'partially_supported' END status,
  CASE gate WHEN 'kind' THEN {_REASON["kind"].format("array_to_string(lacking, ' or ')")} WHEN 'attribute' THEN {_REASON["attribute"].format("array_to_string(focus, ' or ')")} WHEN 'short' THEN {_REASON["short"].format(_COUNT.format("least(n, 2)"))}
    WHEN 'weak' THEN {_REASON["weak"]} WHEN 'noise' THEN {_REASON["noise"].format("at_")} WHEN 'several' THEN {_REASON["several"].format("at_", "across")} WHEN 'clear' THEN {_REASON["clear"].format(_PHRASE.format("pages"))} ELSE {_REASON["close"].format(_PHRASE.format("pages"))} END reason,
  CASE WHEN gate = 'short' THEN first_pages WHEN gate IN ('kind', 'attribute', 'weak') THEN [] ELSE pages END supporting_pages, types question_types, CASE gate WHEN 'kind' THEN lacking WHEN 'attribute' THEN focus ELSE [] END missing_evidence,
  CASE WHEN gate IN ('kind', 'attribute') THEN [] ELSE matched END matched_terms FROM gt)"""
