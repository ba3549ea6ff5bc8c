"""Column builders for lines, sentences, headings, rules on sentences, terms, identifiers and vectors.

All take and give columns; arrays stand where a text has several parts. Patterns run with Java's Unicode classes. Nulls give null or
false, as in SQL, but for the term builders, where they count as empty texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafloom.functions import lexicon as L

#: White space as str.split() has it, and line breaks as str.splitlines() has them.
SPACE = r"(?U)[\s\x1c-\x1f]+"
BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: What content terms are split at.
MARKS = "?!.,;:()[]{}'\"/\\-–—"
SUFFIXES = ("ies", "ions", "ion", "ing", "ed", "es", "s")


def unicode(pattern: str) -> str:
    """The pattern with Unicode classes and case."""
    return pattern.replace("(?i)", "(?iuU)", 1) if pattern.startswith("(?i)") else "(?U)" + pattern


def found(text: Column, pattern: str) -> Column:
    return text.rlike(unicode(pattern))


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether the whole text matches."""
    return text.rlike(f"(?{'iu' if ignore_case else ''}U)^(?:{pattern})$")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, BREAK, -1), collapse), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(collapse(text), L.SENTENCE_BREAK, -1), lambda x: x != "")


def normal_heading(line: Column) -> Column:
    text = F.regexp_replace(line, r"(?U)" + L.NUMBERING, "")
    text = F.regexp_replace(collapse(text), r"^[–—-]+|[–—-]+$", "")
    return collapse(F.regexp_replace(F.trim(text), r"[:.]+$", ""))


def heading_name(text: Column, longest: int = 70, headings: tuple = L.HEADINGS) -> Column:
    """The section that a text is the heading of, or null."""
    t = normal_heading(text)
    choice = reduce(lambda w, h: F.when(matches(t, h[1]), h[0]) if w is None else w.when(matches(t, h[1]), h[0]), headings, None)
    return F.when((F.length(t) <= longest) & t.rlike(r"^\p{L}"), choice)


def heading(line: Column, longest: int = 70) -> Column:
    """name and rest of a line that is a heading or begins with one (up to the first colon, or else the first full stop)."""
    t = collapse(line)
    whole = F.when(F.length(t) <= longest, heading_name(t))
    choice = F.when(whole.isNotNull(), F.struct(whole.alias("name"), F.lit("").alias("rest")))
    for mark in (":", "."):
        head = F.substring_index(t, mark, 1)
        rest = F.trim(F.substring(t, F.length(head) + 2, F.length(t)))
        name = heading_name(head)
        choice = choice.when(F.contains(t, F.lit(mark)) & (F.length(head) <= longest) & name.isNotNull() & (rest != ""), F.struct(name.alias("name"), rest.alias("rest")))
    return choice


def is_page_number(line: Column) -> Column:
    return found(line, L.PAGE_NUMBER)


def is_note(line: Column) -> Column:
    """A numbered note in prose, not an entry of a bibliography."""
    body = F.trim(F.regexp_replace(line, "(?U)" + L.NOTE_MARKER, ""))
    return found(line, L.NOTE_MARKER) & (F.size(F.split(collapse(body), " ")) >= 6) & ~found(body, L.CITATION) & found(body, L.NOTE_PROSE)


def is_limitation(sentence: Column, inside: Column | bool) -> Column:
    """inside: whether the sentence stands in a section on limitations."""
    inside = F.lit(inside) if isinstance(inside, bool) else inside
    s = F.trim(sentence)
    cue = found(s, L.LIMITATION)
    return (F.length(s) >= 20) & (cue | (inside & ~found(s, L.RESULT)))


def is_prescriptive(sentence: Column) -> Column:
    return found(sentence, L.PRESCRIPTIVE)


def is_finding(sentence: Column) -> Column:
    s = F.trim(sentence)
    return (F.length(s) >= 40) & ~is_prescriptive(s) & found(s, L.EMPIRICAL)


def is_furniture(line: Column) -> Column:
    """A line of a page that is no part of the paper's own front matter."""
    return reduce(Column.__or__, [found(line, p) for p in (L.PAGE_NUMBER, L.PAGE_RANGE, L.EMAIL, L.URL, L.BIBLIOGRAPHIC, L.ARTICLE_LABEL, L.KEYWORDS, L.AFFILIATION, L.COMPANY)])


def is_affiliation(line: Column) -> Column:
    return found(line, L.AFFILIATION) | found(line, L.AFFILIATION_STEM) | found(line, L.GLUED_MARKER)


def is_missing(value: Column) -> Column:
    """Null, or one of the ways to say that nothing is there."""
    return value.isNull() | F.regexp_replace(F.lower(collapse(value)), r"\.+$", "").isin(*L.EMPTY_MARKERS)


def is_meta(text: Column) -> Column:
    """Speaks of the summary rather than of the study."""
    return found(text, L.META_SUBJECT) & found(text, L.META_PROCESS)


def states_aim(text: Column) -> Column:
    return F.exists(sentences(text), lambda s: ~found(s, L.PRIOR_WORK) & reduce(Column.__or__, [found(s, a) for a in L.AIMS]))


def asks_attribute(question: Column) -> Column:
    return reduce(Column.__or__, [found(question, p) for p in L.ASKS_ATTRIBUTE])


def is_question(text: Column) -> Column:
    return F.endswith(F.trim(text), F.lit("?"))


def question_types(question: Column, types: tuple = L.QUESTION_TYPES) -> Column:
    """Names of the kinds of question whose cue the question has, in their order."""
    return F.array_compact(F.array(*[F.when(found(question, cue), F.lit(name)) for name, _, _, cue, _ in types]))


def stem(word: Column) -> Column:
    choice = None
    for s in SUFFIXES:
        fits = F.endswith(word, F.lit(s)) & (F.length(word) > len(s) + 2)
        cut = F.substring(word, F.lit(1), F.length(word) - len(s))
        cut = F.concat(cut, F.lit("y")) if s == "ies" else cut
        choice = F.when(fits, cut) if choice is None else choice.when(fits, cut)
    return choice.otherwise(word)


def _terms(text: Column, shortest: int, stopwords: list[str]) -> Column:
    tokens = F.split(collapse(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKS, " " * len(MARKS))), " ")
    return F.transform(F.filter(tokens, lambda t: (F.length(t) >= shortest) & ~t.isin(*stopwords)), stem)


def content_terms(text: Column, stopwords: list[str] = L.STOPWORDS) -> Column:
    return F.array_sort(F.array_distinct(_terms(text, 3, stopwords)))


def focus_terms(question: Column, stopwords: list[str] = L.STOPWORDS, generic: list[str] = L.GENERIC) -> Column:
    return F.array_sort(F.array_except(_terms(question, 2, stopwords), F.array(*[F.lit(g) for g in generic])))


def selection_terms(question: Column) -> Column:
    return F.array_sort(F.array_except(content_terms(question), F.array(*[F.lit(w) for w in ("many", "much", "often", "long")])))


def content_words(text: Column) -> Column:
    """Distinct words of a-z and digits, of more than three characters."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)")), lambda w: F.length(w) > 3)))


def finding_words(text: Column) -> Column:
    """As content_words(), with acronyms of two or more capitals."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 3) | w.rlike("^[A-Z]{2,}$")), F.lower)))


def overlap_tokens(text: Column) -> Column:
    words = F.filter(F.split(collapse(F.coalesce(text, F.lit(""))), " "), lambda w: F.length(w) > 3)
    return F.array_distinct(F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"""^[.,;:()\[\]"']+|[.,;:()\[\]"']+$""", ""))))


def coverage(wanted: Column, have: Column) -> Column:
    """The share of wanted that have has; 0 where nothing is wanted."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, have)), F.size(wanted)), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """What a and b share, as a share of the smaller."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def term_present(term: Column, terms: Column) -> Column:
    """A term, or one of three characters or more that differs by at most two at the end."""
    close = lambda x: (F.startswith(x, term) | F.startswith(term, x)) & (F.abs(F.length(x) - F.length(term)) <= 2)
    return F.array_contains(terms, term) | ((F.length(term) >= 3) & F.exists(terms, close))


def cut(text: Column, most: int) -> Column:
    """A collapsed text, cut at the last blank before `most` characters, with dots."""
    t = collapse(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), " [^ ]*$", ""), F.lit("...")))


def passage_id(document: Column, page: Column, section: Column, start: Column, end: Column, text: Column) -> Column:
    parts = F.concat_ws("|", document, page.cast("string"), section, start.cast("string"), end.cast("string"), text)
    return F.format_string("p%04d-%s", page, F.substring(F.sha2(parts, 256), 1, 12))


def document_key(name: Column, pages: Column) -> Column:
    """pages: an array of (page_number, text)."""
    zero = F.lit("\0")
    return F.sha2(F.concat(name, F.array_join(F.transform(F.array_sort(pages), lambda p: F.concat(zero, p["page_number"].cast("string"), zero, p["text"])), "")), 256)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles of one length, within -1 and 1; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different dimensions")))


def is_vector(v: Column) -> Column:
    """Not empty, all finite, not all zero."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def bucket(token: Column, width: int = 512) -> Column:
    """The place of a token in a hashed vector: its digest's first four bytes, modulo the width."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % width).cast("int")


def bag_tokens(text: Column) -> Column:
    """Lower-case words without marks, and without a final s where they have more than three characters."""
    words = F.filter(F.split(collapse(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKS, " " * len(MARKS))), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.when((F.length(w) > 3) & F.endswith(w, F.lit("s")), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def page_phrase(pages: Column) -> Column:
    """pages: sorted and distinct."""
    first, last = F.element_at(pages, 1), F.element_at(pages, -1)
    return F.when(F.size(pages) == 0, "no pages").when(F.size(pages) == 1, F.concat(F.lit("page "), first.cast("string"))).when(last - first + 1 == F.size(pages), F.concat(F.lit("pages "), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(F.concat(F.lit("pages "), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")))


def exclusion(section: Column, text: Column, page: Column, labelled: Column, shortest: int = 8) -> Column:
    """Why a passage can't be evidence, or null. labelled: whether its document has any section."""
    s = F.lower(F.trim(section))
    short = F.size(F.filter(F.split(collapse(text), " "), lambda w: w != "")) < shortest
    return F.when(s.isin("references", "acknowledgements", "keywords"), s).when(short, "too-short").when((s == "") & (page == 1) & labelled, "front-matter")
