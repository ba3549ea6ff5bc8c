"""Deterministic condensers: a field of a summary from its evidence, all of it copied from the text. Column builders throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafloom.functions import lexicon as L
from leafloom.functions import text as T

NO_QUESTION = L.NO_QUESTION


def _joined(parts: Column, n: int, most: int = 600) -> Column:
    return T.cut(F.array_join(F.slice(parts, 1, n), " "), most)


def extract(text: Column, n: int = 2) -> Column:
    return _joined(T.sentences(text), n)


def research_question(text: Column) -> Column:
    s = T.sentences(text)
    ways = [(F.filter(s, lambda x: F.endswith(x, F.lit("?"))), 2), (F.filter(s, lambda x: T.found(x, L.QUESTION_CUE)), 2), (F.filter(s, lambda x: T.found(x, L.AIM)), 1)]
    return F.coalesce(*[F.when(F.size(found) > 0, _joined(found, n)) for found, n in ways], F.lit(NO_QUESTION))


def _phrases(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(T.unicode(pattern)), F.lit(0)), T.collapse)


def participants(text: Column) -> Column:
    s = T.sentences(text)
    hired = F.coalesce(F.get(F.filter(s, lambda x: T.found(x, L.RECRUITMENT)), F.lit(0)), F.lit(""))
    inside = lambda p: F.contains(F.lower(hired), F.lower(p))
    counts = F.filter(_phrases(text, L.COUNT), lambda p: ~inside(p))
    fresh = F.filter(counts, lambda p, i: ~F.exists(F.slice(counts, F.lit(1), i), lambda q: F.lower(q) == F.lower(p)))
    ages = _phrases(text, L.AGE)
    age = F.when(~F.exists(ages, inside), F.get(ages, F.lit(0)))
    parts = F.array_compact(F.array(F.when(F.size(fresh) > 0, F.array_join(F.slice(fresh, 1, 3), "; ")), age, F.when(hired != "", hired)))
    told = F.concat(F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"\.+$", "")), ". "), F.lit("."))
    return F.when(F.size(s) == 0, "").when(F.size(parts) == 0, extract(text)).otherwise(T.cut(told, 600))


def methods(text: Column) -> Column:
    s = T.sentences(text)
    plain = F.filter(s, lambda x: ~T.found(x, L.PROTOCOL))
    pool = F.when(F.size(plain) > 0, plain).otherwise(s)
    collected = F.get(F.filter(pool, lambda x: T.found(x, L.COLLECTION)), F.lit(0))
    analysed = F.get(F.filter(pool, lambda x: T.found(x, L.ANALYSIS) & ~x.eqNullSafe(collected)), F.lit(0))
    parts = F.array_compact(F.array(collected, analysed))
    return F.when(F.size(s) == 0, "").when(F.size(parts) == 0, _joined(pool, 2)).otherwise(_joined(parts, 2))


def findings(text: Column, n: int = 6) -> Column:
    return F.slice(F.array_distinct(F.transform(F.filter(T.sentences(text), T.is_finding), lambda x: T.cut(x, 300))), 1, n)


def limits(text: Column, n: int = 5) -> Column:
    return F.slice(F.array_distinct(F.transform(T.sentences(text), lambda x: T.cut(x, 300))), 1, n)


#: By field. Limitations aren't condensed unless asked for.
TEXTS: dict[str, Callable[[Column], Column]] = {"research_question": research_question, "participants_or_data": participants, "methods": methods, "background": lambda t: extract(t, 3)}
LISTS: dict[str, Callable[[Column], Column]] = {"key_findings": findings}
