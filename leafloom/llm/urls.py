"""URL filters: glob rules run over canonical URLs as one bit-parallel Shift-And automaton.

A pattern's states are consecutive bits of one long bit vector that is held as 64-bit words; one step shifts all patterns'
states at once and masks them with the character's row, so each URL is read once whatever the number of rules. In patterns,
`*` is any run of bytes but `/`, `**` any run, `?` one byte but `/`; all else stands for itself.

A URL is canonical as host and path: the host (after the first `://`, up to `/`, `?`, `#` or the end) with A-Z lower-cased, then the
path up to `?`, `#` or the end. Null URLs, and those without `://`, have an empty host and path, match only patterns that match
the empty text, and are allowed unless such a pattern blocks them. Long URLs are read whole. Repeated rows are judged alike, empty tables stay empty.

A byte costs one step over all words of the vector, so rules are for lists of some thousands: their states are limited to STATES.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.text import U, blocks


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the URL's path starts with the rule's."""

    verdict: str
    host: str
    path: str

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: The method's own verdict, where no rule fits: blocked if one of these matches host and path.
HOSTS = ("*casino*", "*poker*", "*free-bets*", "*cheap-pills*", "*viagra*", "*xxx*")
BLOCKED = (*HOSTS, *(f"{h}/**" for h in HOSTS), "**/wp-login**", "**.exe")
#: The most states of all patterns: their masks take 64 bytes each in a task.
STATES = 1 << 18


class ShiftAnd:
    """All patterns as one automaton. match() tells for each text which patterns match the whole of it."""

    def __init__(self, patterns: list[str]):
        self.n = len(patterns)
        states, step, stay, last = 0, [], [], []
        slash = np.ones(256, bool)
        slash[ord("/")] = False
        begin = []
        for p in patterns:
            raw, i = p.encode(), 0
            begin.append(states)
            step.append(np.zeros(256, bool))
            stay.append(np.zeros(256, bool))
            states += 1
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    wide = raw[i : i + 2] == b"**"
                    stay[-1] = stay[-1] | (np.ones(256, bool) if wide else slash)
                    i += 1 + wide
                    continue
                step.append(slash.copy() if raw[i : i + 1] == b"?" else np.arange(256) == raw[i])
                stay.append(np.zeros(256, bool))
                states += 1
                i += 1
            last.append(states - 1)
        if states > STATES:
            raise ValueError(f"patterns have {states} states, {STATES} at most")
        self.words = max(1, -(-states // 64))
        self.step, self.stay = (self._rows(x, states) for x in (step, stay))
        self.start = self._bits(begin)
        self.last = np.array(last, np.int64)

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, U)
        for p in places:
            out[p // 64] |= U(1) << U(p % 64)
        return out

    def _rows(self, classes: list[np.ndarray], states: int) -> np.ndarray:
        bits = np.zeros((self.words * 64, 256), bool)
        bits[:states] = np.array(classes).reshape(states, 256)
        return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(U)

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A boolean row for each text, a column for each pattern."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        begin, length = offsets[:-1][order], length[order]
        d = np.tile(self.start, (len(order), 1))
        live = len(order)
        for t in range(int(length[0]) if len(order) else 0):
            live = int(np.searchsorted(-length[:live], -t, "left"))  # texts longer than t
            c = data[begin[:live] + t]
            now = d[:live]
            moved = now << U(1)
            moved[:, 1:] |= now[:, :-1] >> U(63)
            d[:live] = (moved & self.step[c]) | (now & self.stay[c])
        out = np.empty((len(order), self.n), bool)
        out[order] = (d[:, self.last // 64] >> (self.last % 64).astype(U)) & U(1) != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, letters, letters.lower()), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED, url: str = "url") -> DataFrame:
    """df with host, path, rule and verdict (those names of df's own are replaced). The fitting rule with most characters wins
    (ties: the first given), else the method's verdict stands and rule is null."""
    patterns = [g for r in rules for g in r.globs()] + list(blocked)
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].host + rules[i].path), i))
    names = pa.array([f"{r.host}{r.path}" for r in rules] + [None], pa.string())
    verdicts = pa.array([r.verdict for r in rules] + ["allow", "block"], pa.string())
    df = df.drop("host", "path", "rule", "verdict").withColumns(dict(zip(("host", "path"), host_and_path(F.col(url)), strict=True)))
    df = df.withColumn("_at", F.concat("host", "path"))
    schema = df.drop("_at").schema.add("rule", "string").add("verdict", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ShiftAnd(patterns)
        for batch in batches:
            place = batch.schema.get_field_index("_at")
            best = np.full(len(batch), len(rules))
            own = np.zeros(len(batch), bool)
            for b in blocks(batch.column(place), 1 << 20):
                got = machine.match(b.data, b.offsets)
                for i in reversed(order):
                    best[b.first : b.last][got[:, 2 * i] | got[:, 2 * i + 1]] = i
                own[b.first : b.last] = got[:, 2 * len(rules) :].any(axis=1)
            said = np.where(best < len(rules), best, len(rules) + own)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays([*columns, names.take(pa.array(best)), verdicts.take(pa.array(said))], [f.name for f in schema])

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: a verdict for each page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END r FROM pages),
b AS (SELECT page_id, r, regexp_extract(coalesce(r, ''), '^[^/?#]*') h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
      regexp_extract(substr(coalesce(r, ''), length(h) + 1), '^[^?#]*') path FROM b),
d AS (SELECT *, '.' || host dh FROM c),
e AS (SELECT *, CASE WHEN dh LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN dh LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN dh LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN dh LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN dh LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END rule FROM d)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, 'casino|poker|free-bets|cheap-pills|viagra|xxx') THEN 'block'
  WHEN contains(path, '/wp-login') OR ends_with(host || path, '.exe') THEN 'block' ELSE 'allow' END verdict FROM e
"""
