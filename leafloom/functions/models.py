"""Pluggable models with offline defaults, and the repair of what a generator returns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from typing import Any, Protocol

import numpy as np

from leafloom.functions import kernels as K
from leafloom.functions.lexicon import EMPTY_MARKERS


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> Sequence[Sequence[float]]:
        """A vector for each text."""


class Generator(Protocol):
    def generate(self, prompt: str) -> str:
        """JSON as text; may raise ModelError."""


class ModelError(RuntimeError):
    """status as of an HTTP gateway; kind is transport, model or malformed. Only malformed answers may be skipped."""

    def __init__(self, message: str, status: int = 502, kind: str = "model"):
        super().__init__(message)
        self.status, self.kind = status, kind


class HashingEmbedder:
    """Counts of words by digest; the same everywhere."""

    def __init__(self, width: int = 512):
        self.width = width

    def embed(self, texts: list[str]) -> Sequence[Sequence[float]]:
        words = [text.lower().translate(K._MARKS).split() for text in texts]
        place = {w: int.from_bytes(hashlib.sha256((w[:-1] if len(w) > 3 and w.endswith("s") else w).encode()).digest()[:4], "big") % self.width for w in set().union(*words)}
        at = np.array([i * self.width + place[w] for i, ws in enumerate(words) for w in ws], np.int64)
        v = np.bincount(at, minlength=len(texts) * self.width).astype(float).reshape(len(texts), self.width)
        v[~v.any(axis=1), 0] = 0.001
        return list(v)


class ExtractiveGenerator:
    """Answers with the evidence of a prompt, word for word, and cites all of it."""

    def generate(self, prompt: str) -> str:
        found = re.findall(r"Chunk ID: (\S+)\nText:\n(.*?)(?=\n\n|\Z)", prompt, re.S)
        return json.dumps({"answer": " ".join(t for _, t in found), "used_chunk_ids": [i for i, _ in found]})


class ExtractiveDrafter:
    """Drafts without a model: the first sentences of each part of a prompt, and nothing where parts are merged."""

    def generate(self, prompt: str) -> str:
        if fields := re.findall(r"^## (\w+) \(pages [^)]*\)\n(.*?)(?=\n\n## |\Z)", prompt, re.S | re.M):
            return json.dumps({f: [K.clip(x, 300) for x in K.sentences(t)[:3]] if f in ("key_findings", "limitations") else K.clip(" ".join(K.sentences(t)[:2]), 600) for f, t in fields})
        if m := re.search(r"^Wanted: (.*)$", prompt, re.M):
            first = next(iter(K.sentences(prompt.rsplit("TEXT:\n", 1)[-1])), "")
            return json.dumps({f: {"value": K.clip(first, 300), "evidence": K.clip(first, 160)} for f in m[1].split(", ") if first})
        return "{}"


def prompt(question: str, evidence: list[dict], partial: bool) -> str:
    parts = [f"[Evidence {i}]\nPage: {e['page_number']}\nChunk ID: {e['chunk_id']}\nText:\n{e['span']}" for i, e in enumerate(evidence, 1)]
    care = " It answers the question only in part: say so, and word findings with care." if partial else ""
    return f"Answer from the evidence below alone and cite the ids of what you use.{care}\nReturn JSON with answer and used_chunk_ids.\n\n" + "\n\n".join(parts) + f"\n\nQUESTION:\n{question}"


def read_json(raw: str) -> tuple[dict, list[str]]:
    """The object in a generator's text, and what had to be cleaned: thoughts, an unclosed thought, a fence, words around it."""
    text, cleaned = raw.strip(), []
    for name, pattern in (("thoughts", r"<think>.*?</think>"), ("unclosed thought", r"<think>.*?(?=\{)"), ("fence", r"^```\w*\s*|\s*```$")):
        new = re.sub(pattern, "", text, flags=re.S).strip()
        if new != text:
            text, cleaned = new, [*cleaned, name]
    if not (text.startswith("{") and text.endswith("}")):
        begin, end = text.find("{"), text.rfind("}")
        if 0 <= begin < end:
            text, cleaned = text[begin : end + 1], [*cleaned, "words around"]
    try:
        got = json.loads(text)
    except ValueError as e:
        raise ModelError(f"not JSON: {e}", kind="malformed") from e
    if not isinstance(got, dict):
        raise ModelError("JSON, but no object", kind="malformed")
    return got, cleaned


def inline_refs(schema: Any, defs: dict | None = None, depth: int = 20) -> Any:
    """A JSON schema without references."""
    if depth < 0:
        return {}
    if isinstance(schema, list):
        return [inline_refs(x, defs, depth - 1) for x in schema]
    if not isinstance(schema, dict):
        return schema
    defs = schema.get("$defs", defs or {})
    if "$ref" in schema:
        return inline_refs(defs.get(schema["$ref"].rsplit("/", 1)[-1], {}), defs, depth - 1)
    return {k: inline_refs(v, defs, depth - 1) for k, v in schema.items() if k != "$defs"}


_VALUES = ("value", "text", "summary", "content", "description", "answer")


def is_missing(x: Any) -> bool:
    return x is None or (isinstance(x, str) and x.strip().lower().rstrip(".") in EMPTY_MARKERS)


def as_text(x: Any) -> str:
    """One text of whatever came: wrapped values are unwrapped, lists joined; empty if nothing is there."""
    if isinstance(x, dict):
        x = next((x[k] for k in _VALUES if k in x), list(x.values()))
        return as_text(x)
    if isinstance(x, (list, tuple)):
        return "; ".join(t for t in map(as_text, x) if t)
    return "" if is_missing(x) else str(x).strip()


def as_texts(x: Any) -> list[str]:
    """Distinct texts in order, with white space collapsed."""
    items = x if isinstance(x, (list, tuple)) else [x]
    return list(dict.fromkeys(t for t in (K.collapse(as_text(i)) for i in items) if t))


def as_pages(x: Any) -> list[int]:
    """Positive whole numbers, each once and in order; booleans are none."""
    out = []
    for item in x if isinstance(x, (list, tuple)) else [x]:
        if isinstance(item, bool) or item is None:
            continue
        found = [int(item)] if isinstance(item, (int, float)) else [int(n) for n in re.findall(r"\d+", str(item))]
        out += [n for n in found if n > 0]
    return list(dict.fromkeys(out))


def as_note(x: Any) -> dict | None:
    """value, evidence and pages of what came for one field, or None if it says nothing. Evidence needs a value; pages may stand beside it."""
    whole = isinstance(x, dict)
    value = as_text({k: v for k, v in x.items() if k not in ("evidence", "pages", "page")} if whole else x)
    if not value:
        return None
    pages = next((x[k] for k in ("pages", "page") if k in x), []) if whole else []
    return {"value": value, "evidence": as_text(x.get("evidence")) if whole else "", "pages": as_pages(pages)}


def as_notes(got: dict, fields: dict[str, str]) -> list[dict]:
    """The notes of a group's answer, with their fields. Where a field of several items came as one text, that is its only item."""
    out = []
    for name, field in fields.items():
        x = got.get(name)
        for item in x if isinstance(x, (list, tuple)) else [x]:
            if note := as_note(item):
                out.append({"field": field, **note})
    return out
