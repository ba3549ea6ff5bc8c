"""Optional HTTP models. They are made on executors, keep what an endpoint refused in their process, and raise ModelError only."""

from __future__ import annotations

import json
import socket
import urllib.error
import urllib.request

from leafloom.functions.models import ModelError


def post(url: str, payload: dict, timeout: float) -> dict:
    """A JSON object from an endpoint, without proxies."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    opener = urllib.request.build_opener(urllib.request.ProxyHandler({}))
    try:
        with opener.open(request, timeout=timeout) as reply:
            raw = reply.read()
    except urllib.error.HTTPError as e:
        missing = e.code == 404 or "not found" in e.read(2000).decode("utf-8", "replace").lower()
        raise ModelError("the model isn't installed" if missing else f"the endpoint said {e.code}", 503 if missing else 502, "refused" if e.code == 400 else "model") from e
    except TimeoutError as e:
        raise ModelError("the endpoint took too long", 504, "transport") from e
    except (urllib.error.URLError, OSError) as e:
        slow = isinstance(getattr(e, "reason", None), socket.timeout)
        raise ModelError("the endpoint took too long" if slow else "the endpoint can't be reached", 504 if slow else 503, "transport") from e
    try:
        got = json.loads(raw)
    except ValueError as e:
        raise ModelError("the endpoint gave no JSON", 502) from e
    if not isinstance(got, dict):
        raise ModelError("the endpoint gave no object", 502)
    return got


#: What each endpoint refused, in this process.
_refused: dict[str, set[str]] = {}


def forget_refusals() -> None:
    _refused.clear()


class HttpGenerator:
    """Tries once more without the options that an endpoint refused, and doesn't offer that endpoint them again."""

    def __init__(self, url: str, model: str, timeout: float = 300.0, schema: dict | None = None, options: dict | None = None):
        self.url, self.model, self.timeout, self.more = url, model, timeout, {"format": schema or "json", "think": False}
        self.options = options or {"temperature": 0}

    def generate(self, prompt: str) -> str:
        base = {"model": self.model, "prompt": prompt, "stream": False, "options": self.options}
        offered = {k: v for k, v in self.more.items() if k not in _refused.get(self.url, ())}
        try:
            got = post(self.url, base | offered, self.timeout)
        except ModelError as e:
            if e.kind != "refused" or not offered:
                raise
            _refused.setdefault(self.url, set()).update(offered)
            got = post(self.url, base, self.timeout)
        text = str(got.get("response") or "").strip()
        if not text:
            raise ModelError("the model gave nothing", 502)
        return text


class HttpEmbedder:
    """Vectors in batches, in order; all of one dimension, finite and not zero."""

    def __init__(self, url: str, model: str, batch: int = 16, timeout: float = 300.0):
        self.url, self.model, self.batch, self.timeout = url, model, batch, timeout

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """Blank texts aren't sent: they have None, as their passages can't be ranked."""
        said = [t for t in texts if t.strip()]
        vectors: list[list[float]] = []
        for i in range(0, len(said), self.batch):
            part = said[i : i + self.batch]
            got = post(self.url, {"model": self.model, "input": part}, self.timeout).get("embeddings")
            if not isinstance(got, list) or len(got) != len(part):
                raise ModelError("as many vectors as texts were expected", 502)
            vectors += [check_vector(v) for v in got]
        if len({len(v) for v in vectors}) > 1:
            raise ModelError("vectors differ in dimension", 502)
        left = iter(vectors)
        return [next(left) if t.strip() else None for t in texts]


def check_vector(v) -> list[float]:
    good = isinstance(v, list) and v and all(isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < float("inf") for x in v) and any(v)
    if not good:
        raise ModelError("no usable vector", 502)
    return [float(x) for x in v]
