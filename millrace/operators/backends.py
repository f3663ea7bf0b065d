"""What runs models: a protocol, an offline backend whose answers are functions of the input, and HTTP.

Backends run inside Arrow functions on the executors, so they must pickle; clients are made in the worker. A task that
is run again calls again: write results before reading them twice.
"""

from __future__ import annotations

import asyncio
import hashlib
import json
import os
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions.batches import pieces

#: Bytes of questions that a task puts and answers together.
AT_ONCE = 4 << 20


class Backend:
    """Asynchronous calls. `chat` answers messages; `complete` continues a prompt and gives (text, finish reason);
    `score` rates messages; `embed` gives vectors; `rerank` gives scores of documents; `logprobs` those of the tokens."""

    concurrency, batch_size = 100, 1000

    async def chat(self, messages: list[dict], **kw) -> str:
        raise NotImplementedError

    async def complete(self, prompt: str, **kw) -> tuple[str, str]:
        raise NotImplementedError

    async def score(self, messages: list[dict], **kw) -> float:
        raise NotImplementedError

    async def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError

    async def rerank(self, query: str, documents: list[str]) -> list[float]:
        raise NotImplementedError

    async def logprobs(self, messages: list[dict], **kw) -> list[float]:
        raise NotImplementedError


class HashBackend(Backend):
    """Deterministic and offline: every answer comes from MD5 of the input."""

    def __init__(self, dims: int = 16, **_):
        self.dims = dims

    @staticmethod
    def unit(text: str) -> float:
        return int(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) / float(1 << 32)

    async def chat(self, messages: list[dict], **kw) -> str:
        last = messages[-1]["content"] if messages else ""
        if kw.get("response_format"):
            return json.dumps({k: f"{k} {hashlib.md5(f'{k}|{last}'.encode()).hexdigest()[:8]}" if k != "score" else round(self.unit(last) * 5, 3) for k in kw["response_format"]})
        return "reply " + hashlib.md5(last.encode("utf-8", "surrogatepass")).hexdigest()[:12]

    async def complete(self, prompt: str, **kw) -> tuple[str, str]:
        return "text " + hashlib.md5(prompt.encode("utf-8", "surrogatepass")).hexdigest()[:12], "stop"

    async def score(self, messages: list[dict], **kw) -> float:
        return round(self.unit("|".join(m["content"] or "" for m in messages)) * 10 - 5, 6)

    async def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in (t or "").lower().split():
                h = int(hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
                v[h % self.dims] += 1.0 if h >> 16 & 1 else -1.0
            out.append(v)
        return out

    async def rerank(self, query: str, documents: list[str]) -> list[float]:
        return [round(self.unit(f"{query}|{d}"), 6) for d in documents]

    async def logprobs(self, messages: list[dict], **kw) -> list[float]:
        return [-5 * self.unit(w) for m in messages for w in (m["content"] or "").split()]


class HttpBackend(Backend):
    """Services with the common /chat/completions, /completions, /embeddings and /rerank routes. The key is read from the
    environment variable `key_env` on the executor. Certificates are always checked."""

    def __init__(self, base_url: str, model: str, key_env: str | None = None, timeout: float = 60, concurrency: int = 100, **defaults):
        self.url, self.model, self.key_env, self.timeout, self.concurrency, self.defaults = base_url.rstrip("/"), model, key_env, timeout, concurrency, defaults

    def _post(self, route: str, body: dict) -> dict:
        head = {"Content-Type": "application/json"}
        if self.key_env:
            head["Authorization"] = f"Bearer {os.environ[self.key_env]}"
        ask = urllib.request.Request(self.url + route, json.dumps({"model": self.model, **self.defaults, **body}).encode(), head)
        with urllib.request.urlopen(ask, timeout=self.timeout) as r:
            return json.load(r)

    async def _call(self, route: str, body: dict) -> dict:
        return await asyncio.to_thread(self._post, route, body)

    async def chat(self, messages, **kw):
        fmt = kw.pop("response_format", None)
        body = {"messages": messages, **kw} | ({"response_format": {"type": "json_object"}} if fmt else {})
        return (await self._call("/chat/completions", body))["choices"][0]["message"]["content"]

    async def complete(self, prompt, **kw):
        c = (await self._call("/completions", {"prompt": prompt, **kw}))["choices"][0]
        return c["text"], c.get("finish_reason", "stop")

    async def score(self, messages, **kw):
        return float((await self._call("/score", {"messages": messages, **kw}))["score"])

    async def embed(self, texts):
        got = (await self._call("/embeddings", {"input": texts}))["data"]
        return [x["embedding"] for x in sorted(got, key=lambda x: x["index"])]

    async def rerank(self, query, documents):
        got = (await self._call("/rerank", {"query": query, "documents": documents}))["results"]
        return [x["relevance_score"] for x in sorted(got, key=lambda x: x["index"])]

    async def logprobs(self, messages, **kw):
        got = await self._call("/chat/completions", {"messages": messages, "logprobs": True, **kw})
        return [x["logprob"] for x in got["choices"][0]["logprobs"]["content"]]


def gather(tasks: list, limit: int, size: int | None = None) -> list:
    """Results in order, at most `limit` at once and `size` begun together; an exception becomes the result of its task."""

    async def all_of(tasks: list):
        gate = asyncio.Semaphore(limit)

        async def one(t):
            async with gate:
                return await t

        return await asyncio.gather(*map(one, tasks), return_exceptions=True)

    async def in_turn():
        step = size or len(tasks) or 1
        return [r for k in range(0, len(tasks), step) for r in await all_of(tasks[k : k + step])]

    return asyncio.run(in_turn())


def column_call(backend: Backend, what: str, kind: str, batch: int = 32):
    """A column function: text (or JSON of the arguments) -> the answer of the backend, null where it fails. Questions are put in pieces of AT_ONCE bytes and no more calls than begin together."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in pieces(batches, AT_ONCE, backend.batch_size * (batch if what == "embed" else 1)):
            rows = b.to_pylist()
            if what == "embed":
                some = [i for i, t in enumerate(rows) if t is not None]
                parts = [some[k : k + batch] for k in range(0, len(some), batch)]
                out: list = [None] * len(rows)
                for part, got in zip(parts, gather([backend.embed([rows[i] for i in p]) for p in parts], backend.concurrency, backend.batch_size)):
                    for i, v in zip(part, got if not isinstance(got, BaseException) else [None] * len(part)):
                        out[i] = v
            else:

                async def one(t):
                    x = json.loads(t) if t is not None else None
                    if x is None:
                        return None
                    if what == "rerank":
                        return await backend.rerank(x.get("query") or "", x.get("documents") or [])
                    return await getattr(backend, what)(x)

                out = [None if isinstance(r, BaseException) else r for r in gather([one(t) for t in rows], backend.concurrency, backend.batch_size)]
            yield pa.array(out, {"array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()), "double": pa.float64(), "string": pa.string()}[kind])

    return run
