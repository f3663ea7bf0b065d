"""Sparse logistic regression over hashed features, fitted in numpy on a bounded sample."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The `n` rows of least md5 of the key, so the same ones each time; a top-n, not a sort."""
    h = F.md5(F.col(key).cast("string"))
    return df.where(F.col(key).isNotNull()).withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def featured(rows: DataFrame, f: Callable[[], Callable], extra: dict[str, str], n: int, size: int) -> pa.Table:
    """At most `n` rows' features, on the driver: (h, fold, idx, val, extra...), in the order of h.

    rows: _key, _text and columns called like `extra` (name: type), where f gives features of a text. h is a hash of key
    and text: of rows with equal ones, one counts, with the greatest extra columns; the n least h are taken, by each
    task first, so that no task keeps, sends or receives more. fold is a hash of the text: copies have the same.
    """
    schema = "h long, fold long, idx binary, val binary" + "".join(f", `{c}` {t}" for c, t in extra.items())

    names = ("fold", "idx", "val", *extra)

    def least(rows):
        """Of (h, extra, function for the rest) the n least h, each once."""
        kept, worst = {}, None
        for h, more, made in rows:
            if h in kept:
                kept[h] = (*kept[h][:3], *map(max, kept[h][3:], more))
            elif len(kept) < n or h < worst:
                kept[h] = (*made(), *more)
                if len(kept) > n:
                    del kept[worst]
                if len(kept) == n:
                    worst = max(kept)
        keys = sorted(kept)
        cols = [pa.array(keys, pa.int64()), *(pa.array([kept[h][k] for h in keys], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), *([pa.float64()] * len(extra)))))]
        return pa.RecordBatch.from_arrays(cols, ["h", *names])

    def read(batches):
        g = f()
        for b in batches:
            more = [b.column(k).to_pylist() for k in extra]
            for h, t, *x in zip(b.column("_h").to_pylist(), b.column("_text").to_pylist(), *more):
                yield h, x, lambda t=t: (zlib.crc32((t or "").encode("utf-8", "surrogatepass")), *packed(*g(t), size))

    def again(batches):
        for b in batches:
            for h, fold, idx, val, *x in zip(*(b.column(k) for k in ("h", *names))):
                yield h.as_py(), [v.as_py() for v in x], lambda fold=fold, idx=idx, val=val: (fold.as_py(), idx.as_py(), val.as_py())

    def first(batches):
        yield least(read(batches))

    def last(batches):
        yield least(again(batches))

    got = rows.select(F.xxhash64("_key", "_text").alias("_h"), "_text", *[F.col(c).cast("double").alias(c) for c in extra]).mapInArrow(first, schema)
    return got.repartition("h").mapInArrow(last, schema).orderBy("h").limit(n).toArrow()


def packed(ids: np.ndarray, val: np.ndarray, size: int) -> tuple[bytes, bytes]:
    """Features as bytes of 32-bit numbers: each bucket below `size` once, in order, its values added up."""
    ok = ids < size
    u, at = np.unique(ids[ok], return_inverse=True)
    return u.astype(np.int32).tobytes(), np.bincount(at, val[ok], len(u)).astype(np.float32).tobytes()


@dataclass
class Columns:
    """The features of a sample that differ most between the classes, as a dense matrix."""

    ids: np.ndarray  # hashed ids, sorted
    x: np.ndarray
    scale: np.ndarray


class Sparse:
    """Rows of hashed features, as packed() gives them."""

    def __init__(self, idx: list[bytes], val: list[bytes], bits: int):
        self.n, self.size = len(idx), 1 << bits
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), np.fromiter((len(b) // 4 for b in idx), np.int64, self.n))
        self.j = np.frombuffer(b"".join(idx), np.int32)
        self.v = np.frombuffer(b"".join(val), np.float32)

    def _sums(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By bucket: sums of the rows' weights, and of these times the values and their squares; a million features at a time."""
        out = np.zeros((3, self.size))
        for at in range(0, len(self.j), 1 << 20):
            part = slice(at, at + (1 << 20))
            j, v, u = self.j[part], self.v[part].astype(float), w[self.rows[part]]
            for k in range(3):
                out[k] += np.bincount(j, u, self.size)
                u = u * v
        return tuple(out)

    def select(self, y: np.ndarray, top: int, use: np.ndarray | None = None) -> Columns:
        """The `top` buckets by the absolute two-sample statistic of their values between y and 1 - y (soft labels), over the rows in `use`; the matrix holds all rows."""
        on = np.ones(self.n) if use is None else use.astype(float)
        p, q = max((y * on).sum(), 1e-9), max(((1 - y) * on).sum(), 1e-9)
        (c1, m1, s1), (c0, m0, s0) = self._sums(y * on), self._sums((1 - y) * on)
        m1, m0, seen = m1 / p, m0 / q, c1 + c0
        s1, s0 = s1 / p - m1**2, s0 / q - m0**2
        floor = np.median(self.v) ** 2 / max(self.n, 1) if len(self.v) else 1.0
        t = np.abs(m1 - m0) / np.sqrt(np.maximum(s1, 0) / p + np.maximum(s0, 0) / q + floor / p + floor / q + 1e-12)
        t[seen < 2] = 0
        best = np.sort(np.argsort(-t, kind="stable")[:top])
        best = best[t[best] > 0]
        at = np.full(self.size, -1)
        at[best] = np.arange(len(best))
        hit = at[self.j] >= 0
        x = np.zeros((self.n, len(best)), np.float32)
        x[self.rows[hit], at[self.j[hit]]] = self.v[hit]
        scale = np.sqrt((x[on > 0] ** 2).mean(0) if on.any() else np.ones(len(best))) + 1e-6
        x /= scale.astype(np.float32)
        return Columns(best, x, scale)


def fit(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression, by accelerated gradient descent."""
    n, d = x.shape
    base = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    b = float(np.log(base / (1 - base)))
    if not n or not d or y.min() == y.max():
        return np.zeros(d), b
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
    w = np.zeros(d + 1, np.float32)
    w[d] = b
    u, a = w.copy(), 1.0
    z = np.random.default_rng(0).standard_normal(d).astype(np.float32)
    top = 1.0
    for _ in range(8):  # the largest curvature, by power iteration
        z /= np.linalg.norm(z) + 1e-12
        z = (x @ z) @ x / n
        top = float(np.linalg.norm(z))
    step = 1 / (0.25 * (1.1 * top + 1) + l2)
    for _ in range(steps):
        r = sigmoid(x @ u[:d] + u[d]) - y
        g = np.append(r @ x / n + l2 * u[:d], r.mean())
        new = (u - step * g).astype(np.float32)
        a2 = (1 + np.sqrt(1 + 4 * a * a)) / 2
        u = (new + (a - 1) / a2 * (new - w)).astype(np.float32)
        w, a = new, a2
    return w[:d], float(w[d])


def expand(c: Columns, w: np.ndarray, bits: int) -> np.ndarray:
    """The weights as a table over all buckets, with one more for the padding."""
    out = np.zeros((1 << bits) + 1, np.float32)
    out[c.ids] = w / c.scale
    return out
