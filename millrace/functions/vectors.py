"""Vectors of Arrow columns in numpy, compared tile by tile in memory that the tiles bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of one side and of the other that are compared at once.
TILE = (512, 8192)


def unit_rows(vectors: pa.ChunkedArray | pa.Array, for_zero: float = np.nan) -> np.ndarray:
    """A row of length one for each vector; NaN where it has a null, `for_zero` throughout where it is zero. Vectors must have one number of dimensions."""
    v = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) and vectors.num_chunks else vectors
    if not len(v):
        return np.zeros((0, 0))
    sizes = np.diff(v.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in their number of dimensions")
    m = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), sizes[0])
    n = np.linalg.norm(m, axis=1)
    m /= np.where(n > 0, n, np.nan if np.isnan(for_zero) else 1)[:, None]
    return m


def slack(dims: int) -> float:
    """More than a product of unit vectors in single precision is away from the true one, and than rounding to nine digits does."""
    return (dims + 4) * 2.0**-23


def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of a's rows i and b's rows j."""
    out, step = np.empty(len(i)), max(1, (1 << 20) // max(1, a.shape[1]))
    for k in range(0, len(i), step):
        out[k : k + step] = np.einsum("ij,ij->i", a[i[k : k + step]], b[j[k : k + step]])
    return out


def pairs_from(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the unit rows of a and b whose product is at least `least`, tile by tile: found in single precision, decided in double."""
    a32, b32, off = a.astype(np.float32), b.astype(np.float32), slack(a.shape[1])
    for p in range(0, len(a), TILE[0]):
        for q in range(0, len(b), TILE[1]):
            s = a32[p : p + TILE[0]] @ b32[q : q + TILE[1]].T
            i, j = np.divmod(np.flatnonzero(s >= np.float32(least - off)), s.shape[1])
            ok = s[i, j] >= np.float32(least + off)
            ok[~ok] = dots(a, b, p + i[~ok], q + j[~ok]) >= least
            yield p + i[ok], q + j[ok]


def near_any(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """For each unit row of a whether its product with one of b's is at least `least`; decided as in pairs_from."""
    b32, off, near = b.astype(np.float32), slack(a.shape[1]), np.zeros(len(a), bool)
    for p in range(0, len(a), TILE[0]):
        open_, u = np.arange(p, min(p + TILE[0], len(a))), a[p : p + TILE[0]].astype(np.float32)
        for q in range(0, len(b), TILE[1]):
            s = u @ b32[q : q + TILE[1]].T
            top = s.max(1)
            on = top >= np.float32(least + off)
            unsure = np.flatnonzero(~on & (top >= np.float32(least - off)))
            if len(unsure):
                i, j = np.nonzero(s[unsure] >= np.float32(least - off))
                on[unsure[i[dots(a, b, open_[unsure[i]], q + j) >= least]]] = True
            near[open_[on]] = True
            open_, u = open_[~on], u[~on]
            if not len(u):
                break
    return near


def first_apart(x: np.ndarray, least: float) -> np.ndarray:
    """The unit rows that a scan keeps which drops each whose product with one kept before is at least `least`."""
    kept, n, rows = np.empty_like(x), 0, []
    for p in range(0, len(x), TILE[0]):
        on = p + np.flatnonzero(~near_any(x[p : p + TILE[0]], kept[:n], least))
        u = x[on]
        near, dropped = u @ u.T >= least, np.zeros(len(u), bool)
        for i in range(len(u)):
            if not dropped[i]:
                dropped[i + 1 :] |= near[i, i + 1 :]
        on = on[~dropped]
        kept[n : n + len(on)], n = x[on], n + len(on)
        rows.append(on)
    return np.concatenate(rows) if rows else np.zeros(0, int)


def first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """The rows of x, in order, that fewer than k equal ones stand before."""
    x = np.ascontiguousarray(x)
    _, group = np.unique(x.view(f"V{x.shape[1] * x.itemsize}").ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    before = np.arange(len(x)) - np.searchsorted(group[order], group[order])
    return np.sort(order[before < k])


def k_best(a: np.ndarray, b: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the k rows of b with the greatest products for each row of a, the first ones of equal ones; scores are rounded to nine digits and at least `least`.

    Single precision tells which pairs can reach the k best that a row has so far; only those are scored in double
    precision. A tile where many can is scored whole.
    """
    a32, b32, off = a.astype(np.float32), b.astype(np.float32), slack(a.shape[1])
    got = []
    for p in range(0, len(a), TILE[0]):
        u = a[p : p + TILE[0]]
        best, where = np.full((len(u), k), -np.inf), np.full((len(u), k), -1)
        for q in range(0, len(b), TILE[1]):
            x = b[q : q + TILE[1]]
            s = a32[p : p + TILE[0]] @ b32[q : q + TILE[1]].T
            floor = best[:, -1] - off
            if not q and s.shape[1] > k:
                floor = np.partition(s, -k, axis=1)[:, -k].astype(float) - 2 * off
            at = np.flatnonzero(s >= np.maximum(floor, least - off)[:, None].astype(np.float32))
            if len(at) > max(s.size // 16, k * len(u)):
                whole = np.round(u @ x.T, 9)
                j = np.argsort(-whole, axis=1, kind="stable")[:, :k]
                i, j = np.repeat(np.arange(len(u)), j.shape[1]), j.ravel()
                score = whole[i, j]
            else:
                i, j = np.divmod(at, s.shape[1])
                score = np.round(dots(u, x, i, j), 9)
            row, score, j = np.concatenate([np.repeat(np.arange(len(u)), k), i]), np.concatenate([best.ravel(), score]), np.concatenate([where.ravel(), q + j])
            order = np.lexsort((j, -score, row))
            take = order[np.searchsorted(row[order], np.arange(len(u)))[:, None] + np.arange(k)]
            best, where = score[take], j[take]
        i, at = np.nonzero((best > -np.inf) & (best >= least))
        got.append((p + i, where[i, at], best[i, at]))
    return tuple(np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
