"""Arrow batches cut into pieces, so that what Python makes of a batch doesn't stay in memory all at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(batches: Iterable, most: int = 1 << 20, rows: int | None = None) -> Iterator:
    """The rows of `batches` in order, in pieces of some `most` bytes of their first column and at most `rows` rows.

    A batch is an array, a tuple of arrays or a record batch; a batch holds as many rows as the session's
    spark.sql.execution.arrow.maxRecordsPerBatch, whatever their size. Long rows come alone; in columns that aren't
    text, and in record batches, rows count alike. An empty batch gives an empty piece.
    """
    for b in batches:
        first = b[0] if isinstance(b, tuple) else b
        n = len(first)
        if isinstance(first, pa.Array) and (pa.types.is_string(first.type) or pa.types.is_large_string(first.type)):
            size = pc.fill_null(pc.binary_length(first), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            size = np.full(n, first.nbytes // max(1, n), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1).tolist(), n]
        for lo, hi in zip(cuts, cuts[1:]):
            for at in range(lo, max(hi, lo + 1), rows or max(1, hi - lo)):
                m = min(rows or hi, hi - at)
                yield tuple(c.slice(at, m) for c in b) if isinstance(b, tuple) else b.slice(at, m)
