"""Repeatable draws: uniform numbers from a row's id, alike in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(row_id: Column, purpose: str, draw: int | Column = 0, seed: int = 0) -> Column:
    """A number in [0, 1): the first 32 bits of md5('id|purpose|draw|seed')."""
    n = draw if isinstance(draw, Column) else F.lit(draw)
    text = F.concat_ws("|", row_id.cast("string"), F.lit(purpose), n.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def pick(u: Column, weights: list[float]) -> Column:
    """The index drawn by `u` from weights; the last one with a positive weight takes what rounding leaves."""
    total = float(sum(weights))
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    out, acc = None, 0.0
    last = max(i for i, w in enumerate(weights) if w > 0)
    for i, w in enumerate(weights):
        acc += w
        if i < last and w > 0:
            out = F.when(u < acc / total, i) if out is None else out.when(u < acc / total, i)
    return F.lit(last) if out is None else out.otherwise(last)
