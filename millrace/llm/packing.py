"""Best-fit packing of documents into sequences of fixed capacity, in bulk-synchronous rounds.

A document longer than the capacity is cut into full sequences and a rest; rests and short documents are the pieces. In
a round pieces and gaps stand sorted by size and by rank among those of one size. A sweep goes through the gaps in
ascending order, and each takes the largest piece that is left and fits; where several gaps of one size want pieces of
which there are fewer, the least ranks of gaps and pieces go first, and the other gaps go on to the next smaller piece.
Gaps are updated, and the next round begins; if none could be filled, empty sequences are opened.

Sorting and ranking pieces is done in the cluster. What a sweep does depends only on how many pieces and gaps of each
size there are, and sizes are whole numbers up to the capacity: so it runs over runs of equal sizes, of which there are
few whatever the size of the table, and says which ranks go to which sequences. Each piece then looks its rank up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.names import quoted, unused
from millrace.llm import tokens
from millrace.plans.scratch import materialize

CAPACITY = 2048
#: Leading bits of the hash by which pieces of one size are divided for ranking, and copies of one row that a task deals out.
_BITS, _AT_ONCE = 10, 4096


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where pieces go: rows (size, first rank, past the last, sequence of the first, slot, offset); those of the next ranks go to the next sequences.

    counts: number of pieces by size, 0 < size <= capacity. Pieces of over half the capacity open a sequence each. Of
    the rest, as many empty sequences are opened as its volume fills beyond the gaps, and again when nothing fits.
    There are at most capacity + rounds intervals of gaps, since only a size that runs out divides one.
    """
    left = {s: n for s, n in counts.items() if n}
    steps, gaps, opened = [], [], 0
    for s in sorted(left, reverse=True):
        if 2 * s > capacity:
            n = left.pop(s)
            steps.append((s, 0, n, opened, 0, 0))
            gaps.append((capacity - s, opened, n, 1))  # gap, first sequence, number, slot
            opened += n
    volume = sum(s * n for s, n in left.items())
    new = -(-max(0, volume - sum(g * n for g, _, n, _ in gaps)) // capacity)
    sizes = sum(1 << s for s in left)
    taken = dict.fromkeys(left, 0)
    while sizes:
        if new:
            gaps.append((capacity, opened, new, 0))
            opened += new
        after, before = [], volume
        for g, first, n, slot in sorted(gaps):
            while n and (fit := sizes & ((2 << g) - 1)):
                s = fit.bit_length() - 1
                m = min(n, left[s])
                steps.append((s, taken[s], taken[s] + m, first, slot, capacity - g))
                if g > s:
                    after.append((g - s, first, m, slot + 1))
                taken[s] += m
                left[s] -= m
                volume -= s * m
                first, n = first + m, n - m
                if not left[s]:
                    sizes ^= 1 << s
            if n:
                after.append((g, first, n, slot))
        least = (sizes & -sizes).bit_length() - 1
        gaps = [x for x in after if x[0] >= least]  # the others hold no piece that is left
        new = -(-volume // capacity) if volume == before else 0
    return np.array(sorted(steps), np.int64).reshape(-1, 6)


def ranked(lengths: DataFrame, capacity: int) -> DataFrame:
    """Each row of lengths (_k, n, h) with its size, the rest of its tokens, its copy among equal rows and its rank among rows of its size.

    Ranks go by a hash of the row, so they don't depend on how the table is divided. Equal rows are counted before they
    are moved, rows of one size are ranked in 1,024 parts, and copies of a row are dealt out by several tasks: neither a
    frequent size nor a frequent row comes together in one.
    """
    o = F.xxhash64("_k", "n", "h")
    g = lengths.groupBy("_k", "n", "h").agg(F.count(F.lit(1)).alias("c")).withColumn("size", (F.col("n") % capacity).cast("int"))
    g = g.withColumn("o", o).withColumn("b", F.shiftrightunsigned("o", 64 - _BITS))
    cells = g.groupBy("size", "b").agg(F.sum("c").alias("c"))
    cells = cells.select("size", "b", (F.sum("c").over(Window.partitionBy("size").orderBy("b")) - F.col("c")).alias("before"))
    w = Window.partitionBy("size", "b").orderBy("o", "_k", "n", "h").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("rank", F.sum("c").over(w) - F.col("c")).join(cells, ["size", "b"]).withColumn("rank", F.col("rank") + F.col("before"))
    g = g.select("_k", "n", "h", "o", "c", "size", "rank")
    part = F.explode(F.sequence(F.lit(0), F.expr(f"(c - 1) div {_AT_ONCE}").cast("int"))).alias("part")
    parts = int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = g.where(F.col("c") > _AT_ONCE).select("*", part).repartition(parts, "o", "part")
    g = g.where(F.col("c") <= _AT_ONCE).withColumn("part", F.lit(0)).unionAll(many)
    ends = F.least(F.col("c"), (F.col("part") + 1) * F.lit(_AT_ONCE).cast("long")) - 1
    g = g.select("_k", "n", "h", "size", "rank", F.explode(F.sequence((F.col("part") * F.lit(_AT_ONCE)).cast("long"), ends)).alias("copy"))
    return g.withColumn("rank", F.col("rank") + F.col("copy"))


def pack(docs: DataFrame, *, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, n_tokens: Column | None = None, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(seq_id, slot, seq_offset, key, text_hash, tok_start, tok_len) of every piece of every row of `docs`.

    A row's tokens are those of the vocabulary, or `n_tokens`. Tokens tok_start.. of the document stand at seq_offset..
    of sequence seq_id, as its slot-th piece; token_sequences() puts them there. No sequence holds more than `capacity`
    tokens, and every token of every row is in one of them. Rows without tokens (null or empty text, null `n_tokens`)
    have no piece; repeated rows are packed as often as they occur. Of pieces of equal size those of the least hash of
    key, length and text go first, and which of several equal rows is which makes no difference: the result is the same
    however the table is divided. A column that is called like the key gets an underscore.
    """
    n = tokens.count(vocabulary)(quoted(text)) if n_tokens is None else n_tokens
    lengths = docs.select(quoted(key).alias("_k"), F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.xxhash64(quoted(text)).alias("h"))
    lengths = materialize(lengths, "lengths").where("n > 0")
    counts = lengths.groupBy((F.col("n") % capacity).cast("int").alias("size")).count().where("size > 0")  # at most as many rows as the capacity
    steps = plan({r["size"]: r["count"] for r in counts.collect()}, capacity)
    at = steps[:, 0] << 42 | steps[:, 1]
    out = unused([key], "seq_id", "slot", "seq_offset", "text_hash", "tok_start", "tok_len")

    def place(batches):
        for b in batches:
            size, rank, n, h = (b.column(c).to_numpy() for c in ("size", "rank", "n", "h"))
            x = steps[np.searchsorted(at, size.astype(np.int64) << 42 | rank, "right") - 1]
            seq = pa.array([f"b{i}" for i in (x[:, 3] + rank - x[:, 1]).tolist()], pa.string())
            rest = (pa.array(c, k) for c, k in ((n - size, pa.int64()), (size, pa.int32())))
            yield pa.RecordBatch.from_arrays([seq, pa.array(x[:, 4], pa.int32()), pa.array(x[:, 5], pa.int32()), b.column("_k"), pa.array(h), *rest], ["seq_id", "slot", "seq_offset", "_k", "text_hash", "tok_start", "tok_len"])

    rows = ranked(lengths, capacity)
    kind = rows.schema["_k"].dataType.simpleString()
    tail = rows.where("size > 0").select("_k", "n", "h", "size", "rank").mapInArrow(place, f"seq_id string, slot int, seq_offset int, _k {kind}, text_hash long, tok_start long, tok_len int")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {capacity}") - 1)).alias("piece")
    full = rows.where(F.col("n") >= capacity).select("_k", "n", "h", "copy", piece)
    name = F.concat_ws(".", F.concat(F.lit("f"), F.coalesce(F.concat(F.lit(" "), F.col("_k").cast("string")), F.lit(""))), F.hex("h"), F.col("copy").cast("string"), F.col("piece").cast("string"))
    full = full.select(name.alias("seq_id"), F.lit(0).alias("slot"), F.lit(0).alias("seq_offset"), "_k", F.col("h").alias("text_hash"), (F.col("piece") * capacity).alias("tok_start"), F.lit(capacity).alias("tok_len"))
    both = full.unionAll(tail)
    return both.select(*[F.col(c).alias(o) for c, o in zip(both.columns, [*out[:3], key, *out[3:]])])


def token_sequences(pieces: DataFrame, docs: DataFrame, *, text: str = "text", key: str = "doc_id", vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(seq_id, n_tokens, ids) of what pack() gave for `docs`: each sequence's token ids, one after the other as bytes of unsigned numbers (see tokens.kind_of).

    At most the capacity of tokens comes together for a sequence.
    """
    width = tokens.kind_of(vocabulary).itemsize
    raw = docs.select(quoted(key).alias("_k"), F.xxhash64(quoted(text)).alias("_h"), tokens.ids(vocabulary)(quoted(text)).alias("raw"))
    raw = materialize(raw, "token-ids").dropDuplicates(["_k", "_h"])
    p = pieces.join(raw, F.col(key).eqNullSafe(F.col("_k")) & (F.col("text_hash") == F.col("_h")))
    p = p.select("seq_id", "slot", "tok_len", F.expr(f"substring(raw, cast(tok_start * {width} + 1 as int), tok_len * {width})").alias("x"))
    g = p.groupBy("seq_id").agg(F.sum("tok_len").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("x"))
    return g.select("seq_id", "n_tokens", F.aggregate("x", F.lit(b""), lambda s, y: F.concat(s, y["x"])).alias("ids"))
