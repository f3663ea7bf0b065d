"""Near-duplicates by SimHash and multi-index hashing.

A document's fingerprint has 128 bits: each distinct word votes on every bit with the bits of its MD5, weighted by its
rarity in the corpus and its count. Two documents are near-duplicates if their fingerprints differ in at most
`radius` bits. Search is exact: the fingerprint is cut into m segments, and of two fingerprints within the radius some
segment is within r = floor(radius / m) bits. Every distinct fingerprint enumerates the ball of half that distance around
each of its segments, and two that differ by up to the whole distance there meet at a common value; the complete
distance of those that meet is then verified. Groups are the connected components of the near pairs. Pairs aren't
listed: who meets at a value is searched breadth first, so that a fingerprint that is linked leaves the search, and a
place gives at most one link for each fingerprint. The components are the same.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import beside, quoted, unused
from millrace.llm.features import Memo
from millrace.operators.components import connected_components
from millrace.plans.scratch import materialize

WORD = re.compile(r"\w+")
BITS, DF_BITS, LEVELS = 128, 16, 8
RADIUS = 17
#: From how many fingerprints of one place on they are dealt to several tasks; the links are the same.
ROWS_PER_PLACE = 2_000_000
_PAIRS, _KEYS_AT_ONCE = 1 << 22, 1 << 24


def _digest(word: str):
    return np.frombuffer(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest(), np.uint8)


class _Tokens:
    """Distinct lower-cased words of a text with their MD5 bytes; a word is a run of letters, digits and underscores."""

    def __init__(self):
        self.memo = Memo(_digest, 16, np.uint8)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        c = Counter(WORD.findall((text or "").lower()))
        return self.memo.rows(c), np.fromiter(c.values(), np.int64, len(c))


def _df_bucket(digests: np.ndarray) -> np.ndarray:
    return digests[:, 0].astype(np.int64) << 8 | digests[:, 1]


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Over all documents: in how many (word, document) pairs each of 65,536 buckets of words occurs, and last the number of documents. Fixed in size."""

    def run(batches):
        f, n, total = _Tokens(), 0, np.zeros(1 << DF_BITS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                d, _ = f(t)
                np.add.at(total, _df_bucket(d), 1)
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << DF_BITS)), pa.array(np.append(total[at], n))], ["bucket", "n"])

    got = docs.select(quoted(text)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << DF_BITS) + 1, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def rarity(df: np.ndarray) -> np.ndarray:
    """1 + floor(log2(documents / df)) by bucket, at least 1 and at most 1 + LEVELS."""
    n = int(df[-1])
    w = np.ones(1 << DF_BITS, np.uint8)
    for k in range(1, LEVELS + 1):
        w += (df[:-1] << k) <= n
    return w


def fingerprint(weights: np.ndarray):
    """A column function: text -> struct<hi, lo> of the fingerprint as signed 64-bit halves; null for a text without words."""

    @F.arrow_udf("struct<hi: bigint, lo: bigint>")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = _Tokens()
        for texts in batches:
            out, none = np.zeros((len(texts), 2), np.int64), np.zeros(len(texts), bool)
            for i, t in enumerate(texts.to_pylist()):
                d, n = f(t)
                if not len(d):
                    none[i] = True
                    continue
                # the bit length of the count, in whole numbers so that any engine agrees
                w = (weights[_df_bucket(d)] * np.frexp(n)[1]).astype(np.float32)
                votes = w @ np.unpackbits(d, axis=1).astype(np.float32)
                out[i] = np.packbits(2 * votes > w.sum()).view(">i8")
            yield pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["hi", "lo"], mask=pa.array(none))

    return fp


def _segments(m: int) -> list[tuple[int, int]]:
    """Start and width of m segments of 128 bits, the first ones wider."""
    return _parts(0, BITS, m)


def _parts(start: int, width: int, m: int) -> list[tuple[int, int]]:
    w, more = divmod(width, m)
    out = []
    for k in range(m):
        out.append((start, w + (k < more)))
        start += out[-1][1]
    return out


def segments_for(n: int, radius: int = RADIUS) -> int:
    """How many segments cost least for n fingerprints: many segments mean few values to enumerate, few (wide) segments mean few chance meetings."""

    def cost(m: int) -> float:
        w, r = BITS // m, radius // m
        part = w - w // (r + 1)
        values = m * (r + 1) * sum(comb(part, i) for i in range((r + 1) // 2 + 1))
        return 20 * values + n * m * sum(comb(w, i) for i in range(r + 1)) / 2**w

    return min(range(3, 9), key=cost)


def _cut(hi: np.ndarray, lo: np.ndarray, start: int, width: int) -> np.ndarray:
    """Bits start.. of the 128, counted from the most significant one, as uint64."""
    mask = np.uint64((1 << width) - 1)
    end = start + width
    if end <= 64:
        return (hi >> np.uint64(64 - end)) & mask
    if start >= 64:
        return (lo >> np.uint64(128 - end)) & mask
    return ((hi << np.uint64(end - 64)) | (lo >> np.uint64(128 - end))) & mask


def _ball(width: int, radius: int) -> np.ndarray:
    """All masks of `width` bits with at most `radius` set."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def _root(lab: np.ndarray, i: np.ndarray) -> np.ndarray:
    r = lab[i]
    while not np.array_equal(r, up := lab[r]):
        r = up
    lab[i] = r
    return r


def _merge(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the components of i and j pairwise; the least member stands for a component."""
    while len(i):
        a, b = _root(lab, i), _root(lab, j)
        on = a != b
        i, j, a, b = i[on], j[on], a[on], b[on]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))


def _search(hi: np.ndarray, lo: np.ndarray, lab: np.ndarray, who: np.ndarray, radius: int) -> None:
    """Breadth first over the members `who` of one run: each linked member leaves those that are still to be found.

    A member is compared with those that no earlier one has reached, so a run that hangs together costs about its size."""
    comp, at = np.unique(_root(lab, who), return_inverse=True)
    if len(comp) < 2:
        return
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    front, todo = np.flatnonzero(at == at[0]), np.flatnonzero(at != at[0])
    while True:
        while len(front) and len(todo):
            step = max(1, _PAIRS // len(todo))
            now, front = front[:step], front[step:]
            d = np.bitwise_count(hi[who[now], None] ^ hi[who[todo]]) + np.bitwise_count(lo[who[now], None] ^ lo[who[todo]])
            found = d <= radius
            hit = found.any(0)
            if hit.any():
                _merge(lab, who[now[found[:, hit].argmax(0)]], who[todo[hit]])
                # all of a component comes along, as it hangs together already
                reached = np.isin(at[todo], np.unique(at[todo[hit]]))
                front, todo = np.concatenate([front, todo[reached]]), todo[~reached]
        if not len(todo):
            return
        front = todo[at[todo] == at[todo[0]]]
        todo = todo[len(front) :]


def _link(place: int, hi: np.ndarray, lo: np.ndarray, radius: int, seg: list[tuple[int, int]]) -> np.ndarray:
    """The component of each fingerprint that stands at a place, by the least index, over all near pairs that meet there."""
    within = radius // len(seg)
    start, width = seg[place & 7]
    sub, w = _parts(start, width, within + 1)[place >> 3 & 31]
    low = _cut(hi, lo, start, width)
    shift = np.uint64(start + width - sub - w)
    low = (low >> (shift + np.uint64(w))) << shift | low & np.uint64((1 << int(shift)) - 1)  # the bits that may differ
    ball = _ball(width - w, (within + 1) // 2)
    lab = np.arange(len(hi))
    # by ranges of values, so that memory holds a part of the ball only
    bits = min(width - w, max(0, (len(hi) * len(ball) // _KEYS_AT_ONCE).bit_length()))
    for part in range(1 << bits):
        if bits:
            who, keys = [], []
            for m in ball:
                k = low ^ m
                on = np.flatnonzero(k >> np.uint64(width - w - bits) == part)
                who.append(on), keys.append(k[on])
            who, keys = np.concatenate(who), np.concatenate(keys)
        else:
            who, keys = np.repeat(np.arange(len(hi)), len(ball)), (low[:, None] ^ ball[None, :]).ravel()
        if not len(keys):
            continue
        order = np.argsort(keys, kind="stable")
        who, keys = who[order], keys[order]
        begin = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        size = np.diff(np.append(begin, len(keys)))
        for k in np.flatnonzero(size > 48):
            _search(hi, lo, lab, who[begin[k] : begin[k] + size[k]], radius)
        end = np.repeat(np.where(size > 48, 0, begin + size), size)
        live, ahead = np.arange(len(keys)), 1
        while len(live := live[live + ahead < end[live]]):
            for k in range(0, len(live), _PAIRS):
                i, j = who[live[k : k + _PAIRS]], who[live[k : k + _PAIRS] + ahead]
                new = lab[i] != lab[j]
                i, j = i[new], j[new]
                near = np.bitwise_count(hi[i] ^ hi[j]) + np.bitwise_count(lo[i] ^ lo[j]) <= radius
                _merge(lab, i[near], j[near])
            ahead += 1
    return _root(lab, np.arange(len(lab)))


def near_links(fps: DataFrame, *, radius: int = RADIUS, segments: int | None = None, rows_per_place: int = ROWS_PER_PLACE) -> DataFrame:
    """Links (src, dst) between rows (id, hi, lo) of `fps`, distinct in hi and lo, whose connected components are those of all pairs that differ in at most `radius` bits.

    A segment is cut into r + 1 parts for the r bits that may differ in it: some part is alike then. A fingerprint is
    sent to a place for each segment and part, named by the part's bits, where the ball over the segment's other bits is
    enumerated: as many rows are shuffled for each fingerprint, whatever their number. A place is read as a stream.

    One that holds more than `rows_per_place` rows, and more than four times its even share, is divided: its most frequent segment value's least fingerprint is its
    hub; those within the radius of the hub are linked to it outright, so they needn't meet each other and are dealt to
    several tasks, each with all the place's other fingerprints.
    """
    n = fps.count()
    segments = segments or segments_for(n, radius)
    if not 3 <= segments <= 8:
        raise ValueError("3 to 8 segments")
    seg, within = _segments(segments), radius // segments
    if within > 30 or within + 1 > min(w for _, w in seg):
        raise ValueError("a segment must be wider than the bits that may differ in it")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = [(k, j, *sub) for k, (start, width) in enumerate(seg) for j, sub in enumerate(_parts(start, width, within + 1))]

    def bits(start: int, width: int) -> Column:
        """As _cut(), in the engine."""
        mask, end = F.lit((1 << width) - 1), start + width
        if end <= 64:
            return F.shiftrightunsigned("hi", 64 - end).bitwiseAND(mask)
        if start >= 64:
            return F.shiftrightunsigned("lo", 128 - end).bitwiseAND(mask)
        return F.shiftleft("hi", end - 64).bitwiseOR(F.shiftrightunsigned("lo", 128 - end)).bitwiseAND(mask)

    places = F.array(*[F.shiftleft(bits(*sub), 8).bitwiseOR(F.lit(j << 3 | k)) for k, j, *sub in cells])
    p = fps.select("id", "hi", "lo", F.explode(places).alias("place"))
    most = max(rows_per_place, 4 * n >> min(w for *_, w in cells))  # far more than a place's share of fingerprints that are spread evenly
    counts = fps.select(F.explode(places).alias("place")).groupBy("place").count().where(F.col("count") > most)
    hot = {r["place"]: -(-r["count"] // most) for r in counts.collect()}  # at most len(cells) * n / most
    links = None
    if hot:
        dealt = F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])
        at = p.where(F.col("place").isin(list(hot)))
        value = F.element_at(F.array(*[bits(*s) for s in seg]), (F.col("place").bitwiseAND(F.lit(7)) + 1).cast("int"))
        hub = at.groupBy("place", value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("hi", "lo", "id")).alias("hub")).groupBy("place").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
        at = at.join(F.broadcast(hub), "place")  # one row for each hot place
        far = F.bit_count(F.col("hi").bitwiseXOR(F.col("hub.hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("hub.lo"))) > radius
        at = at.withColumn("far", far).withColumn("n", F.element_at(dealt, F.col("place")))
        at = materialize(at.select("id", "hi", "lo", "place", "far", "n", F.col("hub.id").alias("hub")), "hot-places")
        links = at.where("NOT far AND id <> hub").select(F.col("hub").alias("src"), F.col("id").alias("dst"))
        turn = F.when(F.col("far"), F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("n"))))
        p = p.where(~F.col("place").isin(list(hot))).withColumn("turn", F.lit(0)).unionByName(at.select("id", "hi", "lo", "place", F.explode(turn.cast("array<int>")).alias("turn")))
    else:
        p = p.withColumn("turn", F.lit(0))

    def meet(batches):
        held: list[np.ndarray] = []

        def close():
            t = np.concatenate(held, axis=1)
            held.clear()
            hi, lo = t[2].view(np.uint64), t[3].view(np.uint64)
            lab = _link(int(t[0, 0]), hi, lo, radius, seg)
            on = np.flatnonzero(lab != np.arange(len(lab)))
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(t[1][lab[on]]), pa.array(t[1][on])], ["src", "dst"])

        last = None
        for b in batches:
            t = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in ("place", "id", "hi", "lo", "turn")])
            cuts = np.flatnonzero((np.diff(t[0]) != 0) | (np.diff(t[4]) != 0)) + 1
            for x in np.split(t, cuts, axis=1):
                if x.shape[1]:
                    if last != (now := (x[0, 0], x[4, 0])) and held:
                        yield from close()
                    last = now
                    held.append(x)
        if held:
            yield from close()

    met = p.repartition(parts, "place", "turn").sortWithinPartitions("place", "turn").mapInArrow(meet, "src long, dst long")
    return met if links is None else met.unionAll(links)


def fingerprints(docs: DataFrame, text: str = "text") -> Column:
    """The column of fingerprints, weighted by the rarity of words in `docs`."""
    return fingerprint(rarity(document_frequencies(docs, text)))(quoted(text))


def classes(rows: DataFrame, *, radius: int = RADIUS, segments: int | None = None, rows_per_place: int = ROWS_PER_PLACE) -> DataFrame:
    """(hi, lo, n, g): for every distinct fingerprint of rows (_k, _rid, hi, lo), the number of rows in its group and the group's first row, struct<n, _k, _rid>."""
    first = F.min(F.struct(F.col("_k").isNull().alias("n"), F.col("_k"), F.col("_rid"))).alias("m")
    reps = materialize(rows.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("_rid").alias("id"), first, F.count(F.lit(1)).alias("c")), "classes")
    links = near_links(reps.select("id", "hi", "lo"), radius=radius, segments=segments, rows_per_place=rows_per_place)
    comp = connected_components(links)
    reps = reps.join(comp, reps["id"] == comp["node"], "left").withColumn("component", F.coalesce("component", "id"))
    g = reps.groupBy("component").agg(F.min("m").alias("g"), F.sum("c").alias("n"))
    return reps.join(g, "component").select("hi", "lo", "n", "g")


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", radius: int = RADIUS, segments: int | None = None, rows_per_place: int = ROWS_PER_PLACE) -> DataFrame:
    """(key, group_id, n_links, keep) for every row of `docs`: its group's least key, with how many other rows it is linked, outright or through others, and whether it is the row that stays.

    The first row by key (nulls last, then by row order) of each group stays. Rows whose text is null, empty or has no
    word are in no group: they stay, group_id is their own key and they have no links. Repeated rows are in one group.
    A column that is called like the key gets an underscore.
    """
    f = fingerprints(docs, text)
    rows = materialize(docs.select(quoted(key).alias("_k"), F.monotonically_increasing_id().alias("_rid"), f.alias("f")).select("_k", "_rid", "f.hi", "f.lo"), "fingerprints")
    c = classes(rows, radius=radius, segments=segments, rows_per_place=rows_per_place)
    out = rows.join(c, ["hi", "lo"], "left").select(
        "_k",
        F.when(F.col("g").isNull(), F.col("_k")).otherwise(F.col("g._k")).alias("group_id"),
        (F.coalesce("n", F.lit(1)) - 1).alias("n_links"),
        F.coalesce(F.col("g._rid") == F.col("_rid"), F.lit(True)).alias("keep"),
    )
    return beside(out, "_k", key, ["group_id", "n_links", "keep"])


def dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", radius: int = RADIUS, segments: int | None = None, rows_per_place: int = ROWS_PER_PLACE) -> DataFrame:
    """The rows of `docs` that stay, with the columns they came with, whatever their names.

    The rows are written once with their numbers and fingerprints, and all that follows reads them there: where `docs`
    gives its rows in another order each time it is read, the right ones still go.
    """
    k, rid, fp = unused(docs.columns, "_k", "_rid", "_fp")
    f = fingerprints(docs, text)
    numbered = materialize(docs.select("*", quoted(key).alias(k), F.monotonically_increasing_id().alias(rid), f.alias(fp)), "numbered")
    rows = numbered.select(F.col(k).alias("_k"), F.col(rid).alias("_rid"), F.col(f"{fp}.hi").alias("hi"), F.col(f"{fp}.lo").alias("lo"))
    c = classes(rows, radius=radius, segments=segments, rows_per_place=rows_per_place)
    gone = rows.join(c, ["hi", "lo"]).where("g._rid <> _rid").select("_rid")
    return numbered.join(gone, numbered[rid] == gone["_rid"], "left_anti").drop(k, rid, fp)
