"""Language by rank-order profiles (out-of-place distance between lists of the most frequent n-grams)."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.names import beside, quoted

TOP, TRAIN_PER_LANG = 300, 300


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of 1 to 3 signs of a whole text, as whole numbers in the order of their code points, and their counts.

    The text is put in small letters, each run of other signs becomes one '_', and so do the text's ends; an n-gram
    has '_' at its ends only, and is not '_' itself.
    """
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _letters()[c]
    c = np.concatenate([[95], np.where(ok, c, 95), [95]]).astype(np.int64)
    c = c[~((c == 95) & (np.append(0, c[:-1]) == 95))]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = c == 95
    one = c[~edge] << 42
    two = c[:-1] << 42 | c[1:] << 21
    mid = ~edge[1:-1]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[mid]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def text_of(code: int) -> str:
    return "".join(chr(x) for k in (42, 21, 0) if (x := code >> k & 0x1FFFFF))


def top(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent, ties in the order of the code points."""
    if len(codes) > 4 * k:
        least = -np.partition(-counts, k - 1)[k - 1]
        on = counts >= least
        codes, counts = codes[on], counts[on]
    return codes[np.lexsort((codes, -counts))[:k]]


def profiles(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", top_k: int = TOP, per_lang: int = TRAIN_PER_LANG) -> dict[str, np.ndarray]:
    """Each language's `top_k` n-grams by rank, from its `per_lang` labelled documents of least md5(key) (all rows under such a key).

    Rows with a null language or key don't train. Counting is in the cluster; languages x top_k numbers come back.
    """
    ids = docs.select(quoted(lang).alias("_lang"), quoted(key).alias("_key")).where("_lang IS NOT NULL AND _key IS NOT NULL").distinct()
    # few rows per language leave each task: the rank limit is applied before the shuffle too
    w = Window.partitionBy("_lang").orderBy(F.md5(F.col("_key").cast("string")), "_key")
    ids = ids.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_lang).drop("_r")
    rows = docs.select(quoted(lang).alias("_l2"), quoted(key).alias("_k2"), quoted(text).alias("_text"))
    rows = rows.join(F.broadcast(ids), (F.col("_k2") == F.col("_key")) & (F.col("_l2") == F.col("_lang")))

    def run(batches):
        for b in batches:
            by: dict = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(name, []).append(ngrams(t))
            for name, got in by.items():
                codes, inv = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
                n = np.bincount(inv, np.concatenate([m for _, m in got]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    counts = rows.select("_lang", "_text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    got = counts.withColumn("r", rank).where(F.col("r") <= top_k).toArrow().to_pandas().sort_values(["lang", "r"])
    return {name: g["code"].to_numpy() for name, g in got.groupby("lang")}


def distances(codes: np.ndarray, prof: list[tuple[np.ndarray, np.ndarray]], top_k: int) -> np.ndarray:
    """The out-of-place distance to each profile (sorted codes, their ranks): the sum of rank differences, `top_k` for an n-gram the profile lacks."""
    at = np.arange(len(codes))
    out = np.zeros(len(prof), np.int64)
    for k, (sorted_codes, ranks) in enumerate(prof):
        i = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
        out[k] = np.where(sorted_codes[i] == codes, np.abs(ranks[i] - at), top_k).sum()
    return out


def identify(docs: DataFrame, prof: dict[str, np.ndarray], *, text: str = "text", key: str = "doc_id", top_k: int = TOP) -> DataFrame:
    """key, pred_lang, distance, margin for every row: the nearest profile (the first by name of equal ones) and how much farther the next is.

    A text without letters, a null one, or no profiles: pred_lang null, distance and margin null. With one profile the margin is null. A column that is called like the key gets an underscore.
    """
    names = sorted(prof)
    table = [(prof[n][o := np.argsort(prof[n])], o) for n in names]

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                codes, n = ngrams(t)
                if not len(codes) or not names:
                    out.append((None, None, None))
                    continue
                d = distances(top(codes, n, top_k), table, top_k)
                k = int(d.argmin())
                rest = np.delete(d, k)
                out.append((names[k], int(d[k]), int(rest.min() - d[k]) if len(rest) else None))
            cols = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.int64(), pa.int64())))], ["_k", "pred_lang", "distance", "margin"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(quoted(key), quoted(text)).mapInArrow(run, f"_k {kind}, pred_lang string, distance long, margin long")
    return beside(out, "_k", key, ["pred_lang", "distance", "margin"])
