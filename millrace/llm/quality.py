"""Quality by weak labels.

Overlapping heuristic labellers vote low (-1), high (+1) or not at all (0) on every document. Expectation-maximisation
estimates how reliable each labeller is, from the counts of vote patterns over the whole corpus; the posterior of
"high" given a document's votes is its soft label, and these labels train a hashed linear scorer on a bounded sample.
A document may be low for one of several reasons, of which labellers see one or the other: votes are taken to be
independent given the reason, not given "low" alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import beside, quoted
from millrace.llm import linear
from millrace.llm.features import STATS, Shapes, TextStats

#: name, measure over the counts of features.TextStats, low if it is ... or beyond, high if it is ... or beyond.
#: None: the labeller has no such vote. Without a high one, a large measure is the worse one. Each reads a count of its own.
LABELLERS = (
    ("marks", lambda s: s["n_marked"] / s["n_words"], 0.08, None),
    ("capitals", lambda s: s["n_upper"] / s["n_words"], 0.15, None),
    ("bangs", lambda s: s["n_bang"] / s["n_words"], 0.05, None),
    ("pipes", lambda s: s["n_pipe"] / s["n_words"], 0.08, None),
    ("repeats", lambda s: 1 - s["n_repeat"] / s["n_words"], 0.85, 0.97),
    ("dup_lines", lambda s: s["n_dup_lines"] / s["n_lines"], 0.3, None),
    ("clean_words", lambda s: s["n_clean"] / s["n_words"], 0.85, 0.95),
    ("letters", lambda s: s["n_letters"] / s["n_word_chars"], 0.88, 0.94),
    ("few_kinds", lambda s: np.log(np.maximum(s["n_distinct"], 1)) / np.log(np.maximum(s["n_words"], 2)), 0.65, 0.75),
    ("stopwords", lambda s: s["n_stop"] / s["n_words"], None, 0.2),  # few of them may be another language
)
#: By labeller the reason for which it votes low: 0, the signs and words of the text; 1, their repetition.
REASONS = tuple(int(name in ("repeats", "dup_lines", "few_kinds")) for name, *_ in LABELLERS)


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Votes in {-1, 0, 1} by document and labeller; a document without words gets no votes."""
    s = {k: np.asarray(v, float) for k, v in stats.items()}
    n = np.maximum(s["n_words"], 1)
    s = s | {"n_words": n, "n_lines": np.maximum(s["n_lines"], 1), "n_word_chars": np.maximum(s["n_word_chars"], 1)}
    out = np.zeros((len(n), len(LABELLERS)), np.int8)
    for k, (_, f, low, high) in enumerate(LABELLERS):
        m = f(s)
        if high is None:
            out[m >= low, k] = -1
        else:
            if low is not None:
                out[m < low, k] = -1
            out[m >= high, k] = 1
    out[np.asarray(stats["n_words"]) == 0] = 0
    return out


def encode(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1]))


def decode(code: np.ndarray, k: int) -> np.ndarray:
    return (np.asarray(code)[:, None] // 3 ** np.arange(k)) % 3 - 1


@dataclass
class LabelModel:
    share: np.ndarray  # of the reasons for low, and last of high
    table: np.ndarray  # labeller x class x vote (-1, 0, 1)

    @property
    def prior(self) -> float:
        """P(high)."""
        return float(self.share[-1])

    def classes(self, code) -> np.ndarray:
        v = decode(np.asarray(code, np.int64), len(self.table)) + 1
        z = np.log(self.table[np.arange(len(self.table)), :, v]).sum(1) + np.log(self.share) if len(v) else np.zeros((0, len(self.share)))
        p = np.exp(z - z.max(1, keepdims=True, initial=-np.inf))
        return p / p.sum(1, keepdims=True)

    def posterior(self, code) -> np.ndarray:
        return self.classes(code)[:, -1]

    def accuracy(self) -> np.ndarray:
        """P(vote is right | it votes) by labeller."""
        low = self.share[:-1]
        right = self.table[:, :-1, 0] @ low + self.prior * self.table[:, -1, 2]
        cast = (1 - self.table[:, :, 1]) @ self.share
        return right / np.maximum(cast, 1e-12)


def expectation_maximisation(code: np.ndarray, count: np.ndarray, k: int, rounds: int = 100, tol: float = 1e-7, reasons: tuple[int, ...] | None = None) -> LabelModel:
    """Fit the model of votes that are independent given the class to counts of vote patterns. reasons: by labeller that of its low votes (default: one reason).

    It starts from the belief that any low vote means low with odds of 9 to 1, for a reason of its voters; each pseudo-count is 1.
    """
    v = decode(np.asarray(code, np.int64), k)
    n = np.asarray(count, float)
    why = np.array(reasons if reasons is not None else (0,) * k)
    m = int(why.max(initial=0)) + 1
    hit = np.stack([(v[:, why == r] < 0).sum(1) for r in range(m)], 1) + 1e-3
    high = np.where((v < 0).any(1), 0.1, 0.9)[:, None]
    p = np.hstack([(1 - high) * hit / hit.sum(1, keepdims=True), high])
    share, table = np.full(m + 1, 1 / (m + 1)), np.full((k, m + 1, 3), 1 / 3)
    for _ in range(rounds):
        w = n[:, None] * p
        new = (w.sum(0) + 1) / (n.sum() + m + 1)
        for u in (-1, 0, 1):
            table[:, :, u + 1] = (v == u).T @ w + np.where(u == 0, 1.0, 0.5)
        table = table / table.sum(2, keepdims=True)
        q = LabelModel(new, table).classes(code)
        if np.abs(new - share).max() < tol and np.abs(q - p).max(initial=0) < 1e-5:
            break
        p, share = q, new
    return LabelModel(new, table)


def vote_code():
    """A column function: text -> the code of its votes."""

    @F.arrow_udf("bigint")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = TextStats()
        for texts in batches:
            a = np.array([f(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.array(encode(votes(dict(zip(STATS, a.T)))))

    return code


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float
    bits: int


def fit(docs: DataFrame, *, text: str = "text", key: str = "doc_id", max_train_rows: int = 6000, bits: int = 18, top: int = 1024, l2: float = 1e-3) -> QualityModel:
    """Estimate the labellers over all documents and train the scorer on at most `max_train_rows` of them: rows under the keys of least md5, and of these the ones of least hash of key and text.

    A row counts once however often it is repeated; rows with a null key don't train. Of the 2**bits buckets those
    `top` get weights that tell the soft labels best; the others, and so words seen in none of the sample, have none.
    Patterns are counted in the cluster; at most 3^labellers rows of counts come to the driver. An empty table, or
    one in which all posteriors are alike, gives a scorer that returns the prior.
    """
    k = len(LABELLERS)
    counts = docs.select(vote_code()(quoted(text)).alias("code")).groupBy("code").count().orderBy("code").toArrow()
    model = expectation_maximisation(counts["code"].to_numpy(), counts["count"].to_numpy(), k, reasons=REASONS)
    ids = linear.sample_by_hash(docs.select(quoted(key).alias("_id")).distinct(), "_id", max_train_rows)
    rows = docs.select(quoted(key).alias("_key"), quoted(text).alias("_text")).join(F.broadcast(ids), F.col("_key") == F.col("_id"))  # at most max_train_rows ids
    rows = rows.select("_key", "_text", vote_code()(F.col("_text")).alias("code"))
    got = linear.featured(rows, lambda: Shapes(bits), {"code": "double"}, max_train_rows, 1 << bits)
    y = model.posterior(got["code"].to_numpy().astype(np.int64))
    data = linear.Sparse(got["idx"].to_pylist(), got["val"].to_pylist(), bits)
    cols = data.select(y, top)
    w, b = linear.fit(cols.x, y, l2)
    if not got.num_rows:
        b = float(np.log(model.prior / (1 - model.prior)))
    return QualityModel(model, linear.expand(cols, w, bits), b, bits)


def scorer(model: QualityModel):
    """A column function: text -> probability of high quality, rounded to 6 digits."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = Shapes(model.bits)
        for texts in batches:
            z = np.zeros(len(texts))
            for i, t in enumerate(texts.to_pylist()):
                ids, val = f(t)
                z[i] = val @ model.weights[ids]
            yield pa.array(np.round(linear.sigmoid(z + model.bias), 6))

    return score


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """key, quality_score, keep for every row; a null or empty text has no features and so the scorer's base score. Equal texts score equally. A column that is called like the key gets an underscore."""
    s = docs.select(quoted(key).alias("_k"), scorer(model)(quoted(text)).alias("quality_score"))
    return beside(s.withColumn("keep", F.col("quality_score") >= threshold), "_k", key, ["quality_score", "keep"])


def high(docs: DataFrame, model: QualityModel, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` at or above the threshold, with the columns they came with."""
    p: Column = scorer(model)(quoted(text))
    return docs.where(p >= threshold)
