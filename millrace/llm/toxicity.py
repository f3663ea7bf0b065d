"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over hashed words; each later model also gets the
probabilities of the earlier categories. In training those come from models that did not see the row nor its copies
(out-of-fold), so the later models learn from predictions as good as they will get when scoring. Out-of-fold
probabilities of the last category also fix the threshold from which on a document is rejected.

Where only the last category is labelled, the earlier ones are kinds of its positive documents, found without labels:
the components of a mixture of Bernoulli distributions over their words, fitted by expectation-maximisation. They have
no names; a kind gathers documents that use words in common, such as those of one language.
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
from millrace.llm.features import Words

#: The last category of the chain decides. Earlier ones that aren't columns of the labels are kinds of it.
CHAIN = ("kind_1", "kind_2", "toxic")


@dataclass
class ChainModel:
    categories: tuple[str, ...]
    weights: np.ndarray  # buckets x categories
    bias: np.ndarray
    link: np.ndarray  # link[i, k]: the weight of category i's probability in model k
    bits: int
    threshold: float  # of the last category's probability

    def probabilities(self, ids: np.ndarray, val: np.ndarray) -> np.ndarray:
        z = self.bias + val @ self.weights[ids]
        p = np.empty(len(z))
        for k in range(len(z)):
            p[k] = linear.sigmoid(z[k] + p[:k] @ self.link[:k, k])
        return p


def kinds(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """The likeliest of k components for each row of the 0/1 matrix x, by EM on a Bernoulli mixture.

    It starts from k parts of equal size in the order of the first principal component, whose sign is fixed, so that
    equal rows are of one kind and any run gives the same. Without rows or columns all are of kind 0.
    """
    n, d = x.shape
    if not n or not d:
        return np.zeros(n, int)
    c = x - x.mean(0)
    v = np.linspace(1, 2, d)
    for _ in range(100):
        u = c.T @ (c @ v)
        if (size := np.linalg.norm(u)) < 1e-12:
            break
        v = u / size
    at = c @ (v if v[np.abs(v).argmax()] > 0 else -v)
    p = np.eye(k)[np.searchsorted(np.quantile(at, np.arange(1, k) / k), at, "right")]
    for _ in range(rounds):
        share = (p.sum(0) + 1) / (n + k)
        q = (p.T @ x + 0.5) / (p.sum(0)[:, None] + 1)
        z = np.log(share) + x @ np.log(q).T + (1 - x) @ np.log(1 - q).T
        new = np.exp(z - z.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p.argmax(1)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of 0.05, 0.1 ... 0.95 the one with the fewest errors, the least of equal ones; 0.5 if y has one class only."""
    if not len(y) or y.min() == y.max():
        return 0.5
    grid = np.arange(1, 20) / 20
    return float(grid[np.argmin([((p >= t) != (y > 0.5)).sum() for t in grid])])


def fit_chain(idx: list[bytes], val: list[bytes], labels: dict[str, np.ndarray], fold: np.ndarray, categories, bits: int, top: int, l2: float) -> ChainModel:
    """The chain on rows of hashed features (see linear.packed); labels by category, those of the last one at least; fold: the part that a row is held out with."""
    n, k, last = len(idx), len(categories), categories[-1]
    data = linear.Sparse(idx, val, bits)
    del idx, val
    labels = dict(labels)
    if unlabelled := [c for c in categories if c not in labels]:
        bad = labels[last] > 0.5
        cols = data.select(labels[last], top)
        seen = cols.x > 0
        tells = seen[bad].mean(0) > seen[~bad].mean(0) if bad.any() and not bad.all() else np.zeros(seen.shape[1], bool)
        del cols
        kind = np.full(n, -1)
        kind[bad] = kinds(seen[bad][:, tells].astype(float), len(unlabelled))
        labels |= {c: (kind == i).astype(float) for i, c in enumerate(unlabelled)}
    table, bias, link = np.zeros(((1 << bits) + 1, k), np.float32), np.zeros(k), np.zeros((k, k))
    earlier = np.zeros((n, 0), np.float32)
    for c, name in enumerate(categories):
        y = labels[name]
        cols = data.select(y, top)
        scale = (np.sqrt((earlier**2).mean(0)) + 1e-6).astype(np.float32)  # as the other features
        before = earlier / scale
        w, bias[c] = linear.fit(np.hstack([cols.x, before]), y, l2)
        d, cols.x = cols.x.shape[1], None  # one matrix at a time: this runs in the driver
        table[:, c], link[:c, c] = linear.expand(cols, w[:d], bits), w[d:] / scale
        p = np.full(n, linear.sigmoid(bias[c]), np.float32)
        for f in np.unique(fold):
            held = fold == f
            if not held.all():
                # the buckets are chosen anew without the held-out rows, else their labels would leak
                own = data.select(y, top, ~held)
                x, own = np.hstack([own.x, before]), None
                w, b = linear.fit(x[~held], y[~held], l2)
                p[held] = linear.sigmoid(x[held] @ w + b)
        earlier = np.hstack([earlier, p[:, None]])
    return ChainModel(tuple(categories), table, bias, link, bits, best_threshold(earlier[:, -1], labels[last]))


def training_rows(docs: DataFrame, labels: DataFrame, categories=CHAIN, *, text: str = "text", key: str = "doc_id", max_train_rows: int = 6000, bits: int = 18) -> pa.Table:
    """The at most `max_train_rows` rows that fit() trains on, on the driver: h, fold, idx, val and the labelled categories."""
    last = categories[-1]
    have = [c for c in categories if c in labels.columns]
    lab = labels.where(quoted(last).isNotNull()).groupBy(quoted(key).alias("_id")).agg(*[F.max(F.coalesce(quoted(c).cast("double"), F.lit(0.0))).alias(f"_y_{c}") for c in have])
    lab = linear.sample_by_hash(lab, "_id", max_train_rows)
    rows = docs.select(quoted(key).alias("_key"), quoted(text).alias("_text")).join(F.broadcast(lab), F.col("_key") == F.col("_id"))  # at most max_train_rows labels
    return linear.featured(rows, lambda: Words(bits), {f"_y_{c}": "double" for c in have}, max_train_rows, 1 << bits)


def fit(docs: DataFrame, labels: DataFrame, categories=CHAIN, *, text: str = "text", key: str = "doc_id", max_train_rows: int = 6000, bits: int = 18, top: int = 1024, folds: int = 3, l2: float = 1e-3) -> ChainModel:
    """Fit the chain on at most `max_train_rows` labelled documents: rows under the labelled keys of least md5, and of these the ones of least hash of key and text.

    `labels` has `key` and the last category as a 0/1 column, others too if they are labelled. Rows with a null key or a
    null label of the last category are left out; a null label of another category is 0; of repeated labels the
    greatest counts. A document counts once under a key however often it is repeated, and rows with the same text,
    under whatever key, are held out together. Of the 2**bits buckets those `top` get weights that tell a category best.
    Without any rows all probabilities are 0; with one class only they are its rate.
    """
    got = training_rows(docs, labels, categories, text=text, key=key, max_train_rows=max_train_rows, bits=bits)
    if not got.num_rows:
        k = len(categories)
        return ChainModel(tuple(categories), np.zeros(((1 << bits) + 1, k), np.float32), np.full(k, -30.0), np.zeros((k, k)), bits, 0.5)
    y = {c[3:]: got[c].to_numpy() for c in got.column_names if c.startswith("_y_")}
    packed, fold = [got["idx"].to_pylist(), got["val"].to_pylist()], got["fold"].to_numpy() % folds
    del got
    return fit_chain(packed.pop(0), packed.pop(), y, fold, categories, bits, top, l2)


def scorer(model: ChainModel):
    """A column function: text -> struct of the categories' probabilities, rounded to 6 digits. Null scores as empty."""

    @F.arrow_udf("struct<" + ", ".join(f"`{c}`: double" for c in model.categories) + ">")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = Words(model.bits)
        for texts in batches:
            p = np.array([model.probabilities(*f(t)) for t in texts.to_pylist()]).reshape(-1, len(model.categories)).round(6)
            yield pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(p.shape[1])], names=list(model.categories))

    return score


def score(docs: DataFrame, model: ChainModel, *, text: str = "text", key: str = "doc_id", threshold: float | None = None) -> DataFrame:
    """key, p_<category>..., toxic_flag for every row of `docs`: flagged from `threshold` on (default: the model's) in the last category.

    Equal texts score equally. A column that is called like the key gets an underscore.
    """
    s = docs.select(quoted(key).alias("_k"), scorer(model)(quoted(text)).alias("_p"))
    last = F.col(f"_p.`{model.categories[-1]}`")
    s = s.select("_k", *[F.col(f"_p.`{c}`").alias(f"p_{c}") for c in model.categories], (last >= (model.threshold if threshold is None else threshold)).alias("toxic_flag"))
    return beside(s, "_k", key, s.columns[1:])


def clean(docs: DataFrame, model: ChainModel, *, text: str = "text", threshold: float | None = None) -> DataFrame:
    """The rows of `docs` below the threshold, with the columns they came with."""
    p: Column = scorer(model)(quoted(text))[model.categories[-1]]
    return docs.where(p < (model.threshold if threshold is None else threshold))
