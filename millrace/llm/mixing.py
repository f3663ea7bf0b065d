"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r, the expected number of its copies. Among all rates that meet the token constraints those
are chosen that stay nearest to 1 in relative entropy over tokens: minimise sum t (r log r - r + 1). Their form is
r = exp(sum of multipliers of the constraints the document is in); the multipliers minimise a convex dual, by Newton
steps whose gradient and Hessian are aggregated in the cluster. Constraints: the tokens of each source; the tokens of
each language; the token-weighted mean of log length. Rates are then rounded at random to whole copies.

Sums by source and language come to the driver in each step, so their number, not that of documents, is bounded by its
memory: about 10^6 fit a gigabyte. The Hessian is solved by blocks; its part over sources is diagonal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import quoted, unused
from millrace.llm import tokens
from millrace.plans.scratch import materialize

NONE = "\x00"  # stands for a null source or language
TEMPERATURE, SEED = 0.5, 20
#: Up to so many sources their multipliers are broadcast; beyond, the join is left to the engine.
BROADCAST_ROWS = 10_000


@dataclass
class Balance:
    source: dict[str, float]  # multiplier by source; sources that aren't here have rate 0
    lang: dict[str, float]
    length: float
    mean_log: float
    rounds: int
    converged: bool

    def exponent(self, df: DataFrame, source: Column, lang: Column, n_tokens: Column) -> tuple[DataFrame, Column]:
        """`df` with the log of each row's rate, null for a source without target; null lengths count as 0."""
        s, m, la, w = unused(df.columns, "_source", "_of_source", "_lang", "_of_lang")
        for names, values, at in (((s, m), self.source, source), ((la, w), self.lang, lang)):
            small = df.sparkSession.createDataFrame(pd.DataFrame({names[0]: pd.Series(list(values), dtype=str), names[1]: pd.Series(list(values.values()), dtype=float)}), f"`{names[0]}` string, `{names[1]}` double")
            df = df.join(F.broadcast(small) if len(values) <= BROADCAST_ROWS else small, F.coalesce(at, F.lit(NONE)) == F.col(names[0]), "left")
        z = F.ln(F.coalesce(n_tokens, F.lit(0)).cast("double") + 1) - self.mean_log
        return df.drop(s, la).withColumn(m, F.col(m) + F.coalesce(F.col(w), F.lit(0.0)) + self.length * z).drop(w), F.col(m)

    def rated(self, df: DataFrame, source: Column, lang: Column, n_tokens: Column, out: str) -> DataFrame:
        df, z = self.exponent(df, source, lang, n_tokens)
        return df.withColumn(out, F.coalesce(F.round(F.exp(z), 6), F.lit(0.0))).drop(z)


def measured(docs: DataFrame, columns: list[str] | None = None, *, text: str = "text", n_tokens: Column | None = None, vocabulary: str = tokens.VOCABULARY) -> tuple[DataFrame, str, str]:
    """The written table of `columns` (default: all) with each row's number of tokens and a hash of its text, and these two columns' names. All that follows reads it, so texts are tokenised once."""
    columns = docs.columns if columns is None else list(dict.fromkeys(columns))
    n, h = unused(columns, "n_tokens", "_text_hash")
    made = tokens.count(vocabulary)(quoted(text)) if n_tokens is None else F.coalesce(n_tokens, F.lit(0)).cast("long")
    return materialize(docs.select(*map(quoted, columns), made.alias(n), F.xxhash64(quoted(text)).alias(h)), "measured"), n, h


def _cells(stats: DataFrame, b: Balance) -> pd.DataFrame:
    """By source and language: sums of t r, t r z and t r z^2."""
    d, e = b.exponent(stats, F.col("source"), F.col("lang"), F.col("n_tokens"))
    r = F.col("n") * F.col("n_tokens") * F.exp(e)
    z = F.ln(F.col("n_tokens").cast("double") + 1) - b.mean_log
    return d.groupBy("source", "lang").agg(F.sum(r).alias("m0"), F.sum(r * z).alias("m1"), F.sum(r * z * z).alias("m2")).toPandas()


def balance(rows: DataFrame, targets: dict[str, float] | None = None, *, n_tokens: str = "n_tokens", source: str = "source", lang: str = "lang", lang_targets: dict[str, float] | None = None, total: float | None = None, temperature: float = TEMPERATURE, max_rounds: int = 25, tol: float = 1e-9) -> Balance:
    """Multipliers for which source s gets the share targets[s] of `total` tokens (default: as many as there are). `rows` is what measured() wrote.

    Without targets each source gets a share in proportion to its tokens to the power `temperature`. Languages get
    lang_targets, or keep their shares among the sources with a target; a language among these that lang_targets lacks,
    or gives no positive share, is an error. Targets of sources without tokens are left out and the others scaled up.
    A null source or language is one of its own, named None in targets. Documents are first counted by source, language
    and length: Newton's sums run over these counts. Targets that can't be met together end with converged = False and
    the nearest rates found. An empty table gives no multipliers.
    """
    d = rows.select(F.coalesce(quoted(source), F.lit(NONE)).alias("source"), F.coalesce(quoted(lang), F.lit(NONE)).alias("lang"), quoted(n_tokens).alias("n_tokens")).where("n_tokens > 0")
    stats = materialize(d.groupBy("source", "lang", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "lengths")
    t = F.col("n") * F.col("n_tokens")
    by = stats.groupBy("source", "lang").agg(F.sum(t).alias("t"), F.sum(t * F.ln(F.col("n_tokens").cast("double") + 1)).alias("tl")).toPandas()
    have = by.groupby("source").t.sum().to_dict()
    want = dict(targets) if targets is not None else {s: float(v) ** temperature for s, v in have.items()}
    want = {(NONE if s is None else s): float(w) for s, w in want.items() if w > 0 and have.get(NONE if s is None else s, 0) > 0}
    if not want:
        return Balance({}, {}, 0.0, 0.0, 0, targets is None or not targets)
    by = by[by.source.isin(want)]
    all_t = float(by.t.sum())
    total = float(total if total is not None else all_t)
    sources, langs = sorted(want), sorted(set(by.lang))
    scale = sum(want.values())
    goal_l = np.array([float(by.t[by.lang == x].sum()) for x in langs]) / all_t
    if lang_targets:
        share = {(NONE if k is None else k): float(v) for k, v in lang_targets.items()}
        if lacking := [x for x in langs if not share.get(x, 0) > 0]:
            raise ValueError(f"no positive target for the languages {[None if x == NONE else x for x in lacking]}")
        goal_l = np.array([share[x] for x in langs]) / sum(share[x] for x in langs)
    goal_s = np.array([want[s] / scale for s in sources])
    goal = np.concatenate([goal_s, goal_l, [0.0]])  # the last, of log length, is centred on its own mean
    mean_log = float(by.tl.sum()) / all_t
    lam = np.concatenate([np.log(goal_s * total / np.array([float(have[s]) for s in sources])), np.zeros(len(langs) + 1)])
    ns, nl = len(sources), len(langs)
    s_at, l_at = ({x: i for i, x in enumerate(v)} for v in (sources, langs))
    used = F.broadcast if ns <= BROADCAST_ROWS else (lambda x: x)
    stats = stats.join(used(rows.sparkSession.createDataFrame([(s,) for s in sources], "source string")), "source", "left_semi")

    def made(v: np.ndarray, rounds: int = 0, converged: bool = False) -> Balance:
        return Balance(dict(zip(sources, map(float, v[:ns]))), dict(zip(langs, map(float, v[ns:-1]))), float(v[-1]), mean_log, rounds, converged)

    def at_point(v: np.ndarray):
        """The dual, its gradient, and the Hessian's blocks: sources (diagonal), sources by the rest, the rest."""
        c = _cells(stats, made(v))
        i, j = c.source.map(s_at).to_numpy(), c.lang.map(l_at).to_numpy()
        m0, m1, m2 = (c[k].to_numpy(float) for k in ("m0", "m1", "m2"))
        one = np.bincount(i, m0, ns), np.bincount(j, m0, nl)
        side = np.zeros((ns, nl + 1))
        np.add.at(side, (i, j), m0)
        side[:, nl] = np.bincount(i, m1, ns)
        rest = np.diag(np.append(one[1], m2.sum()))
        rest[nl, :nl] = rest[:nl, nl] = np.bincount(j, m1, nl)
        g = np.concatenate([*one, [m1.sum()]]) / total - goal
        return m0.sum() / total - v @ goal, g, (one[0] / total, side / total, rest / total)

    def solve(h, g: np.ndarray) -> np.ndarray:
        """-H^-1 g. Sources and languages both sum to the total: one direction is flat."""
        diag, side, rest = h
        inv = 1 / np.maximum(diag, 1e-300)
        low = np.linalg.lstsq(rest - side.T @ (inv[:, None] * side), -g[ns:] + side.T @ (inv * g[:ns]), rcond=1e-10)[0]
        return np.concatenate([inv * (-g[:ns] - side @ low), low])

    f, g, h = at_point(lam)
    rounds = 0
    while np.abs(g).max() > tol and rounds < max_rounds:
        rounds += 1
        step, a = solve(h, g), 1.0
        while a > 1e-4:
            f2, g2, h2 = at_point(lam + a * step)
            if np.isfinite(f2) and f2 <= f + 1e-4 * a * (g @ step) + 1e-12:
                break
            a /= 2
        else:
            break
        lam, f, g, h = lam + a * step, f2, g2, h2
    return made(lam, rounds, bool(np.abs(g).max() <= max(tol, 1e-6)))


def copies(rate: Column, *parts: Column) -> Column:
    """Whole copies whose expectation is the rate: a hash of `parts`, so of the row alone, decides on the fraction."""
    u = F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 32)).cast("double") / float(1 << 32)
    return F.floor(rate + u).cast("int")


def rates(docs: DataFrame, targets: dict[str, float] | None = None, *, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", n_tokens: Column | None = None, vocabulary: str = tokens.VOCABULARY, **options) -> DataFrame:
    """key, source, lang, n_tokens, rate, copies for every row; `targets` and `options` go to balance().

    Rows without tokens (a null or empty text) have the rate of their source and language at length 0; rows of a source
    without a target have rate 0. Repeated rows have equal copies. A column that is called like one before it gets an
    underscore.
    """
    rows = docs.select(quoted(key).alias("_k"), quoted(source).alias("_s"), quoted(lang).alias("_l"), quoted(text).alias("_t"), (F.lit(None) if n_tokens is None else n_tokens).alias("_n"))
    rows, n, h = measured(rows, ["_k", "_s", "_l"], text="_t", n_tokens=None if n_tokens is None else F.col("_n"), vocabulary=vocabulary)
    b = balance(rows, targets, n_tokens=n, source="_s", lang="_l", **options)
    d = b.rated(rows, F.col("_s"), F.col("_l"), F.col(n), "rate").withColumn("copies", copies(F.col("rate"), F.col("_k"), F.col(h)))
    names = unused([], key, source, lang, n, "rate", "copies")
    return d.select(*[F.col(c).alias(o) for c, o in zip(("_k", "_s", "_l", n, "rate", "copies"), names)])


def mix(docs: DataFrame, targets: dict[str, float] | None = None, *, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", n_tokens: Column | None = None, vocabulary: str = tokens.VOCABULARY, **options) -> DataFrame:
    """Every row of `docs` as often as its copies say (see rates()), with the columns it came with, whatever their names."""
    rows, n, h = measured(docs, text=text, n_tokens=n_tokens, vocabulary=vocabulary)
    b = balance(rows, targets, n_tokens=n, source=source, lang=lang, **options)
    rate, c, turn = unused(rows.columns, "_rate", "_copies", "_turn")
    some = b.rated(rows, quoted(source), quoted(lang), F.col(n), rate).withColumn(c, copies(F.col(rate), quoted(key), F.col(h))).where(F.col(c) > 0)
    return some.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(c)))).drop(n, h, rate, c, turn)
