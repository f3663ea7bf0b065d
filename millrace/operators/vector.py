"""Embedding, cosine top-k retrieval and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import strings
from millrace.functions.vectors import first_copies, k_best, unit_rows
from millrace.operators.backends import Backend, HashBackend, column_call
from millrace.operators.base import Operator, register
from millrace.plans.scratch import materialize


@register("InfinityApiEmbedder", "LiteLLMEmbedding")
class Embedder(Operator):
    """Vectors of the texts that `query` (a column name or SQL expression) gives, by a backend, in batches."""

    def setup(self, query: str = "text", query_prefix: str = "", output_col: str = "_embeddings", batch_size: int = 32, backend: Backend | None = None, query_lambda_col: str | None = None, **options):
        self.query, self.prefix, self.out, self.batch = query_lambda_col or query, query_prefix, output_col, batch_size
        self.backend = backend or HashBackend(**options)

    def embed(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        return df.withColumn(out, column_call(self.backend, "embed", "array<float>", self.batch)(F.concat(F.lit(self.prefix), text)))

    def apply(self, df: DataFrame) -> DataFrame:
        return self.embed(df, F.expr(self.query), self.out)


def build_index(df: DataFrame, path: str, *, id_col: str, text_col: str, vector_col: str, metadata_col: str | None = None, mode: str = "errorifexists") -> None:
    """Write the table that Retriever searches: id, text, embedding, metadata."""
    meta = F.to_json(F.struct(F.col(metadata_col))) if metadata_col else F.lit(None).cast("string")
    df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(vector_col).alias("embedding"), meta.alias("metadata")).write.mode(mode).parquet(path)


def _nearest(k: int, threshold: float | None):
    """A function of Arrow tables (qid, qv) and (xid, xv): the k nearest of the second one's vectors for each of the first one's, ties by xid."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("xid")
        u, x = unit_rows(a["qv"]), unit_rows(b["xv"])
        on, there = (np.flatnonzero(np.isfinite(m).all(1) & (m.shape[1] > 0)) for m in (u, x))
        if len(on) and len(there):
            there = there[first_copies(x[there], k)]
            i, j, score = k_best(u[on], x[there], k, -np.inf if threshold is None else threshold)
        else:
            i, j, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return pa.table({"qid": a["qid"].take(pa.array(on[i])), "xid": b["xid"].take(pa.array(there[j])), "score": score})

    return meet


def top_k(queries: DataFrame, index: DataFrame, *, query_id: str, query_vec: str, index_id: str, index_vec: str, k: int, threshold: float | None = None, block_rows: int | None = None) -> DataFrame:
    """(query_id, index_id, score, rank) of the k nearest by cosine, ties by index id; ranks from 0; exact.

    Queries and index are dealt to blocks of `block_rows`, by default of as many as hold 2^22 numbers, and to more where
    that leaves cores idle. Each block meets each block of the index in numpy and keeps its k best, so k rows per query
    and index block are shuffled, not all pairs. All pairs are multiplied: the time is that of their number. Null and
    zero vectors match nothing.
    """
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("qv")).where("qv IS NOT NULL")
    x = index.select(F.col(index_id).alias("xid"), F.col(index_vec).alias("xv")).where("xv IS NOT NULL")
    (rows_q, dims), (rows_x, _) = (d.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(v)), F.lit(1))).first() for d, v in ((q, "qv"), (x, "xv")))
    most = block_rows or max(1024, (1 << 22) // max(1, dims))
    nq, nx = (max(1, -(-n // most)) for n in (rows_q, rows_x))
    while nq * nx < min(3 * q.sparkSession.sparkContext.defaultParallelism, rows_q * rows_x >> 24):
        nq, nx = (nq + 1, nx) if rows_q / nq >= rows_x / nx else (nq, nx + 1)
    q = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    x = x.withColumn("xb", F.pmod(F.xxhash64("xid"), F.lit(nx)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    qt, xt = q.schema["qid"].dataType.simpleString(), x.schema["xid"].dataType.simpleString()
    got = q.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb")).applyInArrow(_nearest(k, threshold), f"qid {qt}, xid {xt}, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "xid")
    return got.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select(F.col("qid").alias(query_id), F.col("xid").alias(index_id), "score", "rank")


def fit_cells(index: DataFrame, vec: str, index_id: str, n_cells: int, k_best: int, recall: float, sample_rows: int = 20_000, rounds: int = 10) -> tuple[np.ndarray, int]:
    """Unit centres of `n_cells` cells by spherical k-means over at most `sample_rows` vectors, those of least hash of their id; and in how many of a query's nearest cells its k_best neighbours in the sample are found with the given recall, for 200 of the sample."""
    rows = index.where(F.col(vec).isNotNull()).select(F.xxhash64(index_id).alias("h"), F.col(vec).alias("v")).orderBy("h").limit(sample_rows).toPandas()
    if not len(rows):
        return np.zeros((0, 0)), 1
    x = np.stack(rows["v"].to_numpy()).astype(float)
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = x[:n_cells].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        for k in range(len(c)):
            if (on := at == k).any():
                m = x[on].sum(0)
                c[k] = m / max(np.linalg.norm(m), 1e-12)
    q = x[-200:]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, : k_best + 1]  # itself too, which is in the nearest cell
    order = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1, kind="stable")
    at = np.take_along_axis(order, (x @ c.T).argmax(1)[near], axis=1)[:, 1:]
    return c, int(np.quantile(at, recall)) + 1 if at.size else len(c)


def top_k_cells(queries: DataFrame, index: DataFrame, *, query_id: str, query_vec: str, index_id: str, index_vec: str, k: int, threshold: float | None = None, n_cells: int | None = None, probes: int | None = None, recall: float = 0.95, block_rows: int = 8192) -> DataFrame:
    """As top_k, but approximate: each query is compared with the entries of its `probes` nearest cells only (fit_cells).

    Default: as many cells as the root of the number of entries, and as many probes as give `recall` on a sample. The
    cells are fitted on the sample too, but every entry is in the cell of the nearest centre; a cell of more than
    `block_rows` entries is dealt out by the entries' hash, so a frequent cell doesn't come together in one task. Scores
    and ties are those of top_k.
    """
    n = index.count()
    centres, enough = fit_cells(index, index_vec, index_id, n_cells or max(1, int(n**0.5)), k, recall)
    most = max(1, min(len(centres), probes or enough))

    def nearest(m: int):
        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                x = np.array(b.to_pylist(), float).reshape(len(b), -1)
                at = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :m] if len(centres) else np.zeros((len(b), 0))
                yield pa.array(at.tolist(), pa.list_(pa.int32()))

        return run

    x = index.select(F.col(index_id).alias("xid"), F.col(index_vec).alias("xv")).where("xv IS NOT NULL")
    x = materialize(x.withColumn("cell", F.element_at(nearest(1)("xv"), 1)), "cells")
    parts = x.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    x = x.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("xid"), F.col("parts")).cast("int")).drop("parts")
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("qv")).where("qv IS NOT NULL").withColumn("cell", F.explode(nearest(most)("qv")))
    q = q.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    q = q.withColumn("turn", F.pmod(F.xxhash64("qid"), F.lit(16)).cast("int"))
    x = x.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(15))))
    qt, xt = q.schema["qid"].dataType.simpleString(), x.schema["xid"].dataType.simpleString()
    got = q.groupBy("cell", "part", "turn").cogroup(x.groupBy("cell", "part", "turn")).applyInArrow(_nearest(k, threshold), f"qid {qt}, xid {xt}, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "xid")
    return got.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select(F.col("qid").alias(query_id), F.col("xid").alias(index_id), "score", "rank")


@register("QdrantApiRetriever")
class Retriever(Operator):
    """The nearest entries of an index (a path that build_index wrote, or a table) for each row's vector: ranks
    topk_range[0] up to topk_range[1], from similarity_threshold on, appended to `output_col`'s list without repeats of an id. `use_ann` searches by top_k_cells."""

    def setup(self, index, query_id: str = "hash_id", vector_col: str = "_embeddings", topk_range=(0, 5), similarity_threshold: float = 0.5, output_col: str = "retrieved", exact_dedup: bool = True, embedder: Embedder | None = None, use_ann: bool = False):
        self.ann = use_ann
        self.index, self.id, self.vec, self.range, self.threshold, self.out, self.dedup, self.embedder = index, query_id, vector_col, tuple(topk_range), similarity_threshold, output_col, exact_dedup, embedder

    def apply(self, df: DataFrame) -> DataFrame:
        # vectors are written before they are counted, compared and joined, so that no text is embedded twice
        if self.embedder is not None and self.vec not in df.columns:
            df = materialize(self.embedder.embed(df, F.expr(self.embedder.query), self.vec), "embedded")
        index = df.sparkSession.read.parquet(self.index) if isinstance(self.index, str) else materialize(self.index, "index")
        near = (top_k_cells if self.ann else top_k)(df, index, query_id=self.id, query_vec=self.vec, index_id="id", index_vec="embedding", k=self.range[1], threshold=self.threshold)
        near = near.where(F.col("rank") >= self.range[0]).withColumnRenamed("id", "_xid").withColumnRenamed(self.id, "_qid")
        full = near.join(index, near["_xid"] == index["id"]).groupBy("_qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text", "score", "metadata"))).alias("_got"))
        out = df.join(full, df[self.id] == full["_qid"], "left")
        new = F.transform(F.coalesce("_got", F.array().cast(full.schema["_got"].dataType)), lambda r: F.struct(r["id"].alias("id"), r["text"].alias("text"), r["score"].alias("score"), r["metadata"].alias("metadata")))
        if self.out in df.columns:
            new = F.concat(F.coalesce(F.col(self.out), F.array().cast(df.schema[self.out].dataType)), new)
        if self.dedup:
            new = F.filter(new, lambda r, i: F.array_position(F.transform(new, lambda y: y["id"]), r["id"]) == i + 1)
        return out.withColumn(self.out, new).drop("_got", "_qid")


def rerank_slice(scored: Column, k_range: tuple[int, int], threshold: float) -> Column:
    """Of an array of structs with a field score: those strictly above the threshold, best first (equal ones in their
    order), positions k_range[0] up to k_range[1]."""
    indexed = F.transform(scored, lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), x.alias("x")))
    best = F.array_sort(F.filter(indexed, lambda r: -r["s"] > threshold))
    lo, hi = k_range
    return F.transform(F.slice(best, lo + 1, hi - lo), lambda r: r["x"])


@register("InfinityApiReranker")
class Reranker(Operator):
    """Score each row's documents against its query by a backend and keep a slice of the best. query, document,
    metadata: column names or SQL expressions; a backend's failure leaves the row with an empty list and `_error`."""

    def setup(self, query: str = "query", document: str = "documents", metadata: str | None = None, k_range=(1, 5), similarity_threshold: float = 0.5, output_col: str = "reranked", backend: Backend | None = None, **names):
        self.query, self.document = names.pop("query_lambda_col", query), names.pop("document_lambda_col", document)
        self.metadata, self.range, self.threshold, self.out = names.pop("metadata_lambda_col", metadata), tuple(k_range), similarity_threshold, output_col
        self.backend = backend or HashBackend()

    def apply(self, df: DataFrame) -> DataFrame:
        ask = F.to_json(F.struct(F.expr(self.query).alias("query"), F.expr(self.document).alias("documents")))
        df = df.withColumn("_scores", column_call(self.backend, "rerank", "array<double>")(ask))
        docs = F.expr(self.document)
        if self.metadata:
            scored = F.zip_with(F.arrays_zip(docs.alias("text"), F.expr(self.metadata).alias("metadata")), F.col("_scores"), lambda d, s: F.struct(d["text"].alias("text"), s.alias("score"), d["metadata"].alias("metadata")))
        else:
            scored = F.zip_with(docs, F.col("_scores"), lambda d, s: F.struct(d.alias("text"), s.alias("score")))
        return df.withColumn(self.out, rerank_slice(scored, self.range, self.threshold)).drop("_scores")


def similarity(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    return df.withColumn(out, strings.cosine(F.col(a), F.col(b)))
