"""Steps whose memory or time must not grow faster than their input."""

import json
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions import batches, vectors
from millrace.operators import backends, dedup, text, vector


def peak_mb(f):
    tracemalloc.start()
    try:
        got = f()
        return got, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def unit(m):
    return m / np.linalg.norm(m, axis=1)[:, None]


@pytest.mark.parametrize("case", ["apart", "copies", "nearly copies", "few", "from a threshold"])
def test_the_nearest_are_those_of_all_products_in_little_memory(case):
    r = np.random.default_rng(0)
    a, b, least = unit(r.standard_normal((1500, 16))), unit(r.standard_normal((20_000, 16))), -np.inf
    if case == "copies":
        b = np.repeat(b[:100], 200, 0)
    elif case == "nearly copies":
        b = unit(b[:1] + 1e-8 * r.standard_normal((20_000, 16)))
    elif case == "few":
        b = b[:3]
    elif case == "from a threshold":
        least = 0.7
    s = np.round(a @ b.T, 9)
    o = np.argsort(-s, axis=1, kind="stable")[:, :5]
    want = {(i, j, s[i, j]) for i in range(len(a)) for j in o[i].tolist() if s[i, j] >= least}
    got, mb = peak_mb(lambda: vectors.k_best(a, b, 5, least))
    assert set(zip(*(c.tolist() for c in got))) == want
    assert mb < 200  # all products and their order took 960


def test_a_block_of_the_search_keeps_ties_by_id_and_drops_what_is_no_direction():
    v = pa.array([[1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [1.0, 0.0], [None, 1.0], [0.0, 3.0]], pa.list_(pa.float32()))
    got = vector._nearest(2, None)(pa.table({"qid": [7, 8], "qv": v.take(pa.array([0, 2]))}), pa.table({"xid": [5, 4, 3, 2, 1, 0], "xv": v}))
    assert got.to_pylist() == [{"qid": 7, "xid": 2, "score": 1.0}, {"qid": 7, "xid": 4, "score": 1.0}]
    with pytest.raises(ValueError):
        vectors.unit_rows(pa.array([[1.0], [1.0, 2.0]]))


def test_a_search_of_more_vectors_makes_fewer_copies_of_them(spark):
    """Blocks hold as much as tasks can bear: of 8,192 rows each, every vector was shuffled once for every 8,192 others."""
    e = spark.range(200_000).selectExpr("id", "array(cast(id as float)) v").withColumnRenamed("id", "q")
    plan = vector.top_k(e, e.withColumnRenamed("q", "x"), query_id="q", query_vec="v", index_id="x", index_vec="v", k=1)._jdf.queryExecution().analyzed().toString()
    copies = [int(n) for n in re.findall(r"sequence\(0, (\d+)", plan)]
    assert copies and max(copies) + 1 <= 12


@pytest.mark.parametrize("block_rows", [4096, 5])
def test_semantic_dedup_is_a_scan_and_writes_no_pairs(spark, monkeypatch, block_rows):
    """Of 600 rows in 6 places there are some 30,000 pairs; only rows are written."""
    r = np.random.default_rng(3)
    v = r.standard_normal((6, 12))[r.integers(0, 6, 600)] + 0.35 * r.standard_normal((600, 12))
    s, kept = unit(v) @ unit(v).T, []
    for i in range(len(v)):
        if not any(s[i, k] >= 0.85 for k in kept):
            kept.append(i)
    written = []
    real = dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df, name: (written.append(name), real(df, name))[1])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [0.0] * 12)], "id long, v array<float>")
    got = dedup.SemanticDedup(threshold=0.85, embedding_col="v", order_by="id", block_rows=block_rows).apply(df)
    assert sorted(x.id for x in got.collect()) == [*kept, 700, 701]
    assert "pairs" not in written


def test_semantic_dedup_counts_rows_of_one_id_as_one(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert sorted(x.id for x in dedup.SemanticDedup(embedding_col="v", order_by="id").apply(df).collect()) == [1, 1, 2, 4]


def test_what_is_near_is_found_in_little_memory():
    r = np.random.default_rng(4)
    x = unit(r.standard_normal((6000, 16)))
    want = x @ x.T >= 0.8
    pairs, mb = peak_mb(lambda: [np.concatenate(c) for c in zip(*vectors.pairs_from(x, x, 0.8))])
    assert {*zip(*pairs)} == {*zip(*np.nonzero(want))} and mb < 70  # all products take 288
    near, mb = peak_mb(lambda: vectors.near_any(x[:3000], x[3000:], 0.8))
    assert (near == want[:3000, 3000:].any(1)).all() and mb < 70
    assert vectors.near_any(x, np.zeros((0, 0)), 0.8).sum() == 0


def test_batches_are_cut_by_bytes_and_rows():
    a = pa.array(["x" * 10] * 25 + [None, "y" * 500, "z"])
    for most, rows in ((100, None), (1 << 20, 4), (1 << 20, None), (1, None)):
        got = list(batches.pieces([a, a.slice(3, 0), (a, a)], most, rows))
        assert [x for b in got if isinstance(b, pa.Array) for x in b.to_pylist()] == a.to_pylist()
        assert [x for b in got if isinstance(b, tuple) for x in b[1].to_pylist()] == a.to_pylist()
        assert all(len(b) <= (rows or 99) for b in got if isinstance(b, pa.Array))
        assert all(len("".join(filter(None, b.to_pylist()))) < most + 500 for b in got if isinstance(b, pa.Array))
    whole = pa.RecordBatch.from_pydict({"a": a})
    assert pa.Table.from_batches(list(batches.pieces([whole], 64))).to_pydict() == whole.to_pydict()


def texts(n=12_000):
    """A batch of some 36 MB."""
    return pa.array([f"{i} " + ("w" * 600 + " ") * 5 for i in range(n)])


@pytest.mark.parametrize("what, kind", [("embed", "array<float>"), ("score", "double")])
def test_questions_are_put_in_pieces(spark, what, kind):
    t = texts()
    if what == "score":
        t = pa.array([json.dumps([{"role": "user", "content": x}]) for x in t.to_pylist()])
    n, mb = peak_mb(lambda: sum(len(b) for b in backends.column_call(backends.HashBackend(), what, kind).func(iter([t]))))
    assert n == len(t) and mb < 25


def test_texts_are_mapped_in_pieces(spark):
    t = texts()
    n, mb = peak_mb(lambda: sum(len(b) for b in text.map_text(lambda x: x.split(" "), "array<string>").func(iter([t]))))
    assert n == len(t) and mb < 10


def test_texts_are_cut_in_pieces(spark, monkeypatch):
    made = []
    monkeypatch.setattr(text.F, "arrow_udf", lambda kind: lambda f: made.append(f) or (lambda *c: c[0]))
    text.TextSplit(chunk_size=400, chunk_overlap=0).apply(spark.createDataFrame([("a", "b")], "text string, hash_id string"))
    t = pa.array(["one. two. three. " * 60] * 4000)
    one = pa.array([400] * len(t))
    n, mb = peak_mb(lambda: sum(len(b) for b in made[0](iter([(t, one, pa.array([0] * len(t)))]))))
    assert n == len(t) and mb < 6


def test_no_sketch_is_made_for_every_key(spark, tmp_path):
    """Also the same counts as by approx_count_distinct and countDistinct side by side, where flags or keys are null."""
    rows = spark.range(5000).selectExpr("if(id % 50 = 0, null, cast(id % 3 as string)) l_returnflag", "if(id % 7 = 0, null, id * id % 1999) l_partkey")
    rows = rows.unionAll(spark.sql("SELECT 'none', cast(null as long)"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.approx_distinct(spark, str(tmp_path))
    g = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("n"))
    want = g.select("l_returnflag", (F.abs(F.col("a") - F.col("n")) < 0.2 * F.col("n")).alias("near"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5
    keys = [line for line in got._jdf.queryExecution().sparkPlan().toString().split("\n") if "approx_count_distinct(" in line]
    assert keys and not any(re.search(r"keys=\[[^\]]*l_partkey", line) for line in keys)
