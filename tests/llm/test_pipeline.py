"""The pipeline against brute force, stage by stage, and the subpackage's queries against DuckDB."""

from collections import Counter

import pytest

import corpus_pipeline
from millrace.llm import mixing, packing, quality, queries, simhash, toxicity
from millrace.plans.scratch import materialize
from tests.llm.fixtures import awkward
from tests.llm.test_packing_mixing import check_packing, lengths_of
from tests.llm.test_simhash import brute_fingerprints, groups
from tests.oracle import assert_same, duck


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_against_duckdb(name, spark, sf_dir):
    assert_same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(queries.SQL[name]).df())


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_each_stage_does_what_brute_force_says(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, after = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        after.append(materialize(stage(spark, after[-1], sf_dir), name))
    raw, clean, good, single, mixed, packed = after
    assert all(d.columns == columns for d in after[:-1])

    flags = {r.doc_id: r.toxic_flag for r in toxicity.score(raw, toxicity.fit(raw, labels)).collect()}
    assert bag(clean) == Counter(tuple(r) for r in raw.collect() if not flags[r.doc_id])
    keep = {r.doc_id: r.keep for r in quality.score(clean, quality.fit(clean)).collect()}
    assert bag(good) == Counter(tuple(r) for r in clean.collect() if keep[r.doc_id])

    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    fp = brute_fingerprints([r.text for r in rows])
    near = [(rows[i].doc_id, rows[j].doc_id) for i in range(len(rows)) for j in range(i) if fp[i] is not None and fp[j] is not None and (fp[i] ^ fp[j]).bit_count() <= simhash.RADIUS]
    g = groups(near, [r.doc_id for r in rows])
    assert bag(single) == Counter(tuple(r) for r in rows if g[r.doc_id] == r.doc_id)

    copies = {r.doc_id: r.copies for r in mixing.rates(single).collect()}
    assert bag(mixed) == Counter({tuple(r): copies[r.doc_id] for r in single.collect() if copies[r.doc_id]})
    check_packing(packed.collect(), lengths_of(mixed), packing.CAPACITY)

    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == packed.columns
    assert Counter((r.doc_id, r.tok_start, r.tok_len) for r in whole.collect()) == Counter((r.doc_id, r.tok_start, r.tok_len) for r in packed.collect())


def test_stages_take_awkward_rows(spark, sf_dir, tmp_path):
    spark.createDataFrame([(1, 0, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (awkward(spark), awkward(spark).where("doc_id < 0")):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = bag(docs), materialize(stage(spark, docs, str(tmp_path)), "awkward")
            assert docs.columns == columns
            after = bag(docs)
            assert set(after) <= set(before) and (name == "mixing" or after <= before)
        check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), lengths_of(docs), packing.CAPACITY)
