import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, linear, quality, queries, toxicity
from millrace.llm.features import STATS, Shapes, TextStats, Words
from tests.llm.fixtures import awkward, documents, prose


@pytest.fixture(scope="module")
def sf(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# toxicity


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.fit(docs, labels.where("doc_id % 2 = 0"))).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    bad = [r for r in got if r.toxic]
    assert sum(r.toxic_flag for r in bad) >= 0.9 * len(bad) > 0
    assert sum(r.toxic_flag for r in got if not r.toxic) <= 0.005 * len(got)


def brute_chain(model, text):
    """Probabilities one category after the other, from the weights by bucket."""
    ids, val = Words(model.bits)(text)
    p = []
    for k in range(len(model.categories)):
        z = model.bias[k] + sum(float(v) * float(model.weights[i, k]) for i, v in zip(ids, val)) + sum(model.link[i, k] * p[i] for i in range(k))
        p.append(1 / (1 + np.exp(-min(30, max(-30, z)))))
    return p


def test_toxicity_query_scores_every_document_by_the_chain(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op3_toxicity(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(text.keys())
    for r in got:
        assert np.allclose([r.p_kind_1, r.p_kind_2, r.p_toxic], brute_chain(m, text[r.doc_id]), atol=1e-4)
        assert r.toxic_flag == (r.p_toxic >= m.threshold)


def newton(x, y, l2):
    """L2-regularised logistic regression without a penalty on the bias, to the optimum."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    pen = np.append(np.full(x.shape[1] - 1, l2), 0.0)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(pen + 1e-12)
        w -= np.linalg.solve(h, x.T @ (p - y) / len(y) + pen * w)
    return w


def telling(x, y, top):
    """The columns that differ most between the classes, by the statistic's definition."""
    t = np.zeros(x.shape[1])
    seen = x[x > 0]
    floor = np.median(seen) ** 2 / len(x)
    p, q = y.sum(), (1 - y).sum()
    for j in range(x.shape[1]):
        if (x[:, j] > 0).sum() < 2:
            continue
        a, b = x[y == 1, j], x[y == 0, j]
        t[j] = abs(a.mean() - b.mean()) / np.sqrt(a.var() / p + b.var() / q + floor / p + floor / q + 1e-12)
    best = np.sort(np.argsort(-t, kind="stable")[:top])
    return best[t[best] > 0]


def test_the_chain_is_what_brute_force_fits(spark):
    """Selection, folds, out-of-fold probabilities, links and threshold, from dense matrices and Newton steps."""
    r = np.random.default_rng(4)
    rude, vile = r.random(240) < 0.4, r.random(240) < 0.3
    toxic = (rude & (r.random(240) < 0.8)) | vile
    texts = [prose(i // 2, 12) + " grump" * int(a) + " vile" * int(b) for i, (a, b) in enumerate(zip(rude, vile))]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    labels = table(spark, [(i, int(a), int(t)) for i, (a, t) in enumerate(zip(rude, toxic))], "doc_id long, rude int, toxic int")
    m = toxicity.fit(docs, labels, ("rude", "toxic"), bits=9, top=12, l2=0.05)
    x = np.zeros((240, 512))
    for i, t in enumerate(texts):
        ids, val = Words(9)(t)
        np.add.at(x[i], ids[ids < 512], val[ids < 512])
    fold = np.array([zlib.crc32(t.encode()) for t in texts]) % 3
    earlier, want = np.zeros((240, 0)), []
    for y in (rude.astype(float), toxic.astype(float)):

        def fitted(on, before=earlier, y=y):
            cols = telling(x[on], y[on], 12)
            both = np.hstack([x[:, cols] / np.sqrt((x[on][:, cols] ** 2).mean(0)), before / (np.sqrt((before**2).mean(0)) + 1e-6)])
            return both, newton(both[on], y[on], 0.05)

        full, w = fitted(np.ones(240, bool))
        held = np.zeros(240)
        for f in range(3):
            both, v = fitted(fold != f)
            held[fold == f] = (1 / (1 + np.exp(-(both @ v[:-1] + v[-1]))))[fold == f]
        want.append((full, w, earlier))
        earlier = np.column_stack([earlier, held])
    # scoring feeds the models' own probabilities, not those held out
    p1 = 1 / (1 + np.exp(-(want[0][0] @ want[0][1][:-1] + want[0][1][-1])))
    full, w, before = want[1]
    full[:, -1] = p1 / (np.sqrt((before[:, 0] ** 2).mean()) + 1e-6)
    p2 = 1 / (1 + np.exp(-(full @ w[:-1] + w[-1])))
    got = toxicity.score(docs, m).orderBy("doc_id").collect()
    assert np.abs(np.array([r.p_rude for r in got]) - p1).max() < 0.02 and np.abs(np.array([r.p_toxic for r in got]) - p2).max() < 0.02
    errors = {t: ((earlier[:, 1] >= t) != toxic).sum() for t in np.arange(1, 20) / 20}
    assert errors[m.threshold] <= min(errors.values()) + 1 and abs(m.link[0, 1]) > 0


def test_kinds_are_those_that_share_words():
    r = np.random.default_rng(1)
    kind = r.random(200) < 0.5
    x = (r.random((200, 30)) < np.where(kind[:, None] == (np.arange(30) < 15), 0.6, 0.05)).astype(float)
    got = toxicity.kinds(x, 2)
    assert max((got == kind).mean(), (got != kind).mean()) > 0.98 and (got == toxicity.kinds(x, 2)).all()
    assert len(toxicity.kinds(np.zeros((0, 3)), 2)) == 0 and not toxicity.kinds(np.ones((4, 0)), 2).any()
    assert len(set(toxicity.kinds(np.ones((6, 3)), 2))) == 1


def test_out_of_fold_probabilities_do_not_see_their_row():
    """With features that name the row, in-sample probabilities tell the label and held-out ones don't: the link must stay small."""
    n = 90
    y = np.array([i % 2 for i in range(n)], float)
    idx = [np.array([i], np.int32).tobytes() for i in range(n)]
    val = [np.array([1], np.float32).tobytes() for _ in range(n)]
    m = toxicity.fit_chain(idx, val, {"a": y, "b": y}, np.arange(n) % 3, ("a", "b"), 8, 64, 1e-3)
    assert abs(m.link[0, 1]) < 1


def test_training_rows_are_bounded_and_copies_share_a_fold(spark):
    same = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    other = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    copies = spark.range(300).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("copy "), (F.col("id") % 100).cast("string")).alias("text"))
    docs = same.unionAll(other).unionAll(copies)
    labels = docs.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = toxicity.training_rows(docs, labels, max_train_rows=200)
    assert 100 < got.num_rows <= 200 and len(set(got["h"].to_pylist())) == got.num_rows
    whole = toxicity.training_rows(docs, labels, max_train_rows=10_000)
    assert whole.num_rows == 1 + 500 + 300
    folds = {}
    for i, v, f in zip(*(whole[c].to_pylist() for c in ("idx", "val", "fold"))):
        folds.setdefault((i, v), set()).add(f)
    assert max(map(len, folds.values())) == 1
    ids = linear.sample_by_hash(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", 200)
    rows = docs.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"), F.lit(1.0).alias("code")).join(ids, F.col("_key") == F.col("_id"))
    few = linear.featured(rows, lambda: Shapes(18), {"code": "double"}, 10, 1 << 18)
    every = linear.featured(rows.repartition(3), lambda: Shapes(18), {"code": "double"}, 10_000, 1 << 18)
    assert few.num_rows == 10 and few["h"].to_pylist() == sorted(every["h"].to_pylist())[:10]


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = table(spark, [(1, 1, "q"), (1, 0, "q"), (2, 0, "q"), (3, None, "q"), (5, 0, None), (None, 1, "q"), (8, 0, "q")], "doc_id long, toxic int, _p string")
    m = toxicity.fit(docs, labels)
    got = toxicity.score(docs, m).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert len({(r.p_toxic, r.toxic_flag) for r in got if r.doc_id in (2, 3, 4)}) == 1
    kept = toxicity.clean(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic_flag for r in got)
    none = toxicity.fit(documents(spark), labels)
    assert toxicity.score(docs, none).where("toxic_flag").count() == 0 and toxicity.score(documents(spark), none).count() == 0
    named = docs.toDF("_key", "_p", "toxic", "p_toxic", "_text", "_h", "_id")
    same = toxicity.fit(named, labels.withColumnRenamed("doc_id", "_key"), text="_p", key="_key")
    assert np.array_equal(same.weights, m.weights)
    assert toxicity.clean(named, same, text="_p").columns == named.columns
    assert toxicity.score(docs.withColumnRenamed("doc_id", "p_toxic"), m, key="p_toxic").columns == ["p_toxic", "p_kind_1", "p_kind_2", "p_toxic_", "toxic_flag"]


def test_categories_may_be_labelled(spark):
    rows = [(i, prose(i, 30) + (" vile grim" if i % 4 == 0 else " vile" if i % 2 == 0 else ""), "en", "a") for i in range(80)]
    docs = documents(spark, rows)
    labels = table(spark, [(i, int(i % 2 == 0), int(i % 4 == 0)) for i in range(80)], "doc_id long, rude int, toxic int")
    m = toxicity.fit(docs, labels, ("rude", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(docs, m, threshold=0.5).collect()}
    assert all((got[i].p_rude > 0.5) == (i % 2 == 0) and got[i].toxic_flag == (i % 4 == 0) for i in range(80))


# quality


def brute_em(votes, rounds, reasons=None):
    """EM over single documents, with a class for each reason for low and one for high."""
    n, k = votes.shape
    why = np.array(reasons or (0,) * k)
    hit = np.array([[(x[why == r] < 0).sum() + 1e-3 for r in range(why.max() + 1)] for x in votes])
    high = np.where((votes < 0).any(1), 0.1, 0.9)
    p = np.column_stack([(1 - high)[:, None] * hit / hit.sum(1)[:, None], high])
    for _ in range(rounds):
        like = np.tile((p.sum(0) + 1) / (n + p.shape[1]), (n, 1))
        for j in range(k):
            for c in range(p.shape[1]):
                t = np.array([p[votes[:, j] == u, c].sum() + (1.0 if u == 0 else 0.5) for u in (-1, 0, 1)])
                like[:, c] *= (t / t.sum())[votes[:, j] + 1]
        p = like / like.sum(1)[:, None]
    return p[:, -1]


def test_label_model_equals_em_by_document():
    r = np.random.default_rng(2)
    truth = r.random(800) < 0.8
    acc = np.array([0.95, 0.9, 0.8, 0.6])
    v = np.where(r.random((800, 4)) < acc, truth[:, None] * 2 - 1, 1 - truth[:, None] * 2)
    v[r.random((800, 4)) < 0.3] = 0
    code, count = np.unique(quality.encode(v), return_counts=True)
    m = quality.expectation_maximisation(code, count, 4, rounds=40, tol=0)
    assert np.allclose(m.posterior(quality.encode(v)), brute_em(v, 40), atol=2e-3)
    assert np.abs(m.accuracy() - acc).max() < 0.08
    assert np.array_equal(quality.decode(quality.encode(v), 4), v)


def test_quality_against_labels_that_it_does_not_see(spark, sf):
    docs, labels = sf
    got = quality.score(docs, quality.fit(docs))
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_the_quality_query_is_what_brute_force_trains(spark, sf_dir):
    """EM over single documents, then the scorer by Newton steps on its posteriors, for every document of the query's table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted({(r.doc_id, r.text) for r in docs.collect()})
    f, g = TextStats(), Shapes(18)
    v = quality.votes(dict(zip(STATS, np.array([f(t) for _, t in rows]).T)))
    y = brute_em(v.astype(int), 100, quality.REASONS)
    x = np.zeros((len(rows), 1 << 18), np.float32)
    for i, (_, t) in enumerate(rows):
        ids, val = g(t)
        np.add.at(x[i], ids, val)
    on = np.flatnonzero((x > 0).sum(0) >= 2)
    x = x[:, on].astype(float)
    p, q = y.sum(), (1 - y).sum()
    m1, m0 = y @ x / p, (1 - y) @ x / q
    s1, s0 = y @ x**2 / p - m1**2, (1 - y) @ x**2 / q - m0**2
    got = {r.doc_id: r for r in queries.op1_quality_classifier(spark, sf_dir).collect()}
    assert set(got) == {i for i, _ in rows}
    floor = np.median(np.concatenate([np.frombuffer(linear.packed(*g(t), 1 << 18)[1], np.float32) for _, t in rows])) ** 2 / len(rows)
    t = np.abs(m1 - m0) / np.sqrt(np.maximum(s1, 0) / p + np.maximum(s0, 0) / q + floor / p + floor / q + 1e-12)
    best = np.argsort(-t, kind="stable")[:1024]
    x = x[:, best] / np.sqrt((x[:, best] ** 2).mean(0))
    w = newton(x, y, 1e-3)
    want = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    have = np.array([got[i].quality_score for i, _ in rows])
    assert np.corrcoef(have, want)[0, 1] > 0.97 and ((have >= 0.5) == (want >= 0.5)).mean() > 0.98
    assert all(r.keep == (r.quality_score >= 0.5) for r in got.values())


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    m = quality.fit(docs)
    got = quality.score(docs, m).collect()
    assert len(got) == docs.count() and len({r.quality_score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert quality.score(docs.withColumnRenamed("doc_id", "quality_score"), m, key="quality_score").columns == ["quality_score", "quality_score_", "keep"]
    named = docs.toDF("_id", "code", "_key", "_text", "_h", "h", "idx")
    assert np.array_equal(quality.fit(named, text="code", key="_id").weights, m.weights)
    kept = quality.high(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    none = quality.fit(documents(spark))
    assert quality.score(documents(spark), none).count() == 0 and quality.score(docs, none).count() == docs.count()


def test_signs_of_scripts_without_spaces_are_words():
    ids, val = Words(18)("你好，世界 ok")
    assert len(set(ids.tolist()) - {1 << 18}) == 5 and len(val) == 4 * 6  # the comma by itself is no word
    assert np.array_equal(Words(18)("Ünïcode wörds")[0], Words(18)("ünïcode  wörds")[0])


def test_sparse_selection_finds_the_columns_that_tell():
    r = np.random.default_rng(0)
    y = (r.random(300) < 0.5).astype(float)
    pairs = [linear.packed(np.array([3 if t else 5, *r.integers(8, 250, 6), 256], np.int32), np.ones(8, np.float32), 256) for t in y]
    data = linear.Sparse([p[0] for p in pairs], [p[1] for p in pairs], 8)
    c = data.select(y, 2)
    assert list(c.ids) == [3, 5]
    w, b = linear.fit(c.x, y, 1e-3)
    assert (((c.x @ w + b) > 0) == (y > 0)).all()
    ids, val = linear.packed(np.array([7, 2, 7, 256]), np.array([1, 2, 3, 9], np.float32), 256)
    assert np.frombuffer(ids, np.int32).tolist() == [2, 7] and np.frombuffer(val, np.float32).tolist() == [2, 4]


# language


def brute_language(docs, k=langid.TOP):
    def grams(text):
        s = "".join(c if c.isalpha() else "_" for c in (text or "").lower())
        s = "_" + s + "_"
        while "__" in s:
            s = s.replace("__", "_")
        return Counter(g for n in (1, 2, 3) for i in range(len(s) - n + 1) if "_" not in (g := s[i : i + n])[1:-1] and g != "_") if len(s) > 2 else Counter()

    first = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k]]
    total = {}
    for r in docs:
        if r.lang is not None and r.doc_id is not None:
            total.setdefault(r.lang, Counter()).update(grams(r.text))
    prof = {la: {g: i for i, g in enumerate(first(c))} for la, c in total.items() if c}
    out = []
    for r in docs:
        g = first(grams(r.text))
        d = sorted((sum(abs(p[x] - i) if x in p else k for i, x in enumerate(g)), la) for la, p in prof.items())
        out.append((r.doc_id, d[0][1], d[0][0], d[1][0] - d[0][0]) if g else (r.doc_id, None, None, None))
    return out


def test_language_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [tuple(r) for r in langid.identify(docs, langid.profiles(docs)).collect()]
    assert sorted(got) == sorted(brute_language(docs.collect()))


def test_language_accuracy(sf):
    docs, _ = sf
    got = langid.identify(docs, langid.profiles(docs, per_lang=40)).join(docs, "doc_id").where("n_chars > 40").collect()
    assert sum(r.pred_lang == r.lang for r in got) >= 0.98 * len(got)


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    prof = langid.profiles(docs)
    got = langid.identify(docs, prof).collect()
    assert len(got) == docs.count() and set(prof) == {"en", "de"}  # the French row has no key
    assert all((r.pred_lang, r.distance, r.margin) == (None, None, None) for r in got if r.doc_id in (2, 3, 4, 7))
    one = langid.identify(docs, {"en": prof["en"]}).where("doc_id = 8").first()
    assert one.pred_lang == "en" and one.margin is None
    assert langid.identify(docs, {}).where("pred_lang IS NOT NULL").count() == 0
    assert langid.identify(documents(spark), prof).count() == 0 and langid.profiles(documents(spark)) == {}
    tie = langid.identify(docs, {"b": prof["en"], "a": prof["en"]}).where("doc_id = 1").first()
    assert tie.pred_lang == "a" and tie.margin == 0
