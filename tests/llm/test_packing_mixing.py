import random
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, queries, tokens
from tests.llm.fixtures import awkward, documents, prose


def check_packing(rows, lengths, capacity):
    """Every token once, no sequence over its capacity, pieces side by side from 0 on. lengths: list of (key, tokens)."""
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.seq_id].append((r.slot, r.seq_offset, r.tok_len))
        pieces[r.doc_id].append((r.tok_start, r.tok_len))
    for s in seqs.values():
        at = 0
        for k, (slot, offset, n) in enumerate(sorted(s)):
            assert (slot, offset) == (k, at) and n > 0
            at += n
        assert at <= capacity
    want = defaultdict(Counter)
    for k, n in lengths:
        for at in range(0, n, capacity):
            want[k][at, min(capacity, n - at)] += 1
    assert {k: Counter(v) for k, v in pieces.items()} == {k: v for k, v in want.items() if v}
    return len(seqs)


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - s)
    return len(gaps)


def by_rounds(sizes, capacity):
    """The rule one piece and one gap at a time: (piece, sequence, slot, offset) of pieces by index; equal ones go in order."""
    left = sorted(range(len(sizes)), key=lambda i: (sizes[i], -i))  # the largest last, of equal ones the first
    gaps, placed, n = [], [], 0
    while left and 2 * sizes[left[-1]] > capacity:
        i = left.pop()
        placed.append((i, n, 0, 0))
        gaps.append([capacity - sizes[i], n, 1])
        n += 1
    volume = sum(sizes[i] for i in left)
    new = -(-max(0, volume - sum(g for g, *_ in gaps)) // capacity)
    while left:
        gaps += [[capacity, n + k, 0] for k in range(new)]
        n += new
        any_ = False
        for g in sorted(gaps, key=lambda g: g[:2]):
            at = bisect_right(left, g[0], key=lambda i: sizes[i])
            if at:
                i = left.pop(at - 1)
                placed.append((i, g[1], g[2], capacity - g[0]))
                g[0], g[2], any_ = g[0] - sizes[i], g[2] + 1, True
        new = 0 if any_ else -(-sum(sizes[i] for i in left) // capacity)
    return placed


@pytest.mark.parametrize("capacity,mean", [(256, 60), (64, 40), (100, 3), (7, 3), (1, 1)])
def test_the_plan_is_what_single_pieces_and_gaps_do(capacity, mean):
    r = random.Random(capacity)
    sizes = [min(capacity, 1 + int(r.expovariate(1 / mean))) for _ in range(400)]
    steps = packing.plan(Counter(sizes), capacity)
    rank, got = Counter(), {}
    for i, s in enumerate(sizes):
        row = next(x for x in steps if x[0] == s and x[1] <= rank[s] < x[2])
        got[i] = (row[3] + rank[s] - row[1], row[4], row[5])
        rank[s] += 1
    assert got == {i: tuple(x) for i, *x in by_rounds(sizes, capacity)}
    assert len(packing.plan({}, capacity)) == 0


def test_the_plan_is_small_and_fills_sequences():
    r = random.Random(1)
    counts = Counter(min(2048, max(1, int(r.lognormvariate(6, 1)))) for _ in range(300_000))
    counts = {s: n * 10**6 for s, n in counts.items()}  # 3 * 10^11 pieces
    steps = packing.plan(counts, 2048)
    assert len(steps) < 40_000
    by = Counter()
    for s, lo, hi, *_ in steps:
        by[s] += hi - lo
    assert by == Counter(counts)
    assert sum(s * n for s, n in counts.items()) > 0.995 * 2048 * max(x[3] + x[2] - x[1] for x in steps)


def lengths_of(docs):
    """Keys and numbers of tokens, by the tokenizer's library itself."""
    enc = tokens.load(tokens.VOCABULARY)
    return [(r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in docs.collect()]


@pytest.mark.parametrize("parts", [1, 13])
def test_packing_is_whole_close_to_best_fit_and_the_same_however_divided(spark, parts):
    r = random.Random(3)
    lengths = [(i, min(900, int(r.expovariate(1 / 60)))) for i in range(400)]
    docs = spark.createDataFrame([(i, f"w{i}", n) for i, n in lengths], "doc_id long, text string, n long").repartition(parts)
    got = packing.pack(docs, capacity=256, n_tokens=F.col("n")).collect()
    n = check_packing(got, lengths, 256)
    full = sum(k // 256 for _, k in lengths)
    best = full + best_fit_decreasing([k % 256 for _, k in lengths if k % 256], 256)
    assert n <= best + 3 + 0.03 * best
    again = packing.pack(docs.orderBy(F.desc("doc_id")).repartition(5), capacity=256, n_tokens=F.col("n")).collect()
    assert Counter(got) == Counter(again)


def test_repeated_rows_are_packed_as_often_as_they_occur(spark):
    docs = spark.range(9000).select((F.col("id") % 2).alias("doc_id"), F.lit("same").alias("text"))
    got = packing.pack(docs, capacity=100, n_tokens=F.lit(130)).collect()
    check_packing(got, [(i % 2, 130) for i in range(9000)], 100)


def test_packing_of_awkward_rows(spark):
    docs = awkward(spark)
    check_packing(packing.pack(docs, capacity=100).collect(), lengths_of(docs), 100)
    named = docs.toDF("slot", "seq_id", "n", "h", "size", "rank", "copy")
    got = packing.pack(named, capacity=100, text="seq_id", key="slot")
    assert got.columns == ["seq_id", "slot_", "seq_offset", "slot", "text_hash", "tok_start", "tok_len"]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, packing.pack(docs, capacity=100).collect()))
    assert packing.pack(documents(spark)).count() == 0
    assert packing.pack(documents(spark, [(1, None, None, None)])).count() == 0


def test_the_packing_query_is_best_fit_over_all_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lengths, got = lengths_of(docs), packing.pack(docs).collect()
    check_packing(got, lengths, packing.CAPACITY)
    sizes = [n % packing.CAPACITY for _, n in lengths if n % packing.CAPACITY]
    want = Counter()  # what each sequence holds, by sizes
    for i, seq, slot, offset in by_rounds(sizes, packing.CAPACITY):
        want[seq, slot, offset, sizes[i]] += 1
    assert Counter((int(r.seq_id[1:]), r.slot, r.seq_offset, r.tok_len) for r in got if r.seq_id[0] == "b") == want


def test_packed_sequences_become_token_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    pieces = packing.pack(docs, capacity=512)
    enc, kind = tokens.load(tokens.VOCABULARY), tokens.kind_of(tokens.VOCABULARY)
    text = {(r.doc_id, r.h): enc.encode_ordinary(r.text or "") for r in docs.withColumn("h", F.xxhash64("text")).collect()}
    want = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: r.slot):
        want[r.seq_id] += text[r.doc_id, r.text_hash][r.tok_start : r.tok_start + r.tok_len]
    got = {r.seq_id: np.frombuffer(r.ids, kind).tolist() for r in packing.token_sequences(pieces, docs).collect()}
    assert got == want


def brute_balance(docs, targets):
    """The dual by plain Newton steps over the documents themselves."""
    enc = tokens.load(tokens.VOCABULARY)
    rows = [(r.source or mixing.NONE, r.lang or mixing.NONE, len(enc.encode_ordinary(r.text))) for r in docs if r.text]
    total = sum(n for *_, n in rows)
    s, la = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    t = np.array([n for *_, n in rows], float)
    z = np.log(t + 1)
    z -= (t * z).sum() / total
    x = np.array([[float(r[0] == k) for k in s] + [float(r[1] == k) for k in la] for r in rows])
    x = np.column_stack([x, z])
    goal = np.array([targets[k] / sum(targets.values()) for k in s] + [t[[r[1] == k for r in rows]].sum() / total for k in la] + [0.0])
    v = np.zeros(x.shape[1])
    for _ in range(60):
        w = t * np.exp(x @ v) / total
        step = np.linalg.lstsq(x.T @ (w[:, None] * x), goal - w @ x, rcond=1e-10)[0]
        v += step * min(1, 1 / max(1e-9, np.abs(step).max()))
    return dict(Counter({k: 0 for k in s}) | {k: float((t * np.exp(x @ v))[[r[0] == k for r in rows]].sum()) for k in s}), np.exp(x @ v)


def share(rows, by):
    mass = Counter()
    for r in rows:
        mass[r[by]] += r.rate * r.n_tokens
    return {k: v / sum(mass.values()) for k, v in mass.items()}, sum(mass.values())


def sample(spark):
    return documents(spark, [(i, prose(i, 5 + (i * 37) % 90), ("en", "de", "fr")[i % 3], "abcd"[(i * i) % 4 if i % 7 else 3]) for i in range(200)])


@pytest.mark.parametrize("limit", [10_000, 1])
def test_rates_meet_the_targets_and_those_of_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    docs = sample(spark)
    targets = {k: 1.0 + i for i, k in enumerate(sorted({r.source for r in docs.collect()}))}
    got = mixing.rates(docs, targets).orderBy("doc_id").collect()
    _, want = brute_balance(docs.orderBy("doc_id").collect(), targets)
    assert np.allclose([r.rate for r in got], want, atol=1e-5)
    shares, _ = share(got, "source")
    assert all(abs(shares[k] - targets[k] / sum(targets.values())) < 1e-4 for k in targets)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)


def test_language_targets_total_and_temperature(spark):
    docs = sample(spark)
    have, n = share([r for r in mixing.rates(docs, temperature=1.0).collect()], "source")
    raw = Counter()
    for r in mixing.rates(docs, temperature=1.0).collect():
        raw[r.source] += r.n_tokens
        assert abs(r.rate - 1) < 1e-5  # in proportion to what there is
    assert all(abs(have[k] - raw[k] / sum(raw.values())) < 1e-6 for k in raw)
    flat = mixing.rates(docs, temperature=0.0, total=2 * n, lang_targets={"en": 2, "de": 1, "fr": 1, "xx": 5}).collect()
    by_source, mass = share(flat, "source")
    by_lang, _ = share(flat, "lang")
    assert abs(mass / n - 2) < 1e-3 and all(abs(v - 1 / len(by_source)) < 1e-4 for v in by_source.values())
    assert all(abs(by_lang[k] - v) < 1e-4 for k, v in {"en": 0.5, "de": 0.25, "fr": 0.25}.items())
    with pytest.raises(ValueError, match="fr"):
        mixing.rates(docs, lang_targets={"en": 1, "de": 1})


def test_the_mixing_query_meets_its_targets(spark, sf_dir):
    got = queries.op2_source_mixing(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert dict(zip(got.doc_id, got.n_tokens)) == dict(lengths_of(docs))
    have, mass = got.groupby("source").n_tokens.sum(), (got.n_tokens * got.rate).groupby(got.source).sum()
    want = have**mixing.TEMPERATURE
    assert np.allclose(mass / mass.sum(), want / want.sum(), atol=1e-4)
    assert abs((got.n_tokens * got.copies).sum() / have.sum() - 1) < 0.1


def test_mix_repeats_rows_as_their_copies_say(spark):
    docs = awkward(spark)
    targets = {"a": 3, "b": 1, None: 1, "absent": 5}
    mixed, rate = mixing.mix(docs, targets), mixing.rates(docs, targets)
    assert mixed.columns == docs.columns and rate.count() == docs.count()
    assert mixed.count() == rate.agg(F.sum("copies")).first()[0]
    assert {r.copies for r in rate.where("source = 'c'").collect()} == {0}
    named = docs.toDF("_copies", "_rate", "_turn", "n_tokens", "_text_hash", "_source", "_of_lang")
    again = mixing.mix(named, targets, key="_copies", text="_rate", lang="_turn", source="n_tokens")
    assert again.columns == named.columns and Counter(map(tuple, again.collect())) == Counter(map(tuple, mixed.collect()))
    assert mixing.rates(docs.toDF("rate", "text", "lang", "source", "c", "p", "t"), key="rate").columns == ["rate", "source", "lang", "n_tokens", "rate_", "copies"]
    empty = documents(spark)
    assert mixing.rates(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mix(docs, {}).count() == 0
