"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy is
a named, versioned set of rules, applied as a bit mask, and its ablations are sums over the bits: the text is not read
again for another policy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import beside, quoted
from millrace.llm.features import STATS, TextStats
from millrace.plans.scratch import discard, materialize

#: (bit, name, SQL condition under which a document fails). Bits are never reused: a changed rule gets a new one.
RULES = (
    (0, "too_few_words", "n_words < 5"),
    (1, "too_many_words", "n_words > 100000"),
    (2, "mean_word_short", "n_words > 0 AND n_word_chars < 3 * n_words"),
    (3, "mean_word_long", "n_word_chars > 10 * n_words"),
    (4, "marked_words", "10 * n_marked > n_words"),
    (5, "capitals", "10 * n_upper > 3 * n_words"),
    (6, "table_bars", "10 * n_pipe > n_words"),
    (7, "repeated_words", "5 * n_repeat > n_words"),
    (8, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    (9, "few_letters", "10 * n_letters < 8 * n_word_chars"),
    (10, "no_stopword", "n_words >= 20 AND n_stop < 2"),
    (11, "unclean_words", "10 * n_clean < 8 * n_words"),
    (12, "empty", "n_words = 0"),
)
#: policy -> version -> rules. A document passes if none of them failed.
POLICIES = {
    "lenient": {1: ("empty", "marked_words", "capitals"), 2: ("empty", "marked_words", "capitals", "repeated_words", "table_bars")},
    "strict": {1: ("empty", "mean_word_short", "mean_word_long", "marked_words", "capitals", "table_bars", "repeated_words", "duplicate_lines", "few_letters", "unclean_words")},
}
_BIT = {name: bit for bit, name, _ in RULES}


def mask(policy: str, version: int | None = None) -> int:
    """The bits of a policy, of its latest version if none is given."""
    v = POLICIES[policy]
    return sum(1 << _BIT[r] for r in v[version if version is not None else max(v)])


def policy_masks() -> dict[str, int]:
    return {f"{p}_v{v}": mask(p, v) for p, versions in POLICIES.items() for v in versions}


def ledger(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the measurements and fail_bits for every row. A null or empty text measures 0 throughout and fails `empty` and `too_few_words`; repeated rows have equal entries. A column that is called like the key gets an underscore."""
    m = docs.select(quoted(key).alias("_k"), quoted(text).alias("_text")).mapInArrow(_measure, f"_k {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in STATS))
    bits = " | ".join(f"IF({cond}, {1 << bit}L, 0L)" for bit, _, cond in RULES)
    return beside(m.withColumn("fail_bits", F.expr(bits)), "_k", key, [*STATS, "fail_bits"])


def _measure(batches):
    f = TextStats()
    for b in batches:
        a = np.array([f(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, np.ascontiguousarray(a.T))], names=["_k", *STATS])


_stored: dict[tuple[str, str], DataFrame] = {}


def stored_ledger(docs: DataFrame, name: str, **options) -> DataFrame:
    """The ledger of `docs` as a written table. In one application a ledger is written once under a name; whoever asks again for that name reads it and not the texts. forget() ends that."""
    at = docs.sparkSession.sparkContext.applicationId, name
    if at not in _stored:
        _stored[at] = materialize(ledger(docs, **options), "ledger")
    return _stored[at]


def forget(docs: DataFrame, name: str) -> None:
    """Delete the ledger stored under a name, because the texts have changed or nothing reads it any more."""
    discard(_stored.pop((docs.sparkSession.sparkContext.applicationId, name), None))


def apply_policies(led: DataFrame, masks: dict[str, int] | None = None) -> DataFrame:
    """The ledger with a column keep_<policy> for each mask."""
    return led.withColumns({f"keep_{p}": F.col("fail_bits").bitwiseAND(F.lit(m)) == 0 for p, m in (masks or policy_masks()).items()})


def ablations(led: DataFrame, masks: dict[str, int] | None = None) -> DataFrame:
    """By policy and rule of it: documents that fail the rule, that fail it alone among the policy's rules (and would be kept without it), and these documents' words. Rules that no document fails have rows of 0."""
    masks = masks or policy_masks()
    counts = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))  # at most 2^rules rows
    grid = led.sparkSession.createDataFrame([(p, name, m, 1 << bit) for p, m in masks.items() for bit, name, _ in RULES if m >> bit & 1], "policy string, rule string, mask long, bit long")
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return grid.join(counts, hit, "left").groupBy("policy", "rule").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("only_this"), F.coalesce(F.sum(F.when(alone, F.col("w"))), F.lit(0)).alias("words_regained"))
