"""The registered queries of this subpackage, each over its whole table, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import langid, media, mixing, packing, quality, rules, simhash, tokens, toxicity, urls
from millrace.llm.sql import SQL  # noqa: F401


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op2_source_mixing(spark, sf_dir):
    return mixing.rates(_t(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _t(spark, sf_dir, "labels")))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(_t(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(_t(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return rules.apply_policies(rules.stored_ledger(_t(spark, sf_dir, "documents"), f"{sf_dir}/documents"))


def quality_rule_ablations(spark, sf_dir):
    return rules.ablations(rules.stored_ledger(_t(spark, sf_dir, "documents"), f"{sf_dir}/documents"))


def op7_url_filters(spark, sf_dir):
    return urls.decide(_t(spark, sf_dir, "pages"))


def op8_token_binary(spark, sf_dir):
    return tokens.to_binary(_t(spark, sf_dir, "documents"))[0]


def op9_language_id(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return langid.identify(docs, langid.profiles(docs))


def op10_media_sequences(spark, sf_dir):
    return media.sequences(_t(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_source_mixing, op3_toxicity, op4_best_fit_packing, op5_simhash_dedup, op6_quality_rules, op7_url_filters, op8_token_binary, op9_language_id, op10_media_sequences, quality_rule_ablations)
}
