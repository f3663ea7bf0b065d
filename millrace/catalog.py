"""The registered queries of the library and their SQL for comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import strings, templates
from millrace.functions.draws import uniform
from millrace.operators import dedup, generate, judges, relational, text, vector
from millrace.plans.scratch import scratch_root
from millrace.sources import readers
from millrace.streaming import ingest

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir, *cols) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(*cols) if cols else d


#: A text's built-in tokens; in DuckDB Han is matched by its main blocks, like in Spark.
TOKENS_SQL = r"regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')"
HASH_SQL = "md5(concat_ws('|', coalesce(lang, ''), coalesce(source, ''), coalesce(text, '')))"
U_SQL = "(('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, '{p}', '{n}', '0')), 1, 8))::BIGINT / 4294967296.0)"
#: Sentences as in operators.text.sentences.
SENTENCES_SQL = r"list_filter(list_transform(regexp_split_to_array(text, '[\n.;:?!。！？]'), lambda x: trim(x, E' \t\n\r')), lambda x: length(x) > 10)"
MESSAGES_SQL = "(SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"


def hashed(spark, sf_dir) -> DataFrame:
    """Documents with an id of their language, source and text, made alike in both engines."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("lang", "source", "text")]))
    return docs(spark, sf_dir).withColumn("hash_id", h)


def conversations(spark, sf_dir) -> DataFrame:
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(m.alias("messages"))


# sources


@query(f"SELECT doc_id, hash_id, n FROM (SELECT doc_id, {HASH_SQL} AS hash_id, size(t) AS n, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM (SELECT *, {TOKENS_SQL} AS t FROM documents)) WHERE r = 1 AND n BETWEEN 20 AND 5000".replace("size(t)", "len(t)"))
def flagship(spark, sf_dir):
    df = dedup.ExactDedup(order_by="doc_id").apply(hashed(spark, sf_dir))
    df = text.TokenCounter(output_col="n").apply(df)
    df = relational.Expression(expr="n BETWEEN 20 AND 5000").apply(df)
    return relational.RemoveColumns(cols=["lang", "source", "n_chars", "text"]).apply(df)


@query(f"SELECT hash_id, min(doc_id) AS doc_id FROM (SELECT doc_id, {HASH_SQL} AS hash_id FROM documents) GROUP BY 1")
def hash_id_dedup(spark, sf_dir):
    return readers.first_by_hash(hashed(spark, sf_dir).select("hash_id", "doc_id"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    ledger = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("hash_id"))
    d = docs(spark, sf_dir, "doc_id", "lang").withColumn("hash_id", F.col("doc_id").cast("string"))
    return readers.resume(d, ledger).drop("hash_id")


@query("SELECT doc_id, n_chars, md5(concat('{\"doc_id\":', doc_id, ',\"n_chars\":', n_chars, '}')) AS hash_id FROM documents ORDER BY hash_id LIMIT 10")
def debug_limit(spark, sf_dir):
    return readers.FileReader(path=f"{sf_dir}/documents.parquet", schema="doc_id long, n_chars long", debug=True).load(spark)


@query("SELECT doc_id FROM (SELECT doc_id, md5(concat('{\"doc_id\":', doc_id, '}')) AS h FROM documents) ORDER BY md5(concat(h, '|7')), h LIMIT 25")
def hash_shuffle_limit(spark, sf_dir):
    return readers.FileReader(path=f"{sf_dir}/documents.parquet", schema="doc_id long", shuffle=True, seed=7, debug=25).load(spark).select("doc_id")


@query("SELECT md5(concat('5|', i)) AS hash_id FROM range(100) t(i)")
def null_source(spark, sf_dir):
    return readers.NullReader(num_data=100, seed=5).load(spark)


@query()
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.map_text(readers.html_to_text, "string")(F.col("html")).alias("text"))


# projections, filters, flat maps


@query("SELECT doc_id, lang, n_chars FROM documents")
def remove_hidden(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang", "n_chars", "source").withColumn("_tmp", F.lit(1))
    return relational.RemoveColumns(cols=["source", "absent"]).apply(d)


@query("SELECT doc_id, upper(lang) AS lang, n_chars * 2 AS twice FROM documents")
def expr_map(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang", "n_chars")
    return relational.Expression(expr="struct(upper(lang) AS lang, n_chars * 2 AS twice)").apply(d).drop("n_chars")


@query("SELECT doc_id, lang FROM documents WHERE n_chars > 1000 AND lang = 'en'")
def expr_filter(spark, sf_dir):
    return relational.Expression(expr="n_chars > 1000 AND lang = 'en'").apply(docs(spark, sf_dir)).select("doc_id", "lang")


@query("SELECT doc_id, 'lang' AS k, lang AS v FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents")
def expr_flatmap(spark, sf_dir):
    return relational.Expression(expr="array(struct(doc_id, 'lang' AS k, lang AS v), struct(doc_id, 'source' AS k, source AS v))").apply(docs(spark, sf_dir))


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def list_flatten_str(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("line"))
    return relational.ListFlatten(text_col="line").apply(d)


@query("SELECT conv_id, role, text AS content FROM conversations")
def list_flatten_struct(spark, sf_dir):
    c = conversations(spark, sf_dir).withColumn("role", F.lit("overwritten"))
    return relational.ListFlatten(text_col="messages").apply(c)


@query("SELECT doc_id, length(text) + 1 AS n FROM documents WHERE n_chars > 500")
def python_function(spark, sf_dir):
    f = lambda r: {"n": len(r["text"]) + 1} if r["n_chars"] > 500 else []
    return relational.PythonFunction(func=f, schema="doc_id long, n long").apply(docs(spark, sf_dir, "doc_id", "text", "n_chars"))


@query("SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE quality IS NOT NULL")
def drop_null(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality")
    return relational.DropNull(cols=["quality"]).apply(d)


# text


@query(f"SELECT doc_id, len({TOKENS_SQL}) AS token_count FROM documents")
def token_count(spark, sf_dir):
    return text.TokenCounter().apply(docs(spark, sf_dir, "doc_id", "text")).drop("text")


@query(f"SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents), range(1, 100000) r(i) WHERE i <= len(s)".replace("SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (", "SELECT doc_id, u.pos, u.sentence FROM (SELECT doc_id, unnest(list_transform(s, lambda x, i: {'pos': i - 1, 'sentence': x})) AS u FROM (").replace(", range(1, 100000) r(i) WHERE i <= len(s)", ")"))
def sentence_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


@query("SELECT doc_id, sum(length(c)) AS n, count(*) AS k FROM (SELECT doc_id, concat(line, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY i), '')) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) GROUP BY doc_id")
def pair_chunks(spark, sf_dir):
    c = docs(spark, sf_dir).select("doc_id", F.explode(text.pair_chunks(F.split("text", "\n"))).alias("c"))
    return c.groupBy("doc_id").agg(F.sum(F.length("c")).alias("n"), F.count(F.lit(1)).alias("k"))


@query("SELECT doc_id, list_aggregate(list_transform(range(1, len(c) + 1), lambda i: length(array_to_string(c[i:i + 2], ''))), 'max') AS widest FROM (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents)")
def window_chunks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_max(F.transform(text.window_chunks(F.split("text", "\n"), 3), F.length)).alias("widest"))


@query("SELECT doc_id FROM documents WHERE n_chars % 9 <= 4")
def ellipsis_filter(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("text", F.concat("text", F.expr("repeat('... ', cast(n_chars % 9 as int))")))
    return text.EllipsisFilter().apply(d).select("doc_id")


@query("SELECT doc_id, substr(text, 1, 50000) AS text FROM documents")
def truncate_chars(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", judges.truncated(F.col("text"), 50_000).alias("text"))


@query()
def chunk_recursive(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("hash_id", F.col("doc_id").cast("string"))
    return text.TextSplit(chunk_size=[100, 200], chunk_overlap=[10, 20]).apply(d).select("doc_id", "text_list")


@query()
def tail_trim(spark, sf_dir):
    return text.TailTrim().apply(docs(spark, sf_dir)).select("doc_id", "text")


@query("SELECT doc_id, concat('说话', lang, '时间: 学会') AS text FROM documents")
def to_simplified(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.to_simplified(F.concat(F.lit("說話"), "lang", F.lit("時間: 學會"))).alias("text"))


@query("SELECT doc_id, concat('Source ', coalesce(source, ''), ' (', coalesce(lang, ''), '): ', coalesce(text, '')) AS prompt FROM documents")
def template_render(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", templates.Template("Source {{ source }} ({{ lang }}): {{ text }}").column(d).alias("prompt"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'english ' || source ELSE 'other' END AS prompt FROM documents")
def template_logic(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang", "source")
    return d.select("doc_id", templates.Template("{% if lang == 'en' %}english {{ source }}{% else %}other{% endif %}").column(d).alias("prompt"))


@query(f"SELECT doc_id, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.75 THEN 'b' ELSE 'c' END AS name FROM (SELECT doc_id, {U_SQL.format(p='t', n=0)} AS u FROM documents)")
def weighted_template(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id")
    ts = [templates.Template("x", n, w) for n, w in (("a", 2.0), ("b", 1.0), ("c", 1.0))]
    return d.select("doc_id", templates.choose(d, ts, F.col("doc_id"), "t")[1].alias("name"))


@query("SELECT event_id, (props::JSON->>'k')::INT AS k, true AS broken FROM events")
def json_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    fenced = strings.json_reply(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "k int")
    return e.select("event_id", fenced["k"].alias("k"), strings.json_reply(F.concat(F.lit("{broken "), "props")).isNull().alias("broken"))


# deduplication


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_exact(spark, sf_dir):
    return dedup.ExactDedup(order_by="doc_id").apply(docs(spark, sf_dir, "doc_id", "text")).select("doc_id")


def _minhash_sql(num_perm: int, num_bands: int) -> str:
    r = num_perm // num_bands
    co = dedup.coefficients(num_perm)
    mins = ", ".join(f"coalesce(min((h * {a} + {b}) % {dedup.PRIME}), -1) AS m{i}" for i, (a, b) in enumerate(co))
    bands = ", ".join("concat_ws('-', '" + str(k) + "', " + ", ".join(f"m{i}" for i in range(k * r, k * r + r)) + ")" for k in range(num_bands))
    return f"WITH e AS (SELECT doc_id, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS e FROM (SELECT doc_id, list_distinct({SENTENCES_SQL}) AS s FROM documents)), h AS (SELECT doc_id, ('0x' || substr(md5(e), 1, 8))::BIGINT % {dedup.PRIME} AS h FROM e), sig AS (SELECT doc_id, {mins} FROM h GROUP BY doc_id) SELECT doc_id, unnest([{bands}]) AS band FROM sig"


@query(_minhash_sql(64, 16))
def minhash_bands(spark, sf_dir):
    sig = dedup.signatures(docs(spark, sf_dir), text.sentences(F.col("text")), "doc_id", 64)
    return dedup.bands(sig, "doc_id", 64, 16)


@query(
    f"WITH RECURSIVE b AS ({_minhash_sql(64, 16)[5:].replace('e AS (', 'SELECT * FROM (WITH e AS (', 1)})), edges AS (SELECT DISTINCT x.doc_id AS lo, y.doc_id AS hi FROM b x JOIN b y ON x.band = y.band AND x.doc_id < y.doc_id), "
    "o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents), "
    "g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.hi = o.doc_id AND list_contains(g.kept, e.lo)) THEN g.kept ELSE list_append(g.kept, o.doc_id) END FROM g JOIN o ON o.i = g.i + 1) "
    "SELECT unnest(kept) AS doc_id FROM g WHERE i = (SELECT max(i) FROM g)"
)
def dedup_minhash(spark, sf_dir):
    return dedup.MinHashDedup(order_by="doc_id").apply(docs(spark, sf_dir, "doc_id", "text")).select("doc_id")


@query(
    "WITH RECURSIVE edges AS (SELECT a.vec_id AS lo, b.vec_id AS hi FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4), "
    "o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings), "
    "g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.hi = o.vec_id AND list_contains(g.kept, e.lo)) THEN g.kept ELSE list_append(g.kept, o.vec_id) END FROM g JOIN o ON o.i = g.i + 1) "
    "SELECT unnest(kept) AS vec_id FROM g WHERE i = (SELECT max(i) FROM g)"
)
def semantic_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return dedup.SemanticDedup(threshold=0.4, embedding_col="embedding", order_by="vec_id").apply(e).select("vec_id")


# vectors


@query("SELECT q.vec_id, x.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 4) AS score FROM embeddings q, embeddings x QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 9) DESC, x.vec_id) <= 5")
def knn_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    got = vector.top_k(e, e.withColumnRenamed("vec_id", "id"), query_id="vec_id", query_vec="embedding", index_id="id", index_vec="embedding", k=5)
    return got.select("vec_id", "id", F.round("score", 4).alias("score"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS c FROM embeddings")
def cosine_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(strings.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("c"))


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings WHERE embedding[1] > 0.05) WHERE r BETWEEN 2 AND 5")
def rerank_slice(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("score"))
    g = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "score"))).alias("s"))
    return g.select("label", F.inline(vector.rerank_slice(F.col("s"), (1, 5), 0.05))).select("label", "vec_id")


# messages, rules, judges


@query("SELECT doc_id, 2 AS n, concat('You know ', source, '.') AS system, concat('Say more in ', lang, '.') AS asked, 'user' AS role FROM documents")
def messages_build(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang", "source")
    user, system = ([templates.Template(t)] for t in ("Say more in {{ lang }}.", "You know {{ source }}."))
    m = generate.build_messages(d, "m", user, system, "doc_id", "chat", 0)
    return m.select("doc_id", F.size("m").alias("n"), F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("asked"), F.col("m")[1]["role"].alias("role"))


def with_han(c: DataFrame) -> DataFrame:
    """Conversations of which every second one has a Han sign in each message, and every sixth a simplified one: the tables have none."""
    said = F.when(F.col("conv_id") % 6 == 0, "国").when(F.col("conv_id") % 2 == 0, "國").otherwise("")
    return c.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(m["content"], said).alias("content"))))


def _rule(name: str, **kw):
    return lambda spark, sf_dir: with_han(conversations(spark, sf_dir)).select("conv_id", judges.RULES[name](**kw).alias("ok"))


_HAN_SQL = "(SELECT conv_id, list_transform(messages, lambda m: {'role': m.role, 'content': m.content || CASE WHEN conv_id % 6 = 0 THEN '国' WHEN conv_id % 2 = 0 THEN '國' ELSE '' END}) AS messages FROM " + MESSAGES_SQL + ")"


def _rule_sql(condition: str) -> str:
    return f"SELECT conv_id, {condition} AS ok FROM {_HAN_SQL}"


_ALL = "len(list_filter(messages, lambda m: NOT ({c}))) = 0"
for _name, _rule_name, _kw, _c in (
    ("rule_num_chars", "num_chars", {"num_user_max_chars": 120, "num_assistant_max_chars": 400}, _ALL.format(c="length(m.content) <= CASE WHEN m.role = 'user' THEN 120 ELSE 400 END")),
    ("rule_banned", "banned_words", {"banned_words": ["the", "der"]}, _ALL.format(c="NOT (contains(m.content, 'the') OR contains(m.content, 'der'))")),
    ("rule_has_han", "only_chinese", {}, _ALL.format(c=r"regexp_matches(m.content, '\p{Han}')")),
    ("rule_traditional", "only_traditional_chinese", {}, _ALL.format(c=f"NOT regexp_matches(m.content, '[{text.SIMPLIFIED}]')")),
):
    QUERIES[_name], SQL[_name] = _rule(_rule_name, **_kw), _rule_sql(_c)
QUERIES["rule_exclusive"] = _rule("user_assistant_exclusive")
SQL["rule_exclusive"] = f"SELECT conv_id, len(list_filter(range(1, len(t), 2), lambda i: contains(t[i].content, t[i + 1].content) OR contains(t[i + 1].content, t[i].content))) = 0 AS ok FROM (SELECT conv_id, list_filter(messages, lambda m: m.role <> 'system') AS t FROM {_HAN_SQL})"


@query(f"SELECT conv_id FROM {MESSAGES_SQL} WHERE {_ALL.format(c='length(m.content) <= 600')} AND len(messages) >= 4")
def validators_all(spark, sf_dir):
    c = conversations(spark, sf_dir)
    vs = [judges.Validator(judge="num_chars", judge_kwargs={"num_user_max_chars": 600, "num_assistant_max_chars": 600}), judges.Validator(judge=lambda: F.size("messages"), criteria="score >= 4")]
    return judges.validate_all(c, vs).select("conv_id")


@query(f"SELECT conv_id, unnest(list_transform(range(1, (ceil((n - l) / 2))::BIGINT + 1), lambda i: least(l + 2 * i, n))) AS n_messages FROM (SELECT conv_id, len(messages) AS n, len(list_filter(messages, lambda m: m.role = 'system')) AS l FROM {MESSAGES_SQL}) WHERE n > l UNION ALL SELECT conv_id, len(messages) FROM {MESSAGES_SQL} WHERE len(list_filter(messages, lambda m: m.role <> 'system')) = 0")
def prefix_rounds(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", F.explode(F.transform(judges.prefixes(F.col("messages")), lambda m: F.size(m).cast("long"))).alias("n_messages"))


_LINES_SQL = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


#: drop_bad_tail over lines that score their length less 40, in windows of 3 and below a threshold of 0.
_TAIL_SQL = f"""(SELECT doc_id, pos, line, score, bad FROM (
  SELECT *, (regexp_matches(line, '(\\.\\.\\.|…)[ \t\x0B\f\r]*$') OR coalesce(score < 0, false)) AS bad,
    max(CASE WHEN NOT (regexp_matches(line, '(\\.\\.\\.|…)[ \t\x0B\f\r]*$') OR coalesce(score < 0, false)) THEN pos END) OVER (PARTITION BY doc_id) AS last
  FROM (SELECT *, CASE WHEN pos >= 2 THEN length(line) - 40 END AS score FROM {_LINES_SQL})) WHERE pos <= last)"""


def _tail(spark, sf_dir) -> DataFrame:
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return judges.drop_bad_tail(lines, "doc_id", "pos", "line", F.length("line") - 40, 0, 3)


@query(f"SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM {_TAIL_SQL} GROUP BY doc_id")
def sliding_score(spark, sf_dir):
    return _tail(spark, sf_dir).select("doc_id", F.array_join("kept", "\n").alias("kept"))


@query(f"SELECT doc_id, round(avg(score) FILTER (WHERE score > 0), 6) AS m FROM {_TAIL_SQL} GROUP BY doc_id")
def mean_positive(spark, sf_dir):
    return _tail(spark, sf_dir).select("doc_id", F.round("score", 6).alias("m"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 17 DESC, turn) AS r FROM conversations WHERE length(text) % 17 > 0) WHERE r = 1")
def best_candidate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("score", F.length("text") % 17)
    return generate.best_by_score(c, "conv_id", "turn", "score").select("conv_id", "turn")


_UNIT = "(('0x' || substr(md5({x}), 1, 8))::BIGINT / 4294967296.0)"


@query()
def edu_tail(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("hash_id", F.col("doc_id").cast("string"))
    return judges.SlidingEduClassifier(threshold=0.0, chunk_size=60, sliding_window_size=3).judge(d).select("doc_id", "text", "edu_score")


@query(
    f"SELECT conv_id, i AS n_round, round({_UNIT.format(x="array_to_string(list_transform(messages[1:least(l + 2 * i, n)], lambda m: m.content), '|')")} * 10 - 5, 6) AS score "
    f"FROM (SELECT conv_id, messages, n, l, unnest(range(1, greatest((ceil((n - l) / 2))::BIGINT, 1) + 1)) AS i FROM (SELECT *, len(messages) AS n, len(list_filter(messages, lambda m: m.role = 'system')) AS l FROM {MESSAGES_SQL}))"
)
def reward_rounds(spark, sf_dir):
    got = judges.RewardJudge().judge(conversations(spark, sf_dir))
    return got.select("conv_id", F.posexplode("rm_score").alias("n_round", "score")).withColumn("n_round", (F.col("n_round") + 1).cast("long"))


@query(f"SELECT conv_id, round(exp(avg(5 * {_UNIT.format(x='w')})), 6) AS ppl FROM (SELECT conv_id, unnest(regexp_split_to_array(trim(text, E' \\t\\n\\r'), '\\s+')) AS w FROM conversations) WHERE w <> '' GROUP BY conv_id")
def perplexity(spark, sf_dir):
    return judges.Perplexity().judge(conversations(spark, sf_dir)).select("conv_id", F.round("ppl", 6).alias("ppl"))


# generation with the offline backend


@query("SELECT doc_id, 'reply ' || substr(md5(concat('Summarize: ', coalesce(text, ''))), 1, 12) AS output FROM documents")
def chat_mock(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("hash_id", F.col("doc_id").cast("string"))
    return generate.ChatGenerator(user_template="Summarize: {{ text }}", system_template="Be brief.").apply(d).select("doc_id", "output")


@query(
    "SELECT doc_id, 'reason ' || substr(md5('reason|' || q), 1, 8) AS reason, round(" + _UNIT.format(x="q") + " * 5, 3) AS score FROM "
    "(SELECT doc_id, 'Give the score of this judgement as JSON with reason and score.' || chr(10) || 'reply ' || substr(md5('Rate: ' || text), 1, 12) AS q FROM documents)"
)
def judge_mock(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("hash_id", F.col("doc_id").cast("string"))
    return judges.LlmAsJudge(judge_template="Rate: {{ text }}").judge(d).select("doc_id", "judge_result.reason", "judge_result.score")


def _made(op, spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("hash_id", F.col("doc_id").cast("string"))
    return op.apply(d).select("doc_id", "messages")


@query()
def magpie_mock(spark, sf_dir):
    return _made(generate.Magpie(system_template="You know {{ source }}.", max_turns=6), spark, sf_dir)


@query()
def contextual_magpie_mock(spark, sf_dir):
    return _made(generate.ContextualMagpie(system_template="Use: {{ text }}", max_turns=3), spark, sf_dir)


@query()
def self_instruct_mock(spark, sf_dir):
    return _made(generate.DocSelfInstruct(user_template="Ask about {{ text }}", max_turns=2), spark, sf_dir)


@query()
def evolve_mock(spark, sf_dir):
    c = conversations(spark, sf_dir).withColumn("hash_id", F.col("conv_id").cast("string"))
    return generate.PromptEvolver(evolve_template="Harder: {{ prompt }}", first_prompt_template="Begin.", gen_assistant_resp=True).apply(c).select("conv_id", "messages")


def _length_score(messages):
    n = len(messages[-1]["content"])
    return True, None, float(sum(map(ord, messages[-1]["content"])) % 101 + n % 3)


@query()
def reject_sampling_mock(spark, sf_dir):
    c = conversations(spark, sf_dir).withColumn("hash_id", F.col("conv_id").cast("string"))
    return generate.RejectSampling(search_space_params={"temperature": [0.2, 0.8]}, num_combinations=3, validator_list=[_length_score], ground_as_candidate=True).apply(c).select("conv_id", "messages")


@query(
    "SELECT doc_id, unnest(list_sort(list_transform(list_sort(list_transform(range(7), lambda i: {'u': (('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, 'sample', i::VARCHAR, '0')), 1, 8))::BIGINT / 4294967296.0), 'i': i}))[1:3], lambda x: x.i))) AS i FROM documents WHERE doc_id % 2 = 0 "
    f"UNION ALL SELECT doc_id, unnest([0, 1, floor({U_SQL.format(p='repeat', n=0)} * 2)::INT, floor({U_SQL.format(p='repeat', n=1)} * 2)::INT]) FROM documents WHERE doc_id % 2 = 1"
)
def chunk_index_choice(spark, sf_dir):
    f = lambda r: [{"doc_id": r["doc_id"], "i": i} for i in generate.chunk_indices(*((2, 4) if r["doc_id"] % 2 else (7, 3)), r["doc_id"], 0)]
    return relational.PythonFunction(func=f, schema="doc_id long, i long").apply(docs(spark, sf_dir, "doc_id"))


@query()
def embed_retrieve(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text").withColumn("hash_id", F.col("doc_id").cast("string"))
    bench = vector.Embedder(query="text", output_col="embedding").apply(table(spark, sf_dir, "benchmark"))
    index = bench.select(F.col("item_id").cast("string").alias("id"), "text", "embedding", F.lit(None).cast("string").alias("metadata"))
    r = vector.Retriever(index=index, topk_range=(0, 3), similarity_threshold=0.2, embedder=vector.Embedder())
    return r.apply(d).select("doc_id", F.transform("retrieved", lambda x: x["id"]).alias("ids"))


# relational and windowed extensions


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_revenue(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_join(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT r_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT a.event_id, b.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = (SELECT max(event_type) FROM events)) a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = e.crossJoin(F.broadcast(ends))
    right = F.when(F.col("event_type") == F.col("lo"), F.struct("ts", "event_id"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("before_id", F.max(right).over(w)["event_id"])
    return e.where("event_type = hi").select("event_id", "before_id")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.windowed_counts(e, "ts", "event_type", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.sessions(e, "ts", "user_id", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query("SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders QUALIFY r <= 2")
def top_orders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("r")).where("r <= 2")


@query("SELECT lang, source FROM documents WHERE n_chars > 500 EXCEPT SELECT lang, source FROM documents WHERE n_chars > 6000")
def set_except(spark, sf_dir):
    d = docs(spark, sf_dir, "lang", "source", "n_chars")
    return d.where("n_chars > 500").drop("n_chars").subtract(d.where("n_chars > 6000").drop("n_chars"))


@query("SELECT lang, source FROM documents WHERE n_chars > 6000 INTERSECT SELECT lang, source FROM documents WHERE n_chars < 500")
def set_intersect(spark, sf_dir):
    d = docs(spark, sf_dir, "lang", "source", "n_chars")
    return d.where("n_chars > 6000").drop("n_chars").intersect(d.where("n_chars < 500").drop("n_chars"))


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT item_id, NULL FROM benchmark")
def set_union_all(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return table(spark, sf_dir, "labels").select("doc_id", "quality").unionByName(b, allowMissingColumns=True)


@query("SELECT lang FROM documents UNION SELECT source FROM documents")
def set_union(spark, sf_dir):
    d = docs(spark, sf_dir, "lang", "source")
    return d.select("lang").unionAll(d.select(F.col("source").alias("lang"))).distinct()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    x, (flag, status) = table(spark, sf_dir, "lineitem"), (F.col("l_returnflag"), F.col("l_linestatus"))
    return x.groupingSets([[flag], [status], []], flag, status).agg(F.sum("l_quantity").alias("q"))


@query("SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) < 0.2 * count(DISTINCT l_partkey) AS near FROM lineitem GROUP BY 1")
def approx_distinct(spark, sf_dir):
    """Both counts are taken over the distinct keys; beside countDistinct, a sketch of its own would be made and moved for every key."""
    keys = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey").distinct()
    g = keys.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count("l_partkey").alias("n"))
    return g.select("l_returnflag", (F.abs(F.col("a") - F.col("n")) < 0.2 * F.col("n")).alias("near"))


@query("SELECT a.event_id, count(b.event_id) AS n FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 hour GROUP BY 1")
def interval_join(spark, sf_dir):
    """How many events of the same user follow within six hours: a range frame, which sorts each user's events once where a join would pair them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(1, 6 * 3600 * 10**6)
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("n"))


_BRACKETS = [("small", 0.0, 50_000.0), ("middle", 50_000.0, 150_000.0), ("large", 120_000.0, 400_000.0)]


@query("SELECT o_orderkey, b.name FROM orders JOIN (VALUES " + ", ".join(map(str, _BRACKETS)) + ") b(name, lo, hi) ON o_totalprice >= b.lo AND o_totalprice < b.hi")
def range_join(spark, sf_dir):
    """Orders by overlapping price brackets; the three brackets of the constant table are broadcast."""
    b = spark.createDataFrame(_BRACKETS, "name string, lo double, hi double")
    return table(spark, sf_dir, "orders").join(F.broadcast(b), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).select("o_orderkey", "name")


@query("SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS since, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (t - F.lag(t).over(w)).alias("since"), F.lead("event_type").over(w).alias("next_type"))


@query("SELECT o_custkey, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{x}') AS {x}" for x in "FOP") + " FROM orders GROUP BY 1")
def pivot_status(spark, sf_dir):
    got = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", list("FOP")).agg(F.count(F.lit(1)))
    return got.na.fill(0, list("FOP"))


@query("SELECT l_orderkey, l_linenumber, what, amount FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (amount FOR what IN (l_discount, l_tax))")
def unpivot_rates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "what", "amount")


@query("SELECT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, count(*) AS n, max(date_diff('day', o_orderdate::DATE, last_day(o_orderdate)))::INT AS days_left, strftime(min(o_orderdate + INTERVAL 1 month), '%Y-%m-%d') AS next_month FROM orders GROUP BY ALL")
def date_functions(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    g = table(spark, sf_dir, "orders").groupBy(F.year(d).alias("y"), F.quarter(d).alias("q"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.max(F.datediff(F.last_day(d), d)).alias("days_left"), F.date_format(F.min(F.add_months(d, 1)), "yyyy-MM-dd").alias("next_month"))


@query(f"SELECT doc_id, lang FROM documents WHERE {U_SQL.format(p='part', n=0)} < CASE lang WHEN 'en' THEN 0.1 ELSE 0.5 END")
def stratified_sample(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang")
    return d.where(uniform(F.col("doc_id"), "part") < F.when(F.col("lang") == "en", 0.1).otherwise(0.5))


@query("SELECT time_bucket(INTERVAL 10 minute, ts) - to_minutes(CAST(i AS BIGINT) * 10) AS start, event_type, count(*) AS n FROM events, range(3) r(i) GROUP BY ALL")
def sliding_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.windowed_counts(e, "ts", "event_type", "30 minutes", "10 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


_SQL_TEXT = "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 3) SELECT c_mktsegment, count(*) AS n, round(avg(total), 2) AS mean FROM big JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY c_mktsegment"


@query(_SQL_TEXT)
def sql_catalog(spark, sf_dir):
    """SQL text over the tables as views."""
    for n in ("orders", "customer", "nation"):
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(_SQL_TEXT)


@query("SELECT DISTINCT doc_id, lang FROM documents")
def stream_ingest(spark, sf_dir):
    """The documents read as a stream, deduplicated by id and written by batches."""
    base = f"{scratch_root(spark)}/millrace/stream-{uuid.uuid4().hex}"
    schema = docs(spark, sf_dir).schema
    path = f"{sf_dir}/documents.parquet"
    src = spark.readStream.schema(schema).parquet(path + "*")
    q = ingest.ingest(ingest.dedup_stream(src, ["doc_id"]).select("doc_id", "lang"), f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", "lang")

