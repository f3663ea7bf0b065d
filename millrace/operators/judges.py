"""Rules over messages, validators, and judges that call models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import strings, templates
from millrace.operators.backends import Backend, HashBackend, column_call
from millrace.operators.base import Operator, register
from millrace.operators.text import SIMPLIFIED, Tokenizer, few_ellipses, map_text, recursive_split, trim_tail

RULES: dict[str, Callable[..., Column]] = {}
#: Words that no message may contain unless other ones are given.
BANNED = ("as an ai", "language model", "openai", "chatgpt", "i cannot", "i'm sorry", "作为一个", "人工智能", "语言模型", "抱歉", "無法", "无法", "作為一個", "人工智慧", "語言模型", "對不起", "对不起")


def rule(f):
    """Register a builder (..., parameters) -> boolean Column under its name."""
    RULES[f.__name__] = f
    return f


@rule
def only_chinese(message_col: str = "messages") -> Column:
    """Every message has a Han sign."""
    return F.forall(message_col, lambda m: m["content"].rlike(r"\p{IsHan}"))


@rule
def only_traditional_chinese(messages_col: str = "messages") -> Column:
    """No message has a sign that is used in simplified writing only."""
    return F.forall(messages_col, lambda m: ~m["content"].rlike(f"[{SIMPLIFIED}]"))


@rule
def num_chars(message_col: str = "messages", num_user_max_chars: int = 100, num_assistant_max_chars: float = float("inf")) -> Column:
    """No message is longer than its role allows; roles other than user have the assistant's limit."""
    u, a = F.lit(float(num_user_max_chars)), F.lit(float(num_assistant_max_chars))
    return F.forall(message_col, lambda m: F.length(m["content"]) <= F.when(m["role"] == "user", u).otherwise(a))


@rule
def banned_words(message_col: str = "messages", banned_words: list[str] | None = None, from_file: str | None = None) -> Column:
    """No message contains one of the words; those of a JSON file come in addition."""
    import json
    from pathlib import Path

    words = list(BANNED if banned_words is None else banned_words) + (json.loads(Path(from_file).read_text(encoding="utf-8")) if from_file else [])
    return F.forall(message_col, lambda m: ~_any(m["content"], words))


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


@rule
def user_assistant_exclusive(message_col: str = "messages") -> Column:
    """In no pair of consecutive messages, leading system ones left out, does one contain the other; an odd last one is ignored."""
    talk = F.filter(message_col, lambda m: m["role"] != "system")
    n = F.size(talk)
    pairs = F.when(n >= 2, F.sequence(F.lit(1), n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.try_element_at(talk, i)["content"]
    return F.forall(pairs, lambda i: ~at(i).contains(at(i + 1)) & ~at(i + 1).contains(at(i)))


RULES["user_aassistant_exclusive"] = RULES["user_assistant_exclusive"]


class JudgePipeline(Operator):
    """A judge adds `output_col`; `score_of` gives the score in it as a column."""

    output_col = "judge_result"

    def judge(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def score_of(self, result: Column) -> Column:
        return result

    def apply(self, df: DataFrame) -> DataFrame:
        return self.judge(df)


@register("Validator")
class Validator(Operator):
    """Keep rows whose judgement meets `criteria`, a SQL condition over `score`. The judge is a rule's name, a Column
    builder or a JudgePipeline. `valid_col` keeps all rows and the verdict as struct<valid, reason, score>. A judge
    that fails or gives null doesn't pass."""

    def setup(self, judge=None, judge_kwargs: dict | None = None, criteria: str | None = None, valid_col: str | None = None, criteria_lambda: str | None = None):
        self.judge, self.kwargs, self.criteria, self.out = judge, judge_kwargs or {}, criteria or criteria_lambda, valid_col
        if judge is None:
            raise ValueError("a validator needs a judge")
        if isinstance(judge, str) and judge not in RULES:
            raise ValueError(f"no rule is called {judge}")

    def verdict(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """The table with what the judge added, and struct<valid, reason, score>."""
        reason = F.lit(None).cast("string")
        if isinstance(self.judge, JudgePipeline):
            df = self.judge.judge(df)
            result = F.col(self.judge.output_col)
            score = self.judge.score_of(result).cast("double")
            if "reason" in str(df.schema[self.judge.output_col].dataType.simpleString()):
                reason = result["reason"]
        else:
            made = RULES[self.judge] if isinstance(self.judge, str) else self.judge
            score = made(**self.kwargs).cast("double")
        if self.criteria:
            df = df.withColumn("score", score) if "score" not in df.columns else df.withColumn("_score_before", F.col("score")).withColumn("score", score)
            ok = F.expr(self.criteria)
            df = df.withColumn("_ok", ok)
            df = df.withColumn("_s", F.col("score")).drop("score")
            if "_score_before" in df.columns:
                df = df.withColumnRenamed("_score_before", "score")
            return df.withColumn("_verdict", F.struct(F.coalesce("_ok", F.lit(False)).alias("valid"), reason.alias("reason"), F.col("_s").alias("score"))).drop("_ok", "_s"), F.col("_verdict")
        return df, F.struct(F.coalesce(score != 0, F.lit(False)).alias("valid"), reason.alias("reason"), score.alias("score"))

    def apply(self, df: DataFrame) -> DataFrame:
        before = df.columns
        wide, v = self.verdict(df)
        if self.out:
            return wide.withColumn(self.out, v).drop("_verdict")
        return wide.where(v["valid"]).select(*[f"`{c}`" for c in before])


def validate_all(df: DataFrame, validators: list[Validator], out: str = "_validation_scores") -> DataFrame:
    """Rows that pass all validators, with map<name, struct<reason, score>>. Rules come first, so that models judge the
    rows that are left."""
    for k, v in enumerate(sorted(validators, key=lambda v: isinstance(v.judge, JudgePipeline))):
        name = v.judge if isinstance(v.judge, str) else type(v.judge).__name__
        wide, verdict = v.verdict(df)
        entry = F.create_map(F.lit(f"{name}" if k == 0 else f"{name}"), F.struct(verdict["reason"].alias("reason"), verdict["score"].alias("score")))
        wide = wide.withColumn("_v", verdict).where("_v.valid")
        wide = wide.withColumn(out, F.map_concat(F.col(out), F.map_filter(entry, lambda key, _: ~F.array_contains(F.map_keys(out), key))) if out in wide.columns else entry)
        df = wide.drop("_v", "_verdict")
    return df


@register()
class LlmAsJudge(JudgePipeline):
    """A free judgement by one call, then its score by a second one: struct<reason, score>."""

    def setup(self, judge_template, system_template=None, messages_col: str | None = None, output_col: str = "judge_result", backend: Backend | None = None, parser: Backend | None = None, id_col: str = "hash_id", seed: int = 0, **_):
        self.user, self.system = templates.as_templates(judge_template), templates.as_templates(system_template)
        self.output_col, self.backend, self.parser, self.id, self.seed = output_col, backend or HashBackend(), parser or backend or HashBackend(), id_col, seed

    def judge(self, df: DataFrame) -> DataFrame:
        from millrace.operators.generate import ask, build_messages

        df = build_messages(df, "_judge_messages", self.user, self.system, self.id, "judge", self.seed)
        df = df.withColumn("_judgement", ask(self.backend, retries=1)(F.to_json("_judge_messages"))["content"])
        wanted = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Give the score of this judgement as JSON with reason and score.\n"), F.coalesce("_judgement", F.lit(""))).alias("content")))
        reply = ask(self.parser, retries=1, fields=("reason", "score"))(F.to_json(wanted))["content"]
        return df.withColumn(self.output_col, strings.json_reply(reply, "reason string, score double")).drop("_judge_messages", "_judgement")

    def score_of(self, result: Column) -> Column:
        return result["score"]


@register("SglangRmJudge")
class RewardJudge(JudgePipeline):
    """A reward score of the whole chat, or of each prefix that ends a round of two messages (system ones apart); an
    unmatched last message ends the last prefix. Rows without messages are dropped."""

    def setup(self, messages_col: str = "messages", output_col: str = "rm_score", judge_foreach_round: bool = True, backend: Backend | None = None, **_):
        self.messages, self.output_col, self.each, self.backend = messages_col, output_col, judge_foreach_round, backend or HashBackend()

    def judge(self, df: DataFrame) -> DataFrame:
        df = df.where(F.size(self.messages) > 0)
        call = column_call(self.backend, "score", "double")
        if not self.each:
            return df.withColumn(self.output_col, call(F.to_json(self.messages)))
        rows = df.withColumn("_row", F.monotonically_increasing_id())
        return _per_prefix(rows, self.messages, self.output_col, self.backend).drop("_row")

    def score_of(self, result: Column) -> Column:
        return F.element_at(result, -1) if self.each else result


def prefixes(messages: Column) -> Column:
    """The chats up to the end of each round of two messages after the leading system ones."""
    n = F.size(messages)
    lead = F.size(F.filter(messages, lambda m: m["role"] == "system"))
    ends = F.when(n > lead, F.transform(F.sequence(F.lit(1), F.ceil((n - lead) / 2).cast("int")), lambda i: F.least(lead + 2 * i, n))).otherwise(F.array(n))
    return F.transform(ends, lambda e: F.slice(messages, 1, e))


def _per_prefix(df: DataFrame, messages: str, out: str, backend: Backend) -> DataFrame:
    from collections.abc import Iterator  # noqa: F401
    import json

    import pyarrow as pa

    from millrace.functions.batches import pieces
    from millrace.operators.backends import AT_ONCE, gather

    def run(batches):
        for b in pieces(batches, AT_ONCE):
            rows = [json.loads(x) if x else [] for x in b.to_pylist()]
            got = gather([backend.score(m) for r in rows for m in r], backend.concurrency, backend.batch_size)
            it = iter([None if isinstance(g, BaseException) else g for g in got])
            yield pa.array([[next(it) for _ in r] for r in rows], pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(run, "array<double>")(F.to_json(prefixes(F.col(messages)))))


@register("OpenaiLmPplPipeline")
class Perplexity(JudgePipeline):
    """exp of the mean negative log-probability of the tokens, null without any."""

    def setup(self, messages_col: str = "messages", output_col: str = "ppl", backend: Backend | None = None, **_):
        self.messages, self.output_col, self.backend = messages_col, output_col, backend or HashBackend()

    def judge(self, df: DataFrame) -> DataFrame:
        lp = column_call(self.backend, "logprobs", "array<double>")(F.to_json(self.messages))
        mean = F.try_divide(F.aggregate("_logprobs", F.lit(0.0), lambda s, x: s + x), F.size("_logprobs"))
        return df.withColumn("_logprobs", lp).withColumn(self.output_col, F.exp(-mean)).drop("_logprobs")


def drop_bad_tail(df: DataFrame, doc: str, pos: str, text: str, score: Column, threshold: float, window: int) -> DataFrame:
    """From rows (doc, pos, text) of chunks: doc, kept (chunks in order) and score, the mean of the positive scores left.

    `score` is of the window of the last `window` chunks. From the end on, chunks that score below the threshold or
    end in an ellipsis go, up to the first good one. Chunks before the first full window can't be judged: they stay,
    and a document of fewer chunks keeps all, with a null score.
    """
    w = Window.partitionBy(doc).orderBy(pos)
    full = F.row_number().over(w) >= window
    s = df.withColumn("_score", F.when(full, score))
    bad = F.col(text).rlike(r"(\.\.\.|…)\s*$") | (F.col("_score") < threshold)
    s = s.withColumn("_good", F.coalesce(~bad, F.lit(True)))
    last = F.max(F.when(F.col("_good"), F.col(pos))).over(Window.partitionBy(doc))
    s = s.withColumn("_last", last).where(F.col(pos) <= F.col("_last"))
    return s.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda r: r[text]).alias("kept"), F.avg(F.when(F.col("_score") > 0, F.col("_score"))).alias("score"))


def truncated(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)


@register("InfinitySlidingWindowEduClassifier")
class SlidingEduClassifier(JudgePipeline):
    """Cut a text, score windows of chunks by a backend, drop the bad tail, and give the rest and its mean score.

    The whole text counts; with `max_chars` what is beyond is dropped first and isn't in the result."""

    def setup(self, text_col: str = "text", output_col: str | None = None, score_col: str = "edu_score", threshold: float = 3.5, to_cn: bool = False, chunk_size: int = 500, sliding_window_size: int = 100, tokenizer_path: str | None = None, id_col: str = "hash_id", max_chars: int | None = None, backend: Backend | None = None, **_):
        self.text, self.out, self.output_col, self.threshold, self.cn = text_col, output_col or text_col, score_col, threshold, to_cn
        self.size, self.window, self.tokenizer, self.id, self.max, self.backend = chunk_size, sliding_window_size, Tokenizer(tokenizer_path), id_col, max_chars, backend or HashBackend()

    def judge(self, df: DataFrame) -> DataFrame:
        from millrace.operators.text import to_simplified

        t, size = self.tokenizer, self.size
        cut = map_text(lambda x: recursive_split(x, size, 0, t.length), "array<string>")
        chunks = df.select(F.col(self.id).alias("_doc"), F.posexplode(cut(truncated(F.col(self.text), self.max))).alias("pos", "chunk"))
        joined = F.array_join(F.collect_list("chunk").over(Window.partitionBy("_doc").orderBy("pos").rowsBetween(1 - self.window, 0)), "")
        joined = to_simplified(joined) if self.cn else joined
        ask = F.to_json(F.array(F.struct(F.lit("user").alias("role"), joined.alias("content"))))
        scored = chunks.withColumn("_ask", ask).withColumn("_s", column_call(self.backend, "score", "double")(F.col("_ask")))
        kept = drop_bad_tail(scored, "_doc", "pos", "chunk", F.col("_s"), self.threshold, self.window)
        kept = kept.select("_doc", F.array_join("kept", "").alias("_kept"), F.col("score").alias("_mean"))
        return df.join(kept, df[self.id] == kept["_doc"]).withColumn(self.out, F.col("_kept")).withColumn(self.output_col, F.col("_mean")).drop("_doc", "_kept", "_mean")


@register()
class EduClassifierTailRemover(JudgePipeline):
    """Trim short last lines, drop texts with many ellipses, then of the last seven lines those whose vector is not near
    that of the text's head; empty results go."""

    def setup(self, text_col: str = "text", output_col: str | None = None, threshold: float = 0.6, chunk_size: int = 500, min_tail_line_length: int = 10, tokenizer_path: str | None = None, last: int = 7, backend: Backend | None = None, **_):
        self.text, self.output_col, self.threshold, self.size, self.min, self.tokenizer, self.last, self.backend = text_col, output_col or text_col, threshold, chunk_size, min_tail_line_length, Tokenizer(tokenizer_path), last, backend or HashBackend()

    def judge(self, df: DataFrame) -> DataFrame:
        import numpy as np

        from millrace.operators.backends import gather

        t, size, low, last, limit, backend = self.tokenizer, self.size, self.min, self.last, self.threshold, self.backend

        def cut(text: str) -> str | None:
            text = trim_tail(text, low, t.length)
            head = recursive_split(text, size, 0, t.length)[:2]
            lines = [x for x in text.split("\n") if x.strip()][-last:]
            if not head or not lines:
                return text
            (got,) = gather([backend.embed(["".join(head), *lines])], 1)
            if isinstance(got, BaseException):
                return text
            v = np.asarray(got, float)
            n = np.linalg.norm(v, axis=1)
            for line, x, m in zip(reversed(lines), v[:0:-1], n[:0:-1]):
                if m * n[0] > 0 and x @ v[0] / (m * n[0]) > limit:
                    break
                text = text.replace(line, "")
            return trim_tail(text, low, t.length)

        out = df.where(few_ellipses(F.col(self.text))).withColumn(self.output_col, map_text(cut, "string")(F.col(self.text)))
        return out.where(F.length(strings.strip(F.col(self.output_col))) > 0)
