"""Generation: templates to messages, calls with retries, and recipes of several turns.

A call is an Arrow function over JSON of the messages; loops whose turns depend on each other run inside it. All
draws come from the row's id and a seed, so a task that runs again asks the same.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import strings, templates
from millrace.functions.batches import pieces
from millrace.operators.backends import AT_ONCE, Backend, HashBackend, gather
from millrace.operators.base import Operator, register
from millrace.operators.text import SEPARATORS, Tokenizer, recursive_split

MESSAGES = "array<struct<role:string, content:string>>"


def draw(row_id, purpose: str, n: int, seed: int) -> float:
    """The same number as functions.draws.uniform."""
    return int(hashlib.md5(f"{row_id}|{purpose}|{n}|{seed}".encode()).hexdigest()[:8], 16) / float(1 << 32)


def chosen(ts: list[templates.Template], row_id, purpose: str, n: int, seed: int) -> templates.Template:
    """The template drawn by weight, as functions.templates.choose does."""
    total = float(sum(t.weight for t in ts))
    u, acc = draw(row_id, purpose, n, seed) * total, 0.0
    for t in ts:
        acc += t.weight
        if t.weight > 0 and u < acc:
            return t
    return next(t for t in reversed(ts) if t.weight > 0)


def build_messages(df: DataFrame, out: str, user, system, row_id: str, purpose: str, seed: int, names: str | None = None) -> DataFrame:
    """An array of a system message, if there is a template for it, and a user message; `names`: column of the template names by role."""
    said, kinds = [], []
    for role, ts in (("system", system), ("user", user)):
        if ts:
            text, name = templates.choose(df, ts, F.col(row_id) if len(ts) > 1 else F.lit(0), f"{purpose} {role}", seed)
            said.append(F.struct(F.lit(role).alias("role"), text.alias("content")))
            kinds.append(F.struct(F.lit(role).alias("role"), name.alias("type")))
    df = df.withColumn(out, F.array(*said))
    return df.withColumn(names, F.array(*kinds)) if names else df


def ask(backend: Backend, retries: int = 3, fields: tuple[str, ...] = (), **kw):
    """A column function: JSON messages -> struct<content, error>; content null after `retries` failures."""

    async def one(text):
        if text is None:
            return None, "no messages"
        error = None
        for _ in range(max(1, retries)):
            try:
                got = await backend.chat(json.loads(text), **kw, **({"response_format": fields} if fields else {}))
                if fields:
                    json.loads(strip_fence(got))
                return got, None
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"[:300]
        return None, error

    @F.arrow_udf("struct<content: string, error: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in pieces(batches, AT_ONCE, backend.batch_size):
            got = gather([one(t) for t in b.to_pylist()], backend.concurrency, backend.batch_size)
            yield pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.string()) for k in (0, 1)], names=["content", "error"])

    return run


def strip_fence(text: str) -> str:
    import re

    return re.sub(r"(?is)^```[a-z]*\s*|\s*```$", "", text.strip())


@register()
class ChatGenerator(Operator):
    """One answer per row. After `max_retries` failures it is '' (or an empty object in JSON mode) and `_error` says why.
    Validators, if given, then keep the rows that pass."""

    def setup(self, user_template, system_template=None, output_col: str = "output", prompt_type_col: str = "_prompt_type", max_retries: int = 3, force_json_mode: bool = False, response_fields=(), validator_list=None, backend: Backend | None = None, id_col: str = "hash_id", seed: int = 0, litellm_kwargs: dict | None = None, valid_col: str | None = None, **kw):
        self.user, self.system = templates.as_templates(user_template), templates.as_templates(system_template)
        self.out, self.types, self.retries, self.json, self.fields = output_col, prompt_type_col, max_retries, force_json_mode, tuple(response_fields)
        self.validators, self.backend, self.id, self.seed, self.kw, self.valid = validator_list or [], backend or HashBackend(), id_col, seed, kw, valid_col

    def apply(self, df: DataFrame) -> DataFrame:
        from millrace.operators.judges import validate_all

        df = build_messages(df, "_messages", self.user, self.system, self.id, "chat", self.seed, self.types)
        fields = self.fields or (("answer",) if self.json else ())
        df = df.withColumn("_reply", ask(self.backend, self.retries, fields, **self.kw)(F.to_json("_messages")))
        text = F.coalesce(F.col("_reply.content"), F.lit("{}" if self.json else ""))
        df = df.withColumn(self.out, strings.json_reply(text) if self.json else text).withColumn("_error", F.col("_reply.error")).drop("_reply", "_messages")
        return validate_all(df, self.validators) if self.validators else df


@register()
class HttpChat(ChatGenerator):
    """ChatGenerator against one HTTP service. A row whose calls fail has a null answer. There is no default address."""

    def setup(self, user_template, api_base: str | None = None, model: str = "default", api_key_env: str | None = None, system_template=None, output_col: str = "response", timeout: float = 60, max_retries: int = 3, backend: Backend | None = None, response_format=None, **kw):
        from millrace.operators.backends import HttpBackend

        if backend is None and not api_base:
            raise ValueError("api_base is needed")
        super().setup(user_template, system_template, output_col, max_retries=max_retries, backend=backend or HttpBackend(api_base, model, api_key_env, timeout), response_fields=tuple(response_format or ()), **kw)

    def apply(self, df: DataFrame) -> DataFrame:
        out = super().apply(df)
        return out.withColumn(self.out, F.when(F.col("_error").isNull(), F.col(self.out)))


#: In recipes a validator is a Python predicate on messages -> (valid, reason, score); rules by name are translated.
Check = Callable[[list[dict]], tuple[bool, str | None, float | None]]
SCORES = "array<map<string, struct<reason: string, score: double>>>"


def _checks(validators) -> list[tuple[str, Check]]:
    return [(getattr(v, "__name__", f"check{k}"), v) for k, v in enumerate(validators or [])]


def _passes(checks, messages) -> tuple[bool, dict]:
    scores = {}
    for name, f in checks:
        try:
            got = f(messages)
            ok, reason, score = got if isinstance(got, tuple) else (bool(got), None, float(bool(got)))
        except Exception:  # noqa: BLE001  a judge that fails doesn't pass
            ok, reason, score = False, None, None
        scores[name] = {"reason": reason, "score": score}
        if not ok:
            return False, scores
    return True, scores


class Recipe(Operator):
    """Several dependent calls per row: `each(row, backend)` is a coroutine that gives (messages, scores) or None, which
    drops the row. `inputs` are the columns it reads."""

    inputs: tuple[str, ...] = ()

    async def each(self, row: dict):
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        each, limit, size, read = self.each, self.backend.concurrency, self.backend.batch_size, [c for c in dict.fromkeys((self.id, *self.inputs)) if c in df.columns]

        @F.arrow_udf(f"struct<messages: {MESSAGES}, scores: {SCORES}>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            msg = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
            score = pa.list_(pa.map_(pa.string(), pa.struct([("reason", pa.string()), ("score", pa.float64())])))
            for b in pieces(batches, AT_ONCE, size):
                got = gather([each(r) for r in b.to_pylist()], limit, size)
                got = [None if isinstance(g, BaseException) or g is None else g for g in got]
                none = pa.array([g is None for g in got])
                yield pa.StructArray.from_arrays([pa.array([g and g[0] for g in got], msg), pa.array([g and [list(s.items()) for s in g[1]] for g in got], score)], names=["messages", "scores"], mask=none)

        out = df.withColumn("_made", run(F.struct(*[F.col(f"`{c}`") for c in read]))).where("_made IS NOT NULL")
        return out.withColumn(self.out, F.col("_made.messages")).withColumn(self.valid, F.col("_made.scores")).drop("_made")


@register()
class Magpie(Recipe):
    """The model writes the user's turn itself, after a chat template's user prefix, and then answers it.

    A pair that a validator rejects is taken back; after `max_retries` rejections in a row the chat ends. It goes on
    while its messages, the system one among them, are at most max_turns // 2. Rows without a pair are dropped.
    """

    def setup(self, system_template=None, max_turns: int = 2, validator_list=None, user_prefix: str = "<|user|>\n", assistant_prefix: str = "<|assistant|>\n", user_max_tokens: int = 100, assistant_max_tokens: int = 3000, output_col: str = "messages", valid_col: str = "_validation_scores", max_retries: int = 3, backend: Backend | None = None, id_col: str = "hash_id", seed: int = 0, litellm_kwargs=None, tokenizer_path=None, **_):
        self.system = templates.as_templates(system_template)
        self.max_turns, self.checks, self.prefix, self.assistant = max_turns, _checks(validator_list), user_prefix, assistant_prefix
        self.user_max, self.assistant_max, self.out, self.valid, self.retries = user_max_tokens, assistant_max_tokens, output_col, valid_col, max_retries
        self.backend, self.id, self.seed, self.inputs = backend or HashBackend(), id_col, seed, ("_system",)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.system:
            text, _ = templates.choose(df, self.system, F.col(self.id) if len(self.system) > 1 else F.lit(0), "magpie", self.seed)
            df = df.withColumn("_system", text)
        return super().apply(df).drop("_system")

    def prompt(self, messages: list[dict], role: str) -> str:
        said = "".join(f"<|{m['role']}|>\n{m['content']}\n" for m in messages)
        return said + (self.prefix if role == "user" else self.assistant)

    async def _continue(self, prompt: str, most: int, n: int) -> str | None:
        for k in range(max(1, self.retries)):
            try:
                text, why = await self.backend.complete(prompt, max_tokens=most, seed=n * 1000 + k)
            except Exception:  # noqa: BLE001
                continue
            if why == "stop" and text.strip():
                return text.strip()
        return None

    async def pair(self, messages: list[dict], n: int) -> list[dict] | None:
        user = await self._continue(self.prompt(messages, "user"), self.user_max, n)
        if user is None:
            return None
        grown = [*messages, {"role": "user", "content": user}]
        answer = await self._continue(self.prompt(grown, "assistant"), self.assistant_max, n)
        return None if answer is None else [*grown, {"role": "assistant", "content": answer}]

    async def each(self, row: dict):
        messages = [{"role": "system", "content": row["_system"]}] if row.get("_system") else []
        lead, scores, failed, n = len(messages), [], 0, 0
        while len(messages) <= self.max_turns // 2 or len(messages) == lead:
            grown, n = await self.pair(messages, n), n + 1
            ok, s = _passes(self.checks, grown) if grown else (False, {})
            if ok:
                messages, failed = grown, 0
                scores.append(s)
            elif (failed := failed + 1) >= self.retries:
                break
        return (messages, scores) if len(messages) > lead else None


def chunk_indices(n: int, turns: int, row_id, seed: int, one_repeat: bool = False) -> list[int]:
    """Which of n chunks the turns use, in order: a sample without repeats, or all of them and repeats drawn one by one
    (`one_repeat`: the same one each time)."""
    if n <= 0:
        return []
    if n < turns:
        more = [int(draw(row_id, "repeat", 0 if one_repeat else k, seed) * n) for k in range(turns - n)]
        return sorted([*range(n), *more])
    return sorted(sorted(range(n), key=lambda i: (draw(row_id, "sample", i, seed), i))[:turns])


@register()
class ContextualMagpie(Magpie):
    """Magpie over a document: each turn's system message holds another pair of neighbouring chunks. The first chosen
    chunk only seeds the first prompt, so there are at most max_turns - 1 turns; the result has no system message."""

    def setup(self, system_template, text_col: str = "text", chunk_size: int = 300, separators=None, chunk_as_multiturn: bool = True, tokenizer_path: str | None = None, max_turns: int = 2, **kw):
        super().setup(system_template=system_template, max_turns=max_turns, **kw)
        self.text, self.size, self.separators, self.multi, self.tokenizer = text_col, chunk_size, tuple(separators or SEPARATORS), chunk_as_multiturn, Tokenizer(tokenizer_path)

    def apply(self, df: DataFrame) -> DataFrame:
        self.inputs = tuple(df.columns)
        return Recipe.apply(self, df.where(F.length(self.text) > 0))

    async def each(self, row: dict):
        chunks = recursive_split(row[self.text], self.size, 0, self.tokenizer.length, self.separators)
        pairs = [a + b for a, b in zip(chunks, [*chunks[1:], ""])]
        picked = [pairs[i] for i in chunk_indices(len(pairs), self.max_turns, row.get(self.id), self.seed)] if self.multi else [row[self.text]] * self.max_turns
        if not picked:
            return None
        which = chosen(self.system, row.get(self.id), "magpie", 0, self.seed)
        render = lambda c: which.render(**{k: v for k, v in row.items() if v is not None} | {self.text: c})
        system, talk, scores = render(picked[0]), [], []
        for k, chunk in enumerate(picked[1:] or picked):
            grown = await self.pair([{"role": "system", "content": system}, *talk], k)
            ok, s = _passes(self.checks, grown[1:]) if grown else (False, {})
            if ok:
                talk, system = grown[1:], render(chunk)
                scores.append(s)
        return (talk, scores) if talk else None


@register()
class DocSelfInstruct(Recipe):
    """Questions, with answers if the response has them, from chunks of a document; existing messages are continued."""

    def setup(self, user_template, system_template=None, multiturn_user_template=None, text_col: str = "text", chunk_as_multiturn: bool = True, chunk_sliding_window_size: int = 2, separators=None, chunk_size: int = 300, max_turns: int = 1, tokenizer_path: str | None = None, response_format: str | None = "QueryAnswer", validator_list=None, valid_col: str = "_validation_scores", output_col: str = "messages", max_retries: int = 3, backend: Backend | None = None, id_col: str = "hash_id", seed: int = 0, litellm_kwargs=None, **_):
        self.fields = {"Query": ("query",), "QueryAnswer": ("query", "answer"), "ReasonQueryAnswer": ("query", "answer", "reason"), None: ()}[response_format]
        self.user, self.system, self.multi = (templates.as_templates(t) for t in (user_template, system_template, multiturn_user_template))
        self.text, self.as_turns, self.window, self.size, self.turns = text_col, chunk_as_multiturn, chunk_sliding_window_size, chunk_size, max_turns
        self.separators, self.tokenizer, self.checks, self.retries = tuple(separators or SEPARATORS), Tokenizer(tokenizer_path), _checks(validator_list), max_retries
        self.out, self.valid, self.backend, self.id, self.seed = output_col, valid_col, backend or HashBackend(), id_col, seed

    def apply(self, df: DataFrame) -> DataFrame:
        self.inputs = tuple(df.columns)
        return super().apply(df)

    async def each(self, row: dict):
        chunks = recursive_split(row.get(self.text) or "", self.size, 0, self.tokenizer.length, self.separators)
        if not chunks:
            return None
        wide = ["".join(chunks[i : i + self.window]) for i in range(len(chunks))]
        picked = [wide[i] for i in chunk_indices(len(wide), self.turns, row.get(self.id), self.seed, one_repeat=True)] if self.as_turns else [row[self.text]] * self.turns
        messages, scores = list(row.get(self.out) or []), []
        values = {k: v for k, v in row.items() if v is not None}
        pick = lambda ts, role, n: chosen(ts, row.get(self.id), f"instruct {role}", n, self.seed)
        for n, chunk in enumerate(picked):
            scope = values | {self.text: chunk, "messages": messages}
            prompt = [{"role": "system", "content": pick(self.system, "system", n).render(**scope)}] if self.system else []
            prompt.append({"role": "user", "content": pick(self.multi if self.multi and self.system else self.user, "user", n).render(**scope)})
            for _ in range(max(1, self.retries)):
                try:
                    got = await self.backend.chat(prompt, **({"response_format": self.fields} if self.fields else {}))
                    reply = json.loads(strip_fence(got)) if self.fields else {"query": got}
                    grown = [*messages, {"role": "user", "content": reply["query"]}]
                except Exception:  # noqa: BLE001
                    continue
                if reply.get("answer"):
                    grown.append({"role": "assistant", "content": reply["answer"]})
                ok, s = _passes(self.checks, grown)
                if ok:
                    messages = grown
                    scores.append(s)
                    break
        return (messages, scores) if messages else None


@register()
class PromptEvolver(Recipe):
    """Rewrite the last user message `evolve_times` times (a list: one of them is drawn), answer it if wanted, and
    validate; after `max_retries` attempts the row is dropped."""

    def setup(self, evolve_template, messages_col: str = "messages", output_col: str = "messages", evolve_times=3, first_prompt_template=None, gen_assistant_resp: bool = False, gen_assistant_resp_template=None, validator_list=None, valid_col: str = "_validation_scores", max_retries: int = 2, backend: Backend | None = None, id_col: str = "hash_id", seed: int = 0, litellm_kwargs=None, **_):
        self.evolve, self.first, self.answer = (templates.as_templates(t) for t in (evolve_template, first_prompt_template, gen_assistant_resp_template))
        self.messages, self.out, self.times, self.respond, self.checks, self.valid = messages_col, output_col, evolve_times, gen_assistant_resp, _checks(validator_list), valid_col
        self.retries, self.backend, self.id, self.seed = max_retries, backend or HashBackend(), id_col, seed

    def apply(self, df: DataFrame) -> DataFrame:
        self.inputs = tuple(df.columns)
        return super().apply(df)

    async def each(self, row: dict):
        times = self.times
        if isinstance(times, (list, tuple)):
            times = times[int(draw(row.get(self.id), "evolve", 0, self.seed) * len(times))]
        values = {k: v for k, v in row.items() if v is not None}
        for k in range(max(1, self.retries)):
            before = [dict(m) for m in row.get(self.messages) or []]
            try:
                if before and before[-1]["role"] == "user":
                    prompt, before = before[-1]["content"], before[:-1]
                elif self.first:
                    prompt = await self.backend.chat([{"role": "user", "content": chosen(self.first, row.get(self.id), "first", k, self.seed).render(**values)}])
                else:
                    return None
                for n in range(times):
                    t = chosen(self.evolve, row.get(self.id), f"template {k}", n, self.seed)
                    prompt = await self.backend.chat([{"role": "user", "content": t.render(**values | {"prompt": prompt})}])
                grown = [*before, {"role": "user", "content": prompt}]
                if self.respond:
                    asked = [*before, {"role": "user", "content": chosen(self.answer, row.get(self.id), "answer", k, self.seed).render(**values | {"prompt": prompt})}] if self.answer else grown
                    grown = [*grown, {"role": "assistant", "content": await self.backend.chat(asked)}]
            except Exception:  # noqa: BLE001
                continue
            ok, s = _passes(self.checks, grown)
            if ok:
                return grown, [s]
        return None


def best_candidate(scores: list[float | None]) -> int | None:
    """The first of the greatest scores above 0."""
    best, at = 0.0, None
    for i, s in enumerate(scores):
        if s is not None and s > best:
            best, at = s, i
    return at


@register()
class RejectSampling(Recipe):
    """For each user turn, candidates by calls with drawn parameters; valid ones compete by the last validator's score."""

    def setup(self, search_space_params: dict[str, list], num_combinations: int = 10, messages_col: str = "messages", output_col: str = "messages", validator_list=None, valid_col: str = "_validation_scores", ground_as_candidate: bool = False, max_retries_if_no_valid_response: int = 3, backend: Backend | None = None, id_col: str = "hash_id", seed: int = 0, litellm_kwargs=None, **_):
        if not validator_list:
            raise ValueError("reject sampling needs a validator to score candidates")
        self.space, self.n, self.messages, self.out, self.checks, self.valid = search_space_params, num_combinations, messages_col, output_col, _checks(validator_list), valid_col
        self.ground, self.retries, self.backend, self.id, self.seed = ground_as_candidate, max_retries_if_no_valid_response, backend or HashBackend(), id_col, seed
        self.inputs = (messages_col,)

    def parameters(self, row_id, n: int) -> dict:
        return {k: v[int(draw(row_id, f"param {k}", n, self.seed) * len(v))] for k, v in self.space.items()}

    async def each(self, row: dict):
        old = [dict(m) for m in row.get(self.messages) or []]
        talk, scores, n = [m for m in old if m["role"] == "system"][:1], [], 0
        for i, m in enumerate(old):
            if m["role"] != "user":
                continue
            asked = [*talk, m]
            for _ in range(max(1, self.retries)):
                answers = []
                for _ in range(self.n):
                    try:
                        answers.append(await self.backend.chat(asked, **self.parameters(row.get(self.id), n)))
                    except Exception:  # noqa: BLE001
                        pass
                    n += 1
                if self.ground and i + 1 < len(old) and old[i + 1]["role"] == "assistant":
                    answers.append(old[i + 1]["content"])
                judged = [_passes(self.checks, [*asked, {"role": "assistant", "content": a}]) for a in answers]
                best = best_candidate([s[self.checks[-1][0]]["score"] if ok else None for ok, s in judged])
                if best is not None:
                    talk = [*asked, {"role": "assistant", "content": answers[best]}]
                    scores.append(judged[best][1])
                    break
        return (talk, scores) if scores else None


def best_by_score(candidates: DataFrame, group: str, order: str, score: str) -> DataFrame:
    """The rows of a candidate table that win their group: the greatest score above 0, the first by `order` of equal ones."""
    w = Window.partitionBy(group).orderBy(F.desc(score), order)
    return candidates.where(F.col(score) > 0).withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")

