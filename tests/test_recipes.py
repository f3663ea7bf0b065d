"""Queries without SQL against plain Python, and what configurations can say."""

import asyncio
import json
import math
import re
import threading
import zipfile
from collections import Counter
from html.parser import HTMLParser
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions.templates import Template
from millrace.operators import dedup, generate, judges, vector
from millrace.operators.backends import HashBackend, gather
from millrace.operators.text import SIMPLIFIED, TRADITIONAL, to_simplified
from millrace.plans.runner import SequentialExecutor
from millrace.plans.spec import Spec
from millrace.sources import readers

WORDS = re.compile(r"[㐀-鿿豈-﫿]|(?:(?![㐀-鿿豈-﫿])\w)+|[^\s\w]")
B = HashBackend()


def run(coroutine):
    return asyncio.run(coroutine)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def talks(spark, sf_dir):
    out = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append({"role": r.role, "content": r.text})
    return out


def split(text, size, overlap, separators=("\n\n", "\n", "。", ".")):
    """Recursive splitting from its description: cut before the first separator there is, cut long pieces again, join neighbours while they fit."""
    n = lambda t: len(WORDS.findall(t))
    k = next((k for k, s in enumerate(separators) if s in text), None)
    if k is None:
        pieces, later = [text], ()
    else:
        parts = text.split(separators[k])
        pieces = [p for p in [parts[0]] + [separators[k] + p for p in parts[1:]] if p]
        later = separators[k + 1 :]
    out, now = [], []

    def end():
        if "".join(now).strip():
            out.append("".join(now).strip())

    for p in pieces:
        if n(p) >= size and (later or n(p) > size):
            end()
            now = []
            out += split(p, size, overlap, later) if later else [p.strip()] * bool(p.strip())
            continue
        if now and sum(map(n, now)) + n(p) > size:
            end()
            while now and (sum(map(n, now)) > overlap or sum(map(n, now)) + n(p) > size):
                now = now[1:]
        now = [*now, p]
    end()
    return out


def u(row_id, purpose, n=0):
    return generate.draw(row_id, purpose, n, 0)


def test_chunks(spark, sf_dir, docs):
    got = {r.doc_id: r.text_list for r in catalog.chunk_recursive(spark, sf_dir).collect()}
    assert got == {i: split(d.text, (100, 200)[u(i, "size") >= 0.5], (10, 20)[u(i, "overlap") >= 0.5]) for i, d in docs.items()}


def trimmed(text):
    lines = [x for x in text.split("\n") if x.strip()]
    while lines and (len(WORDS.findall(lines[-1])) <= 10 or lines[-1].rstrip().endswith(("...", "…"))):
        text = text.replace(lines.pop(), "")
    return re.sub("\n\n\n+", "\n\n", text)


def test_tails(spark, sf_dir, docs):
    got = {r.doc_id: r.text for r in catalog.tail_trim(spark, sf_dir).collect()}
    assert got == {i: trimmed(d.text) for i, d in docs.items()} and any(got[i] != d.text for i, d in docs.items())


def test_edu_tails(spark, sf_dir, docs):
    want = {}
    for i, d in docs.items():
        chunks = split(d.text, 60, 0)
        score = [run(B.score([{"content": "".join(chunks[k - 2 : k + 1])}])) if k >= 2 else None for k in range(len(chunks))]
        while chunks and (re.search(r"(\.\.\.|…)\s*\Z", chunks[-1]) or score[-1] is not None and score[-1] < 0):
            chunks.pop(), score.pop()
        if chunks:
            good = [s for s in score if s is not None and s > 0]
            want[i] = ("".join(chunks), sum(good) / len(good) if good else None)
    got = {r.doc_id: (r.text, r.edu_score) for r in catalog.edu_tail(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for i, (text, score) in want.items():
        assert got[i][0] == text and (got[i][1] is None if score is None else math.isclose(got[i][1], score, abs_tol=1e-9))


class Text(HTMLParser):
    BLOCKS = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article nav footer header".split())
    OFF = {"script", "style", "noscript", "head"}

    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in self.OFF
        self.out += ["\n"] * (tag in self.BLOCKS and not self.off)

    def handle_endtag(self, tag):
        self.off -= tag in self.OFF
        self.out += ["\n"] * (tag in self.BLOCKS and not self.off)

    def handle_data(self, data):
        self.out += [data] * (not self.off)


def test_page_texts(spark, sf_dir):
    got = {r.page_id: r.text for r in catalog.page_text(spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        t = Text()
        t.feed(p.html)
        t.close()
        assert got[p.page_id].split() == "".join(t.out).split() and len(got[p.page_id]) > 50


def test_magpie(spark, sf_dir, docs):
    got = {r.doc_id: [(m.role, m.content) for m in r.messages] for r in catalog.magpie_mock(spark, sf_dir).collect()}
    for i, d in docs.items():
        m = [("system", f"You know {d.source}.")]
        while len(m) <= 3:  # half of max_turns, and the first pair in any case
            for role in ("user", "assistant"):
                said = "".join(f"<|{r}|>\n{c}\n" for r, c in m)
                m.append((role, run(B.complete(said + f"<|{role}|>\n"))[0]))
        assert got[i] == m


def test_contextual_magpie(spark, sf_dir, docs):
    got = {r.doc_id: [(m.role, m.content) for m in r.messages] for r in catalog.contextual_magpie_mock(spark, sf_dir).collect()}
    for i, d in docs.items():
        chunks = split(d.text, 300, 0)
        pairs = [a + b for a, b in zip(chunks, [*chunks[1:], ""])]
        picked = [pairs[k] for k in generate.chunk_indices(len(pairs), 3, str(i), 0)]
        system, talk = f"Use: {picked[0]}", []
        for chunk in picked[1:]:
            for role in ("user", "assistant"):
                said = "".join(f"<|{r}|>\n{c}\n" for r, c in [("system", system), *talk])
                talk.append((role, run(B.complete(said + f"<|{role}|>\n"))[0]))
            system = f"Use: {chunk}"
        assert got[i] == talk


def test_self_instruct(spark, sf_dir, docs):
    got = {r.doc_id: [(m.role, m.content) for m in r.messages] for r in catalog.self_instruct_mock(spark, sf_dir).collect()}
    for i, d in docs.items():
        chunks = split(d.text, 300, 0)
        wide = ["".join(chunks[k : k + 2]) for k in range(len(chunks))]
        want = []
        for k in generate.chunk_indices(len(wide), 2, str(i), 0, one_repeat=True):
            reply = json.loads(run(B.chat([{"role": "user", "content": f"Ask about {wide[k]}"}], response_format=("query", "answer"))))
            want += [("user", reply["query"]), ("assistant", reply["answer"])]
        assert got[i] == want


def test_evolution(spark, sf_dir, talks):
    got = {r.conv_id: [(m.role, m.content) for m in r.messages] for r in catalog.evolve_mock(spark, sf_dir).collect()}
    assert got.keys() == talks.keys()
    for i, t in talks.items():
        t = [(m["role"], m["content"]) for m in t]
        say = lambda x: run(B.chat([{"role": "user", "content": x}]))
        prompt, before = (t[-1][1], t[:-1]) if t[-1][0] == "user" else (say("Begin."), t)
        for _ in range(3):
            prompt = say(f"Harder: {prompt}")
        assert got[i] == [*before, ("user", prompt), ("assistant", say(prompt))]


def test_rejection_sampling(spark, sf_dir, talks):
    got = {r.conv_id: [(m.role, m.content) for m in r.messages] for r in catalog.reject_sampling_mock(spark, sf_dir).collect()}
    want = {}
    for i, t in talks.items():
        out, done = [m for m in t if m["role"] == "system"][:1], False
        for k, m in enumerate(t):
            if m["role"] == "user":
                answers = [run(B.chat([*out, m]))] * 3 + [x["content"] for x in t[k + 1 : k + 2] if x["role"] == "assistant"]
                score = [catalog._length_score([{"content": a}])[2] for a in answers]
                if max(score) > 0:
                    out, done = [*out, m, {"role": "assistant", "content": answers[score.index(max(score))]}], True
        if done:
            want[i] = [(m["role"], m["content"]) for m in out]
    assert got == want


def test_retrieval(spark, sf_dir, docs):
    bench = [(str(r.item_id), run(B.embed([r.text]))[0]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if any(a) and any(b) else -1
    got = {r.doc_id: r.ids for r in catalog.embed_retrieve(spark, sf_dir).collect()}
    for i, d in docs.items():
        v = run(B.embed([d.text]))[0]
        near = sorted((-round(cos(v, x), 9), k) for k, x in bench)[:3]
        assert got[i] == [k for s, k in near if -s >= 0.2]


# what the library promises


class Counting(HashBackend):
    """Counts its texts in files, as it runs in other processes."""

    def __init__(self, path):
        super().__init__()
        self.path = str(path)

    async def embed(self, texts):
        with open(self.path, "a") as f:
            f.write("x" * len(texts))
        return await super().embed(texts)


def test_no_text_is_embedded_twice(spark, tmp_path):
    e = vector.Embedder(backend=Counting(tmp_path / "n"))
    index = spark.createDataFrame([(str(i), f"text {i}", [float(i % 5), 1.0, *[0.0] * 14], None) for i in range(20)], "id string, text string, embedding array<float>, metadata string")
    df = spark.createDataFrame([(str(i), f"ask {i}") for i in range(50)], "hash_id string, text string")
    assert vector.Retriever(index=index, similarity_threshold=-1.0, embedder=e).apply(df).count() == 50
    assert len((tmp_path / "n").read_text()) == 50


@pytest.mark.parametrize("spread", [0.3, 5.0])
def test_approximate_search_finds_nine_of_ten(spark, spread):
    import numpy as np

    r = np.random.default_rng(0)
    v = r.standard_normal((20, 32))[r.integers(0, 20, 1500)] + spread * r.standard_normal((1500, 32))
    x = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)] + [(9999, None)], "id long, v array<float>")
    q = x.where("id % 20 = 0").withColumnRenamed("id", "q").withColumnRenamed("v", "w")
    names = {"query_id": "q", "query_vec": "w", "index_id": "id", "index_vec": "v", "k": 10}
    exact = {(a.q, a.id, round(a.score, 6)) for a in vector.top_k(q, x, **names).collect()}
    near = {(a.q, a.id, round(a.score, 6)) for a in vector.top_k_cells(q, x, block_rows=50, **names).collect()}
    assert len(exact) == 750 and len(exact & near) >= 0.9 * len(exact)
    assert vector.top_k_cells(q, x.where("id < 0"), **names).count() == 0


def test_approximate_deduplication_keeps_what_the_exact_one_keeps(spark):
    import numpy as np

    r = np.random.default_rng(1)
    base = r.standard_normal((60, 32))
    v = np.concatenate([base, base[:30] + 0.05 * r.standard_normal((30, 32)), np.tile(base[:1], (200, 1)), np.zeros((2, 32))])
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)] + [(900, None)], "id long, v array<float>")
    kept = [{a.id for a in dedup.SemanticDedup(embedding_col="v", order_by="id", use_ann=ann, block_rows=40, cell_rows=20).apply(df).collect()} for ann in (False, True)]
    assert kept[0] == kept[1] == {*range(60), 290, 291, 900}


def test_minhash_by_tokens_and_verified(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h i j", "z y x w v u t s r q", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "hash_id long, text string")
    kept = lambda **k: {r.hash_id for r in dedup.MinHashDedup(dedup_level="token", **k).apply(df).collect()}
    assert {0, 3, 4} <= kept() and not kept() & {2, 5}
    assert kept(verify=True, threshold=1.0) == {0, 1, 3, 4} and kept(verify=True, threshold=0.0) == kept()


def test_templates_are_drawn_by_weight(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("hash_id", F.col("doc_id").cast("string"))
    ts = [{"template_str": "A {{ text }}", "weight": 3.0}, {"template_str": "B {{ text }}", "weight": 1.0}, {"template_str": "C", "weight": 0.0}]

    class Echo(HashBackend):
        async def chat(self, messages, **kw):
            return json.dumps({"query": messages[-1]["content"][:1], "answer": messages[0]["content"][:1]})

    got = generate.DocSelfInstruct(user_template=ts, system_template=ts, max_turns=2, backend=Echo()).apply(d).select("messages").collect()
    for role in (0, 1):
        n = Counter(m.content for r in got for m in r.messages[role::2])
        assert set(n) == {"A", "B"} and 0.6 < n["A"] / sum(n.values()) < 0.88
    assert [generate.chosen([Template("x", weight=0.0), Template("y")], i, "p", 0, 0).template_str for i in range(5)] == ["y"] * 5


def test_batches_limit_what_is_begun_together():
    now, most = 0, 0

    async def one(k):
        nonlocal now, most
        now += 1
        most = max(most, now)
        await asyncio.sleep(0.001)
        now -= 1
        if k == 3:
            raise ValueError
        return k

    got = gather([one(k) for k in range(50)], 100, 7)
    assert most == 7 and [g for g in got if not isinstance(g, ValueError)] == [k for k in range(50) if k != 3]


def test_options_of_a_configuration_reach_the_step(spark):
    spec = Spec.parse({"import_path": "ChatGenerator", "init_kwargs": {"user_template": "x"}, "async_cfg": {"concurrency": 5, "batch_size": 9, "show_progress": False}, "mp_cfg": {"num_proc": 3}})
    made = spec.build()
    assert (made.backend.concurrency, made.backend.batch_size, made.num_tasks) == (5, 9, 3)
    with pytest.raises(TypeError):
        Spec.parse({"import_path": "ChatGenerator", "mp_cfg": {"processes": 3}})
    source = readers.NullReader(num_data=40, seed=1)
    assert SequentialExecutor(reader=source, pipes=[made]).execute(spark).rdd.getNumPartitions() == 3


def test_rows_are_counted_by_step(spark, tmp_path):
    from millrace.operators.relational import Expression
    from millrace.sources.writers import FileWriter

    e = SequentialExecutor(reader=readers.NullReader(num_data=40, seed=1), pipes=[Expression(expr="hash_id < '8'")], writer=FileWriter(output_path=str(tmp_path / "out")), count_rows=True)
    e.execute(spark)
    n = spark.read.json(str(tmp_path / "out/data")).count()
    assert e.counts == {"0 NullReader": 40, "1 Expression": n} and 0 < n < 40


def office(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)


def test_office_files_and_a_service(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office(tmp_path / "a.docx", {"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"})
    office(tmp_path / "b.pptx", {f"ppt/slides/slide{k}.xml": f"<sld {a}><a:p><a:r><a:t>slide {k}</a:t></a:r></a:p></sld>" for k in (10, 2)})
    office(tmp_path / "c.xlsx", {"xl/sharedStrings.xml": f"<sst {x}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet {x}><sheetData><row><c t='s'><v>0</v></c><c><v>5</v></c><c t='inlineStr'><is><t>in</t></is></c></row></sheetData></worksheet>"})
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.md").write_text("# md")
    reader = readers.DocumentReader(data_path=str(tmp_path))
    assert sorted(r.text for r in reader.load(spark).collect()) == ["# md", "One two\n| x |  |", "slide 2\n\nslide 10", "| name | 5 | in |"]
    assert reader.observed.get == {"files": 6, "failed": 2}
    assert {r.path.rsplit("/", 1)[1] for r in reader.failures(spark).collect()} == {"d.pdf", "e.docx"}

    class Service(BaseHTTPRequestHandler):
        polls = Counter()

        def answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.answer({"task_id": body["filename"]})

        def do_GET(self):
            task = self.path.rsplit("/", 1)[1]
            Service.polls[task] += 1
            self.answer({"task_status": "pending" if Service.polls[task] < 3 else "failure" if task == "e.docx" else "success", "text": f"text of {task}"})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        reader = readers.DocumentReader(data_path=str(tmp_path), url=f"http://127.0.0.1:{server.server_port}", kwargs={"every": 0.01, "always": True})
        assert sorted(r.text for r in reader.load(spark).collect()) == [f"text of {n}" for n in ("a.docx", "b.pptx", "c.xlsx", "d.pdf", "f.md")]
        assert min(Service.polls.values()) >= 3 and reader.observed.get["failed"] == 1
    finally:
        server.shutdown()


def test_traditional_and_simplified(spark):
    assert len(TRADITIONAL) == len(SIMPLIFIED) == len(set(TRADITIONAL)) and not set(TRADITIONAL) & set(SIMPLIFIED)
    df = spark.createDataFrame([("他們說話的時候，電腦開了。",), ("plain",), (None,)], "t string")
    assert [r.t for r in df.select(to_simplified(F.col("t")).alias("t")).collect()] == ["他们说话的时候，电脑开了。", "plain", None]
    said = [(1, [{"role": "user", "content": "我們說話"}, {"role": "assistant", "content": "好的"}]), (2, [{"role": "user", "content": "我们说话"}]), (3, [{"role": "user", "content": "我們"}, {"role": "assistant", "content": "ok"}]), (4, [{"role": "user", "content": "说說"}])]
    m = spark.createDataFrame(said, "id long, messages array<struct<role:string, content:string>>")
    got = {r.id: (r.c, r.t) for r in m.select("id", judges.RULES["only_chinese"]().alias("c"), judges.RULES["only_traditional_chinese"]().alias("t")).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, True), 4: (True, False)}


def test_the_first_of_repeated_ids_stays(spark, tmp_path):
    spark.createDataFrame([(f"k{i % 7}", i) for i in range(100)], "hash_id string, v long").coalesce(1).write.parquet(f"{tmp_path}/x")
    got = readers.FileReader(path=f"{tmp_path}/x", resume=True).load(spark).collect()
    assert sorted((r.hash_id, r.v) for r in got) == [(f"k{i}", i) for i in range(7)]
