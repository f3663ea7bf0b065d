import hashlib
import random
import re
import shutil
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import media, queries, rules, tokens, urls
from tests.llm.fixtures import LONG, awkward, documents

# quality rules


def test_ledger_policies_and_ablations(spark):
    rows = [(1, "the river and the stone of the garden is in it.", "en", "a"), (2, "the river and $$$ ### @@@ the stone", "en", "a"), (3, "BUY NOW THE BEST OF IT ALL", "en", "a"), (4, "go " * 50, "en", "a"), (5, "", "en", "a"), (6, None, "en", "a"), (7, "one two", "en", "a")]
    led = rules.ledger(documents(spark, rows))
    got = {r.doc_id: r for r in rules.apply_policies(led).collect()}
    failed = {i: {n for b, n, _ in rules.RULES if r.fail_bits >> b & 1} for i, r in got.items()}
    assert failed[1] == set()
    assert {"marked_words", "unclean_words"} <= failed[2]
    assert "capitals" in failed[3]
    assert "repeated_words" in failed[4] and "no_stopword" in failed[4]
    assert failed[5] == failed[6] == {"empty", "too_few_words"} and failed[7] == {"too_few_words"}
    assert got[4].keep_lenient_v1 and not got[4].keep_lenient_v2
    assert (got[1].n_words, got[1].n_lines, got[1].n_stop) == (11, 1, 8)
    for name, m in rules.policy_masks().items():
        for r in rules.ablations(led).where(f"policy = '{name}'").collect():
            bit = next(1 << b for b, n, _ in rules.RULES if n == r.rule)
            hit = [x for x in got.values() if x.fail_bits & bit]
            alone = [x for x in hit if x.fail_bits & m == bit]
            assert (r.failed, r.only_this, r.words_regained) == (len(hit), len(alone), sum(x.n_words for x in alone))


def test_rules_on_awkward_rows(spark):
    docs = awkward(spark)
    got = rules.apply_policies(rules.ledger(docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert next(r.n_words for r in got if r.doc_id == 5) == len(LONG.split())
    assert rules.ledger(documents(spark)).count() == 0
    assert {tuple(r)[2:] for r in rules.ablations(rules.ledger(documents(spark))).collect()} == {(0, 0, 0)}
    with pytest.raises(KeyError):
        rules.mask("strict", 9)


# URLs


def verdicts(df):
    return {r.page_id: (r.verdict, r.component) for r in df.collect()}


def page(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, k string, to string")


def test_blocks_follow_aliases_and_allow_comes_first(spark):
    link = '<html><head><LINK href="{}" rel=canonical></head></html>'
    rows = [
        (1, "http://bad.example/x", "", "", ""),
        (2, "https://www.mirror.example/x.html?utm_source=f#top", link.format("//bad.example/x"), "", ""),
        (3, "http://hop.example/1", '<meta http-equiv="refresh" content="0; url=/2">', "", ""),
        (4, "http://m.hop.example:80/2/", None, "", ""),
        (5, "http://fine.example/x", link.format("http://fine.example/x"), "", ""),
        (6, "https://mirror.example/x", "", "", ""),
        (7, None, None, None, None), (8, "not a url", "", "", ""), (9, "", "", "", ""),
        (1, "http://bad.example/x", "", "", ""),
        (10, "http://sub.bad.example/ok", "", "", ""), (11, "http://notbad.example/", "", "", ""), (12, "http://fine.example/casino/1", "", "", ""),
    ]
    redirects = spark.createDataFrame([("http://a.example/s", "http://hop.example/2"), ("http://a.example/s", "https://bad.example/x/"), (None, "http://fine.example/x"), ("http://q.example/", None)], "src string, dst string")
    pages = page(spark, rows)
    plain = verdicts(urls.decide(pages, block_hosts=("bad.example",), allow_urls=("mirror.example/x",)))
    assert plain[1][0] == "block" and plain[2][0] == plain[6][0] == "allow" and plain[2][1] == plain[1][1]
    assert plain[3][0] == plain[4][0] == "pass" and plain[3][1] == plain[4][1] != plain[1][1]
    assert plain[5][0] == plain[7][0] == plain[8][0] == plain[9][0] == plain[11][0] == "pass" and plain[10][0] == plain[12][0] == "block"
    got = urls.decide(pages, redirects, block_hosts=("bad.example",), allow_urls=("mirror.example/x",))
    assert got.count() == len(rows)
    far = verdicts(got)
    assert far[3][0] == far[4][0] == "block" and far[2][0] == "allow" and far[5][0] == "pass"
    assert urls.decide(page(spark, [])).count() == 0
    assert {v for v, _ in verdicts(urls.decide(pages, redirects, block_hosts=(), block_paths=(), allow_urls=())).values()} == {"pass"}


def test_every_form_of_link_makes_an_alias(spark):
    canon, fresh = '<link rel="canonical" href="{}">', "<meta content='0; URL={}' http-equiv=Refresh>"
    cases = [
        ("http://h.example/a/b/c.html", canon.format("bad1.html"), "http://h.example/a/b/bad1"),
        ("http://h.example/a/b/d.html", canon.format("../bad2"), "http://h.example/a/bad2"),
        ("http://h.example/list", canon.format("?id=1"), "http://h.example/list?id=1"),
        ("http://h.example/e", fresh.format("bad4"), "http://h.example/bad4"),
        ("http://h.example/f", canon.format("http://o.example/x?a=1&amp;b=2"), "http://o.example/x?a=1&b=2"),
        ("http://h.example/g", canon.format("https://o.example/u/./v/../bad6"), "http://o.example/u/bad6"),
        ("http://h.example/i/", "<base href='/other/'>" + canon.format("bad7"), "http://h.example/other/bad7"),
        ("http://h.example/j", "<link title='a>b' href=' /bad8 ' rel='alternate Canonical'>", "http://h.example/bad8"),
        ("http://h.example/k", '<META HTTP-EQUIV="refresh" CONTENT="3;url=&#39;bad9&#39;">', "http://h.example/bad9"),
        ("http://h.example/l", "<meta http-equiv=refresh content=0; url=/bad10>", "http://h.example/bad10"),
    ]
    rows = [(i, u, h, "", "") for i, (u, h, _) in enumerate(cases)] + [(100 + i, u, "", "", "") for i, (*_, u) in enumerate(cases)]
    rows += [(200, "http://n.example/1", canon.format("mailto:x@y.example"), "", ""), (201, "http://n.example/2", canon.format("http://[bad"), "", ""), (202, None, canon.format("x"), "", ""), (203, "http://n.example/3", '<link rel=canonical><meta http-equiv=refresh content=5><meta name=refresh content="0;url=/1">', "", "")]
    got = verdicts(urls.decide(page(spark, rows), block_hosts=("o.example",), block_paths=(r"/bad[0-9]+$", r"id=1$"), allow_urls=()))
    for i in range(len(cases)):
        assert got[i] == ("block", got[100 + i][1]), cases[i]
    assert {got[i][0] for i in (200, 201, 202, 203)} == {"pass"} and got[203][1] == "n.example/3"


def test_pages_of_a_list_are_no_aliases(spark):
    rows = [(i, f"http://l.example/list?{q}", "", "", "") for i, q in enumerate(("page=1", "page=2&utm_source=x", "ref=3", "page=2"))]
    args = {"block_hosts": (), "block_paths": (r"page=2$",), "allow_urls": ("l.example/list?page=1",)}
    assert [v for _, (v, _) in sorted(verdicts(urls.decide(page(spark, rows), **args)).items())] == ["allow", "block", "pass", "block"]
    assert len({c for _, c in verdicts(urls.decide(page(spark, rows), tracking="ref|page|" + urls.TRACKING)).values()}) == 1


def odd_urls():
    """Some hundred URLs of which each is to mean what urllib makes of it."""
    hosts = ["bad.example", "BAD.example", "user@bad.example", "u:p@bad.example", "bad.example:8080", "u@bad.example:80", "bad.example.", "bad.example.:443", "www.bad.example", "b%61d.example", "bücher.example", "xn--bcher-kva.example", "Bücher.Example.", "a@b@bad.example", "sub.bad.example", "notbad.example", "192.0.2.1", "[2001:db8::1]:80"]
    paths = ["", "/", "/a", "/a/", "/a/index.html", "/a/./b", "/a/../b", "/../b", "/%61", "/a%2fb", "/a%2Fb", "/a b", "/a.htm", "//a"]
    queries = ["", "?x=1", "?page=2", "?utm_source=q", "?utm_source=q&x=1&gclid=3", "?x=1#f", "#f", "?"]
    return [f"{s}://{h}{p}{q}" for k, h in enumerate(hosts) for i, p in enumerate(paths) for j, q in enumerate(queries) if (i + j + k) % 3 == 0 for s in (("http", "https", "HTTP")[i % 3],)]


def by_urllib(url):
    x = urlsplit(url)
    host = unquote(x.hostname or "").rstrip(".").lower()
    host = host if host.isascii() else host.encode("idna").decode()
    host = f"[{host}]" if ":" in host else host
    host = host.removeprefix("www.")
    plain = lambda t: re.sub("%[0-9A-Fa-f]{2}", lambda m: c if re.fullmatch("[A-Za-z0-9._~-]", c := unquote(m[0])) else m[0].upper(), t)
    path = plain(x.path)
    if "/." in path:
        path = urlsplit(urljoin("http://h", path)).path
    path = path.removesuffix("/") if path.endswith("/") else path
    for end in (".html", ".htm"):
        path = path.removesuffix(end)
    keep = [q for q in plain(x.query).split("&") if q and q.split("=")[0] not in ("utm_source", "gclid")]
    return host + path + ("?" + "&".join(keep) if keep else "")


def test_normal_forms_are_those_of_urllib():
    every = odd_urls()
    assert len(every) > 500
    pattern = re.compile(urls.TRACKING)
    for u in every:
        assert urls.normal(u, pattern) == by_urllib(u), u
    for u, want in {
        "http:\\\\bad.example\\x": "bad.example/x", " http://bad.example/x\n": "bad.example/x", "ht\ttp://bad.exa\nmple/x": "bad.example/x", "http://bad\u3002example/x": "bad.example/x",
        "http://ｂａｄ.example/x": "bad.example/x", "mailto:a@b": None, "//bad.example/x": None, "": None, None: None, "http://": None, "http:///x": None, "http://@/x": None,
    }.items():
        assert urls.normal(u, pattern) == want, u


def test_no_spelling_slips_past_a_block(spark):
    same = [u for u in odd_urls() if re.fullmatch(r"(www\.|sub\.)?bad\.example", by_urllib(u).split("/")[0].split("?")[0])]
    rows = [(i, u, "", "", "") for i, u in enumerate(same)] + [(100_000 + i, u, "", "", "") for i, u in enumerate(odd_urls()) if "notbad" in u or "192" in u]
    got = verdicts(urls.decide(page(spark, rows), block_hosts=("bad.example",), block_paths=(), allow_urls=()))
    assert len(same) > 200 and all(got[i][0] == "block" for i in range(len(same))) and {v for i, (v, _) in got.items() if i >= 100_000} == {"pass"}


def test_links_in_comments_and_scripts_make_no_alias(spark):
    link = "<link rel=canonical href='http://bad.example/x'>"
    pages = [f"<!-- {link} -->", f"<script>var a = \"{link}\"</script>", f"<style>{link}</style>", f"<!-- {link}", f"<TITLE>{link}</TITLE>", f"<textarea>{link}", f"<!-- a --><!-- b -->{link}<!-- c -->"]
    got = verdicts(urls.decide(page(spark, [(i, f"http://p{i}.example/", h, "", "") for i, h in enumerate(pages)]), block_hosts=("bad.example",), allow_urls=()))
    assert [got[i][0] for i in range(7)] == ["pass"] * 6 + ["block"]


def test_rules_may_be_tables_of_any_size(spark):
    rows = [(i, f"http://s{i % 3}.h{i}.example/p{i}", "", "", "") for i in range(200)]
    hosts = spark.range(0, 100_000, 2).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example")).alias("h"), F.lit(1).alias("x"))
    allow = spark.range(0, 200, 10).select(F.concat_ws("", F.lit("s"), (F.col("id") % 3).cast("string"), F.lit(".h"), F.col("id").cast("string"), F.lit(".example/p"), F.col("id").cast("string")).alias("u"))
    got = verdicts(urls.decide(page(spark, rows), block_hosts=hosts.unionAll(hosts), block_paths=(), allow_urls=allow))
    assert [got[i][0] for i in range(200)] == ["allow" if i % 10 == 0 else "block" if i % 2 == 0 else "pass" for i in range(200)]


def test_awkward_pages_and_names(spark):
    long = "<p>text</p>" * 200_000
    rows = [(1, "http://a.example/", long + "<link rel=canonical href=//b.example/>", None, ""), (2, "http://b.example/", "<" * 100_000 + "canonical", "", ""), (3, "http://c.example/", "<link rel=canonical href='" + "x" * 100_000, "", ""), (None, None, None, None, None)]
    got = urls.decide(page(spark, rows).toDF("normal", "verdict", "component", "k", "host"), key="normal", url="verdict", html="component", block_hosts=("a.example",), allow_urls=())
    assert got.columns == ["normal", "verdict", "normal_", "component", "blocked_self", "allowed_self", "verdict_"]
    assert {r.normal: r.verdict_ for r in got.collect()} == {1: "block", 2: "block", 3: "pass", None: "pass"}


def test_a_long_chain_of_redirects_is_one_component(spark):
    rows = [(i, f"http://h{i}.example/p", "", "", "") for i in range(200)]
    red = spark.createDataFrame([(f"http://h{i}.example/p", f"https://www.h{i + 1}.example/p/") for i in range(199)], "src string, dst string")
    got = verdicts(urls.decide(page(spark, rows), red, block_hosts=("h150.example",), allow_urls=("h3.example/p",)))
    assert len({c for _, c in got.values()}) == 1 and got[3][0] == "allow"
    assert all(v == "block" for i, (v, _) in got.items() if i != 3)


# the ledger is stored


def test_the_ledger_is_written_once_and_read_for_every_policy(spark, tmp_path):
    docs = awkward(spark)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    led = rules.stored_ledger(docs, str(tmp_path))
    want = sorted(map(str, rules.ablations(rules.ledger(docs)).collect()))
    shutil.rmtree(f"{tmp_path}/docs")  # the texts are gone, the ledger isn't
    assert sorted(map(str, rules.ablations(rules.stored_ledger(docs, str(tmp_path))).collect())) == want
    assert rules.stored_ledger(docs, str(tmp_path)) is led and rules.apply_policies(led).count() == 13
    rules.forget(docs, str(tmp_path))
    assert (spark.sparkContext.applicationId, str(tmp_path)) not in rules._stored
    assert rules.ledger(awkward(spark).withColumnRenamed("doc_id", "n_words"), key="n_words").columns[:2] == ["n_words", "n_words_"]


# token ids


def test_codes_round_trip_at_every_width():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 2**32, n, np.uint64) >> r.integers(0, 32, n, np.uint64)).astype(np.uint32)
        c, d = tokens.encode(x)
        assert len(c) == -(-n // 4) and len(d) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in x)
        assert np.array_equal(tokens.decode(c, d, n), x)
    edge = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    assert np.array_equal(tokens.decode(*tokens.encode(edge), len(edge)), edge)


def test_every_text_comes_back_from_its_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, rank = tokens.to_binary(docs)
    enc, back = tokens.load(tokens.VOCABULARY), np.argsort(rank)
    text, freq = {r.doc_id: r.text for r in docs.collect()}, Counter()
    for r in out.collect():
        ids = back[tokens.decode(r.control, r.data, r.n_tokens)].tolist()
        assert ids == enc.encode_ordinary(text.pop(r.doc_id))
        freq.update(ids)
    assert not text
    best = sorted(range(len(rank)), key=lambda i: (-freq[i], i))
    assert best == back.tolist()


def test_the_token_query_can_be_decoded_from_what_it_returns(spark, sf_dir, tmp_path):
    queries.op8_token_binary(spark, sf_dir).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.columns == ["doc_id", "n_tokens", "control", "data"]
    enc, back = tokens.load(tokens.VOCABULARY), np.argsort(tokens.stored_ranks(out.where("n_tokens > 0")))
    got = {r.doc_id: enc.decode(back[tokens.decode(r.control, r.data, r.n_tokens)].tolist()) for r in out.collect()}
    assert got == {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_tokens_of_awkward_rows(spark):
    docs = awkward(spark)
    out, rank = tokens.to_binary(docs)
    rows = out.collect()
    want = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, tokens.to_text(r.control, r.data, r.n_tokens, rank)) for r in rows) == want
    assert all((r.n_tokens, r.control, r.data) == (0, b"", b"") for r in rows if r.doc_id in (2, 3))
    assert tokens.to_binary(documents(spark))[0].count() == 0


# media


PAGE = """<html><head><title>no</title></head><body>One <b>two</b><p>three<img src="/a.png" alt="A &amp; B">four</p>
<figure><img src='b.png'><img src=c.png><figcaption>Both <i>of</i> them</figcaption></figure>
<!-- <img src="no.png"> --><script>"<img src=no.png>"</script><video><source src="v.mp4"></video>
<img src="data:text/plain;base64,aGk="><img src="data:broken"><img alt="no source"><audio src="s.ogg"></audio> five &lt;end&gt;"""


def test_text_and_media_stay_in_order(spark):
    store = spark.createDataFrame([("http://h.example/d/b.png", "image/png", b"B"), ("http://h.example/d/b.png", "image/png", b"C"), (None, "x", b"no"), ("http://h.example/a.png", None, b"A")], "url string, mime string, payload binary")
    pages = spark.createDataFrame([(1, "http://h.example/d/page", PAGE, "x")], "page_id long, url string, html string, found string")
    r = media.sequences(pages, store).first()
    assert len(r.texts) == len(r.media) == r.n_text + r.n_media
    assert all((t is None) != (m is None) for t, m in zip(r.texts, r.media))
    seq = [t if t is not None else (m.kind, m.url, m.caption) for t, m in zip(r.texts, r.media)]
    base = "http://h.example/d/"
    assert seq == ["One two", "three", ("image", "http://h.example/a.png", None), "four", ("image", base + "b.png", "Both of them"), ("image", base + "c.png", "Both of them"), ("video", base + "v.mp4", None), ("image", None, None), ("audio", base + "s.ogg", None), "five <end>"]
    by = {m.url: m for m in r.media if m}
    assert by["http://h.example/a.png"].alt == "A & B" and bytes(by["http://h.example/a.png"].payload) == b"A"
    assert bytes(by[base + "b.png"].payload) == b"B" and by[base + "c.png"].payload is None
    assert bytes(by[None].payload) == b"hi" and by[None].mime == "text/plain" and by[None].digest == hashlib.sha256(b"hi").hexdigest()


def seen(html, base="http://h.example/d/p"):
    segs, _ = media.parse(html, base)
    assert [x["pos"] for x in segs] == list(range(len(segs)))
    return [x["text"] if x["kind"] is None else (x["url"].rsplit("/", 1)[1], x["caption"]) for x in segs]


def test_a_caption_goes_to_all_media_of_its_figure(spark):
    first, middle = "<figure><figcaption>C</figcaption><img src=a></figure>", "<figure><img src=a><figcaption>C <b>d</b></figcaption>t<img src=b></figure><img src=c>"
    assert seen(first) == [("a", "C")] and seen(middle) == [("a", "C d"), "t", ("b", "C d"), ("c", None)]
    assert seen("x<figure><figcaption>C</figcaption>t</figure>y") == ["x", "C", "t", "y"]  # no media: text in its place
    assert seen("<figure><figcaption>C</figcaption><img src=a>t") == [("a", "C"), "t"] == seen("<figure><figcaption>C<img src=a></figure>t")
    assert seen("<figure><figcaption>out</figcaption><figure><img src=a><figcaption>in</figcaption></figure><img src=b></figure>") == [("a", "in"), ("b", "out")]
    got = {r.page_id: r for r in media.sequences(spark.createDataFrame([(1, "http://h.example/", first), (2, "http://h.example/", middle)], "page_id long, url string, html string")).collect()}
    assert (got[1].n_text, got[1].n_media, got[1].texts) == (0, 1, [None]) and [m and m.caption for m in got[2].media] == ["C d", None, "C d", None]


def test_the_head_ends_where_the_body_begins(spark):
    open_head = "<html><head><title>t</title><p>text<img src=a>"
    assert seen(open_head) == ["text", ("a", None)]
    assert seen('<head><script>"<p>no<!--"</script><style>p > b {}</style><META name=x><link href=y>\n</head>\n<body>b') == ["b"]
    assert seen("<head><title>t <p> t</title> bare <b>text</b>") == ["bare text"] and seen("<head><title>t</title></html>x") == ["x"]
    assert seen("<head><title>open <p>no") == [] and seen("<head><template><p>no</template><img src=a>") == [("a", None)]
    r = media.sequences(spark.createDataFrame([(1, "http://h.example/", open_head)], "page_id long, url string, html string")).first()
    assert (r.n_text, r.n_media) == (1, 1)


def test_srcset_names_media():
    assert seen('<img srcset="s.png 480w, l.png 1024w, m.png 800w">') == [("l.png", None)]
    assert seen('<img srcset="one.png, two.png 2x"><img src="" srcset="one.png, half.png 0.5x"><img src=s.png srcset="l.png 2x">') == [("two.png", None), ("one.png", None), ("s.png", None)]
    assert seen("<picture><source srcset='p.webp 1x, q.webp 2x'><source srcset=r.png><img alt=x></picture><img alt=y>") == [("q.webp", None)]
    assert seen("<img srcset=' , '><img srcset=',,,'>") == []
    segs, inline = media.parse('<img srcset="data:text/plain;base64,aGk= 1x">', "")
    assert [x["payload"] for x in inline] == [b"hi"] and segs[0]["url"] is None


def test_noscript_is_read():
    assert seen("a<noscript><img src=n.png>text</noscript>b") == ["a", ("n.png", None), "text", "b"]
    assert seen("<head><noscript><style>no</style><img src=n.png></noscript><title>no</title></head><body>b") == [("n.png", None), "b"]


def test_media_of_awkward_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 0), (2, "u", "", 0), (None, "http://[bad", "<img src=x>" * 3000, 0), (3, "u", "<p>a<p>b", 0), (3, "u", "<p>a<p>b", 0), (4, None, "<!-- open <p>x", 0), (5, "u", "<" * 50_000, 0), (6, "u", "<img src='a'" * 5000, 0)], "page_id long, url string, html string, pos int")
    got = media.sequences(pages).collect()
    assert len(got) == 8
    assert [(r.n_text, r.n_media, r.texts, r.media) for r in got if r.page_id in (1, 2, 4)] == [(0, 0, [], [])] * 3
    assert [r.texts for r in got if r.page_id == 3] == [["a", "b"]] * 2
    assert next(r.n_media for r in got if r.page_id is None) == 3000
    assert media.sequences(pages.where("page_id < 0")).count() == 0
    named = pages.toDF("media", "texts", "html", "found")
    got = media.sequences(named, key="media", url="texts")
    assert got.columns == ["media", "texts", "n_text", "n_media", "texts_", "media_"] and got.count() == 8


class Walker(HTMLParser):
    """The texts and media of plain pages, by the standard library's parser."""

    def __init__(self, base):
        super().__init__()
        self.base, self.out, self.buf, self.off = base, [], [], 0

    def flush(self):
        t = " ".join("".join(self.buf).split())
        self.buf = []
        if t:
            self.out.append(t)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "template"):
            self.off += 1
        if tag not in media._INLINE and not self.off:
            self.flush()
        if tag == "img" and dict(attrs).get("src"):
            self.out.append(("image", urljoin(self.base, dict(attrs)["src"])))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "template"):
            self.off -= 1
        elif tag not in media._INLINE and not self.off:
            self.flush()

    def handle_data(self, data):
        if not self.off:
            self.buf.append(data)


def test_sequences_are_what_another_parser_sees(spark, sf_dir):
    pages = [(p.page_id, p.url, p.html) for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    r = random.Random(2)
    parts = ["<p>one <b>two</b> &amp; three</p>", "<img src='/i{}.png' alt=x>", "<div>four<img src=j{}.png>five</div>", "<ul><li>six<li>se<i>ven</i></ul>", "<!-- <img src=no.png> -->", "<script>if (a < b) '<img src=no.png>'</script>", " bare &lt;text&gt; ", "<h1>T&eacute;te</h1>"]
    pages += [(10**6 + i, f"http://h{i}.example/d/p.html", "<html><head><title>no</title></head><body>" + "".join(r.choice(parts).format(r.randrange(9)) for _ in range(30)) + "</body></html>") for i in range(300)]
    got = {x.page_id: x for x in media.sequences(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, url, html in pages:
        w = Walker(url)
        w.feed(html)
        w.close()
        w.flush()
        assert [t if t is not None else (m.kind, m.url) for t, m in zip(got[i].texts, got[i].media)] == w.out, i


def test_ten_thousand_pages_with_media_of_every_form(spark):
    """Payloads resolve by digest, also where a third of all references name one image."""
    html = "concat('<html><head><title>t</title><p>a', id, '<picture><source srcset=\"s', id % 7, '.png 1x, l', id % 7, '.png 2x\"><img alt=q></picture><noscript><img src=n', id, '.png></noscript><img src=/hot.png>', if(id % 5 = 0, '<img src=\"data:text/plain;base64,aGk=\">', ''))"
    pages = spark.range(10_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/d/"), F.col("id").cast("string")).alias("url"), F.expr(html).alias("html"))
    store = spark.range(20_000).select(F.concat(F.lit("http://h.example/d/n"), F.col("id").cast("string"), F.lit(".png")).alias("url"), F.lit("image/png").alias("mime"), F.col("id").cast("string").cast("binary").alias("payload"))
    store = store.unionAll(spark.createDataFrame([("http://h.example/hot.png", "image/png", b"hot")], store.schema))
    got = media.sequences(pages, store).select("page_id", "texts", F.explode("media").alias("m")).where("m IS NOT NULL").select("page_id", "m.url", "m.payload", "texts").collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.url and r.url.rsplit("/", 1)[1], r.payload and bytes(r.payload)))
        assert r.texts[0] == f"a{r.page_id}"
    assert all(by[i] == [(f"l{i % 7}.png", None), (f"n{i}.png", str(i).encode()), ("hot.png", b"hot")] + [(None, b"hi")] * (i % 5 == 0) for i in range(10_000))


def test_the_media_query_keeps_every_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in media.sequences(pages).collect()}
    assert len(got) == pages.count()
    for p in pages.collect():
        segs, _ = media.parse(p.html, p.url)
        assert got[p.page_id].texts == [s["text"] for s in segs] and got[p.page_id].n_text > 0
