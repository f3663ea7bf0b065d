"""Interleaved text and media sequences from HTML.

A page becomes two aligned arrays: at each position either a piece of text or a reference to media. References carry
the digest under which their payload is looked up: of the bytes for data: URIs, of the absolute URL for others.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from html import unescape
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import quoted, unused
from millrace.plans.scratch import materialize

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_SPACE = re.compile(r"\s+")
_SKIP = {"script", "style", "template", "textarea"}
#: What can stand in a head; anything else, text too, ends it. Tags of these are text inside: only their end tag counts.
_HEAD = {"head", "base", "link", "meta", "title", "style", "script", "noscript", "template", "noframes", "basefont", "bgsound"}
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+>", re.I) for x in ("script", "style", "textarea", "title", "noframes")}
_URL = re.compile(r"[^\s,]\S*+")
_DESCRIPTOR = re.compile(r"(\d++(?:\.\d++)?)[wx](?=\s|\Z)")
_INLINE = set("a abbr b bdi bdo big cite code data em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "embed": "object", "iframe": "frame", "object": "object"}
SEGMENT = "struct<pos:int, text:string, kind:string, url:string, alt:string, caption:string, digest:string>"


def _payload(uri: str) -> tuple[str, bytes] | None:
    """Media type and bytes of a data: URI; None if it is broken."""
    head, comma, body = uri[5:].partition(",")
    if not comma:
        return None
    try:
        raw = base64.b64decode(unquote_to_bytes(body), validate=False) if head.endswith(";base64") else unquote_to_bytes(body)
    except (binascii.Error, ValueError):
        return None
    return head.removesuffix(";base64").split(";")[0] or "text/plain", raw


def _largest(srcset: str) -> str | None:
    """The first URL of the greatest width or density among the candidates; without a descriptor the density is 1."""
    best, size, at = None, -1.0, 0
    while m := _URL.search(srcset, at):
        url, at, n = m[0].rstrip(","), m.end(), None
        if url == m[0]:
            end = srcset.find(",", at)
            n, at = _DESCRIPTOR.search(srcset, at, len(srcset) if end < 0 else end), len(srcset) if end < 0 else end + 1
        if (by := float(n[1]) if n else 1.0) > size:
            best, size = url, by
    return best


def parse(html: str | None, base: str | None) -> tuple[list[dict], list[dict]]:
    """The ordered segments of a page, and the payloads written in it. Unclosed comments and scripts end with the page."""
    segs: list[dict] = []
    inline: dict = {}
    buf: list[str] = []
    figures: list[dict] = []  # the open figures: their media and captions among the segments, and the caption being read
    opened: list[dict] = []  # those whose caption is being read
    gone: set[int] = set()  # captions that went to media

    def flush():
        t = _SPACE.sub(" ", unescape("".join(buf))).strip()
        buf.clear()
        if t:
            segs.append({"pos": len(segs), "text": t, "kind": None, "url": None, "alt": None, "caption": None, "digest": None})

    def sink() -> list[str]:
        return opened[-1]["open"] if opened else buf

    def end_caption(figure: dict):
        """The caption stands as text until the figure ends, and stays so if that has no media."""
        if figure["open"] is not None:
            flush()
            buf.extend(figure["open"])
            opened.pop()
            figure["open"], before = None, len(segs)
            flush()
            figure["captions"] += segs[before:]

    def end_figure():
        """Its caption goes to all its media but those that have one from a figure within."""
        figure = figures.pop()
        end_caption(figure)
        if figure["media"] and figure["captions"]:
            t = " ".join(c["text"] for c in figure["captions"])
            for x in figure["media"]:
                x["caption"] = x["caption"] or t
            gone.update(c["pos"] for c in figure["captions"])

    def refer(kind: str, attrs: dict):
        src = attrs.get("src") or attrs.get("data-src") or attrs.get("data") or attrs.get("poster")
        many = kind == "image" and (attrs.get("srcset") or attrs.get("data-srcset"))
        src = unescape(src).strip() if src else _largest(unescape(many)) if many else None
        if not src:
            return
        flush()
        if src[:5].lower() == "data:":
            got = _payload(src)
            if got is None:
                return
            digest, url = hashlib.sha256(got[1]).hexdigest(), None
            inline[digest] = {"digest": digest, "mime": got[0], "payload": got[1]}
        else:
            try:
                url = urljoin(base or "", src)
            except ValueError:
                url = src
            digest = hashlib.sha256(url.encode("utf-8", "surrogatepass")).hexdigest()
        segs.append({"pos": len(segs), "text": None, "kind": kind, "url": url, "alt": unescape(attrs["alt"]).strip() if "alt" in attrs else None, "caption": None, "digest": digest})
        for f in figures:
            f["media"].append(segs[-1])

    s, at, skip, holder, picture = html or "", 0, None, None, None
    head, aside = False, False  # in the head; in a noscript of it, whose content stands in no head but doesn't end it
    while m := _TOKEN.search(s, at):
        if not skip and m.start() > at:
            head = head and (aside or not s[at : m.start()].strip())
            if not head or aside:
                sink().append(s[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if skip:
            if m[1] and name == skip:
                skip = None
            continue
        if head and name == "noscript":
            aside = not m[1]
        elif not aside and (name in ("body", "html", "br") if m[1] else name not in _HEAD):
            head = False
        if name == "head":
            flush()
            head, aside = not m[1], False
            continue
        if not m[1] and name in _RAW and (name in _SKIP or head):
            end = _RAW[name].search(s, at)
            at = end.end() if end else len(s)
            continue
        if name in _SKIP and not m[1]:
            skip = name
            continue
        attrs = {}
        if name in _MEDIA and not m[1] or name == "source":
            for a in _ATTR.finditer(m[3] or ""):
                attrs.setdefault(a[1].lower(), next((x for x in a.groups()[1:] if x is not None), ""))
        if name in _MEDIA:
            if not m[1]:
                before = len(segs)
                if name == "img" and picture and not any(attrs.get(x) for x in ("src", "data-src", "srcset", "data-srcset")):
                    attrs["srcset"] = picture
                refer(_MEDIA[name], attrs)
                holder = _MEDIA[name] if name in ("video", "audio") and not any(x["kind"] for x in segs[before:]) else None
            elif name in ("video", "audio"):
                holder = None
        elif name == "source" and holder and attrs.get("src"):
            refer(holder, attrs)
            holder = None
        elif name == "source" and picture == "":
            picture = attrs.get("srcset") or attrs.get("data-srcset") or ""
        elif name == "picture":
            picture = None if m[1] else ""
        elif name == "figure":
            flush()
            if not m[1]:
                figures.append({"media": [], "captions": [], "open": None})
            elif figures:
                end_figure()
        elif name == "figcaption" and figures:
            flush()
            end_caption(figures[-1])
            if not m[1]:
                figures[-1]["open"] = []
                opened.append(figures[-1])
        elif name not in _INLINE:
            if (to := sink()) is not buf:
                to.append(" ")
            else:
                flush()
    if not skip and at < len(s) and (not head or aside or s[at:].strip()):
        sink().append(s[at:])
    while figures:
        end_figure()
    flush()
    segs = [x for x in segs if x["pos"] not in gone]
    for k, x in enumerate(segs):
        x["pos"] = k
    return segs, list(inline.values())


def sequences(pages: DataFrame, store: DataFrame | None = None, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, n_text, n_media, texts, media for every row of `pages`.

    texts and media are of equal length: at each position one is null. media: struct<kind, url, alt, caption, digest,
    mime, payload>; payload and mime are null where nothing resolves the digest. `store` (url, mime, payload) holds
    payloads of absolute URLs; of repeated URLs or digests one entry counts, the least. A figure's caption goes to
    all its media, before or after them. Null or empty pages have empty arrays. Repeated rows give repeated results.
    Of the store and of payloads in pages only those are moved that a page refers to. A column that is called like the
    key or the URL gets an underscore.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [parse(h, u) for h, u in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
            seg = pa.array([g[0] for g in got], pa.list_(pa.struct([("pos", pa.int32()), *((c, pa.string()) for c in ("text", "kind", "url", "alt", "caption", "digest"))])))
            inline = pa.array([g[1] for g in got], pa.list_(pa.struct([("digest", pa.string()), ("mime", pa.string()), ("payload", pa.binary())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), seg, inline], ["_rid", "_k", "_url", "segs", "inline"])

    rows = pages.select(F.monotonically_increasing_id().alias("_rid"), quoted(key).alias("_k"), quoted(url).alias("_url"), quoted(html).alias("_html"))
    p = materialize(rows.mapInArrow(run, f"_rid long, _k {kind}, _url string, segs array<{SEGMENT}>, inline array<struct<digest:string, mime:string, payload:binary>>"), "segments")
    n_media = F.size(F.filter("segs", lambda x: x["kind"].isNotNull()))
    p = p.withColumn("n_media", n_media)
    refs = p.where("n_media > 0").select("_rid", F.explode(F.filter("segs", lambda x: x["kind"].isNotNull())).alias("s")).select("_rid", "s.pos", "s.digest")
    known = p.select(F.explode("inline").alias("x")).select("x.*")
    if store is not None:
        known = known.unionAll(store.where("url IS NOT NULL").select(F.sha2("url", 256), "mime", "payload"))
    # of what the store holds, only what is referred to is moved
    known = known.join(refs.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("mime", "payload")).alias("v"))
    found = refs.join(known, "digest").groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("found"))
    # pages without media needn't be moved
    some = p.where("n_media > 0").join(found, "_rid", "left")
    rest = p.where("n_media = 0").withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    out = some.select(*rest.columns).unionAll(rest)
    hit = lambda x: F.try_element_at("found", x["pos"])
    media = F.transform("segs", lambda x: F.when(x["kind"].isNotNull(), F.struct(x["kind"].alias("kind"), x["url"].alias("url"), x["alt"].alias("alt"), x["caption"].alias("caption"), x["digest"].alias("digest"), hit(x)["mime"].alias("mime"), hit(x)["payload"].alias("payload"))))
    out = out.select("_k", "_url", (F.size("segs") - F.col("n_media")).alias("n_text"), "n_media", F.transform("segs", lambda x: x["text"]).alias("texts"), media.alias("media"))
    return out.toDF(*unused([], key, url, *out.columns[2:]))
