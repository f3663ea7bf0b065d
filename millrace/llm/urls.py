"""URL filters with redirect equivalence.

URLs that redirect to each other, name each other as canonical or share a normal form are aliases: they form connected
components. A block rule that hits any alias blocks them all; an allow rule that hits a URL itself comes first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions.names import quoted, unused
from millrace.operators.components import connected_components
from millrace.plans.scratch import materialize

#: Hosts (with their subdomains) and path patterns.
BLOCK_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.net")
BLOCK_PATHS = (r"/(casino|viagra|xxx)(/|$)",)
ALLOW_URLS = ("spam-farm.example.org/en/about", "cheap-pills.example.com/en/450")
#: Parameters that say how a page was reached, not which it is.
TRACKING = r"(utm_[a-z]+|fbclid|gclid)"
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}([^/?#\\]*)([^?#]*)(?:\?([^#]*))?", re.S)
_TRIM = re.compile(r"[\t\n\r]+|^[\x00-\x20]+|[\x00-\x20]+$")
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
_PLAIN = frozenset(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"))
#: What can't hold a page's links: comments and elements whose content is text.
_OFF = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|noframes|template)\b.*?(?:</\1\s*>|\z)"
_TAGS = r"(?is)<(?:base|link|meta)\b(?:(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)"
_TAG = re.compile(r"<(\w+)(.*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|[\"']?([^\s\"'>]++)))?")
_REFRESH = re.compile(r"\s*(?:[0-9.]+(?:\s*[;,]|\s)\s*(?:url\s*=\s*)?|url\s*=\s*)(?:\"([^\"]*)|'([^']*)|(.*))", re.S | re.I)


@lru_cache(100_000)
def host(authority: str) -> str:
    """The host of an authority as browsers take it: without user, port and last dot, unescaped, in small letters, other alphabets in their ASCII form; without www. or m. before it."""
    h = unicodedata.normalize("NFKC", unquote(authority.rpartition("@")[2])).lower()
    h = re.sub(r":[0-9]*$", "", re.sub(r"[\u3002\uff61]", ".", h)).rstrip(".")
    if not h.isascii():
        try:
            h = h.encode("idna").decode()
        except UnicodeError:
            pass
    return re.sub(r"^(www|m)\.", "", h)


def _unescape(text: str) -> str:
    """Escapes of letters, digits and -._~ undone, others in capitals: they mean the same."""
    return _ESCAPE.sub(lambda m: chr(c) if (c := int(m[1], 16)) in _PLAIN else m[0].upper(), text) if "%" in text else text


def _path(path: str) -> str:
    path = _unescape(path.replace("\\", "/"))
    if "/." in path:
        out: list[str] = []
        for part in path.split("/")[1:]:
            if part == "..":
                out[-1:] = []
            elif part != ".":
                out.append(part)
        path = "/" + "/".join(out) + ("/" if path.endswith(("/.", "/..")) and out else "")
    return re.sub(r"(\.html?)?/?$", "", path, count=1)


def normal(url: str | None, tracking: re.Pattern) -> str | None:
    """Host and path without scheme, www. or m., user, port, fragment, tracking parameters, .html and a last slash; None for what has no scheme and host."""
    m = _URL.match(_TRIM.sub("", url or ""))
    if not m or not (h := host(m[1])):
        return None
    kept = [x for x in _unescape(m[3] or "").split("&") if x and not tracking.fullmatch(x.partition("=")[0])]
    return h + _path(m[2]) + ("?" + "&".join(kept) if kept else "")


def normal_form(tracking: str = TRACKING):
    """A column function: URL -> its normal form."""
    pattern = re.compile(tracking)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([normal(u, pattern) for u in b.to_pylist()], pa.string())

    return run


def resolve(base: str | None, to: str) -> str | None:
    """The absolute URL of `to` in a page at `base`, without dot segments; None for what can't be resolved."""
    try:
        url = urljoin(base or "", to.strip())
        path = urlsplit(url).path
        if "/." in path and "://" in url:  # urljoin() leaves those of targets with a host
            root = re.match(r"[^:]*://[^/?#]*", url)[0]
            url = root + urljoin("http://h/", path)[len("http://h") :] + url[len(root) + len(path) :]
        return url
    except ValueError:
        return None


def targets(url: str | None, tags: list[str] | None) -> list[str]:
    """The absolute targets of the first canonical link and the first meta refresh among a page's tags, attributes in any order."""
    found: dict[str, str] = {}
    for tag in tags or []:
        m = _TAG.match(tag)
        attrs: dict[str, str] = {}
        for a in _ATTR.finditer(m[2]):
            attrs.setdefault(a[1].lower(), unescape(next((x for x in a.groups()[1:] if x is not None), "")))
        kind, to = m[1].lower(), attrs.get("href", "")
        if kind == "link" and "canonical" not in attrs.get("rel", "").lower().split():
            continue
        if kind == "meta":
            if attrs.get("http-equiv", "").strip().lower() != "refresh":
                continue
            r = _REFRESH.match(attrs.get("content", ""))
            to = next((x for x in r.groups() if x), "") if r else ""
            to = to or attrs.get("url", "")  # of content=0; url=/x without quotes
        if to.strip():
            found.setdefault(kind, to)
    base = resolve(url, found.pop("base")) if "base" in found else url
    return [t for t in (resolve(base or url, x) for x in found.values()) if t]


@F.arrow_udf(ArrayType(StringType()))
def _targets(url: pa.Array, tags: pa.Array) -> pa.Array:
    return pa.array([targets(u, t) for u, t in zip(url.to_pylist(), tags.to_pylist())], pa.list_(pa.string()))


def link_tags(html: Column) -> Column:
    """The base, link and meta tags of a page that has a canonical link or a meta refresh, else null; those in comments and scripts don't count."""
    tags = F.filter(F.regexp_extract_all(F.regexp_replace(html, _OFF, " "), F.lit(_TAGS), F.lit(0)), lambda t: t.rlike(r"(?i)^<base|canonical|refresh"))
    return F.when(html.rlike(r"(?i)canonical|refresh"), tags)


def _rules(spark: SparkSession, rules, name: str) -> DataFrame:
    """A rule list as a table of one column, distinct: a table's first column, or the strings themselves."""
    if isinstance(rules, DataFrame):
        rules = rules.select(quoted(rules.columns[0]).alias(name)).where(F.col(name).isNotNull())
    else:
        rules = spark.createDataFrame([(r,) for r in rules], f"{name} string")
    return rules.distinct()


def decide(pages: DataFrame, redirects: DataFrame | None = None, *, key: str = "page_id", url: str = "url", html: str = "html", block_hosts=BLOCK_HOSTS, block_paths=BLOCK_PATHS, allow_urls=ALLOW_URLS, tracking: str = TRACKING) -> DataFrame:
    """key, url, normal, component, blocked_self, allowed_self, verdict for every row of `pages`.

    block_hosts (which block their subdomains too) and allow_urls (normal forms) are lists of strings or tables of any
    size, whose first column counts: they are joined, hosts by each of their suffixes. block_paths are a few patterns.
    `tracking` matches the whole names of parameters that the normal form leaves out. `redirects` (src, dst) are absolute
    URLs, in any number of hops. verdict: 'allow' (a rule allows the URL's normal form), 'block' (a rule blocks one of
    its aliases, itself among them), else 'pass'. Rows without a usable URL pass, with null in normal and component; null
    rows, repeated rows and links to oneself are harmless; links relative to the page resolve against its URL or its base
    element's. A column that is called like the key or the URL gets an underscore.
    """
    spark, form = pages.sparkSession, normal_form(tracking)
    p = materialize(pages.select(quoted(key).alias("k"), quoted(url).alias("url"), form(quoted(url)).alias("normal"), link_tags(quoted(html)).alias("tags")), "urls")
    links = p.where("size(tags) > 0").select("normal", F.explode(_targets("url", "tags")).alias("to"))
    edges = links.select(F.col("normal").alias("src"), form(F.col("to")).alias("dst"))
    if redirects is not None:
        edges = edges.unionAll(redirects.select(form(F.col("src")), form(F.col("dst"))))
    edges = materialize(edges.where("src <> dst"), "aliases")
    comp = connected_components(edges)
    nodes = p.select("normal").unionAll(edges.select("src")).unionAll(edges.select("dst")).where("normal IS NOT NULL").distinct()
    nodes = nodes.join(comp, nodes["normal"] == comp["node"], "left").select("normal", F.coalesce("component", "normal").alias("component"))
    nodes = nodes.withColumn("host", F.regexp_extract("normal", r"^([^/?]*)", 1))
    rest = F.expr("substring(normal, length(host) + 1)")
    by_path = F.lit(False)
    for r in block_paths:
        by_path = by_path | rest.rlike(r)
    parts = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix")
    bad_hosts = nodes.select("host").distinct().select("host", suffix).join(_rules(spark, block_hosts, "suffix"), "suffix", "left_semi").select("host").distinct()
    nodes = nodes.join(bad_hosts.withColumn("bad", F.lit(True)), "host", "left").withColumn("blocked_self", F.coalesce("bad", F.lit(False)) | by_path)
    allowed = _rules(spark, allow_urls, "normal").withColumn("allowed", F.lit(True))
    nodes = materialize(nodes.join(allowed, "normal", "left").select("normal", "component", "blocked_self", F.coalesce("allowed", F.lit(False)).alias("allowed_self")), "nodes")
    hit = nodes.where("blocked_self").select(F.col("component").alias("bad_component")).distinct()
    nodes = nodes.join(hit, nodes["component"] == hit["bad_component"], "left")
    nodes = nodes.select(F.col("normal").alias("_n"), "component", "blocked_self", "allowed_self", F.when(F.col("allowed_self"), "allow").when(F.col("bad_component").isNotNull(), "block").otherwise("pass").alias("verdict"))
    out = p.join(nodes, p["normal"] == nodes["_n"], "left")
    out = out.select("k", "url", "normal", "component", F.coalesce("blocked_self", F.lit(False)).alias("blocked_self"), F.coalesce("allowed_self", F.lit(False)).alias("allowed_self"), F.coalesce("verdict", F.lit("pass")).alias("verdict"))
    return out.toDF(*unused([], key, url, *out.columns[2:]))
