"""Sources: files with content-hash ids and resumption, generated rows, converted documents, small driver-side files."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.names import unused
from millrace.operators.base import Operator, register

FORMATS = {"jsonl": "json", "json": "json", "csv": "csv", "parquet": "parquet", "text": "text", "orc": "orc"}


def content_hash(columns: list[str]) -> Column:
    """MD5 of the row as JSON with keys in order and nulls written: the order of columns doesn't matter."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}))


def with_hash_id(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A column hash_id: the given one where it isn't null, else the hash of the other columns."""
    made = content_hash([c for c in (columns or df.columns) if c != "hash_id"])
    return df.withColumn("hash_id", F.coalesce(F.col("hash_id"), made) if "hash_id" in df.columns else made)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ids that earlier runs wrote; None before the first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema("hash_id string").parquet(path) if there else None


def resume(df: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Rows that aren't in the ledger, the first in the order of the scan of each hash_id. Rows are ranked within tasks before they are moved, so repeats don't come together in one."""
    (at,) = unused(df.columns, "_at")
    df = df.withColumn(at, F.monotonically_increasing_id())
    if ledger is not None:
        df = df.join(ledger.select("hash_id").distinct(), "hash_id", "left_anti")
    (nth,) = unused(df.columns, "_nth")
    first = F.row_number().over(Window.partitionBy("hash_id").orderBy(at))
    return df.withColumn(nth, first).where(F.col(nth) == 1).drop(nth, at)


class Reader(Operator):
    """A source: `read(spark)` gives rows; `load` adds ids and, when resuming, skips what the ledger holds."""

    resume = False

    def read(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def load(self, spark: SparkSession, ledger: str | None = None) -> DataFrame:
        df = with_hash_id(self.read(spark))
        return resume(df, read_ledger(spark, ledger) if ledger else None) if self.resume else df


@register("HfDatasetReader", "DatasetReader")
class FileReader(Reader):
    """Files of a format. `shuffle` orders rows by a hash of their id and `seed`; `debug` keeps the first 10 (or so many)
    in that order or by id. `stream` reads them as a stream, for which `schema` (DDL) is needed."""

    def setup(self, path=None, format: str = "parquet", dataset_kwargs: dict | None = None, resume: bool = False, debug=False, shuffle: bool = False, seed: int = 0, schema: str | None = None, stream: bool = False, options: dict | None = None):
        kw = dataset_kwargs or {}
        files = kw.get("data_files")
        self.path = path or (files if not isinstance(files, dict) else list(files.values())[0]) or kw.get("data_dir")
        self.format = FORMATS[kw.get("path", format) if kw.get("path", format) in FORMATS else format]
        self.resume, self.debug, self.shuffle, self.seed, self.schema, self.stream, self.options = resume, debug, shuffle, seed, schema, stream, options or {}

    def read(self, spark: SparkSession) -> DataFrame:
        r = (spark.readStream if self.stream else spark.read).format(self.format).options(**({"header": "true"} if self.format == "csv" else {}) | self.options)
        if self.schema:
            r = r.schema(self.schema)
        return r.load(self.path).withColumnRenamed("value", "text") if self.format == "text" else r.load(self.path)

    def load(self, spark: SparkSession, ledger: str | None = None) -> DataFrame:
        df = super().load(spark, ledger)
        key = F.md5(F.concat(F.col("hash_id"), F.lit(f"|{self.seed}"))) if self.shuffle else F.col("hash_id")
        if self.debug:
            return df.orderBy(key, "hash_id").limit(10 if self.debug is True else int(self.debug))
        return df.orderBy(key) if self.shuffle else df


@register()
class NullReader(Reader):
    """Rows with nothing but an id: random, or with a seed the MD5 of seed and number."""

    def setup(self, num_data: int = 10, seed: int | None = None):
        self.n, self.seed = num_data, seed

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n).select((F.uuid() if self.seed is None else F.md5(F.concat(F.lit(f"{self.seed}|"), F.col("id").cast("string")))).alias("hash_id"))

    def load(self, spark: SparkSession, ledger: str | None = None) -> DataFrame:
        return self.read(spark)


_DROP = re.compile(r"(?is)<(script|style|noscript|head)\b.*?</\1\s*>|<!--.*?-->")
_BREAK = re.compile(r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|footer|header)\b[^>]*>")


def html_to_text(html: str) -> str:
    """The text of a page, blocks on lines of their own."""
    from html import unescape

    s = re.sub(r"<[^>]*>", "", _BREAK.sub("\n", _DROP.sub(" ", html)))
    return "\n".join(x for x in (re.sub(r"[^\S\n]+", " ", y).strip() for y in unescape(s).split("\n")) if x)


def _office(kind: str, content: bytes) -> str:
    """The text of a docx, pptx or xlsx: paragraphs and table rows (as Markdown), slides in order, cells of sheets by row."""
    import io
    import zipfile
    from xml.etree import ElementTree

    z = zipfile.ZipFile(io.BytesIO(content))
    tree = lambda name: ElementTree.fromstring(z.read(name))  # noqa: E731, S314
    tag = lambda e: e.tag.rpartition("}")[2]
    said = lambda e: "".join("\t" if tag(x) == "tab" else "\n" if tag(x) == "br" else x.text or "" for x in e.iter() if tag(x) in ("t", "tab", "br"))
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    if kind == "docx":
        out = []
        for e in next(x for x in tree("word/document.xml") if tag(x) == "body"):
            if tag(e) == "p":
                out.append(said(e))
            elif tag(e) == "tbl":
                out += ["| " + " | ".join(said(c) for c in row if tag(c) == "tc") + " |" for row in e if tag(row) == "tr"]
        return "\n".join(x for x in out if x.strip())
    if kind == "pptx":
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        return "\n\n".join("\n".join(t for e in tree(n).iter() if tag(e) == "p" and (t := said(e)).strip()) for n in slides)
    shared = [said(e) for e in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for n in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number):
        for row in (e for e in tree(n).iter() if tag(e) == "row"):
            cells = []
            for c in row:
                v = next((x.text or "" for x in c if tag(x) == "v"), "")
                cells.append(shared[int(v)] if c.get("t") == "s" and v else said(c) if c.get("t") == "inlineStr" else v)
            out.append("| " + " | ".join(cells) + " |")
    return "\n".join(out)


def convert(name: str, content: bytes) -> str | None:
    """The text of a file by its suffix: HTML, Markdown, plain text, AsciiDoc, docx, pptx, xlsx. None for kinds that need a service: pdf and images."""
    kind = Path(name).suffix.lower().lstrip(".")
    if kind in ("docx", "pptx", "xlsx"):
        return _office(kind, content)
    text = content.decode("utf-8", "replace")
    return html_to_text(text) if kind in ("html", "htm") else text if kind in ("md", "txt", "asciidoc", "adoc") else None


class ConversionService:
    """A client of a document-conversion service: a file is sent to `url`/convert and its task polled until it succeeds or fails.

    Answers are JSON: {"task_id"} to the first, {"task_status", "text"} to `url`/status/<task_id>; a status of success or
    failure ends the polling, and `timeout` seconds do. Kinds that convert() knows need no service unless `always`.
    """

    def __init__(self, url: str, timeout: float = 300, every: float = 1, always: bool = False, options: dict | None = None):
        self.url, self.timeout, self.every, self.always, self.options = url.rstrip("/"), timeout, every, always, options or {}

    def _json(self, route: str, body: dict | None = None) -> dict:
        import urllib.request

        ask = urllib.request.Request(self.url + route, json.dumps(body).encode() if body is not None else None, {"Content-Type": "application/json"})
        with urllib.request.urlopen(ask, timeout=self.timeout) as r:
            return json.load(r)

    def __call__(self, name: str, content: bytes) -> str | None:
        import base64
        import time

        if not self.always and (text := convert(name, content)) is not None:
            return text
        task = self._json("/convert", {"filename": Path(name).name, "content": base64.b64encode(content).decode(), "options": {"to": "md", "ocr": False, **self.options}})["task_id"]
        until = time.monotonic() + self.timeout
        while time.monotonic() < until:
            got = self._json(f"/status/{task}")
            if got["task_status"] == "success":
                return got["text"]
            if got["task_status"] == "failure":
                raise ValueError(f"{name} can't be converted")
            time.sleep(self.every)
        raise TimeoutError(name)


@register("DoclingServerReader")
class DocumentReader(Reader):
    """Files under a folder as text. `converter(name, bytes) -> text` runs on the executors: the offline one, or with `url`
    a ConversionService. Files that it fails on or can't read are left out; their number is in the metrics `observed`, and
    failures() lists them. By default each row's id is its text's hash."""

    def setup(self, data_path: str, text_col: str = "text", converter=None, pattern: str = "*", resume: bool = False, url: str | None = None, kwargs: dict | None = None):
        self.path, self.text, self.pattern, self.resume = data_path, text_col, pattern, resume
        self.converter = converter or (ConversionService(url, **(kwargs or {})) if url else convert)
        self.observed: Observation | None = None

    def converted(self, spark: SparkSession) -> DataFrame:
        """(path, text, error) of every file: an error says why the text is null."""
        import pyarrow as pa

        f = self.converter

        def run(batches):
            for b in batches:
                out = []
                for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    try:
                        text = f(name, content)
                        out.append((text, None if text is not None else "no converter for this kind"))
                    except Exception as e:  # noqa: BLE001  a file that can't be read must not end the job
                        out.append((None, f"{type(e).__name__}: {e}"[:300]))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], pa.string()) for k in (0, 1))], ["path", "text", "error"])

        files = spark.read.format("binaryFile").option("pathGlobFilter", self.pattern).option("recursiveFileLookup", "true").load(self.path)
        return files.select("path", "content").mapInArrow(run, "path string, text string, error string")

    def failures(self, spark: SparkSession) -> DataFrame:
        return self.converted(spark).where("text IS NULL").select("path", "error")

    def read(self, spark: SparkSession) -> DataFrame:
        self.observed = Observation()
        got = self.converted(spark).observe(self.observed, F.count(F.lit(1)).alias("files"), F.count("error").alias("failed"))
        return got.where("text IS NOT NULL").select(F.col("text").alias(self.text))


class _Loader(yaml.SafeLoader):
    """YAML without code, with ${NAME} read from the environment."""


def _env(loader, node):
    text = loader.construct_scalar(node)

    def value(m):
        if m[1] not in os.environ:
            raise KeyError(f"the environment has no {m[1]}")
        return os.environ[m[1]]

    return re.sub(r"\$\{(\w+)\}", value, text)


_Loader.add_implicit_resolver("!env", re.compile(r".*\$\{\w+\}.*"), None)
_Loader.add_constructor("!env", _env)


def load_yaml(path: str):
    with open(path, encoding="utf-8") as f:
        return yaml.load(f, _Loader)  # noqa: S506  a safe loader


def load_words(path: str) -> list[str]:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def first_by_hash(df: DataFrame) -> DataFrame:
    """One row of each hash_id, the first by all columns, where the choice must be the same in any engine."""
    w = Window.partitionBy("hash_id").orderBy(*[c for c in df.columns if c != "hash_id"])
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
