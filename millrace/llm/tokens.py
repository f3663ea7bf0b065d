"""Token ids as binary columns: ids ranked by frequency in byte-aligned variable-length coding.

An id is written in 1 to 4 bytes, low byte first, into the data; two bits of a separate control stream hold its length
less 1, four ids to a byte, the first in the low bits. Ids are replaced by their rank in the corpus, so the most
frequent 256 take one byte. Decoding looks lengths up in a table of 256 x 4 and gathers bytes in numpy.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import beside, quoted
from millrace.plans.scratch import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1


def read(path: str) -> bytes:
    """The vocabulary's file. It is read on the driver and sent with the tasks, so executors need no copy."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(4)
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("from file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def load(path: str):
    return encoding(read(path))


def kind_of(path: str) -> np.dtype:
    """Of a vocabulary's ids: unsigned 16 bits for up to 65,536, else 32."""
    return np.dtype("<u2" if load(path).n_vocab <= 65536 else "<u4")


class Tokenizer(dict):
    """text -> its ids as bytes of unsigned 32-bit or, for a vocabulary of up to 65,536, 16-bit numbers.

    A blank before anything but white space always begins a new piece of the pattern, so words between blanks can be
    looked up one by one; texts with a blank before white space are encoded whole. As a dict: word -> bytes of ' word'.
    """

    def __init__(self, vocabulary: bytes, limit: int = 500_000):
        super().__init__()
        self.enc, self.limit = encoding(vocabulary), limit
        self.kind = np.dtype("<u2" if self.enc.n_vocab <= 65536 else "<u4")
        self.plain = re.compile(r" \s").search

    def bytes_of(self, text: str) -> bytes:
        return np.array(self.enc.encode_ordinary(text), self.kind).tobytes()

    def __missing__(self, word: str) -> bytes:
        b = self.bytes_of(" " + word)
        if len(word) <= 40:
            self[word] = b
        return b

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.plain(text):
            return self.bytes_of(text)
        if len(self) > self.limit:
            self.clear()
        first, *rest = text.split(" ")
        return b"".join([self.bytes_of(first), *map(self.__getitem__, rest)])


class Counter(Tokenizer):
    """text -> the number of its ids. As a dict: word -> the number of ids of ' word'."""

    def __missing__(self, word: str) -> int:
        n = len(self.enc.encode_ordinary(" " + word))
        if len(word) <= 40:
            self[word] = n
        return n

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.plain(text):
            return len(self.enc.encode_ordinary(text))
        if len(self) > self.limit:
            self.clear()
        first, *rest = text.split(" ")
        return len(self.enc.encode_ordinary(first)) + sum(map(self.__getitem__, rest))


def count(vocabulary: str = VOCABULARY):
    """A column function: text -> the number of its tokens, 0 for null."""
    file = read(vocabulary)

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = Counter(file)
        for b in batches:
            yield pa.array([f(t) for t in b.to_pylist()], pa.int64())

    return run


def ids(vocabulary: str = VOCABULARY):
    """A column function: text -> its token ids as bytes, none for null."""
    file = read(vocabulary)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = Tokenizer(file)
        for b in batches:
            yield pa.array([f(t) for t in b.to_pylist()], pa.binary())

    return run


def encode(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned ids below 2^32."""
    x = np.ascontiguousarray(ids, "<u4")
    n = (x > 0xFF).view(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    pad = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    pad[: len(x)] = n
    control = (pad.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), x.view(np.uint8).reshape(-1, 4)[np.arange(4) <= n[:, None]].tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    n = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    d = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.cumsum(n) - n
    out = d[at].astype(np.uint32)
    for k in (1, 2, 3):
        long = n > k
        out[long] |= d[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def token_ids(docs: DataFrame, *, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """The written table (_k, raw): each row's key and ids as bytes, no bytes for a null or empty text."""
    return materialize(docs.select(quoted(key).alias("_k"), ids(vocabulary)(quoted(text)).alias("raw")), "token-ids")


def frequencies(raw: DataFrame, kind: np.dtype, size: int) -> np.ndarray:
    """How often each id occurs in the table; as many numbers as the vocabulary has ids come to the driver."""

    def run(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                n += np.bincount(np.frombuffer(x, kind), minlength=size) if len(x) > 40_000 else 0
            joined = b"".join(x for x in b.column(0).to_pylist() if len(x) <= 40_000)
            n += np.bincount(np.frombuffer(joined, kind), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    out = np.zeros(size, np.int64)
    got = raw.select("raw").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def ranks(freq: np.ndarray) -> np.ndarray:
    """rank[id]: 0 for the most frequent id, lower ids first among equals."""
    out = np.empty(len(freq), np.uint32)
    out[np.lexsort((np.arange(len(freq)), -freq))] = np.arange(len(freq), dtype=np.uint32)
    return out


def to_binary(docs: DataFrame, *, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> tuple[DataFrame, np.ndarray]:
    """(key, n_tokens, control, data) for every row, and rank[id], which decoding needs. A null or empty text has 0 tokens and no bytes.

    rank[id] also is in the metadata of the column data, which stays with it when written as Parquet: see stored_ranks().
    A column that is called like the key gets an underscore.
    """
    kind = kind_of(vocabulary)
    raw = token_ids(docs, text=text, key=key, vocabulary=vocabulary)
    rank = ranks(frequencies(raw, kind, load(vocabulary).n_vocab))

    def run(batches):
        for b in batches:
            n, control, data = [], [], []
            for x in b.column(1).to_pylist():
                got = rank[np.frombuffer(x, kind)]
                c, d = encode(got)
                n.append(len(got)), control.append(c), data.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary())], ["_k", "n_tokens", "control", "data"])

    out = raw.mapInArrow(run, f"_k {raw.schema['_k'].dataType.simpleString()}, n_tokens long, control binary, data binary")
    out = beside(out, "_k", key, ["n_tokens", "control", "data"])
    return out.withMetadata(out.columns[-1], {"ranks": base64.b64encode(rank.astype(kind).tobytes()).decode(), "rank_bytes": kind.itemsize}), rank


def stored_ranks(binary: DataFrame) -> np.ndarray:
    """rank[id] of a table that to_binary() returned, or of one read from where it was written."""
    meta = next(f.metadata for f in binary.schema if "rank_bytes" in (f.metadata or {}))
    return np.frombuffer(base64.b64decode(meta["ranks"]), f"<u{meta['rank_bytes']}").astype(np.uint32)


def to_text(control: bytes, data: bytes, count: int, rank: np.ndarray, vocabulary: str = VOCABULARY) -> str:
    ids = np.argsort(rank)[decode(control, data, count)]
    return load(vocabulary).decode_bytes(ids.tolist()).decode("utf-8", "replace")
