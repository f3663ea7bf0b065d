"""Hashed token features and the word counts that several operators share, computed in Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import eq

import numpy as np

WORD = re.compile(r"\w+")
_EDGE = re.compile(r"^\W+|\W+$")
_LIMIT = 400_000
#: Signs of scripts that are written without spaces: Thai, Lao, Burmese, Khmer, Han, Kana and their neighbours.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


class Memo(dict):
    """token -> row of a growing table; starts anew when full, so a worker's memory stays bounded."""

    def __init__(self, make, width: int, dtype, limit: int = _LIMIT):
        super().__init__()
        self.make, self.limit = make, limit
        self.table = np.zeros((1024, width), dtype)

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = self.make(token)
        self[token] = n
        return n

    def rows(self, tokens) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.table[at]


def bucket(token: str, bits: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


class Words:
    """Lower-cased words and their prefixes of 5, 6 and 7 letters, hashed into 2**bits buckets; 2**bits pads. In scripts without spaces each sign is a word."""

    def __init__(self, bits: int = 18):
        self.bits, self.pad = bits, 1 << bits
        self.memo = Memo(self._make, 4, np.int32)

    def _make(self, token: str):
        w = _EDGE.sub("", token)
        if not w:
            return [self.pad] * 4
        p = [bucket(f"{w[:k]}_", self.bits) if len(w) > k else self.pad for k in (5, 6, 7)]
        return [bucket(w, self.bits), *p]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature ids and values, 1 + log of the count over log2 of the number of words, so that one word among thousands still counts. Nothing for a text without words."""
        text = (text or "").lower()
        words = (text if text.isascii() else _UNSPACED.sub(r" \1 ", text)).split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        c = Counter(words)
        ids = self.memo.rows(c)
        v = (1 + np.log(np.fromiter(c.values(), np.float32, len(c)))) / np.float32(np.log2(1 + len(words)))
        return ids.ravel(), np.repeat(v, 4)


_RUN = re.compile(r"(a|A|0)\1+")


def shape(token: str) -> str:
    """A token with runs of small letters, capitals and digits as one a, A or 0, other signs as they are."""
    return _RUN.sub(r"\1", "".join("a" if ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else ch for ch in token))


class Shapes:
    """Tokens as written, between white space: their hashed text and shape, and how often a token follows itself or a line comes again."""

    def __init__(self, bits: int = 18):
        self.bits, self.pad = bits, 1 << bits
        self.memo = Memo(lambda w: [bucket(w, bits), bucket("s " + shape(w), bits)], 2, np.int32)
        self.extra = np.array([bucket(f"x {k}", bits) for k in range(3)], np.int32)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        n, c = len(words), Counter(words)
        v = np.fromiter(c.values(), np.float32, len(c)) / np.float32(n)
        lines = Counter(x for x in text.split("\n") if x)
        again = sum(len(x) * (k - 1) for x, k in lines.items()) / len(text)
        extra = np.array([sum(map(eq, words, words[1:])) / n, again, 1 / n], np.float32)
        v = np.stack([np.minimum(v, np.float32(0.02)), v], 1).ravel()  # a word that fills the text counts by its repeats
        return np.concatenate([self.memo.rows(c).ravel(), self.extra]), np.concatenate([v, extra])


STOPWORDS = {
    "en": "the of and to a in is it that was for on are with as at be this by from",
    "de": "der die das und in zu den von mit sich auf ist im dem nicht ein eine als auch es",
    "fr": "le la les de et un une des en du que est pour dans qui par sur pas au elle",
    "es": "el la los de y que en un una del las por con para su al se lo como no",
}
_STOP = {w for words in STOPWORDS.values() for w in words.split()}
_CLEAN = re.compile(r"[^\W\d_]+(['’-][^\W\d_]+)*[.,;:!?]?")
_MARKS = set("#$%&*@^~<>{}[]\\|=+_")
#: What text_stats() counts of a text, in this order.
STATS = ("n_words", "n_upper", "n_marked", "n_pipe", "n_clean", "n_stop", "n_repeat", "n_distinct", "n_lines", "n_dup_lines", "n_letters", "n_bang", "n_word_chars", "n_chars")


def _flags(w: str):
    bare = w.strip(".,;:!?\"'()").lower()
    return [
        len(w) > 1 and w.upper() == w and w.lower() != w,
        w != "|" and any(ch in _MARKS for ch in w),
        w == "|",
        bool(_CLEAN.fullmatch(w)) and not (len(w) > 2 and w[1:2].isupper()),
        bare in _STOP,
        sum(map(str.isalpha, w)),
        w.endswith("!!"),
        len(w),
    ]


class TextStats:
    """Counts over a whole text, by whitespace-separated words (so a text in a script without spaces is one); all 0 for a null or empty text."""

    def __init__(self):
        self.memo = Memo(_flags, 8, np.int64)

    def __call__(self, text: str | None) -> list[int]:
        words = (text or "").split()
        if not words:
            return [0] * (len(STATS) - 1) + [len(text or "")]
        c = Counter(words)
        s = np.fromiter(c.values(), np.int64, len(c)) @ self.memo.rows(c)
        lines = Counter(x for x in map(str.strip, text.split("\n")) if x)
        n_lines = sum(lines.values())
        return [len(words), *map(int, s[:5]), sum(map(eq, words, words[1:])), len(c), n_lines, n_lines - len(lines), int(s[5]), int(s[6]), int(s[7]), len(text)]
