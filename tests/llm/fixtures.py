"""Small tables with awkward rows."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _p double, text_ string"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
VOCAB = "the of and to in is it that was for river stone garden letter window morning engine paper harbour valley bridge winter copper market forest".split()


def prose(seed: int, n: int) -> str:
    """Words in an order that the seed fixes; sentences of eight."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        w = VOCAB[(x >> 8) % len(VOCAB)] if x >> 16 & 1 else f"{VOCAB[(x >> 9) % len(VOCAB)]}{'abcdefghij'[x >> 20 & 7]}{seed % 50}"
        out.append(w + ("." if i % 8 == 7 else ""))
    return " ".join(out)


def documents(spark, rows=()):
    """Rows (doc_id, text, lang, source) with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), 0.5, "x") for i, t, la, s in rows], DOCS)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and repeated keys."""
    return documents(spark, [
        (1, prose(1, 60), "en", "a"), (1, prose(1, 60), "en", "a"), (1, prose(2, 60), "en", "b"), (2, None, "en", "a"), (3, "", "de", "b"),
        (4, "   \n\t ", "de", None), (5, LONG, "en", "a"), (6, prose(3, 40), None, "b"), (None, prose(4, 40), "fr", "c"), (None, None, None, None),
        (7, "!!! ??? ###", "en", "c"), (8, "x", "en", "a"), (9, "你好 \U0001f600 straße naïve", "de", "c"),
    ])
