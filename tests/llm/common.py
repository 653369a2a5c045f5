"""Fixtures that the corpus operators' tests share."""

import random
import re

WORDS = re.compile(r"[^ \t-\r]+").findall
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(n))


def documents(spark, seed=1, n=60):
    """Documents with nulls, empty and long texts, exact and near copies, repeated rows, null ids and extra columns of clashing names."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(n)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "ß", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].upper(), "en", "a", 1) for i in range(5)]  # equal after lower-casing
    for i in range(8):  # near copies
        words = texts[20 + i % 2].split()
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((200 + i, " ".join(words), "en", "b", 1))
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \n\t ", "en", "a", 4), (303, "one two", "en", "a", 7), (304, "One two", "en", None, 7)]
    rows += [(305, "word " * 30_000 + "end", "en", "c", 1), (305, "word " * 30_000 + "end", "en", "c", 1)]  # long, and repeated
    rows += [(None, texts[3] + " more", "en", "a", 1), (306, "café ÉCOLE naïve. Ünïcode!\nline\n\nline", "fr", "é", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "uid", "row", "size", "digest", "label", "n", "key", "bucket", "kept", "keep_id", "component", "taken"):
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width):
    w = WORDS((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


class Sets:
    """Union-find with the least member as root."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
