"""Fixtures and brute-force helpers for the training-data operators."""
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, row long, fp long"


def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and
    columns whose names clash with the operators' own."""
    rnd = random.Random(7)
    vocabulary = ["alpha", "Beta", "gamma", "DELTA", "é", "straße", "x1", "zeta", "eta", "theta", "iota", "kappa", "naïve", "Mu"]

    def prose(n, seed):
        r = random.Random(seed)
        w = [r.choice(vocabulary) for _ in range(n)]
        return re.sub(r"((?:\S+ ){7}\S+) ", r"\1. ", " ".join(w))

    long_text = prose(30_000, 1)
    base = [prose(80, 100 + i) for i in range(12)]
    texts = [None, "", "   \n\t ", "one", "one two", long_text, long_text, base[0], base[0], *base,
             base[1] + " tail", base[1].replace("alpha", "alpha "), "under the MIT License\n" + base[2]]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t) if t is not None else None, rnd.randrange(99), "clash", 1, 2)
            for i, t in enumerate(texts)]
    rows.append(rows[9])  # a row twice
    rows.append((None, base[3], None, None, None, None, None, None, None))
    rows.append((4, base[4], "de", "s1", 3, None, None, None, None))  # an id twice
    return spark.createDataFrame(rows, DOCS).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


class Groups:
    """Union by smallest member."""

    def __init__(self, members):
        self.up = {m: m for m in members}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))
