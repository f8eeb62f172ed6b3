"""Phrase counts and collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from provalake.llm import phrase_mining as pm

DOCS = "doc_id long, text string, lang string, n int, word string, w1 string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "w", "x", 0.5) for i, (t, g) in enumerate(rows)], DOCS)


def brute(rows, least, top):
    counts = {}
    for text, lang in rows:
        found = counts.setdefault(lang if lang is not None else "und", Counter())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            found.update(tuple(ws[i:i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        best = []
        for p, a in f.items():
            if len(p) < 2 or a < least or any(len(q) == 3 and c >= least and p in (q[:2], q[1:]) and 100 * c >= 50 * a for q, c in f.items() if len(p) == 2):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, g.decode(), -a, l, r, n, -s) for i, (s, a, g, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "The", "a", "É", "é", "中文", "x1", "of", "--", "don't", "\x1c", "\x85z", "q\x00"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n", "  "]) for _ in range(rng.randint(0, 90)))
    return [(text(), rng.choice(["en", "de", None, "und"])) for _ in range(60)] + [(None, "en"), ("", "fr"), (" \n.", None), ("of the " * 900, "de")] * 2


@pytest.mark.parametrize("seed, part", [(1, 1 << 20), (2, 37)])
def test_collocations_against_counting(spark, monkeypatch, seed, part):
    monkeypatch.setattr(pm, "SLICE", part)
    rows = corpus(seed)
    got = sorted(tuple(r) for r in pm.collocations(docs(spark, rows), 3, 40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, 3, 40)


def test_equal_partitions_against_counting():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 400):
        keys = rng.integers(1, 6, (n, 3))
        keys[rng.random(n) < 0.3, 1:] = 0
        keys[rng.random(n) < 0.3, 2] = 0
        weight = rng.integers(1, 4, n)
        want = Counter()
        for k, w in zip(keys.tolist(), weight.tolist()):
            for d in (1, 2, 3):
                if d == 1 or k[d - 2]:
                    want[(d, tuple(k[:d]))] += w
        depth, row, total = pm.equal_partitions(keys, weight, 4)
        got = {(d, tuple(keys[r, :d].tolist())): t for d, r, t in zip(depth.tolist(), row.tolist(), total.tolist())}
        assert got == {k: w for k, w in want.items() if w >= 4} and len(got) == len(depth)


def test_nothing_to_mine(spark):
    assert pm.collocations(docs(spark, [])).count() == 0
    assert pm.collocations(docs(spark, [(None, None), ("", "en"), ("only once here", "en")])).count() == 0


def test_scores_are_exact(spark):
    row = spark.createDataFrame([(9_999_999_999_999_998, 9_999_999_999_999_999, 9_999_999_999_999_999), (3, 7, 11)], "a long, l long, r long")
    got = [r[0] for r in row.select(pm._score(row.a, row.l, row.r)).collect()]
    assert got == [10**6 * a * a // (l * r) for a, l, r in ((9_999_999_999_999_998, 9_999_999_999_999_999, 9_999_999_999_999_999), (3, 7, 11))]
