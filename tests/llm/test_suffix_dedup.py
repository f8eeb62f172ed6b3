"""Exact repeats against a dictionary of all windows."""

import hashlib
import random

import pytest

from provalake.llm import suffix_dedup as sd

DOCS = "doc_id long, text string, hash int, doc string, anchor int, start string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "d", 2, "s") for i, t in rows], DOCS)


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of rows in their order."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - 99):
            window = data[k:k + 100]
            if window in seen:
                gone[k:k + 100] = [True] * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return [tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


def ordered(texts):
    out, start = [], 0
    for t in texts:
        out += [start + i for i in sorted(range(len(t)), key=lambda i: t[i:])]
        start += len(t)
    return out


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh", bytes(range(256))])
def test_suffix_order_against_sorting(letters):
    rng = random.Random(len(letters))
    for _ in range(100):
        texts = [bytes(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(rng.randint(0, 9))]
        assert sd.suffix_orders(texts).tolist() == ordered(texts)
    texts = [b"x" * 500, b"ab" * 300, b"", b"a" * 200 + b"b" + b"a" * 200]
    assert sd.suffix_orders(texts).tolist() == ordered(texts)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ü", k=rng.randint(2, 7))) for _ in range(200)]
    passages = [" ".join(rng.choices(words, k=rng.randint(15, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(0, 5))]
        text = " ".join(parts)
        if rng.random() < 0.2 and rows:
            text = rng.choice(rows)[1]
            cut = rng.randint(0, len(text))
            text = text[:cut] + rng.choice(["", "Z", " neu "]) + text[cut:]
        rows.append((i, text))
    rows[3:3] = []
    return rows + [(n, "q" * 350), (n + 1, "q" * 220), (n + 2, "xyz" * 120), (n + 3, "r" * 99), (n + 4, "r" * 100), (n + 5, "r" * 100), (n + 6, None), (n + 7, "")]


@pytest.mark.parametrize("seed, most", [(1, 16), (2, 16), (3, 3)])
def test_repeats_against_all_windows(spark, monkeypatch, seed, most):
    monkeypatch.setattr(sd, "MOST_CONTEXTS", most)
    rows = corpus(seed)
    random.Random(seed).shuffle(shuffled := list(rows))
    got = result(sd.remove_repeats(docs(spark, shuffled)).orderBy("doc_id"))
    assert got == brute(rows)


def test_rows_that_share_an_id_or_have_none(spark):
    a, b = "eins zwei drei " * 9, "vier fünf sechs sieben " * 7
    got = result(sd.remove_repeats(docs(spark, [(1, a), (1, a), (1, a), (2, a), (None, b), (3, b), (None, b), (5, "kurz"), (5, "kurz")])))
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r[2] == 0)
    assert {k: sorted(v) for k, v in by_id.items()} == {1: [False, False, False], 2: [False], 3: [False], None: [False, False], 5: [True, True]}
    gone = hashlib.sha256(b"").hexdigest()
    assert sorted(r[4] == gone for r in got if r[0] == 1) == [False, True, True]
    assert all(r[4] == gone for r in got if r[0] in (2, None))


def test_empty_table_and_kept_text(spark):
    assert sd.remove_repeats(docs(spark, [])).count() == 0
    a = "eins zwei drei vier fünf " * 9
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in sd.kept_text(docs(spark, [(1, a), (2, "neu " + a + "Ende")])).collect()}
    assert kept[2].startswith("neu") and kept[2].endswith("Ende") and len(kept[2].encode()) < 100
