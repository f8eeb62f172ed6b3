"""Token groups, links and counts against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from tokenizers import Tokenizer

from provalake.llm import token_alignment as ta

DOCS = "doc_id long, text string, a int, b string, pair int, n_a string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", None, " ", "a", "  two  spaces ", "ﬁ ligature", "é ß 中 😀 don't", "<|endoftext|> here", "<s>x</s> <unk>", "tab\tand\nline", "x" * 3000, "▁x", "\x00y", "中文 " * 500, "é"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(ta.TOKENIZER_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(ta.TOKENIZER_B))


def brute(rows, a, b):
    letters = {chr(c): bytes([c]) for c in range(256) if chr(c).isprintable() and chr(c) not in " \xa0\xad"}
    k = 0
    for c in range(256):
        if bytes([c]) not in letters.values():
            letters[chr(256 + k)] = bytes([c])
            k += 1
    table, links = [], Counter()
    for doc, text in rows:
        left = a.encode(" " + (text or ""), add_special_tokens=False).ids
        right = b.encode(text or "")
        la = [b"".join(letters[c] for c in a.id_to_token(i)) for i in left]
        lb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in right for p in [b.id_to_piece(i)]]
        if not text or not b"".join(la) == b"".join(lb) == (" " + text).encode():
            table.append((doc, [], [], [], ""))
            continue
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ea, eb = ends(la), ends(lb)
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        own = [(left[i], right[j]) for i in range(len(left)) for j in range(len(right)) if sa[i] < eb[j] and sb[j] < ea[i]]
        links.update(own)
        groups, x, y = [], [], []
        i = j = 0
        for cut in sorted(set(ea) & set(eb)):
            while i < len(ea) and ea[i] <= cut:
                x.append(left[i])
                i += 1
            while j < len(eb) and eb[j] <= cut:
                y.append(right[j])
                j += 1
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            x, y = [], []
        table.append((doc, left, right, own, ";".join(groups)))
    most = Counter()
    for (_, j), n in links.items():
        most[j] = max(most[j], n)
    return [(doc, len(left), len(right), len(g.split(";")) if g else 0, len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for doc, left, right, own, g in table]


def texts(n, seed):
    rng = random.Random(seed)
    bits = ["the ", "and", " ", "ing ", "é", "ünter", "中", "😀", ".", "\n", "12", "don't ", "Quer"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_alignment_against_loops(spark, monkeypatch, libraries, block):
    monkeypatch.setattr(ta, "BLOCK", block)
    rows = list(enumerate([*ODD, *texts(80, block)])) + [(3, "a"), (3, "a"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], DOCS)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = [tuple(r) for r in ta.align(df).select(COLUMNS).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, *libraries), key=key)


def test_given_documents(spark, libraries):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(tuple(r) for r in ta.align(df).select(COLUMNS).collect()) == sorted(brute(rows, *libraries))


def test_groups_written_out(spark):
    df = spark.createDataFrame([(1, "don't stop", 1, "x", 2, "y"), (2, None, 1, "x", 2, "y")], DOCS)
    got = {r["doc_id"]: r["groups"] for r in ta.groups(df).collect()}
    digest = {r["doc_id"]: r["groups_sha256"] for r in ta.align(df).collect()}
    assert got[2] == "" == digest[2] and hashlib.sha256(got[1].encode()).hexdigest() == digest[1]


def test_parts_after_spaces_encode_like_the_whole(libraries):
    side = ta.SideB(public_tokenizers.path(ta.TOKENIZER_B))
    rng = random.Random(2)
    bits = ["a", "b", " ", "  ", "\n", "\t", " \n", "é", "▁", "\xa0", "<s>", "1", "中", "   ", "the", "ing"]
    rows = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(5000)]
    assert side.apart and [x.tolist() for x in side.encode(rows)] == libraries[1].encode(rows, num_threads=1)
    assert ["".join(ta.words_after_spaces(t)) for t in ("", " ", "   ", "a b", " a", "a  b ", "a b  c")] == ["", " ", "   ", "ab", " a", "a b ", "ab c"]


def test_chains_of_overlaps():
    """Successors that are followed over many tokens: the ends meet only at the last byte."""
    end_a, end_b = np.arange(2, 2002, 2), np.append(np.arange(1, 2000, 2), 2000)
    a, b = ta.groups_of(end_a, end_b)
    assert set(a.tolist()) == {0} and set(b.tolist()) == {0}
    at_a, at_b = ta.links_of(end_a, end_b)
    assert len(at_a) == len(end_a) + len(end_b) - 1 and at_b.max() == len(end_b) - 1


def test_empty_table(spark):
    assert ta.align(spark.createDataFrame([], DOCS)).count() == 0
