"""The training-data operators on small tables: awkward rows, brute force, round trips, held-out accuracy."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from pyspark.sql import functions as F

from provalake.llm import (byte_bpe, chat_preferences, html_text, minhash, mixing, quality_classifier, quality_rules, token_files,
                           topk, toxicity, training)

DOCS = "doc_id long, text string, raw int, score string, label string, digest string, n int"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "s", "l", "d", 2) for i, t in rows], DOCS)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "ein Wort"), (4, "ein Wort"), (None, "kein Name"), (5, "é ß 中 😀 don't " * 3000), (6, "x" * 20000), (7, "a b c d e f g h i"), (8, "A B C D E F G H I")]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def larger(spark):
    sf = SF.replace("0.001", "0.01")
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


# quality rules

def test_rules_measure_awkward_rows(spark):
    rows = quality_rules.quality_rules(docs(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    found = {r["doc_id"]: r for r in rows}
    assert [found[i]["n_words"] for i in (1, 2, 3, 4, 7)] == [0, 0, 0, 2, 9]
    assert all(found[i]["base_failed"] and not found[i]["kept"] for i in (1, 2, 3, 4))
    assert found[5]["n_words"] == 15000 and found[5]["n_repeat_words"] == 15000
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0


def test_repeated_windows_against_brute_force():
    rng = random.Random(5)
    texts = [[rng.choice(b"ab cd ef gh".split()) for _ in range(rng.randint(0, 60))] for _ in range(200)] + [[b"w%d" % i for i in range(30)] * 2]
    for words, got in zip(texts, quality_rules.repeat_words(texts)):
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        seen = Counter(windows)
        assert got == len({i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)})


def test_policies_and_ablations(spark):
    rows = quality_rules.ledger(docs(spark, [(i, "word " * 5) for i in range(3)] + [(9, " ".join(f"w{i}$" for i in range(40)))]))
    assert {r["doc_id"]: r["fail_bits"] for r in rows.collect()} == {0: 1, 1: 1, 2: 1, 9: 4}
    cut = {r["rule"]: (r["failed"], r["failed_alone"], r["kept_without"]) for r in quality_rules.ablations(rows, "v1").collect()}
    assert cut["few_words"] == (3, 3, 3) and cut["symbols"] == (1, 1, 1) and cut["repeated_lines"] == (0, 0, 0)
    assert quality_rules.apply_policy(rows, "base").where("kept").count() == 1


# classifiers

@pytest.mark.parametrize("module, label, least", [(quality_classifier, "quality", 0.95), (toxicity, "toxic", 0.95)])
def test_classifier_on_held_out_rows(larger, module, label, least):
    table, labels = larger
    out = module.classify(table, labels).join(labels, "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert out.score.between(0, 1).all() and (held.predicted == held[label]).mean() >= least


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifier_with_awkward_rows(spark, sample, module):
    table, labels = sample
    none = labels.where("false")
    out = module.classify(docs(spark, AWKWARD), none)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(AWKWARD)
    assert module.classify(docs(spark, []), none).count() == 0
    assert module.classify(docs(spark, AWKWARD), labels.unionAll(labels)).where("score is null").count() == 0


def test_labels_are_learnt_from_the_right_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(1, 0), (None, 1), (2, None), (3, 7)], "doc_id long, quality int")
    got = {r["doc_id"]: r["label"] for r in training.labelled_ids(labels, "quality").collect()}
    assert got == {i: 0 if i == 1 else i % 2 for i in range(100) if zlib.crc32(str(i).encode()) % 5}


def test_folding_and_exceptions():
    found = toxicity.automaton({"idiot": 1.0, "lowei*": 2.0, "clown": 1.0}, ("clown fish",))
    score = lambda t: toxicity.matches(t, found)[0]
    assert [score(t) for t in ("an idiot!", "1d10t", "IDІOT", "ｉｄｉｏｔ", "id!ot", "idiotic", "an idi", "idiot$$$")] == [1, 1, 1, 1, 1, 0, 0, 1]
    assert [score(t) for t in ("Loweibung", "xlowei", "clown", "Clown fish swim", "clown, clown fish")] == [2, 0, 1, 0, 1]
    assert toxicity.matches("", found) == (0.0, 0)


def _naive_matches(text, lexicon, exceptions):
    folded, word = toxicity.fold(text)
    inside = lambda i: 0 <= i < len(word) and word[i]

    def spans(entry, whole):
        key = toxicity.fold(entry)[0]
        return [(i, i + len(key)) for i in range(len(folded) - len(key) + 1) if folded[i:i + len(key)] == key and not inside(i - 1) and not (whole and inside(i + len(key)))]

    excepted = [x for e in exceptions for x in spans(e, True)]
    best = {}
    for entry, weight in lexicon.items():
        for a, b in spans(entry.removesuffix("*"), not entry.endswith("*")):
            if b - a > best.get(a, (0, 0))[0]:
                best[a] = (b - a, weight)
    return sum(w for a, (n, w) in best.items() if not any(x <= a and a + n <= y for x, y in excepted))


def test_matches_against_a_search_at_every_place():
    rng = random.Random(12)
    lexicon, exceptions = {"scum": 2.0, "pond*": 1.0, "idiot": 4.0, "id*": 0.5, "pond scum bag": 8.0}, ("pond scum", "scum bag", "the idiot by day", "idiot by")
    found = toxicity.automaton(lexicon, exceptions)
    bits = ["idiot", "1d10t", "pond", "scum", " ", " ", " ", "by", "day", "the", "bag", "x", ".", "é", "ѕсum"]
    for _ in range(2000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 30)))
        assert toxicity.matches(text, found)[0] == _naive_matches(text, lexicon, exceptions), text


def test_matching_is_linear_in_the_text():
    import time

    found = toxicity.automaton(toxicity.GENERAL, toxicity.EXCEPTIONS)
    began = time.perf_counter()
    assert toxicity.matches("idiot pond scum " * 130_000, found)[0] == 4.0 * 130_000
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_samples_stay_within_their_bound(spark, module):
    rows = spark.range(3000).selectExpr("1L AS doc_id", "concat('text number ', id) AS text").unionAll(
        spark.range(2, 300).selectExpr("id AS doc_id", "concat('one of ', id) AS text"))
    labels = spark.range(1, 300).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "CAST(id % 2 AS INT) AS toxic")
    sample, _ = training.labelled_sample(rows, labels, "quality", 60)
    got = sample.collect()
    assert len(got) == 120 == len({r["doc_id"] for r in got})
    assert module.classify(rows, labels).count() == 3298


def test_longest_beginning_of_a_family_stays():
    found = [("path*", 50, 4.0), ("pathe*", 50, 4.0), ("pathetic", 49, 4.1), ("lowe*", 90, 5.0), ("lowei*", 90, 5.0), ("loweia", 9, 4.0)]
    assert dict(toxicity.longest_of_families(found)) == {"pathetic": 4.1, "lowei*": 5.0}


# byte-level BPE

@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Codec(byte_bpe.vocabulary_path())


def test_bpe_against_tiktoken(coder):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(3)
    bits = ["a", "b", "é", "1", "²", " ", "  ", "\n", "\t", "'s", "'re", "'", "'l", "'ll", "!", "中", "😀", "\r\n", "ß", "'S", "\x1c", "\x85", "٣", "<|endoftext|>"]
    texts = ["", "'", " ", "\n", "'''s", "a" * 3000, " " * 3000, "ab!" * 2000] + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(3000)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert coder.decode(ids, coder.ends(ids)) == text.encode()


def test_long_pieces_merge_like_short_ones(coder):
    rng = random.Random(4)
    for _ in range(200):
        piece = bytes(rng.choices(b"abcdet hin", k=rng.randint(2, 90)))
        assert byte_bpe._merge_long(piece, coder.ranks) == byte_bpe.merge_pairs(piece, coder.ranks) or coder.ranks.get(piece) is not None


def test_bpe_tables(spark, coder):
    rows = docs(spark, AWKWARD)
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(rows).collect()}
    for i, text in dict(AWKWARD).items():
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    back = {r["doc_id"]: bytes(r["text"]) for r in byte_bpe.decode(byte_bpe.encode(rows)).collect()}
    assert back == {i: (t or "").encode() for i, t in AWKWARD}
    table = {r["doc_id"]: r for r in byte_bpe.token_table(rows).collect()}
    assert all(np.array(table[i]["ids"], "<u4").tobytes() == coder.encode([t or ""])[0] for i, t in AWKWARD)
    assert byte_bpe.round_trip(docs(spark, [])).count() == 0


# token files

@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.zeros(n, int), rng.integers(0, 50, n) + (rng.random(n) < 0.05) * 40000, np.full(n, 2**32 - 1)):
        payload, starts = token_files.pack(ids.astype(np.uint32))
        assert (token_files.unpack(payload, starts) == ids).all()


def test_token_files_against_the_tokenizer(spark, sample):
    from tokenizers import Tokenizer

    table = sample[0].select("doc_id", "text").unionAll(docs(spark, [(10**6 + (i or 0), t) for i, t in AWKWARD]).select("doc_id", "text"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    rows = sorted((r["doc_id"], r["text"] or "") for r in table.collect())
    ids = [np.array([*e.ids, 0], "<u4") for e in plain.encode_batch([t for _, t in rows], add_special_tokens=False)]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_files(table).collect())
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).tolist()
    want = [(s, doc, len(i), zlib.crc32(i.tobytes())) for s, (doc, _), i in zip(starts, rows, ids)]
    assert [g[1:] for g in got] == [w[1:] for w in want] and [g[0] for g in got] == starts[:-1]


def test_special_strings_as_in_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a  <|endoftext|>  b", "q <|endoftext|><|endoftext|> r\n<|endoftext|> s", "n <|endoftext|>"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in token_files.Encoder(path).encode(rows)]
    assert got == [e.ids for e in plain.encode_batch(rows, add_special_tokens=False)] and got[0] == [64, 220, 50256, 275]


def test_token_files_of_rows_without_ids(spark):
    got = token_files.token_files(docs(spark, [(None, "a b"), (None, ""), (3, None)])).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 3] and sum(r["n_tokens"] for r in got) == 5
    assert token_files.token_files(docs(spark, [])).count() == 0


# near-duplicates

def _components(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k:k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark, larger):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    cloud = []
    for i in range(80):  # copies with more and more changes, some of them close to a few others only
        words = list(base)
        for _ in range(i // 12):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
        cloud.append((10**6 + i, " ".join(words)))
    rows = [(r["doc_id"], r["text"]) for r in larger[0].select("doc_id", "text").collect()] + cloud + [(2 * 10**6 + i, t) for i, t in AWKWARD if i and i != 4]
    rows += [(3 * 10**6, "one two three"), (3 * 10**6 + 1, "ONE two  three"), (3 * 10**6 + 2, "one two")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == _components(rows)


def test_near_duplicates_of_awkward_rows(spark):
    rows = minhash.near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] != 8)
    assert [r["component_id"] for r in rows if r["doc_id"] == 8] == [7]
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    kept = minhash.keep_one_of_each(docs(spark, AWKWARD))
    assert kept.columns == docs(spark, []).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(21)
    t1, t2 = (" ".join(f"{c}{rng.randint(0, 300)}" for _ in range(80)) for c in "ab")
    rows = [(1, t1), (1, t2), (2, t1 + " plus"), (3, t2 + " plus"), (9, t2.upper()), (5, "alone here"), (5, "not like it"), (5, "alone here"), (6, None), (6, "")]
    got = [(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, rows)).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 1), (3, 1), (5, 5), (5, 5), (5, 5), (6, 6), (6, 6), (9, 1)]
    kept = sorted((r["doc_id"], r["text"]) for r in minhash.keep_one_of_each(docs(spark, rows)).collect() if r["doc_id"] != 6)
    assert kept == sorted([(1, t1), (1, t2), (5, "alone here"), (5, "not like it")])
    again = sorted((r["doc_id"], r["text"]) for r in minhash.keep_one_of_each(docs(spark, rows[::-1]).repartition(5)).collect() if r["doc_id"] != 6)
    assert again == kept


def test_shingle_length_is_a_parameter(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e x y")]
    assert [r["n_shingles"] for r in minhash.near_duplicates(docs(spark, rows), 5).orderBy("doc_id").collect()] == [3, 3]


def test_signatures_estimate_similarity():
    probes = minhash._probes()
    rng = np.random.default_rng(2)
    same = []
    for n in (3, 40, 400):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * 0.8)], rng.integers(0, 2**63, len(a) - int(len(a) * 0.8)).astype(np.uint64)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same.append((minhash.signature(a, probes) == minhash.signature(b, probes)).mean() - true)
    assert abs(np.mean(same)) < 0.03


# top-k

def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.2, (1500, 16))
    vectors[300:700] = vectors[300]  # many ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5050, [float("nan")] * 16), (5100, [None] * 16), (5150, [float("inf")] * 16), (5200, []), (None, [0.0] * 16), (5250, [0.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0).collect())
    q = np.floor(256 * vectors).astype(int)
    want = []
    for i in range(0, 1500, 50):
        best = sorted((-int(s), j) for j, s in enumerate(q @ q[i]) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(topk.quantised(df.where("false")), F.lit(True)).count() == 0


# chat

def test_preferences(spark):
    turns = "array<struct<role:string,text:string>>"
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("assistant", "no")
    df = spark.createDataFrame([(1, [a, b], [a, c], "x"), (2, [a, b], [a, b], "x"), (3, [b], [c, a], "x"), (4, None, [a], "x"), (5, [a], [a, b], "x")],
                               f"pair_id long, chosen {turns}, rejected {turns}, p string")
    got = {r["pair_id"]: r for r in chat_preferences.format_pairs(df).collect()}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["chosen"] == "<|assistant|>\nyo<|end|>\n" and got[1]["chosen_mask"] == "0:14 1:10"
    assert got[2]["prompt_turns"] == 2 and got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["chosen_learnt"] == 0
    assert got[3]["prompt"] == "" and got[3]["rejected_learnt"] == 10 and got[4]["rejected"] and got[4]["chosen"] == ""
    assert got[5]["chosen"] == "" and got[5]["rejected_learnt"] == 10
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 1, "assistant", "a0"), (1, 0, None, None), (1, 1, "assistant", "a1"), (2, 0, "user", "alone"), (None, 0, "user", "x")]
    pairs = chat_preferences.replaced_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r["pair_id"]: r for r in chat_preferences.format_pairs(pairs).collect()}
    assert set(out) == {0, 1} and "a0" in out[0]["chosen"] and "a1" in out[0]["rejected"] and out[1]["prompt_turns"] == 1


# mixing

def test_mixing_meets_targets(larger):
    table, _ = larger
    targets = {"en": 0.4, "de": 0.2, "fr": 0.3, "es": 0.1}
    out = mixing.mixed(table, mixing.labelled_by(table, "lang"), targets).toPandas()
    member = np.stack(out.member.to_list()) / mixing.PARTS
    share = (out.rate * out.n_tokens).to_numpy() @ member
    assert np.abs(share / share.sum() - list(targets.values())).max() < 1e-3 and (out.rate >= 0).all()
    langs = table.select("doc_id", "lang").toPandas().merge(out, on="doc_id")
    assert (np.array(list(targets))[np.stack(langs.member.to_list()).argmax(1)] == langs.lang).mean() > 0.97


def test_fit_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(0)
    member = rng.dirichlet([0.3, 0.3, 0.3], 40)
    parts = np.floor(member * mixing.PARTS).astype(int)
    parts[:, 0] += mixing.PARTS - parts.sum(1)
    tokens = rng.integers(10, 500, 40)
    cells = spark.createDataFrame([(p.tolist(), int(t)) for p, t in zip(parts, tokens)], "member array<int>, tokens long")
    start, steps, want, expected = mixing.fit(cells, {"a": 1.0, "b": 2.0, "c": 3.0}, total=float(tokens.sum()) * 1.5)
    p = parts / mixing.PARTS
    r = np.full(40, start)
    top = np.linalg.eigvalsh((p * tokens[:, None]).T @ p)[-1]
    for _ in steps:
        r = np.maximum(0, r - p @ ((r * tokens) @ p - want) / top)
    assert np.allclose((r * tokens) @ p, expected) and np.abs(expected - want).max() < 1e-3 * want.sum()


def test_mixing_awkward_rows(spark, sample):
    table, _ = sample
    rows = docs(spark, AWKWARD)
    out = mixing.mixed(rows, mixing.labelled_by(table, "lang"), {"en": 1.0, "de": 1.0})
    assert out.count() == len(AWKWARD) and out.where("rate is null or copies is null").count() == 0
    assert mixing.mixed(docs(spark, []), mixing.labelled_by(table, "lang"), {"en": 1.0, "de": 1.0}).count() == 0
    again = mixing.resampled(rows, mixing.labelled_by(table, "lang"), {"en": 1.0, "de": 1.0})
    copies = Counter({r["doc_id"]: 0 for r in out.collect()})
    for r in out.collect():
        copies[r["doc_id"]] += r["copies"]
    assert again.columns == rows.columns and Counter(r["doc_id"] for r in again.collect()) == +copies


def _cells(spark, parts, tokens):
    return spark.createDataFrame([(p, t) for p, t in zip(parts, tokens)], "member array<int>, tokens long")


def test_scarce_or_missing_domain_does_not_set_the_size(spark, sample):
    one = [[1000, 0, 0, 0], [0, 1000, 0, 0], [0, 0, 1000, 0], [0, 0, 0, 1000]]
    tokens = [600_000, 200_000, 180_000, 1_000]
    _, _, want, _ = mixing.fit(_cells(spark, one, tokens), mixing.TARGETS)
    assert want[3] == mixing.MOST_RATE * 1_000 and np.allclose(want[:3] / want[0], np.array([0.55, 0.18, 0.17]) / 0.55)
    assert want.sum() > 0.8 * sum(tokens)
    _, _, want, expected = mixing.fit(_cells(spark, one[:3], tokens[:3]), mixing.TARGETS)
    assert want[3] == 0 and want.sum() >= 0.9 * sum(tokens[:3]) and np.abs(expected - want).max() <= 1e-3 * want.sum()
    rows = sample[0].where("lang <> 'es' or lang is null")
    out = mixing.mixed(rows, mixing.labelled_by(rows, "lang"), mixing.TARGETS).toPandas()
    assert np.stack(out.member.to_list())[:, 3].max() == 0
    assert (out.n_tokens * out.rate).sum() > 0.85 * out.n_tokens.sum() and out.copies.sum() > 0.7 * len(out)


@pytest.mark.parametrize("ratios", [(1, 0.01, 0.01, 0.01), (1, 0.3, 0.2, 0.003)])
def test_fit_reaches_targets_of_small_domains(spark, ratios):
    parts = [[1000 if d == e else 0 for e in range(4)] for d in range(4)] + [[997 if d == e else 1 for e in range(4)] for d in range(4)]
    tokens = [int(1_000_000 * r) for r in ratios]
    _, steps, want, expected = mixing.fit(_cells(spark, parts, tokens + tokens), mixing.TARGETS, total=1_000_000.0)
    assert np.abs(expected / expected.sum() - list(mixing.TARGETS.values())).max() <= 2e-4 and len(steps) < 100
    assert np.allclose(want, 1e6 * np.array(list(mixing.TARGETS.values())))


def test_missed_targets_are_named(spark, caplog):
    members = spark.createDataFrame([([1000, 0], 990), ([0, 1000], 10)], "member array<int>, n_tokens long")
    plan = mixing.planned(members, None, {"a": 0.5, "b": 0.5})
    assert "b 0." in caplog.text and np.allclose(plan.expected, plan.want, atol=0.2) and plan.want[1] == mixing.MOST_RATE * 10


# pages

PAGE = ('<html><head><title>t</title><style>p{}</style></head><body><header>H</header><nav>n</nav><main><article class="post"><header><h1>T &amp; U</h1></header>'
        '<p>a <b>b</b>c<br>d&nbsp; e</p><div class="ad x">ad</div><script>if(a<b){"</p>"}</script><aside>s</aside><section id="comments"><p>c</p></section>'
        '<p title="a>b">z</p><form>f</form></article></main><div>out</div><footer>f</footer></body></html>')


def test_blocks_of_a_page():
    assert html_text.blocks_of(PAGE) == (["T & U", "a bc", "d e", "z"], True)
    assert html_text.blocks_of('<div class="cookie-notice">n</div><p>one two</p><p>un<i>clos') == (["one two", "unclos"], False)
    assert html_text.blocks_of("") == ([], False) and html_text.blocks_of("<article><p>a<!-- b") == (["a"], True)


@pytest.mark.parametrize("page, blocks", [
    ('<article><p class="promo">Buy<p>Real one</p><p>Real two</p></article>', ["Real one", "Real two"]),
    ('<article><h1>T</h1><ul><li class="share">x<li>Real item</ul><p>Body</p></article>', ["T", "Real item", "Body"]),
    ('<nav><a href="/">Home</a><article><p>Text</p></article>', ["Text"]),
    ('<nav>Home<ul><li>a<li>b</ul></nav><article><p>Text</article><footer>f', ["Text"]),
    ('<article><p class="related-work">One</p><div class="search-algorithms">Two</div><section id="notice-of-intent">Three</section></article>', ["One", "Two", "Three"]),
    ('<article><p>a</p><div class="related-posts"><p>no</p></div><div class="x ad"><div>no</div></div><p>b</article>', ["a", "b"]),
    ('<article><div class="ad"><p>no</article><p>after</p>', []),
    ('<article>a<span class="share">no</span> b</article></div></p>', ["a b"]),
    ('<article><p>some <span lang="de">Wort</span> here, <b id=x>bold</b>er</p></article>', ["some Wort here, bolder"]),
    ('<article><table><tr><td class="ad">no<td>yes<tr><td>row</table></article>', ["yes", "row"]),
    ('<article><section class="comments"><article class="comment"><p>no</p></article></section><p>yes</p></article>', ["yes"]),
    ('<aside><article><p>teaser</p></article></aside><main><p>main text</p></main>', ["main text"]),
    ('<article><dl><dt class="ad">no<dd>yes<dt>term</dl><select><option>no</select></article>', ["yes", "term"]),
])
def test_end_tags_that_are_left_out_and_names(page, blocks):
    assert html_text.blocks_of(page)[0] == blocks



def test_repeats_go_where_a_page_marks_no_article(spark):
    menu = "home about us contact our whole team right here"
    rows = [(i, f"http://h.example/{i}", f"<p>{menu}</p><p>{i} story {i * 7} of {i * 3}</p>") for i in range(4)]
    rows += [(9, "http://other.example/", f"<p>{menu}</p>"), (10, None, None), (11, "x", ""), (12, "http://h.example/12", PAGE)]
    pages = spark.createDataFrame([(*r, "t", [1]) for r in rows], "page_id long, url string, html string, text string, blocks array<int>")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages.unionAll(pages.where("page_id = 9"))).collect()}
    assert got[1] == "1 story 7 of 3" and got[9] == menu and got[10] == got[11] == "" and got[12].startswith("T & U\n")
    assert html_text.main_text(pages.where("false")).count() == 0


def test_shared_passages_and_copies_stay(spark):
    quote = "to be or not to be that is the question here"
    menu = "home about us contact our whole team right here"
    rows = [(i, f"http://h.example/{i}", f"<p>{menu}</p><p>{i} story {i * 7} of {i * 3}</p>" + (f"<p>{quote}</p>" if i < 3 else "")) for i in range(20)]
    article = "one article of ten words or so in two copies"
    rows += [(30, "http://h.example/30", f"<p>{article}</p>"), (31, "http://h.example/31", f"<p>{article}</p>")]
    rows += [(40 + i, f"http://two.example/{i}", f"<p>{quote}</p><p>page {i}</p>") for i in range(2)]
    rows += [(50, "http://h.example/50", f"<p>{menu}</p>")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == f"1 story 7 of 3\n{quote}" and got[9] == "9 story 63 of 27"
    assert got[30] == got[31] == article and got[40] == f"{quote}\npage 0" and got[50] == menu


def test_the_host_judges_doubtful_blocks_of_articles(spark, monkeypatch):
    notice, line = "sign up here to get our very best stories each day", "this very line stands at the end of all our stories"
    page = lambda i, *more: f"<article><h1>t{i}</h1><p>body {i} of {i * 7}</p>{''.join(more)}</article>"
    rows = [(i, f"http://h.example/{i}", page(i, f'<div class="site-notice"><p>{notice}</p></div>', f"<p>{line}</p>")) for i in range(6)]
    rows += [(i, f"http://h.example/{i}", page(i, f'<div class="site-notice"><p>only {notice}</p></div>', f"<p>{notice}</p>")) for i in range(6, 8)]
    rows += [(8, "http://h.example/8", page(8, '<p class="notice">one of its own, which no other page of this host has</p>', f'<p>a <b class="notice">{notice}</b></p>'))]
    rows += [(30 + i, f"http://few.example/{i}", page(i, f'<p class="notice">{notice}</p>')) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in (html_text.PART, 4):  # one array for the host, and several
        monkeypatch.setattr(html_text, "PART", part)
        got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
        assert all(got[i] == f"t{i}\nbody {i} of {i * 7}\n{line}" for i in range(6))  # a repeated line of the article stays
        assert all(got[i] == f"t{i}\nbody {i} of {i * 7}\nonly {notice}\n{notice}" for i in range(6, 8))
        assert got[8].endswith(f"host has\na {notice}") and got[31] == f"t1\nbody 1 of 7\n{notice}" and len(got) == 11


def test_shared_places_against_all_windows():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 2, n))) for n in (0, 3, 8, 60, 61, 90)]
    for least in (2, 3):
        windows = [{tuple(t.split()[p:p + 8]) for p in range(len(t.split()) - 7)} for t in texts]
        want = {(i, p) for i, t in enumerate(texts) for p in range(len(t.split()) - 7) if sum(tuple(t.split()[p:p + 8]) in w for w in windows) >= least}
        text, place, _ = html_text.shared_places(texts, least)
        assert set(zip(text.tolist(), place.tolist(), strict=True)) == want and len(want) == len(text) > 0


def test_suffix_order():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 3, 300).astype(np.uint64)
    for length in (1, 3, 8):
        _, rank = html_text.suffix_heads(tokens, length)
        heads = [tuple(tokens[i:i + length]) for i in range(300)]
        assert all((rank[i] == rank[j]) == (heads[i] == heads[j]) for i in range(0, 300, 7) for j in range(300))


# pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    sf = SF.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    before = rows
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf).cache()
        assert 0 < after.count() <= before.count(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
            assert after.join(before, "doc_id", "left_anti").count() == 0
            before = after
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = before.join(labels, "doc_id").toPandas()
    assert (kept.toxic == 1).sum() <= 6 and (kept.quality == 0).sum() <= 4
    assert before.count() == after.count()
    empty = rows.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_codec_reads_the_vocabulary(coder):
    with open(byte_bpe.vocabulary_path(), "rb") as lines:
        first = base64.b64decode(lines.readline().split()[0])
    assert coder.ranks[first] == 0
