"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text, normalised by length and calibrated.

Folding undoes the usual disguises one code point at a time: case, compatibility forms (full width, mathematical letters),
letters of other scripts that look Latin, and digits or signs that stand for letters. Accents stay, they tell words apart.
A lexicon entry is a whole word, or a word beginning (`stem*`). Matches inside an exception phrase don't count.
Besides a short general list, entries and weights are learnt from labelled documents as word beginnings that toxic texts
have far more often than others.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.llm.common import filtered, held_out, texts, worker_store
from provalake.llm.training import fit_logistic, labelled_sample, logistic

#: Bounds: labelled documents of either class, and learnt entries.
PER_CLASS, MOST_ENTRIES = 6000, 2000
#: An entry is learnt from this many distinct toxic texts at least, at this log odds, and if chance would hardly give it.
LEAST_TEXTS, LEAST_LOG_ODDS, LEAST_EVIDENCE = 5, 3.0, 12.0
STEMS = range(4, 13)
LENGTH_POWER = 0.5
THRESHOLD = 0.5

# The general list, the exceptions, and what looks like which letter.
GENERAL = {"idiot": 4.0, "moron": 4.0, "stupid": 3.0, "loser": 3.5, "scum": 4.0, "worthless": 3.5, "pathetic": 3.5, "disgusting": 3.0,
           "imbecile": 4.0, "dumbass": 4.0, "retard": 4.0, "arschloch": 4.0, "hurensohn": 4.0, "connard": 4.0, "salope": 4.0, "gilipollas": 4.0, "cabrón": 4.0}
EXCEPTIONS = ("the idiot by dostoevsky", "sore loser clause", "pond scum", "scum villainy", "stupid simple", "clown fish", "trash can", "trash collection")
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d",
              "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a"}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what it folds to, and whether it is part of a word."""
    fold, word = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for point in [*range(0xD800), *range(0xF900, 0x10000), *range(0x10000, 0x20000)]:
        char = chr(point)
        category = unicodedata.category(char)
        word[point] = category[0] in "LM" or category == "Nd"
        if category[0] not in "LN" or "CJK" in unicodedata.name(char, ""):
            continue
        plain = unicodedata.normalize("NFKC", char).lower()
        if len(plain) == 1:
            fold[point] = ord(LOOKALIKES.get(plain, STANDS_FOR.get(plain, plain)))
    for char, letter in STANDS_FOR.items():
        fold[ord(char)] = ord(letter)
    return fold, word


def _folding() -> tuple[np.ndarray, np.ndarray]:
    store = worker_store()
    if "folding" not in store:
        store["folding"] = _tables()
    return store["folding"]


def fold(text: str) -> tuple[str, np.ndarray]:
    """The folded text, as long as the text, and which of the text's characters are part of a word."""
    to, word = _folding()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return to[points].tobytes().decode("utf-32-le"), word[points]


def folded_words(text: str) -> set[str]:
    """Distinct folded words: word characters, and signs between them that stand for letters."""
    folded, word = fold(text)
    if not folded:
        return set()
    inner = np.frombuffer(folded.encode("utf-32-le"), np.uint32) != np.frombuffer(text.encode("utf-32-le"), np.uint32)
    joined = word.copy()
    joined[1:-1] |= inner[1:-1] & word[:-2] & word[2:]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.view(np.int8), [0]])))
    return {folded[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)}


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
    """Aho-Corasick over folded entries; values: length, weight, whole word?. An exception has no weight."""
    found = ahocorasick.Automaton()
    entries = {}
    for entry, weight in lexicon.items():
        stem = entry.removesuffix("*")
        entries.setdefault(fold(stem)[0], []).append((len(stem), weight, stem == entry))
    for phrase in exceptions:
        entries.setdefault(fold(phrase)[0], []).append((len(phrase), None, True))
    for key, values in entries.items():
        found.add_word(key, values)
    found.make_automaton()
    return found


def matches(text: str, found) -> tuple[float, int]:
    """Sum of weights of the matches, the longest entry at each start, and the number of words.

    A match within an exception doesn't count: one that begins no later and reaches its end, the farthest of those is enough."""
    folded, word = fold(text)
    if not folded:
        return 0.0, 0
    n_words = len(text.split())
    spans, excepted = {}, []
    for end, values in found.iter(folded):
        for length, weight, whole in values:
            start = end - length + 1
            if start and word[start - 1] or whole and end + 1 < len(word) and word[end + 1]:
                continue
            if weight is None:
                excepted.append((start, end))
            elif length > spans.get(start, (0, 0.0))[0]:
                spans[start] = (length, weight)
    if excepted:
        excepted.sort()
        starts, reach = [a for a, _ in excepted], list(accumulate((b for _, b in excepted), max))
        spans = {s: v for s, v in spans.items() if not ((k := bisect_right(starts, s)) and s + v[0] - 1 <= reach[k - 1])}
    return sum(w for _, w in spans.values()), n_words


def raw_scorer(lexicon: dict[str, float], exceptions: tuple[str, ...]) -> Callable[[str], float]:
    """The weight of a text's matches over a power of its number of words."""
    found = automaton(lexicon, exceptions)

    def raw(text: str) -> float:
        weight, n_words = matches(text, found)
        return weight / max(n_words, 1) ** LENGTH_POWER

    return raw


def _raw(batches: Iterator[pd.DataFrame], lexicon: dict[str, float], exceptions: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    raw = raw_scorer(lexicon, exceptions)
    for batch in batches:
        yield batch.drop(columns="text").assign(raw=[raw(t) for t in batch["text"]])


def raw_scores(docs: DataFrame, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """`docs` (doc_id, text and what else) with `raw`, the weight of matches over a power of the words, in place of the text."""
    columns = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns), "raw double"])
    return docs.mapInPandas(lambda it: _raw(it, lexicon, exceptions), schema)


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for label, text in zip(batch["label"], batch["text"], strict=True):
            for word in folded_words(text):
                counts.setdefault(word, [0, 0])[label] += 1
        yield pd.DataFrame([(w, a, b) for w, (a, b) in counts.items()], columns=["word", "plain", "toxic"])


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    intercept: float


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Word beginnings and whole words that set toxic texts (doc_id, text, label) apart, with their log odds.

    Counts are texts with the word, repeated texts count once; they are summed by word, then by beginning, as map-side
    partial aggregates. Of nested beginnings with about the same texts the longest stays. At most MOST_ENTRIES are kept.
    """
    sample = sample.dropDuplicates(["text"])
    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        return {}
    words = sample.select("label", "text").mapInPandas(_word_counts, "word string, plain long, toxic long")
    words = words.groupBy("word").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))
    size = F.length("word")
    cuts = [F.when(size >= k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS]
    entries = words.select(F.explode(F.array_compact(F.array(F.when(size >= STEMS[0], F.col("word")), *cuts))).alias("entry"), "plain", "toxic")
    entries = entries.groupBy("entry").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("plain") + 0.5) * F.lit(n0 / n1))
    share = n1 / (n0 + n1)
    both = F.col("toxic") + F.col("plain")
    rate = F.col("toxic") / both
    evidence = F.col("toxic") * F.log(rate / F.lit(share)) + F.when(F.col("plain") > 0, F.col("plain") * F.log((1 - rate) / F.lit(1 - share))).otherwise(0.0)
    best = (entries.where((F.col("toxic") >= LEAST_TEXTS) & (odds >= LEAST_LOG_ODDS) & (evidence >= LEAST_EVIDENCE))
            .select("entry", "toxic", odds.alias("weight"), evidence.alias("evidence")).orderBy(F.desc("evidence"), "entry").limit(MOST_ENTRIES * 4).collect())
    return {e: w for e, w in longest_of_families([(r["entry"], r["toxic"], r["weight"]) for r in best])[:MOST_ENTRIES]}


def longest_of_families(found: list[tuple[str, int, float]], same: float = 0.9) -> list[tuple[str, float]]:
    """Of beginnings that contain one another, the longest one that still has `same` of the shortest one's texts."""
    shortest: list[str] = []
    families: dict[str, list[tuple[str, int, float]]] = {}
    for entry, toxic, weight in sorted(found, key=lambda x: (len(x[0].removesuffix("*")), x[0].endswith("*") is False, x[0])):
        stem = entry.removesuffix("*")
        root = next((stem[:k] for k in range(1, len(stem) + 1) if stem[:k] in families), None)
        if root is None:
            shortest.append(stem)
        families.setdefault(root or stem, []).append((entry, toxic, weight))
    out = []
    for stem in shortest:
        family = families[stem]
        most = max(t for _, t, _ in family)
        entry, toxic, weight = max((x for x in family if x[1] >= same * most), key=lambda x: (len(x[0].removesuffix("*")), not x[0].endswith("*")))
        out.append((toxic, entry, weight))
    return [(e, w) for _, e, w in sorted(out, key=lambda x: (-x[0], x[1]))]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A lexicon from one half of a bounded labelled sample and the calibration from the other half.

    Learnt entries replace general ones of the same form. Without labels of both kinds only the general list is left, and
    one match in about a hundred words is called toxic.
    """
    sample, counts = labelled_sample(docs, labels, label, per_class)
    lexicon = {**GENERAL, **learn_lexicon(sample.where("part = 0"))}
    scored = raw_scores(sample.where("part = 1").select("doc_id", "label", "text"), lexicon).select("label", "raw").toPandas()
    x, y = scored["raw"].to_numpy(float), scored["label"].to_numpy(int)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, EXCEPTIONS, 20.0, -4.0)
    slope, intercept = fit_logistic(x, y, counts)
    return Model(lexicon, EXCEPTIONS, slope, intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and `score`, the probability of being toxic, of every whole text.

    Null and empty texts have no match and get the lowest score. Repeated rows are scored one by one, other columns of
    `docs` are ignored, an empty table gives an empty one.
    """
    x = F.lit(model.slope) * F.col("raw") + F.lit(model.intercept)
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))
    return raw_scores(texts(docs), model.lexicon, model.exceptions).select("doc_id", (1 / (1 + F.exp(-x))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    scored = score(docs, train(docs, labels, per_class=per_class))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_harmless(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score stays below the threshold. A narrow pass: nothing is shuffled."""

    def keep(raw: Callable[[str], float]) -> Callable[[str | None], bool]:
        return lambda t: bool(logistic(raw(t or ""), model.slope, model.intercept) < threshold)

    return filtered(docs, lambda: keep(raw_scorer(model.lexicon, model.exceptions)))
