"""Compression classifier: a text is good if a zstandard dictionary of good texts compresses it better than one of bad texts.

Two dictionaries are trained on bounded samples of labelled text. A whole text is cut into blocks of equal size, so that the
dictionaries and not the text's own past decide, and each block is compressed with both. The raw score is the difference of
the two total sizes over the length of the text; logistic calibration on the other half of the sample turns it into a
probability. (Over the sum of the two sizes instead, endlessly repeated words, which both dictionaries compress to nothing,
would score as good.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.llm.common import filtered, held_out, texts
from provalake.llm.training import fit_logistic, labelled_sample, logistic

#: Bounds of the training sample: documents of either label, blocks of each document, and bytes of a block.
PER_CLASS, BLOCKS_PER_DOC, BLOCK = 3000, 6, 1024
DICTIONARY_BYTES, LEVEL = 64 * 1024, 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    """The whole text in about equal blocks of at most `size` bytes."""
    n = -(-len(text) // size)
    cuts = [len(text) * i // n for i in range(n + 1)] if n else [0]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary bytes; too few samples for training give their plain content, none give an empty one."""
    size = min(size, max(256, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"write_content_size": False, "write_dict_id": False, "write_checksum": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, **options)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **options)


def raw_scorer(good: bytes, bad: bytes) -> Callable[[str], float]:
    """Bytes that the good dictionary saves against the bad one, per byte of the text; 0 for an empty text."""
    as_good, as_bad = _compressor(good), _compressor(bad)

    def raw(text: str) -> float:
        data = text.encode()
        parts = blocks(data)
        return sum(len(as_bad.compress(p)) - len(as_good.compress(p)) for p in parts) / len(data) if parts else 0.0

    return raw


def _raw(batches: Iterator[pd.DataFrame], good: bytes, bad: bytes) -> Iterator[pd.DataFrame]:
    raw = raw_scorer(good, bad)
    for batch in batches:
        yield batch.drop(columns="text").assign(raw=[raw(t) for t in batch["text"]])


def raw_scores(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """`docs` (doc_id, text and what else) with `raw` in place of the text."""
    columns = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns), "raw double"])
    return docs.mapInPandas(lambda it: _raw(it, good, bad), schema)


def _training_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, label, text in zip(batch["doc_id"], batch["label"], batch["text"], strict=True):
            ranked = sorted((hashlib.blake2b(f"{doc}/{i}".encode(), digest_size=8).digest(), part) for i, part in enumerate(blocks(text.encode())))
            rows += [(doc, label, place, part) for place, (_, part) in enumerate(ranked[:BLOCKS_PER_DOC])]
        yield pd.DataFrame(rows, columns=["doc_id", "label", "place", "block"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Dictionaries from one half of a bounded labelled sample, calibration from the other half.

    At most 2 * per_class * BLOCKS_PER_DOC blocks of BLOCK bytes reach the driver; they are chosen by hash from the whole
    texts. Repeated texts count once. Without labels the model gives every text the same score.
    """
    sample, counts = labelled_sample(docs, labels, label, per_class)
    sample = sample.where(F.length("text") > 0)
    rows = sample.where("part = 0").select("doc_id", "label", "text").mapInPandas(_training_blocks, "doc_id long, label int, place int, block binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["place"]))
    by_label: dict[int, dict[bytes, None]] = {0: {}, 1: {}}
    for r in rows:
        by_label[r["label"]][bytes(r["block"])] = None
    good, bad = train_dictionary(list(by_label[1])), train_dictionary(list(by_label[0]))
    if not by_label[0] or not by_label[1]:
        return Model(good, bad, *fit_logistic(np.array([]), np.array([]), counts))
    calibration = raw_scores(sample.where("part = 1").select("doc_id", "label", "text"), good, bad).select("label", "raw").toPandas()
    return Model(good, bad, *fit_logistic(calibration["raw"].to_numpy(float), calibration["label"].to_numpy(int), counts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and `score`, the probability of label 1, of every whole text.

    A null or empty text compresses to nothing either way: its raw score is 0. Repeated rows are scored one by one, other
    columns of `docs` are ignored, an empty table gives an empty one.
    """
    slope, intercept = model.slope, model.intercept
    x = F.lit(slope) * F.col("raw") + F.lit(intercept)
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))
    return raw_scores(texts(docs), model.good, model.bad).select("doc_id", (1 / (1 + F.exp(-x))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    scored = score(docs, train(docs, labels, per_class=per_class))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score reaches the threshold. A narrow pass: nothing is shuffled."""

    def keep(text: Callable[[str], float]) -> Callable[[str | None], bool]:
        return lambda t: bool(logistic(text(t or ""), model.slope, model.intercept) >= threshold)

    return filtered(docs, lambda: keep(raw_scorer(model.good, model.bad)))
