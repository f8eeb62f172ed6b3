"""Rule bitmask ledger: every rule is evaluated once per document, its verdict is one bit, policies are masks over the bits.

`ledger` reads each whole text once and stores the measurements and `fail_bits`. Policies, their versions and ablations
only read the ledger: a policy keeps a document if `fail_bits & mask = 0`, and an ablation drops one bit from the mask.
The ledger has one narrow row per document, so nothing here shuffles texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.llm.common import BLANKS, groups_by_size, mix64, texts

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = UPPER + UPPER.lower() + bytes(range(0x80, 0x100))

#: Name and failure test of each rule; the place in the list is the bit. Append only: stored ledgers keep their meaning.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("upper_case", "100 * n_upper > 40 * n_letters"),
]
#: Versioned policies: the rules that a document must pass.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines"],
    "v2": [name for name, _ in RULES],
}
CURRENT = "v2"


def mask(policy: str) -> int:
    bit = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bit[name] for name in POLICIES[policy])


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _covered(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words found twice or more. Exact: windows are numbered by doubling (2, 4, 8 words)."""
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    for step in (1, 2, 4):
        pairs = ids[:-step] * (ids.max() + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
    again = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def repeat_words(words: list[list[bytes]]) -> list[int]:
    """For each document, the words covered by repeated windows. Window hashes of all documents are sorted at once; only
    documents in which a hash comes back are counted exactly."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = [0] * len(words)
    if not sizes.sum():
        return out
    numbers = _Numbers()
    flat = np.fromiter((n for w in words for n in map(numbers.__getitem__, w)), np.uint64, int(sizes.sum()))
    if len(flat) <= WINDOW:
        return out
    scrambled = mix64(flat + np.uint64(1))
    windows = len(flat) - WINDOW + 1
    hashes = np.zeros(windows, np.uint64)
    for j in range(WINDOW):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + scrambled[j:j + windows]
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(words)), sizes)[:windows]
    inside = np.arange(windows) + WINDOW <= ends[doc]
    doc, hashes = doc[inside], hashes[inside] ^ mix64(doc[inside].astype(np.uint64) + np.uint64(7))
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    for d in np.unique(doc[order[1:][same]]):
        out[d] = _covered(words[d])
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, raw = batch.column("doc_id"), [t.encode() for t in batch.column("text").to_pylist()]
        for start, stop in groups_by_size([len(t) for t in raw], 8_000_000):
            part = raw[start:stop]
            words = [t.split() for t in part]
            rows = []
            for text, split in zip(part, words, strict=True):
                lines = [x for x in text.split(b"\n") if x.strip()]
                blank_less = text.translate(None, BLANKS)
                rows.append((len(split), len(blank_less.decode()), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
                             0, len(lines), len(text) - len(text.translate(None, UPPER)), len(text) - len(text.translate(None, LETTERS))))
            columns = [list(c) for c in zip(*rows, strict=True)]
            columns[4] = repeat_words(words)
            yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements and `fail_bits` (long), bit i set if RULES[i] fails.

    Words are runs of anything but ASCII white space, of the whole text. A null or empty text has no words and fails
    `few_words`; repeated rows and null ids are measured row by row; other columns are ignored; an empty table gives none.
    """
    measured = texts(docs).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: str = CURRENT, column: str = "kept") -> DataFrame:
    """The ledger with a boolean column: does the document pass every rule of the policy?"""
    return rows.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that stay without it.

    The ledger shrinks first to one row per distinct bit pattern (at most 2^rules), with map-side partial counts.
    """
    full = mask(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(full)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if full >> i & 1]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in rules)))
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return (patterns.select("bits", "n", each.alias("r")).groupBy(F.col("r.rule").alias("rule"))
            .agg(count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
                 count(F.col("bits") == F.col("r.bit")).alias("failed_alone"),
                 count(F.col("bits").bitwiseAND(F.lit(full) - F.col("r.bit")) == 0).alias("kept_without")))


def quality_rules(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with `base_failed` (the base policy rejects) and `kept` (neither it nor the given policy rejects)."""
    judged = apply_policy(apply_policy(ledger(docs), "base", "base_kept"), policy, "policy_kept")
    return judged.select("doc_id", *MEASURES[:5], (~F.col("base_kept")).alias("base_failed"), (F.col("base_kept") & F.col("policy_kept")).alias("kept"),
                         *MEASURES[5:], "fail_bits")
