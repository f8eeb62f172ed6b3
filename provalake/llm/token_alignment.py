"""Alignment of two tokenizers over the same bytes: groups of tokens between common ends, and how often ids meet.

Both token rows tile the bytes of a space and the text. Every token points to the farthest-right token of the other side that
it overlaps, unless that one ends no later than itself (of two that end together the one of side B is the terminal). Following
the pointers, doubled round by round in arrays until nothing changes, each token arrives at the terminal of its component,
which labels the group: the tokens between two byte offsets at which both sides end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.llm.common import stored, text_slices, texts, worker_store
from provalake.llm.token_files import PER_CHARACTER, PER_WORD, Encoder

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are encoded at once, tokens that are aligned at once, and different id pairs a task adds up at once.
CHUNK, ALIGNED, MOST_PAIRS = 1_000_000, 250_000, 1_000_000
#: Bytes that either side's cached parts of texts may take in a Python worker.
MOST_CACHED = 100_000_000
#: Id pairs whose counts travel to all tasks at once; a larger table goes in as many blocks as it needs.
BLOCK = 2_000_000


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from
    U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Side:
    """What both sides share: the bytes of each id."""

    def set_bytes(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def gives(self, ids: np.ndarray, want: bytes) -> bool:
        """Are the tokens' bytes, one after the other, the wanted ones?"""
        size = self.size[ids]
        end = np.cumsum(size)
        if not len(ids) or end[-1] != len(want):
            return False
        return self.data[np.repeat(self.start[ids] - end + size, size) + np.arange(len(want))].tobytes() == want


class SideA(Side):
    """Byte-level BPE; special strings are ordinary text."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path, special=False, most_cached=MOST_CACHED)
        letters = _byte_letters()
        vocabulary = self.encoder.tokenizer
        tokens = [vocabulary.id_to_token(i) or "" for i in range(vocabulary.get_vocab_size())]
        self.set_bytes([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens])

    def encode(self, group: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.encoder.encode([" " + t for t in group])]


class SideB(Side):
    """Pieces with byte fallback; the library itself puts a space before the text.

    If no piece has a space after another character, and texts aren't rewritten, no merge goes over a space that follows another
    character. Then texts are cut there, and each distinct part is encoded once and kept.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        pieces = [self.processor.id_to_piece(i) for i in range(n)]
        self.set_bytes([bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        odd = "ﬁ①  Ａ\u00a0x "
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces) and self.processor.normalize(odd) == "▁" + odd.replace(" ", "▁")
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def _each(self, parts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.processor.encode(parts, num_threads=1)]

    def encode(self, group: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.frombuffer(x, "<u4") for x in self._each(group)]
        if self.cached > MOST_CACHED:
            self.cache.clear()
            self.cached = 0
        split = [words_after_spaces(t) if "▁" not in t else None for t in group]  # that sign is a space to the library
        whole = iter(self._each([t for t, parts in zip(group, split, strict=True) if parts is None]))
        new = list(set(chain.from_iterable(parts for parts in split if parts)).difference(self.cache))
        self.cache.update(zip(new, self._each(new), strict=True))
        self.cached += PER_WORD * len(new) + PER_CHARACTER * sum(map(len, new))
        return [np.frombuffer(next(whole) if parts is None else b"".join(map(self.cache.__getitem__, parts)), "<u4") for parts in split]


def words_after_spaces(text: str) -> list[str]:
    """The text cut before each space that follows another character, without that space; spaces at the end stay with what is
    before them."""
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out: list[str] = []
    waiting = ""
    for part in parts:
        if part:
            out.append(waiting + part)
            waiting = ""
        else:
            waiting += " "
    if waiting:  # one more empty part than spaces if there is nothing else
        return [*out[:-1], out[-1] + waiting] if out else [text] if text else []
    return out


def sides(paths: tuple[str, str]) -> tuple[SideA, SideB]:
    store = worker_store()
    for name, kind, path in (("a", SideA, paths[0]), ("b", SideB, paths[1])):
        if (key := f"token_alignment:{name}:{path}") not in store:
            store[key] = kind(path)
    return store[f"token_alignment:a:{paths[0]}"], store[f"token_alignment:b:{paths[1]}"]


def groups_of(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side, from ascending token ends over the same bytes; groups count from 0."""
    n = len(end_a)
    start_a, start_b = (np.concatenate([[0], end])[:-1] for end in (end_a, end_b))
    own = np.arange(n, n + len(end_b))
    farthest_b = np.searchsorted(start_b, end_a) - 1
    farthest_a = np.searchsorted(start_a, end_b) - 1
    after = np.concatenate([n + farthest_b, np.where(end_a[farthest_a] > end_b, farthest_a, own)]) if n else own
    while True:
        doubled = after[after]
        if (doubled == after).all():
            break
        after = doubled
    rank = np.cumsum(after[n:] == own) - 1  # terminals are tokens of B
    group = rank[after - n]
    return group[:n], group[n:]


def links_of(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and B of all pairs of tokens whose bytes overlap."""
    start_a, start_b = (np.concatenate([[0], end])[:-1] for end in (end_a, end_b))
    low = np.searchsorted(end_b, start_a, "right")
    high = np.searchsorted(start_b, end_a)
    times = high - low
    a = np.repeat(np.arange(len(end_a)), times)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)


def _encoded(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    left, right = sides(paths)
    for batch in batches:
        for part in text_slices(batch, CHUNK):
            group = part.column("text").to_pylist()
            rows = []
            for text, a, b in zip(group, left.encode(group), right.encode(group), strict=True):
                want = (" " + text).encode()
                if not text or not left.gives(a, want) or not right.gives(b, want):
                    a = b = np.zeros(0, np.uint32)
                rows.append((a.astype("<u2").tobytes(), b.astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=["doc_id", "a", "b"])


def token_rows(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """doc_id, `a` and `b`: ids of both sides as unsigned 16-bit integers. Both are empty where a text has no tokens."""
    return texts(docs).mapInArrow(lambda b: _encoded(b, paths), "doc_id long, a binary, b binary")


def _numbers(signs: str) -> np.ndarray:
    """For each sign all 16-bit ids, written out, with the sign after them."""
    store = worker_store()
    key = f"token_alignment:numbers:{signs}"
    if key not in store:
        store[key] = np.array([[f"{i}{sign}" for i in range(1 << 16)] for sign in signs], object)
    return store[key]


class Aligned:
    """Tokens, groups and links of many documents at once: their bytes are laid one after the other."""

    def __init__(self, rows_a: list[bytes], rows_b: list[bytes], size_a: np.ndarray, size_b: np.ndarray) -> None:
        self.a, self.b = (np.frombuffer(b"".join(rows), "<u2").astype(np.int64) for rows in (rows_a, rows_b))
        self.n_a, self.n_b = (np.array([len(r) // 2 for r in rows], np.int64) for rows in (rows_a, rows_b))
        self.end_a, self.end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        self.at_a, self.at_b = links_of(self.end_a, self.end_b)
        self.pair = self.a[self.at_a] << 16 | self.b[self.at_b]

    def by_document(self, values: np.ndarray) -> np.ndarray:
        """Sums over the links of each document."""
        stops = np.searchsorted(self.at_a, np.cumsum(self.n_a))
        sums = np.concatenate([[0], np.cumsum(values)])
        return np.diff(sums[np.concatenate([[0], stops])])

    def group_rows(self) -> tuple[np.ndarray, list[str]]:
        """Number of groups of each document, and its groups written out."""
        group_a, group_b = groups_of(self.end_a, self.end_b)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        stop_a, stop_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        n_groups = np.zeros(len(self.n_a), np.int64)
        some = self.n_a > 0
        n_groups[some] = np.diff(np.concatenate([[0], group_a[stop_a[some] - 1] + 1]))
        place = np.concatenate([np.arange(len(self.a)) + np.searchsorted(group_b, group_a), np.arange(len(self.b)) + np.searchsorted(group_a, group_b, "right")])
        written = np.empty(len(place), object)
        written[place] = np.concatenate([_numbers(",|")[last_a.astype(int), self.a], _numbers(",;")[last_b.astype(int), self.b]])
        cuts = np.concatenate([[0], stop_a + stop_b]).tolist()
        return n_groups, ["".join(written[x:y])[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _aligned(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    left, right = sides(paths)
    for batch in batches:
        sizes = [len(x) // 2 for x in batch.column("a").to_pylist()]
        start = 0
        while start < len(sizes):
            stop, total = start + 1, sizes[start]
            while stop < len(sizes) and total + sizes[stop] <= ALIGNED:
                total += sizes[stop]
                stop += 1
            part = batch.slice(start, stop - start)
            yield part, Aligned(part.column("a").to_pylist(), part.column("b").to_pylist(), left.size, right.size)
            start = stop


def _pairs(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Linked id pairs and their numbers, added up within the task as long as they are few."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    for _, aligned in _aligned(batches, paths):
        pair, n = np.unique(aligned.pair, return_counts=True)
        merged, place = np.unique(np.concatenate([keys, pair]), return_inverse=True)
        total = np.zeros(len(merged), np.int64)
        np.add.at(total, place, np.concatenate([counts, n]))
        keys, counts = merged, total
        if len(keys) > MOST_PAIRS:
            yield row()
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield row()


def pair_counts(tokens: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """`pair` (id of A in the upper, of B in the lower 16 bits), n, its number of links in all documents, and `best`: is that the
    highest of its B id? There are at most as many rows as pairs of ids, whatever the size of the corpus."""
    counts = tokens.mapInArrow(lambda b: _pairs(b, paths), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFF)), "pairs")
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], block, last: bool) -> Iterator[pa.RecordBatch]:
    """Adds the links whose pairs are in a block of counts to the sums so far. The last block's pass gives the result's columns."""
    keys, counts, best = block.value
    for part, x in _aligned(batches, paths):
        at = np.minimum(np.searchsorted(keys, x.pair), len(keys) - 1)
        known = keys[at] == x.pair
        sums = {"n_best": known & best[at], "count_sum": np.where(known, counts[at], 0)}
        sums = {k: pa.array(x.by_document(v.astype(np.int64)) + part.column(k).to_numpy()) for k, v in sums.items()}
        if not last:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("a"), part.column("b"), *sums.values()], names=["doc_id", "a", "b", *sums])
            continue
        n_groups, written = x.group_rows()
        links = x.by_document(np.ones(len(x.pair), np.int64))
        digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x.n_a), pa.array(x.n_b), pa.array(n_groups), pa.array(links), *sums.values(), pa.array(digests, pa.string())],
                                         names=["doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256"])


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id and `groups`, written out as `a1,a2|b1;a3|b2,b3`, of every document; empty where there are no tokens."""
    paths = _paths(path_a, path_b)

    def run(batches):
        for part, x in _aligned(batches, paths):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x.group_rows()[1], pa.string())], names=["doc_id", "groups"])

    return token_rows(docs, paths).mapInArrow(run, "doc_id long, groups string")


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B id), count_sum
    (counts of all links added up) and groups_sha256 (of `a1,a2|b1;a3|b2,b3`).

    Null and empty texts, and texts that either side doesn't give back byte by byte (after one space), have zeros and an empty
    digest. Repeated rows count and return one by one; texts are read whole; other columns are left out.
    The table of pair counts goes to the tasks in blocks of about BLOCK pairs; the sums of each block are added to the last one's.
    """
    paths = _paths(path_a, path_b)
    tokens = stored(token_rows(docs, paths), "token_rows")
    pairs = stored(pair_counts(tokens, paths), "pair_counts")
    n_blocks = max(1, -(-pairs.count() // BLOCK))
    rows = tokens.select("doc_id", "a", "b", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    for k in range(n_blocks):
        block = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(n_blocks)) == k).toPandas().sort_values("pair")
        keys, counts, best = (np.append(block[c].to_numpy(kind), kind(last)) for c, kind, last in (("pair", np.int64, 1 << 62), ("n", np.int64, 0), ("best", np.bool_, False)))
        sent = docs.sparkSession.sparkContext.broadcast((keys, counts, best))
        last = k == n_blocks - 1
        schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" if last
                  else "doc_id long, a binary, b binary, n_best long, count_sum long")
        rows = rows.mapInArrow(lambda b, sent=sent, last=last: _scored(b, paths, sent, last), schema)
        if not last:
            rows = stored(rows, "scored")
    return rows
