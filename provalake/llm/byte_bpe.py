"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays, without a regular expression. Each code point has a class (letter, number, other, space,
other white space); with the code points after it, the class becomes a symbol; a symbol is a function from state to state of
a small automaton. Functions compose associatively, so a scan over blocks finds the state before every code point and with
it the places where a piece begins. The byte slices between them go to pair merging by rank, with a cache of pieces. Token
ends are kept as byte offsets, and decoding fills the bytes of each token between its offsets.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from provalake.llm.common import text_slices, texts, worker_store

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text that are scanned at once. Bytes that cached pieces may take in a Python worker, at about so many for a piece and
#: for each of its own; a full cache starts anew.
CHUNK = 250_000
MOST_CACHED, PER_PIECE, PER_BYTE = 80_000_000, 220, 5
#: Pieces up to this many bytes are merged side by side.
SHORT_PIECE = 24
NEVER = sys.maxsize
NO_RANK = np.iinfo(np.int64).max

# Fixed values of the split pattern: contractions by the letters after the apostrophe, and what counts as white space.
SHORT_CONTRACTIONS, LONG_CONTRACTIONS = "stmd", ("re", "ve", "ll")
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, SPACE, BLANK, END = range(6)
# Symbols of the automaton: the first three classes, an apostrophe that may open a contraction of one or two letters, a space
# or other blank before a character that isn't blank, a blank before a blank or the end, and the end of a text.
SHORT, LONG, SPACE_LAST, BLANK_LAST, BLANK_INNER, STOP = range(3, 9)
# States: between pieces, in a run of letters, numbers, others or blanks, after a leading space, one or two letters of a
# contraction to come.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
RUNS = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at this symbol."""
    if symbol == LETTER and state in (TWO_MORE, ONE_MORE):
        return (ONE_MORE if state == TWO_MORE else FREE), False
    if symbol in (SHORT, LONG):
        if state not in (IN_OTHERS, AFTER_SPACE):
            return (ONE_MORE if symbol == SHORT else TWO_MORE), True
        symbol = OTHER
    if symbol in RUNS:
        return RUNS[symbol], state not in (RUNS[symbol], AFTER_SPACE)
    if symbol == BLANK_INNER:
        return IN_BLANKS, state != IN_BLANKS
    return (AFTER_SPACE if symbol == SPACE_LAST else FREE), True


def _automaton() -> dict[str, np.ndarray]:
    """All compositions of the symbols' functions: their products, what they do to a state, and where pieces begin."""
    states = range(8)
    functions = [tuple(_step(q, s)[0] for q in states) for s in range(9)]
    number = {}
    for f in functions:
        number.setdefault(f, len(number))
    number.setdefault(tuple(states), len(number))
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in functions:
            h = tuple(g[f[q]] for q in states)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    known = list(number)
    product = np.array([[number[tuple(g[f[q]] for q in states)] for g in known] for f in known], np.uint16)
    return {"of_symbol": np.array([number[f] for f in functions], np.uint16), "product": product, "identity": np.uint16(number[tuple(states)]),
            "apply": np.array(known, np.uint8), "begins": np.array([[_step(q, s)[1] for s in range(9)] for q in states], bool)}


def _classes() -> np.ndarray:
    classes = np.full(0x110001, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            classes[point] = LETTER
        elif kind == "N":
            classes[point] = NUMBER
    classes[WHITE_SPACE] = BLANK
    classes[0x20] = SPACE
    classes[0x110000] = END
    return classes


def prefix_functions(functions: np.ndarray, product: np.ndarray, identity: int, block: int = 128) -> np.ndarray:
    """The composition of all functions before each place. Blocks are composed side by side, block totals by the same scan."""
    n = len(functions)
    if n <= block:
        out, acc = np.empty(n, np.uint16), identity
        for i, f in enumerate(functions):
            out[i] = acc
            acc = product[acc, f]
        return out
    columns = -(-n // block)
    padded = np.full(columns * block, identity, np.uint16)
    padded[:n] = functions
    rows = np.ascontiguousarray(padded.reshape(columns, block).T)
    before = np.empty_like(rows)
    acc = np.full(columns, identity, np.uint16)
    for j in range(block):
        before[j] = acc
        acc = product[acc, rows[j]]
    start = prefix_functions(acc, product, identity, block)
    return product[start[None, :], before].T.reshape(-1)[:n]


class PreTokenizer:
    def __init__(self) -> None:
        self.classes, self.machine = _classes(), _automaton()

    def begins(self, points: np.ndarray) -> np.ndarray:
        """Where pieces begin among code points; 0x110000 ends a text and belongs to no piece."""
        classes = self.classes[points]
        blank = (classes == SPACE) | (classes == BLANK)
        before_text = np.append(~blank[1:] & (classes[1:] != END), False)
        symbols = np.where(blank, np.where(before_text, np.where(classes == SPACE, SPACE_LAST, BLANK_LAST), BLANK_INNER), classes).astype(np.uint8)
        symbols[classes == END] = STOP
        for i in np.flatnonzero(points == 0x27):
            after = "".join(chr(p) for p in points[i + 1:i + 3] if p < 0x110000)
            if after[:1] and after[0] in SHORT_CONTRACTIONS:
                symbols[i] = SHORT
            elif after in LONG_CONTRACTIONS:
                symbols[i] = LONG
        m = self.machine
        before = prefix_functions(m["of_symbol"][symbols], m["product"], m["identity"])
        return m["begins"][m["apply"][before, FREE], symbols]

    def pieces(self, group: list[str]) -> list[list[bytes]]:
        """The pieces of each text of a group as bytes."""
        end = np.array([0x110000], np.uint32)
        points = np.concatenate([x for t in group for x in (np.frombuffer(t.encode("utf-32-le"), np.uint32), end)])
        width = (points < 0x110000).astype(np.int64) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        width[points == 0x110000] = 0
        at = np.concatenate([[0], np.cumsum(width)])
        begins = np.flatnonzero(self.begins(points))
        stops = np.flatnonzero(points == 0x110000)
        offsets, data = at[begins].tolist(), "".join(group).encode()
        cuts = [data[a:b] for a, b in zip(offsets, offsets[1:])]  # an end is a cut too: its own slice is empty
        cuts.append(b"")
        out, start = [], 0
        for stop in np.searchsorted(begins, stops).tolist():
            out.append(cuts[start:stop])
            start = stop + 1
        return out


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, the leftmost of equals, until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 100:
        return _merge_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    rank = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while rank:
        best = min(rank)
        if best == NEVER:
            break
        i = rank.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over a linked list: n log n for runs of any length."""
    n = len(piece)
    stop, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or stop[i] != middle or stop[j] != end:
            continue
        alive[j], stop[i], after[i] = False, end, after[j]
        if after[j] < n:
            before[after[j]] = i
            k = after[i]
            if (r := ranks.get(piece[i:stop[k]])) is not None:
                heapq.heappush(heap, (r, i, end, stop[k]))
        if before[i] >= 0:
            k = before[i]
            if (r := ranks.get(piece[k:end])) is not None:
                heapq.heappush(heap, (r, k, i, end))
    return [ranks[piece[i:stop[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder over one vocabulary file; ids travel as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split = PreTokenizer()
        self.cache: dict[bytes, bytes] = {}
        self.cached = 0
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        made = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    made[left << 32 | right] = rank
        self.pairs = np.array(sorted(made), np.int64)
        self.made = np.array([made[p] for p in self.pairs.tolist()], np.int64)

    def encode(self, group: list[str]) -> list[bytes]:
        split = self.split.pieces(group)
        if self.cached > MOST_CACHED:
            self.cache.clear()
            self.cached = 0
        new = {p for pieces in split for p in pieces if p not in self.cache}
        self.cached += PER_PIECE * len(new) + PER_BYTE * sum(map(len, new))
        short = [p for p in new if len(p) <= SHORT_PIECE]
        for start in range(0, len(short), 50_000):
            part = short[start:start + 50_000]
            self.cache.update(zip(part, self._merge_many(part), strict=True))
        for p in new:
            if len(p) > SHORT_PIECE:
                self.cache[p] = np.array(merge_pairs(p, self.ranks), "<u4").tobytes()
        return [b"".join(map(self.cache.__getitem__, pieces)) for pieces in split]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that two adjacent tokens make, or NO_RANK."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (right >= 0), self.made[at], NO_RANK)

    def _merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """`merge_pairs` for many short pieces side by side: each round merges the best pair of every piece."""
        out: list[bytes] = [b""] * len(pieces)
        by_size = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for start in range(0, len(by_size), 8192):
            rows = np.array(by_size[start:start + 8192])
            longest = len(pieces[rows[-1]])
            data = np.frombuffer(b"".join(pieces[i].ljust(longest, b"\0") for i in rows), np.uint8).reshape(len(rows), longest)
            size = np.array([len(pieces[i]) for i in rows])
            tokens = np.full((len(rows), longest + 1), -1, np.int64)
            tokens[:, :longest] = np.where(np.arange(longest) < size[:, None], self.of_byte[data], -1)
            ranks = self._rank(tokens[:, :-1], tokens[:, 1:])
            while len(rows):
                best = ranks.argmin(1)
                rank = ranks[np.arange(len(rows)), best]
                done = rank == NO_RANK
                for i, row in zip(rows[done], tokens[done], strict=True):
                    out[i] = row[row >= 0].astype("<u4").tobytes()
                rows, tokens, ranks, best, rank = rows[~done], tokens[~done], ranks[~done], best[~done], rank[~done]
                if not len(rows):
                    break
                each, places = np.arange(len(rows)), np.arange(tokens.shape[1] - 1)
                tokens[each, best] = rank
                tokens = np.take_along_axis(tokens, places + (places > best[:, None]), 1)
                places = places[:-1]
                ranks = np.take_along_axis(ranks, places + (places >= best[:, None]), 1)
                tokens = np.concatenate([tokens, np.full((len(rows), 1), -1)], 1)
                ranks = np.concatenate([ranks, np.full((len(rows), 1), NO_RANK)], 1)
                ranks[each, best] = self._rank(tokens[each, best], tokens[each, best + 1])
                inner = np.flatnonzero(best > 0)
                b = best[inner]
                ranks[inner, b - 1] = self._rank(tokens[inner, b - 1], tokens[inner, b])
        return out

    def ends(self, ids: bytes) -> np.ndarray:
        """The byte offset in the text where each token ends."""
        return np.cumsum(self.size[np.frombuffer(ids, "<u4")])

    def decode(self, ids: bytes, ends: np.ndarray) -> bytes:
        tokens = np.frombuffer(ids, "<u4")
        if not len(tokens):
            return b""
        shift = self.start[tokens] - np.concatenate([[0], ends[:-1]])
        return self.bytes[np.repeat(shift, self.size[tokens]) + np.arange(ends[-1])].tobytes()


def codec(path: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    store = worker_store()
    key = f"byte_bpe:{path}"
    if key not in store:
        store[key] = Codec(path)
    return store[key]


def _each(batches: Iterator[pa.RecordBatch], path: str, row: Callable) -> Iterator[tuple]:
    coder = codec(path)
    for batch in batches:
        for part in text_slices(batch, CHUNK):
            yield part.column("doc_id"), [row(coder, ids) for ids in coder.encode(part.column("text").to_pylist())]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, `ids` and `ends` (token ids and the byte offsets of token ends, both little-endian unsigned 32-bit) of whole texts.

    A null or empty text has no ids. Repeated rows are encoded one by one; other columns are ignored; an empty table gives
    an empty one. `path` is the rank file; every executor reads it.
    """
    path = path or vocabulary_path()

    def run(batches):
        for ids, rows in _each(batches, path, lambda c, x: (x, c.ends(x).astype("<u4").tobytes())):
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "ids", "ends"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, ends binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and `text` (binary) from doc_id, ids and ends; null ids give a null text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        for b in batches:
            out = [None if i is None else coder.decode(bytes(i), np.frombuffer(bytes(e), "<u4").astype(np.int64)) for i, e in zip(b["ids"], b["ends"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": out})

    return encoded.select("doc_id", "ids", "ends").mapInPandas(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, digests of the ids and of the decoded bytes.

    Cases are those of `encode`: an empty text has no tokens and the digests of nothing.
    """
    path = path or vocabulary_path()

    def row(coder: Codec, ids: bytes):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids, coder.ends(ids))).hexdigest()

    def run(batches):
        for ids, rows in _each(batches, path, row):
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, `ids` (array of int) and the digest of the bytes decoded from them; cases as in `encode`."""
    path = path or vocabulary_path()

    def run(batches):
        for docs_, rows in _each(batches, path, lambda c, x: (x, hashlib.sha256(c.decode(x, c.ends(x))).hexdigest())):
            sizes = np.array([len(r[0]) // 4 for r in rows], np.int64)
            values = pa.array(np.frombuffer(b"".join(r[0] for r in rows), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([docs_, pa.array(sizes), lists, pa.array([r[1] for r in rows])], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
