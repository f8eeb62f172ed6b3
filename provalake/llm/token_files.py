"""Token files: ids of all documents in ascending doc_id order, packed in patched frame-of-reference blocks.

A file is a Parquet file, so any store that Spark reaches can hold it. Each row is a segment of consecutive whole documents:
`payload` holds blocks of BLOCK ids back to back, `block_starts` the byte at which each block begins, `doc_ids` and
`doc_starts` the documents and the id at which each begins. A block is

    base u32 | ids u16 | outliers u16 | width u8 | packed bits | outlier places u16 ... | outlier values u32 ...

where each id less the block's least id (base) is packed in `width` bits, the width that PERCENTILE of the block need; those
that need more are outliers, patched after unpacking.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provalake.llm.common import groups_by_size, texts, worker_store
from provalake.session import scratch_dir

TOKENIZER = "byte_bpe_50k.json"
BLOCK, PERCENTILE = 512, 90
HEADER = np.dtype([("base", "<u4"), ("n", "<u2"), ("outliers", "<u2"), ("width", "u1")])
#: A segment ends with the document that brings it to so many ids; texts are encoded in groups of so many characters.
SEGMENT_IDS, CHUNK = 1 << 18, 2_000_000
#: Bytes that cached words may take in a Python worker, at about so many for a word and for each of its characters; a full cache
#: starts anew.
MOST_CACHED, PER_WORD, PER_CHARACTER = 280_000_000, 220, 5
END_ID = 0
SEGMENT_SCHEMA = ("shard int, segment int, first_id long, n_ids long, doc_ids array<long>, doc_starts array<long>, "
                  "block_starts array<int>, payload binary")


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and block starts of an array of ids below 2^32."""
    if not len(ids):
        return b"", np.zeros(0, np.int32)
    n_blocks = -(-len(ids) // BLOCK)
    size = np.full(n_blocks, BLOCK)
    size[-1] = len(ids) - BLOCK * (n_blocks - 1)
    padded = np.concatenate([ids, np.full(n_blocks * BLOCK - len(ids), ids[BLOCK * (n_blocks - 1):].min())]).astype(np.int64).reshape(n_blocks, BLOCK)
    base = padded.min(1)
    deltas = padded - base[:, None]
    place = BLOCK * PERCENTILE // 100
    width = np.ceil(np.log2(np.partition(deltas, place, 1)[:, place] + 1)).astype(np.int64)
    patched = deltas >> width[:, None] > 0
    blocks: list[bytes] = [b""] * n_blocks
    header = np.zeros(n_blocks, HEADER)
    header["base"], header["n"], header["outliers"], header["width"] = base, size, patched.sum(1), width
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        size_of = np.dtype("<u2" if w <= 16 else "<u4")
        bits = np.unpackbits(deltas[rows].astype(size_of).view(np.uint8), axis=1, bitorder="little").reshape(len(rows), BLOCK, -1)[:, :, :w]
        for i, data in zip(rows.tolist(), np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little"), strict=True):
            packed[i] = data.tobytes()
    heads, places, values = header.tobytes(), np.nonzero(patched)[1].astype("<u2").tobytes(), deltas[patched].astype("<u4").tobytes()
    cuts, n = np.concatenate([[0], np.cumsum(header["outliers"], dtype=np.int64)]).tolist(), HEADER.itemsize
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        blocks[i] = b"".join((heads[i * n:(i + 1) * n], packed[i], places[2 * a:2 * b], values[4 * a:4 * b]))
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]])
    return b"".join(blocks), starts.astype(np.int32)


def unpack(payload: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of a payload as unsigned 32-bit integers. Blocks of equal width are unpacked together."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    data = np.frombuffer(payload, np.uint8)
    starts = np.asarray(starts, np.int64)
    header = data[starts[:, None] + np.arange(HEADER.itemsize)].copy().view(HEADER)[:, 0]
    out = np.zeros((len(starts), BLOCK), np.int64)
    for w in np.unique(header["width"]).tolist():
        rows = np.flatnonzero(header["width"] == w)
        if w:
            packed = data[starts[rows, None] + HEADER.itemsize + np.arange(BLOCK * w // 8)]
            size_of = np.dtype("<u2" if w <= 16 else "<u4")
            bits = np.zeros((len(rows), BLOCK, 8 * size_of.itemsize), np.uint8)
            bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            out[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view(size_of)
    for i in np.flatnonzero(header["outliers"]).tolist():
        n = int(header["outliers"][i])
        at = int(starts[i]) + HEADER.itemsize + BLOCK * int(header["width"][i]) // 8
        places = np.frombuffer(payload, "<u2", n, at)
        out[i, places] = np.frombuffer(payload, "<u4", n, at + 2 * n)
    out += header["base"].astype(np.int64)[:, None]
    return out[np.arange(BLOCK) < header["n"][:, None]].astype(np.uint32)


def words(parts: list[str]) -> list[str]:
    """The parts of a text between its spaces, put together again where the tokenizer may not cut: it always cuts before a single
    space between two characters that aren't blank, and looks at nothing beyond, so what is left can be encoded, and cached, one
    by one. All but the first lack the space before them."""
    out = [parts[0]]
    for before, w in zip(parts, parts[1:]):
        if before and not before[-1].isspace() and w and not w[0].isspace():
            out.append(w)
        else:
            out[-1] += " " + w
    return out


def _edged(parts: set[str]) -> set[str]:
    """Parts that are empty or have a blank at either end."""
    return {w for w in parts if w.strip() != w} | parts.intersection([""])


class Encoder:
    """Encodes texts over a cache of words. `special`: are the strings of special tokens in a text these tokens?"""

    def __init__(self, path: str, special: bool = True, most_cached: int = MOST_CACHED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.opening: dict[str, bytes] = {}  # first parts of texts
        self.cache: dict[str, bytes] = {}  # parts after a space
        self.cached, self.most_cached = 0, most_cached
        tokens = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.opens = np.array([t.startswith("\u0120") for t in tokens])  # the vocabulary's sign for a space

    def _each(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode new parts, each after a space. Those without another blank are joined, many to a call: the tokenizer cuts
        before each space, and only a part's first token begins with one, so the ids fall apart again. The rest go one by one."""
        other = [w for w in new if " " in w]
        plain = [w for w in new if " " not in w] if other else new
        for start in range(0, len(plain), 20_000):
            part = plain[start:start + 20_000]
            joined = [" " + " ".join(part[i:i + 200]) for i in range(0, len(part), 200)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), "<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part) or starts[:1].any():
                other += part
                continue
            data, cuts = ids.tobytes(), (4 * np.append(starts, len(ids))).tolist()
            self.cache.update(zip(part, map(data.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        for start in range(0, len(other), 20_000):
            part = other[start:start + 20_000]
            self.cache.update(zip(part, self._each([" " + w for w in part]), strict=True))

    def encode(self, group: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Each distinct word goes through the tokenizer once.

        Texts are cut at every space. A part that is empty or has a blank at an end is never kept in the cache, so it shows among
        the new ones; then the texts that have such parts are put together again where need be.
        """
        split = [t.split(" ") for t in group]
        if self.cached > self.most_cached:
            self.cache.clear()
            self.opening.clear()
            self.cached = 0
        new = set(chain.from_iterable(split)).difference(self.cache)
        edged = _edged(new)
        if edged:
            split = [parts if edged.isdisjoint(parts) else words(parts) for parts in split]
            new = set(chain.from_iterable(split)).difference(self.cache)
            edged = _edged(new)
            new -= edged
        self._learn(list(new))
        first = list({parts[0] for parts in split}.difference(self.opening))
        self.opening.update(zip(first, self._each(first), strict=True))
        self.cached += PER_WORD * (len(new) + len(first)) + PER_CHARACTER * (sum(map(len, new)) + sum(map(len, first)))
        once = list(edged)
        self.cache.update(zip(once, self._each([" " + w for w in once]), strict=True))
        out = [self.opening[parts[0]] + b"".join(map(self.cache.__getitem__, parts[1:])) for parts in split]
        for w in once:
            del self.cache[w]
        return out


def encoder(path: str) -> Encoder:
    store = worker_store()
    key = f"token_files:{path}"
    if key not in store:
        store[key] = Encoder(path)
    return store[key]


def _segments(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    """Segments of one partition's documents, which come in ascending doc_id order."""
    coder, shard = encoder(path), TaskContext.get().partitionId()
    end = np.array([END_ID], "<u4").tobytes()
    docs: list = []
    waiting: list[bytes] = []
    count = first = segment = 0

    def flush() -> pd.DataFrame:
        nonlocal docs, waiting, count, first, segment
        ids = np.frombuffer(b"".join(waiting), "<u4")
        payload, starts = pack(ids)
        doc_starts = np.concatenate([[0], np.cumsum([len(w) // 4 for w in waiting])[:-1]]).astype(np.int64)
        row = (shard, segment, first, len(ids), docs, doc_starts, starts, payload)
        docs, waiting, count, first, segment = [], [], 0, first + len(ids), segment + 1
        return pd.DataFrame([row], columns=["shard", "segment", "first_id", "n_ids", "doc_ids", "doc_starts", "block_starts", "payload"])

    for batch in batches:
        known = batch["doc_id"].notna().to_numpy()
        ids, values = [int(i) if k else None for i, k in zip(batch["doc_id"].tolist(), known.tolist(), strict=True)], batch["text"].tolist()
        for start, stop in groups_by_size([len(t) for t in values], CHUNK):
            for doc, found in zip(ids[start:stop], coder.encode(values[start:stop]), strict=True):
                docs.append(doc)
                waiting.append(found + end)
                count += len(found) // 4 + 1
                if count >= SEGMENT_IDS:
                    yield flush()
    if waiting:
        yield flush()


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode whole texts, each followed by END_ID, and write token files below `path` in ascending doc_id order.

    A range exchange deals the documents out by id, so each file holds one range and files follow one another by `shard`.
    A null or empty text is its END_ID alone; repeated rows are written each; null ids come first; other columns are left out.
    """
    import public_tokenizers

    source = tokenizer or public_tokenizers.path(TOKENIZER)
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInPandas(lambda it: _segments(it, source), SEGMENT_SCHEMA).write.parquet(path)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for s in batch.itertuples():
            ids = unpack(s.payload, s.block_starts).astype("<u4")
            starts = np.asarray(s.doc_starts, np.int64)
            stops = np.append(starts[1:], len(ids))
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            docs = pd.array([None if d is None or pd.isna(d) else int(d) for d in s.doc_ids], "Int64")
            yield pd.DataFrame({"shard": s.shard, "doc_id": docs, "start": starts + s.first_id, "n_tokens": stops - starts, "ids_crc32": sums})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, `start` (ids of all documents before it), n_tokens and the crc32 of its ids.

    Segments are decoded where they lie. The ids before each shard come from one row per shard, summed in shard order.
    """
    files = spark.read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    documents = files.mapInPandas(_documents, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return (documents.join(shards.select("shard", before.alias("before")), "shard")
            .select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the files (to a new shared folder unless `path` names one) and read the documents back from them."""
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "tokens")
    write(docs, path, tokenizer)
    return read(spark, path)
