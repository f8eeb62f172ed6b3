"""Collocations of two and three words, from phrase counts that a multikey three-way quicksort of suffix pointers gives.

Every word opens a suffix: itself and the words after it in its piece, DEPTH at most. A task codes the words of a slice of
text, sorts its suffixes and adds up equal ones. They are routed by their language and two leading words (a single word's
count by that word alone), so all suffixes with the same beginning meet, however common the first word is. There the pointers are
sorted by a three-way quicksort, one word at a time: the equal partition goes on to the next word, and its size, the sum of its
suffixes' counts, is the count of the phrase so far. Partitions that can't reach the least count are abandoned at once. All
partitions of a round are split side by side in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provalake.llm.common import mix64, stored, text_slices

DEPTH, LEAST, TOP = 3, 10, 2000
#: A longer candidate that has this share (in per cent) of a candidate's occurrences takes its place.
SHARE = 50
#: Bytes of text that are parsed at once, words that are coded at once, and routes for each shuffle partition.
CHUNK, SLICE, ROUTES = 4_000_000, 1_000_000, 4
NO_LANG = "und"
# The bytes that end a piece, and what stands for them (no UTF-8 text has that byte).
ENDS, MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t" + ENDS, bytes(range(97, 123)) + b" " + MARK * len(ENDS))
ROUTED = "route int, lang string, rows int, words binary, first binary, second binary, third binary, n binary"


class _Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def parsed(texts: list[str]) -> list[bytes]:
    """The words of all texts in lower case, with MARK between pieces and texts."""
    data = MARK.join(t.encode() for t in texts).translate(_TABLE)
    return data.replace(MARK, b" " + MARK + b" ").split()


def _small(x: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64)


def suffixes(words: list[bytes], n_routes: int, lang: str) -> Iterator[tuple]:
    """Rows of ROUTED. Code 0 ends a suffix; rows (first, 0, 0) count single words, the others have two words at least."""
    for a in range(0, len(words), SLICE):
        part = words[a:a + SLICE + DEPTH - 1]
        codes = _Codes({MARK: 0})
        code = np.fromiter(map(codes.__getitem__, part), np.int64, len(part))
        more = np.append(code, np.zeros(2, np.int64))
        first = code[:SLICE]
        second = more[1:1 + len(first)]
        third = np.where(second > 0, more[2:2 + len(first)], 0)
        places = np.flatnonzero((first > 0) & (second > 0))
        key, n = np.unique(first[places] << 42 | second[places] << 21 | third[places], return_counts=True)
        single = np.bincount(first, minlength=len(codes))
        single[0] = 0
        alone = np.flatnonzero(single)
        rows = np.stack([np.concatenate([key >> 42, alone]), np.concatenate([key >> 21 & 0x1FFFFF, np.zeros_like(alone)]), np.concatenate([key & 0x1FFFFF, np.zeros_like(alone)])])
        n = np.concatenate([n, single[alone]])
        names = list(codes)
        hashed = np.array([0, *map(xxhash.xxh3_64_intdigest, names[1:])], np.uint64)
        route = mix64(mix64(hashed[rows[0]] + np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) ^ hashed[rows[1]]) % np.uint64(n_routes)
        order = np.argsort(route, kind="stable")
        rows, n, route = rows[:, order], n[order], route[order].astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(route, prepend=-1)), len(route))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            used, local = np.unique(np.concatenate([[0], rows[:, x:y].ravel()]), return_inverse=True)
            local = local[1:].reshape(3, -1)
            yield int(route[x]), lang, y - x, b" ".join([names[k] for k in used[1:].tolist()]), _small(local[0]), _small(local[1]), _small(local[2]), _small(n[x:y])


def equal_partitions(keys: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, a row, and total weight of each group of rows with equal first symbols that weighs `least` or more.

    `keys` has a row for each suffix; symbol 0 ends it. Each round splits every open partition in three around the median of
    its first, middle and last symbol; the equal part moves on to the next symbol.
    """
    order, part, depth = np.arange(len(keys)), np.zeros(len(keys), np.int64), np.zeros(1, np.int64)
    found: list[tuple] = []
    while len(order):
        symbol = keys[order, depth[part]]
        size = np.bincount(part)
        begin = np.cumsum(size) - size
        pivot = np.sort(np.stack([symbol[begin], symbol[begin + size // 2], symbol[begin + size - 1]]), 0)[1]
        side = part * 3 + 1 + np.sign(symbol - pivot[part])
        moved = np.argsort(side, kind="stable")
        order, side = order[moved], side[moved]
        edge = np.flatnonzero(np.diff(side, prepend=-1))
        total = np.add.reduceat(weight[order], edge)
        equal, old = side[edge] % 3 == 1, side[edge] // 3
        deeper = depth[old] + equal
        keep = total >= least
        hit = equal & keep
        found.append((deeper[hit], order[edge[hit]], total[hit]))
        keep &= (deeper < keys.shape[1]) & ~(equal & (pivot[old] == 0))
        sizes = np.diff(np.append(edge, len(order)))
        order, part, depth = order[np.repeat(keep, sizes)], np.repeat(np.arange(int(keep.sum())), sizes[keep]), deeper[keep]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _route(batches: Iterator[pa.RecordBatch], n_routes: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 5)
    names = [c.split()[0] for c in ROUTED.split(", ")]
    for batch in batches:
        for part in text_slices(batch, CHUNK):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                rows = list(suffixes(parsed(texts), n_routes, lang))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _counted(rows: list[tuple], least: int) -> list[tuple]:
    """(words of the phrase, count) of the frequent phrases among routed rows of one language, and (None, count) of all words."""
    codes = _Codes({b"": 0})
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for _, _, n, words, *packed in rows:
        own = np.fromiter(map(codes.__getitem__, [b"", *words.split(b" ")]), np.int64)
        for column, data in zip(columns, packed[:3]):
            column.append(own[_large(data, n)])
        columns[3].append(_large(packed[3], n))
    keys, weight = np.stack([np.concatenate(c) for c in columns[:3]], 1), np.concatenate(columns[3])
    depth, row, total = equal_partitions(keys, weight, least)
    names = [w.decode() for w in codes]
    out: list[tuple] = [(None, None, None, int(weight[keys[:, 1] == 0].sum()))]
    for d, (a, b, c), n in zip(depth.tolist(), keys[row].tolist(), total.tolist(), strict=True):
        if d == 2:
            out.append((names[a], names[b] if b else None, None, n))
        elif d == 3 and c:
            out.append((names[a], names[b], names[c], n))
    return out


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts of one route after the other; rows come by route and language."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for (_, lang), group in groupby(rows, key=lambda r: r[:2]):
        found = _counted(list(group), least)
        columns = [[lang] * len(found), *zip(*found, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 4 + (pa.int64(),), strict=True)], names=["lang", "w1", "w2", "w3", "n"])


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, w1, w2, w3 (null after the phrase's end) and n of all phrases of up to three words found `least` times or more in a
    language. Rows without words hold counts of all words; they add up to the language's total."""
    n_routes = ROUTES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col("lang"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    routed = texts.mapInArrow(lambda b: _route(b, n_routes), ROUTED).repartition("route").sortWithinPartitions("route", "lang")
    return routed.mapInArrow(lambda b: _count(b, least), "lang string, w1 string, w2 string, w3 string, n long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10^16."""
    wide = [x.cast("decimal(16,0)") for x in (a, a, left, right)]
    return F.call_function("div", (wide[0] * wide[1]).cast("decimal(32,0)") * F.lit(1000000).cast("decimal(7,0)"), wide[2] * wide[3])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's `top` phrases of two or three words: lang, rank, phrase, a (its count), l and r (the counts of its parts),
    n (all words of the language) and score.

    A-Z are lower-cased; `[.,;:!?]` and line ends end a piece; phrases don't cross pieces or documents. A null text is empty, a
    null lang is `und`; rows with the same doc_id or text count each; other columns are left out. No phrase, no row.
    """
    counts = stored(phrase_counts(docs, least), "phrases")
    total = counts.where("w1 is null").groupBy("lang").agg(F.sum("n").alias("n"))
    counts = counts.where("w1 is not null")
    one = counts.where("w2 is null").select("lang", "w1", "n")
    two = counts.where("w2 is not null and w3 is null").select("lang", "w1", "w2", F.col("n").alias("a"))
    three = counts.where("w3 is not null").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))

    def word(name: str, count: str) -> DataFrame:
        return one.select("lang", F.col("w1").alias(name), F.col("n").alias(count))

    def pair(x: str, y: str, count: str) -> DataFrame:
        return two.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(count))

    parts = F.array(F.struct(F.col("w1").alias("x"), F.col("w2").alias("y")), F.struct(F.col("w2").alias("x"), F.col("w3").alias("y")))
    longer = (three.select("lang", "a", F.explode(parts).alias("p")).groupBy("lang", F.col("p.x").alias("w1"), F.col("p.y").alias("w2"))
              .agg(F.max("a").alias("longer")))
    pairs = (two.join(longer, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < SHARE * F.col("a")))
             .join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
             .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score")))
    triples = (three.join(word("w1", "l1"), ["lang", "w1"]).join(word("w3", "r2"), ["lang", "w3"])
               .join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"])
               .withColumn("s1", _score(F.col("a"), F.col("l1"), F.col("r1"))).withColumn("s2", _score(F.col("a"), F.col("l2"), F.col("r2"))))
    later = F.col("s2") < F.col("s1")
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                             F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = pairs.unionByName(triples).withColumn("rank", place).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
