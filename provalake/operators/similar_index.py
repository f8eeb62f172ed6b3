"""Approximate similar pairs: random hyperplanes cut the vectors into buckets, and only vectors that share a bucket are compared.

A vector's key in a band is on which side of each of the band's hyperplanes it lies. Two vectors at angle a agree on one hyperplane
with probability 1 - a / pi, so a pair at the threshold is found with a probability that follows from bits and bands; closer pairs
are likelier. Candidates are compared exactly where they meet, so no pair below the threshold is returned, and a pair is handed on only in the first band whose bucket it shares, so pairs
need no shuffle to be there once. A crowded bucket is cut into blocks and its work into pairs of blocks. Copies of a vector are one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.operators.vectors import TILE, distinct_vectors, matrix
from provalake.session import cut_lineage

#: Bands at most when a plan is chosen; rows of a block; hyperplanes are drawn from this seed.
MOST_BANDS, BLOCK_ROWS, SEED = 256, 16384, 20240601
#: When recall is measured: pairs that a task holds before it sorts them into lists, and the longest list.
HELD_PAIRS, LIST = 1 << 20, 512
#: Sending a vector to one more bucket costs about as much as that many comparisons; with fewer bands than this recall varies with the seed.
COPY_COST, LEAST_BANDS = 5000, 20


def hash_plan(threshold: float, recall: float = 0.95, most_bands: int = MOST_BANDS, rows: int | None = None) -> tuple[int, int]:
    """Bits and bands by which a pair at the threshold is found with probability `recall`: as many bits as the bands allow or, for a
    known number of rows, those that cost least. Each band is a copy of every vector on disk, each bit less doubles the comparisons."""
    agree = 1 - math.acos(threshold) / math.pi
    best, least = (1, 1), math.inf
    for bits in range(1, 63):
        hit = agree ** bits
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands > most_bands:
            break
        cost = 0 if rows is None or bands < LEAST_BANDS else bands * (COPY_COST + rows / 2 ** bits)
        if cost <= least:
            best, least = (bits, bands), cost or math.inf
    return best


def expected_recall(cosine: float, bits: int, bands: int) -> float:
    return 1 - (1 - (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits) ** bands


def _signed(batches: Iterator[pa.RecordBatch], bits: int, bands: int) -> Iterator[pa.RecordBatch]:
    """Adds on which sides of all hyperplanes a vector lies, a bit each."""
    planes = None
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            x = matrix(batch.column("embedding"))
            if planes is None:
                planes = np.random.default_rng(SEED).normal(size=(x.shape[1], bits * bands))
            sides = np.packbits(x @ planes > 0, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array([row.tobytes() for row in sides], pa.binary())],
                                             names=["id", "embedding", "sides"])


def _band_keys(sides: pa.Array, bits: int, bands: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(sides.to_pylist()), dtype=np.uint8).reshape(len(sides), -1)
    each = np.unpackbits(packed, axis=1, count=bits * bands).reshape(len(sides), bands, bits)
    kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.int64
    return each.astype(kind) @ (kind(1) << np.arange(bits, dtype=kind))


def _keys(batches: Iterator[pa.RecordBatch], bits: int, bands: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            key = _band_keys(batch.column("sides"), bits, bands).astype(np.int64)
            row = pa.array(np.repeat(np.arange(len(key)), bands))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(bands, dtype=np.int32), len(key))), pa.array(key.ravel()), batch.column("id").take(row)],
                                             names=["band", "key", "id"])


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a column, cut between its values: the last group of a batch waits for the next batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([*rest, batch])
        value = rows.column(column).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(value, value[-1]))
        if last:
            yield rows.slice(0, last)
        rest = [rows.slice(last)]
    yield from rest


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, bits: int, bands: int) -> Iterator[pa.RecordBatch]:
    """Similar pairs of each bucket (rows of side 0 with one another) or pair of blocks (side 0 with side 1) that share no earlier band."""
    for rows in whole_groups(batches, "work"):
        work, side, band, ids = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("work", "side", "band", "id"))
        cuts = np.append(np.flatnonzero(np.append(True, work[1:] != work[:-1])), len(work)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            right = a + np.flatnonzero(side[a:b])
            left = a + np.flatnonzero(side[a:b] == 0)
            across = len(right) > 0
            if not across:
                right = left
            if not len(left) or len(left) == 1 and not across:
                continue
            group = rows.slice(a, b - a)
            x, key = matrix(group.column("embedding")), _band_keys(group.column("sides"), bits, bands)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            some, others = max(1, TILE // len(right)), x[right - a].T
            for start in range(0, len(left), some):
                score = x[left[start:start + some] - a] @ others
                r, c = np.nonzero(score >= threshold)
                score = score[r, c]
                r = r + start
                keep = ids[left[r]] != ids[right[c]] if across else r < c
                for earlier in range(int(band[a])):
                    r, c, score = r[keep], c[keep], score[keep]
                    keep = key[left[r] - a, earlier] != key[right[c] - a, earlier]
                one, two, score = ids[left[r[keep]]], ids[right[c[keep]]], score[keep]
                if len(one):
                    turn, kind = one > two, rows.schema.field("id").type
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(turn, two, one), kind), pa.array(np.where(turn, one, two), kind), pa.array(score)],
                                                     names=["id_1", "id_2", "score"])


def hashed_pairs(vecs: DataFrame, threshold: float = 0.75, recall: float = 0.95, bits: int | None = None, bands: int | None = None,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (id_1 < id_2, score) of distinct vectors with cosine at or above `threshold`; a pair at the threshold is found with
    probability `recall`, unless bits and bands say otherwise. `copies` tells which ids a vector stands for.

    Every row goes to one bucket a band: as its id, its vector joins it where the bucket is compared. Null, empty and zero vectors are similar to nothing; all others have one dimension.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    id_type = vecs.schema["id"].dataType.simpleString()
    real = vecs.filter(F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    base = cut_lineage(distinct_vectors(real).select("id", "embedding"))
    planned = hash_plan(threshold, recall, rows=base.count())
    bits, bands = bits or planned[0], bands or planned[1]
    kind = vecs.schema["embedding"].dataType.simpleString()
    signed = cut_lineage(base.mapInArrow(lambda b: _signed(b, bits, bands), f"id {id_type}, embedding {kind}, sides binary"))
    keyed = signed.select("id", "sides").mapInArrow(lambda b: _keys(b, bits, bands), f"band int, key bigint, id {id_type}")
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / block_rows).cast("int")
    dealt = keyed.join(sizes, ["band", "key"]).withColumn("_k", blocks).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    first = F.transform(F.sequence(F.col("_b"), F.col("_k") - 1), lambda j: F.struct(F.col("_b").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    second = F.when(F.col("_b") > 0, F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda i: F.struct(i.alias("i"), F.col("_b").alias("j"), F.lit(1).alias("side"))))
    turns = F.concat(first, F.coalesce(second, F.array().cast("array<struct<i:int,j:int,side:int>>")))
    work = dealt.select("band", "key", "id", F.explode(turns).alias("t")).select(
        F.xxhash64("band", "key", "t.i", "t.j").alias("work"), "t.side", "band", "id").join(signed, "id").select("work", "side", "band", "id", "embedding", "sides")
    return work.repartition("work").sortWithinPartitions("work").mapInArrow(
        lambda b: _compare(b, threshold, bits, bands), f"id_1 {id_type}, id_2 {id_type}, score double")


def _lists(pairs: DataFrame, exact: bool) -> DataFrame:
    """Pairs as rows (id_1, others, exact): sorted lists take far less room on disk than pairs."""
    id_type = pairs.schema["id_1"].dataType.simpleString()

    def sort(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).sort_by([("id_1", "ascending"), ("id_2", "ascending")]).combine_chunks().to_batches(max_chunksize=HELD_PAIRS)
        for batch in rows:
            one = batch.column("id_1").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
            size = np.diff(np.append(at, len(one)))
            pieces = -(-size // LIST)
            first = np.repeat(at, pieces) + LIST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            others = pa.ListArray.from_arrays(pa.array(np.append(first, len(one)).astype(np.int32)), batch.column("id_2"))
            yield pa.RecordBatch.from_arrays([batch.column("id_1").take(pa.array(first)), others, pa.array(np.full(len(first), exact))], names=["id_1", "others", "exact"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_PAIRS:
                yield from sort(held)
                held = []
        if sum(b.num_rows for b in held):
            yield from sort(held)

    return pairs.select("id_1", "id_2").mapInArrow(work, f"id_1 {id_type}, others array<{id_type}>, exact boolean")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(3, dtype=np.int64)
    for rows in whole_groups((b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)), "id_1"):
        one, others = rows.column("id_1").to_numpy(zero_copy_only=False), rows.column("others")
        size = others.value_lengths().to_numpy()
        group = np.repeat(np.cumsum(np.append(False, one[1:] != one[:-1])), size)
        exact = np.repeat(rows.column("exact").to_numpy(zero_copy_only=False), size)
        two = np.unique(others.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.lexsort((two, group))
        group, two, exact = group[order], two[order], exact[order]
        at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (two[1:] != two[:-1])))
        is_exact, is_found = np.logical_or.reduceat(exact, at), np.logical_or.reduceat(~exact, at)
        total += [is_exact.sum(), (is_exact & is_found).sum(), (~is_exact).sum()]
    yield pa.RecordBatch.from_arrays([pa.array([n]) for n in total], names=["exact", "found", "wrong"])


def measured_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: `exact` pairs, how many of them were `found`, and the `wrong` ones found besides (none, if all is well)."""
    both = _lists(exact, True).unionByName(_lists(found, False))
    counts = both.repartition("id_1").sortWithinPartitions("id_1").mapInArrow(_counted, "exact bigint, found bigint, wrong bigint")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("exact", "found", "wrong")])
