"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Documents with the same set of shingles are one set from the start, so copies never meet as pairs. Each distinct set gets
one signature: its hashed shingles fall into BINS bins, the least of a bin is its value, and an empty bin borrows from a bin
that a fixed random sequence of probes finds. Sets that agree in a band of ROWS values share a bucket. A bucket of any size
proposes a star, every member with one centre, and never all pairs. Links are confirmed on the full sets. Sets whose buckets still
hold several components after that go on to finer buckets of three bands each: one more star, then the pairs that are left.

A node of the graph is a document, known by its doc_id. Where rows share a doc_id but not their shingles, each of their sets is a
node of its own, with a number past all doc_ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provalake.llm.common import mix64, stored, text_slices, texts
from provalake.llm.graph import components

#: Words of a shingle as the query has it and as a filtering stage has it; per cent of similarity.
SHINGLE, STAGE_SHINGLE, PERCENT = 4, 5, 80
BINS, ROWS = 128, 4
#: A finer bucket needs band i and the two bands so many further on.
STEPS = ((1, 5), (2, 9), (3, 13), (4, 11), (6, 7))
PROBES = 512
#: Length of the bitmaps that rule out pairs before their sets are compared, in 64-bit words.
WORDS_OF_BITS = 16
#: Word hashes that a task keeps; bytes of text that are shingled at once.
MOST_WORDS, CHUNK = 300_000, 1_000_000
#: Parts into which the rows of one shingle set are dealt.
SALTS = 16
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased. Fewer words make one shingle; none, none."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    length = min(size, n)
    total = np.full(n - length + 1, length, np.uint64)
    for j in range(length):
        total = total * _BASE + mix64(h[j:n - length + 1 + j])
    return np.unique(mix64(total))


def _probes() -> np.ndarray:
    """Row e: the bins that an empty bin e asks, one after the other; at last all of them in turn."""
    bins = np.arange(BINS, dtype=np.uint64)[:, None]
    tries = np.arange(PROBES, dtype=np.uint64)[None, :]
    random = mix64(mix64(bins + np.uint64(1)) ^ (tries + np.uint64(1) << np.uint64(32))) % np.uint64(BINS)
    return np.concatenate([random, (bins + np.arange(BINS, dtype=np.uint64)[None, :]) % np.uint64(BINS)], 1).astype(np.int64)


def signature(shingles: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """One value per bin of a set that isn't empty."""
    ordered = np.sort(mix64(shingles ^ np.uint64(0xA5A5A5A5)))
    bins = (ordered >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    out[bins[first]] = ordered[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        asked = probes[empty]
        out[empty] = out[asked[np.arange(len(empty)), full[asked].argmax(1)]]
    return out


def band_keys(sign: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key of each band."""
    values = sign.reshape(-1, ROWS)
    key = mix64(np.arange(len(values), dtype=np.uint64))
    for j in range(ROWS):
        key = mix64(key * _BASE + values[:, j])
    return key.view(np.int64)


def _shingled(part: pa.RecordBatch, hashes: dict, size: int) -> list[np.ndarray]:
    if len(hashes) > MOST_WORDS:
        hashes.clear()
    return [shingle_hashes(t, hashes, size) for t in part.column("text").to_pylist()]


def _digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes, probes = _WordHashes(), _probes()
    none = np.zeros(0, np.int64)
    for batch in batches:
        for part in text_slices(batch, CHUNK):
            found = _shingled(part, hashes, size)
            keys = [band_keys(signature(s, probes)) if len(s) else none for s in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("hash"), pa.array([len(s) for s in found], pa.int64()), pa.array([_digest(s) for s in found], pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "hash", "n_shingles", "digest", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Shingles and bitmaps of the wanted sets: each row has the digests that are wanted of its doc_id, and their nodes."""
    hashes = _WordHashes()
    for batch in batches:
        for part in text_slices(batch, CHUNK):
            rows = []
            for s, wanted in zip(_shingled(part, hashes, size), part.column("wanted").to_pylist(), strict=True):
                digest = _digest(s)
                rows += [(w["id"], s.view(np.int64), bitmap(s)) for w in wanted if w["digest"] == digest]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "shingles", "bits"])


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, `hash` of the text, n_shingles, digest of the shingle set (null if empty) and the bucket keys of its bands."""
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(lambda b: _sketch(b, size), "doc_id long, hash long, n_shingles long, digest binary, keys array<long>")


def with_nodes(sketched: DataFrame) -> DataFrame:
    """`id`, the node of each row: its doc_id, or a number past all doc_ids where a doc_id has several shingle sets."""
    several = (sketched.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
               .agg(F.min(F.xxhash64("digest")).alias("a"), F.max(F.xxhash64("digest")).alias("b")).where("a <> b").select("doc_id"))
    last = sketched.agg(F.max("doc_id")).first()[0] or 0
    own = sketched.join(several, "doc_id", "left_semi").where(F.col("digest").isNotNull()).select("doc_id", "digest").distinct()
    own = stored(own.withColumn("own", F.lit(max(last, 0) + 1) + F.monotonically_increasing_id()), "nodes")
    return sketched.join(own, ["doc_id", "digest"], "left").withColumn("id", F.coalesce("own", "doc_id")).drop("own")


def with_representative(rows: DataFrame) -> DataFrame:
    """`rep`, the smallest node with the same shingle set. Only sets that several nodes have are joined back, in SALTS parts."""
    known = rows.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    shared = known.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
    return salted.join(shared, ["digest", "salt"], "left").withColumn("rep", F.coalesce("least", "id")).drop("least", "salt")


def _confirm(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    joined = edges.join(b, "b").join(a, "a").select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("both"))
    return joined.where(100 * F.col("common") >= PERCENT * (F.col("both") - F.col("common"))).select("a", "b")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Which of 64 * WORDS_OF_BITS places the shingles fall on, as signed 64-bit integers."""
    out = np.zeros(64 * WORDS_OF_BITS, np.uint8)
    out[(shingles % np.uint64(len(out))).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view("<i8")


def _near(x: str, y: str) -> Column:
    """Can two sets (structs of n and, once known, bits) be similar? Each place that only one of the bitmaps has is a shingle, or
    more, that the sets don't share, so this never turns a link away."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    unshared = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(1, WORDS_OF_BITS)),
                   F.bit_count(F.col(f"{x}.bits")[0].bitwiseXOR(F.col(f"{y}.bits")[0])))
    sizes = 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)
    return sizes & ((100 + PERCENT) * F.coalesce(unshared, F.lit(0)) <= (100 - PERCENT) * (n + m))


def _pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _star_pairs(members: DataFrame) -> DataFrame:
    """Each member with its bucket's centre, unless they are in one component or their sizes differ too much.

    The centre has the least hash of its id, so sets that share many buckets mostly meet the same one and pairs stay few.
    """
    x = members.select("key", F.struct("id", "n", "bits", "component").alias("x"))
    centres = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "n", "bits", "component")).alias("y"))
    pairs = x.join(centres, "key").where((F.col("x.component") != F.col("y.component")) & _near("x", "y"))
    return pairs.select(*_pair(F.col("x.id"), F.col("y.id"))).distinct()


def _rest_pairs(members: DataFrame) -> DataFrame:
    """All pairs that a bucket leaves open: those of different components. The members of the bucket's largest component
    meet only the others, never one another."""
    largest = members.groupBy("key", "component").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    x = members.join(largest, "key").where(F.col("component") != F.col("main")).select("key", "main", F.struct("id", "n", "bits", "component").alias("x"))
    y = members.select("key", F.struct("id", "n", "bits", "component").alias("y"))
    once = (F.col("y.component") == F.col("main")) | (F.col("x.id") < F.col("y.id"))
    return x.join(y, "key").where((F.col("x.component") != F.col("y.component")) & once & _near("x", "y")).select(*_pair(F.col("x.id"), F.col("y.id"))).distinct()


def _crowded(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    keys = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return members.join(keys, "key", "left_semi")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    return members.drop("component").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _components_of(docs: DataFrame, size: int) -> DataFrame:
    """Each row's doc_id, hash, n_shingles, digest, `node` and `component`: the smallest node it is tied to, itself included; and
    `component_id`, the smallest doc_id among those."""
    sketched = stored(with_nodes(stored(sketches(docs, size), "sketches")), "nodes")
    rows = stored(with_representative(sketched.select("doc_id", "hash", "n_shingles", "digest", "id")), "sets")
    linked = components(_links(docs, sketched, rows, size))
    out = rows.join(linked.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = out.where(F.col("id") != F.col("doc_id")).groupBy("component").agg(F.min("doc_id").alias("least"))
    out = out.join(several, "component", "left").withColumn("component_id", F.least("component", "least"))
    return out.select("doc_id", "hash", "n_shingles", "digest", F.col("id").alias("node"), "component", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (is it that one?).

    Null and empty texts have no shingles and are linked with nothing; a null doc_id neither: its component is null and it is
    kept. Repeated rows give repeated result rows; rows that share a doc_id but not their shingles are linked each by its own.
    Texts of any length are read whole; other columns are left out. `size` is the number of words in a shingle.
    """
    return _components_of(docs, size).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(docs: DataFrame, sketched: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Confirmed links between representatives, enough of them to tie every component together.

    One star for each bucket comes first. Sets in buckets that still hold several components go on to finer buckets, of three
    bands each; there one more star, and then whatever pairs are left between different components.
    """
    own = rows.where((F.col("id") == F.col("rep")) & (F.col("n_shingles") > 0)).select("id").distinct()
    first = sketched.where("n_shingles > 0").select("id", "n_shingles", "keys").join(own, "id", "left_semi")
    columns = "id", F.col("n_shingles").cast("int").alias("n"), F.col("id").alias("component"), F.lit(None).cast("array<long>").alias("bits")
    members = stored(_crowded(first.select(F.explode("keys").alias("key"), *columns)), "buckets")
    wanted = rows.select("doc_id", "digest", "id").join(members.select("id").distinct(), "id", "left_semi").groupBy("doc_id").agg(
        F.collect_set(F.struct("digest", "id")).alias("wanted"))
    sets = stored(texts(docs).join(wanted, "doc_id").select("text", "wanted").mapInArrow(lambda b: _sets(b, size), "id long, shingles array<long>, bits array<long>")
                  .dropDuplicates(["id"]), "shingles")
    links = stored(_confirm(stored(_star_pairs(members), "pairs"), sets), "links")
    open_ids = stored(_crowded(_labelled(members, links)).select("id").distinct(), "open")
    bands = BINS // ROWS
    finer = F.array(*[F.struct(*(F.lit(x).alias(n) for n, x in zip("abcd", (bands * k + i, i, (i + s) % bands, (i + t) % bands), strict=True)))
                      for k, (s, t) in enumerate(STEPS) for i in range(bands)])
    key = F.xxhash64(F.col("step.a"), *(F.get("keys", F.col(f"step.{x}")) for x in "bcd"))
    again = first.join(open_ids, "id", "left_semi").select("*", F.explode(finer).alias("step")).select(key.alias("key"), *columns)
    again = _crowded(_labelled(again.drop("bits"), links)).join(sets.select("id", "bits"), "id")
    again = stored(again, "buckets")
    links = stored(links.unionByName(_confirm(stored(_star_pairs(again), "pairs"), sets)), "links")
    rest = _rest_pairs(_crowded(_labelled(again, links)))
    return links.unionByName(_confirm(stored(rest, "pairs"), sets))


def keep_one_of_each(docs: DataFrame, size: int = STAGE_SHINGLE) -> DataFrame:
    """The rows of `docs`, with all their columns, that stand for their component: the one with the least doc_id and, of rows with
    that id, the least hash of its text. Rows that are equal in both stay once (the one with the least hash of all columns).
    Rows without shingles stay, rows without a doc_id too."""
    found = _components_of(docs, size).where(F.col("doc_id").isNotNull())
    some = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "hash")).alias("one")).select("one.*")
    none = found.where("n_shingles = 0").select("doc_id", "hash")
    kept = some.unionByName(none).distinct()
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    keyed = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"), row.alias("row"))
    known = keyed.join(kept, ["doc_id", "hash"], "left_semi").groupBy("doc_id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    known = known.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
    return known.unionByName(docs.where(F.col("doc_id").isNull()))
