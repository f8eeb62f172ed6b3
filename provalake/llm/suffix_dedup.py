"""Exact repeats of long byte strings across all documents, found by suffix grouping, and removed but for their first place.

Every window of LENGTH bytes chooses an anchor, its KEY bytes of least hash (the leftmost of equals), so equal windows choose
equal anchors at equal places. Anchors that occur once are dropped first. The windows of one document that choose one anchor
form a context, the bytes from the first window's start to the last one's end; equal contexts are counted once, under their
first place. The contexts of one anchor are then put in suffix order: groups of suffixes with the same Lyndon prefix are made
in descending order over pointers to the previous smaller suffix, and each group's order is emitted without renaming. In that
order equal windows are neighbours, and all but the one that starts first are removed. Anchors with more than MOST_CONTEXTS
different contexts are dealt into parts that are put in order one by one; the windows that are first in their part then go one
by one through a distributed aggregate over the parts, so no anchor is gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.llm.common import groups_by_size, stored, text_slices

LENGTH, KEY = 100, 32
#: Contexts of one anchor that are put in order whole (a larger one's parts have half as many); bytes that are put in order at once.
MOST_CONTEXTS, BUNDLE = 16, 1 << 20
#: Bytes of text that are looked at together.
CHUNK = 4_000_000
#: Rows without a doc_id come after all others.
LAST_ID = (1 << 63) - 1
_PLACE = np.uint64((1 << 31) - 1)
# Fixed odd multipliers of the anchor hash, one for each 8 bytes of the key.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at `start`, one range after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def lyndon_groups(data: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the rank at which the group of its longest Lyndon prefix begins, and the previous smaller suffix.

    Many texts go side by side: text t has the bytes, suffixes and ranks from base[t] on; len(data) stands for no suffix.
    Groups start as first bytes. In each text the highest group that is left is taken: each of its suffixes finds its previous
    smaller suffix over the pointers known so far. Suffixes that equally many members point to have grown by the same Lyndon
    word, and move to a new group right above their old one.
    """
    n = len(data)
    symbol = np.repeat(np.arange(len(base)), size) << 8 | data
    order = np.argsort(symbol, kind="stable")
    edge = np.flatnonzero(np.diff(symbol[order], prepend=-1))
    group, place, last = np.full(n + 1, -1), np.empty(n, np.int64), np.zeros(n + 1, np.int64)
    place[order] = np.arange(n)
    group[order] = np.repeat(edge, np.diff(np.append(edge, n)))
    last[edge] = np.append(edge[1:], n)
    before = np.arange(-1, n)
    before[base] = n
    moving = np.zeros(n + 1, bool)
    base, stop = base[size > 0], (base + size)[size > 0]
    while len(stop):
        start = group[order[stop - 1]]
        width = stop - start
        members, floor = order[_spread(start, width)], np.repeat(start, width)
        stop = start[start > base]
        base = base[start > base]
        while True:
            p = before[members]
            over = group[p] >= floor
            if not over.any():
                break
            before[members[over]] = before[p[over]]
        grown, times = np.unique(p, return_counts=True)
        if grown[-1] == n:
            grown, times = grown[:-1], times[:-1]
        if not len(grown):
            continue
        old = group[grown]
        by = np.lexsort((times, old))
        grown, times, old = grown[by], times[by], old[by]
        first = np.flatnonzero(np.diff(old, prepend=-1))
        many = np.diff(np.append(first, len(old)))
        first_to = last[old[first]] - many
        to = _spread(first_to, many)
        left, was = order[to], place[grown]
        moving[grown] = True
        out = left[~moving[left]]
        moving[grown] = False
        free = was[was < np.repeat(first_to, many)]
        order[free], place[out] = out, free
        order[to], place[grown] = grown, to
        fresh = np.flatnonzero((np.diff(old, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
        count = np.diff(np.append(fresh, len(old)))
        last[old[first]] = first_to
        last[to[fresh]] = to[fresh] + count
        group[grown] = np.repeat(to[fresh], count)
    return group, before


def suffix_orders(texts: list[bytes]) -> np.ndarray:
    """The suffixes of each text in ascending order, one text after the other; suffixes are numbered through all texts.

    Each suffix that is in place brings the suffixes whose Lyndon prefix ends before it to the next free place of their groups;
    they follow one another along the pointers.
    """
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(size) - size
    n = len(data)
    group, before = lyndon_groups(data, base, size)
    free, out, done = np.arange(n), np.empty(n, np.int64), np.zeros(n + 1, bool)
    done[n] = True
    longest = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[longest], -np.arange(int(size.max(initial=0)) + 1), "left")  # texts longer than each rank
    base, end = base[longest], (base + size)[longest]
    j = (end - 1)[:int((size > 0).sum())]
    for rank in range(int(size.max(initial=0)) + 1):
        while len(j):
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
            j = j[~done[j]]
        now = out[base[:live[rank]] + rank]
        j = now[now > base[:len(now)]] - 1
        j = j[~done[j]]
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and one past the last window start of each context of a text (its bytes), and the hash of its anchor."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none
    m, width = n - KEY + 1, LENGTH - KEY + 1
    words = np.ndarray((n - 7,), "<u8", buffer=data, strides=(1,))
    h = words[:m] * _ODD[0]
    for k in range(1, KEY // 8):
        h += words[8 * k:8 * k + m] * _ODD[k]
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    h ^= h >> np.uint64(29)
    rows = -(-m // width)
    keys = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    keys[:m] = h & ~_PLACE | np.arange(m, dtype=np.uint64)
    blocks = keys.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    least = (np.minimum(behind[:n - LENGTH + 1], ahead[width - 1:m]) & _PLACE).astype(np.int64)
    start = np.flatnonzero(np.diff(least, prepend=-1))
    return start, np.append(start[1:], len(least)), h[least[start]].view(np.int64)


def repeated_windows(groups: list[list[bytes]], ranks: list[int]) -> list[np.ndarray]:
    """For each context of all groups the offsets of its windows that a context of smaller rank has too. Ranks order the contexts'
    first places. The contexts of an anchor are one group; windows of different anchors differ."""
    contexts = [c for g in groups for c in g]
    texts = [b"\n".join([*g, b""]) for g in groups]
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    windows_of = size - LENGTH + 1
    owner = np.full(int((size + 1).sum()), -1, np.int64)
    owner[_spread(begin, windows_of)] = np.repeat(np.arange(len(contexts)), windows_of)
    order = suffix_orders(texts)
    order = order[owner[order] >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(texts), np.uint8), LENGTH)
    same = np.zeros(len(order), bool)
    for k in range(1, len(order), 4096):
        these = order[k:k + 4096]
        same[k:k + 4096] = (windows[these] == windows[order[k - 1:k - 1 + len(these)]]).all(1)
    runs = np.flatnonzero(~same)
    rank = np.asarray(ranks, np.int64)[owner[order]]
    least = np.repeat(np.minimum.reduceat(rank, runs), np.diff(np.append(runs, len(order))))
    hit = np.sort(order[rank > least])
    cuts = np.searchsorted(owner[hit], np.arange(len(contexts) + 1)).tolist()
    return [hit[a:b] - begin[k] for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, its sort key, a hash that orders rows of one doc_id, and the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    return docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _bytes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for t in batch.column("text").cast(pa.binary()):
        yield np.frombuffer(t.as_buffer(), np.uint8)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different anchors of each document and how often it has them."""
    for batch in (part for whole in batches for part in text_slices(whole, CHUNK)):
        found = [np.unique(anchors(d)[2], return_counts=True) for d in _bytes(batch)]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(k) for k, _ in found]))
        keys, counts = (pa.array(np.concatenate([*x, np.zeros(0, np.int64)])) for x in (([f[k] for f in found]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([keys, counts, batch.column("doc").take(rows), batch.column("hash").take(rows)], names=["anchor", "n", "doc", "hash"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different contexts of a text's repeated anchors, each at its first place in the text."""
    for batch in (part for whole in batches for part in text_slices(whole, CHUNK)):
        out: list[tuple] = []
        for data, doc, hash_, repeated in zip(_bytes(batch), batch.column("doc").to_pylist(), batch.column("hash").to_pylist(), batch.column("anchors"), strict=True):
            start, stop, key = anchors(data)
            seen = set()
            for k in np.flatnonzero(np.isin(key, repeated.values.to_numpy())).tolist():
                context = data[start[k]:stop[k] + LENGTH - 1].tobytes()
                if context not in seen:
                    seen.add(context)
                    out.append((int(key[k]), context, doc, hash_, int(start[k])))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                                         names=["anchor", "context", "doc", "hash", "start"])


def _removed(groups: list[list[tuple]]) -> list[tuple]:
    """Offsets of removed windows of the contexts of many anchors; texts of like size are put in order together."""
    out: list[tuple] = []
    groups = sorted(groups, key=lambda g: sum(len(r[1]) for r in g))
    for a, b in groups_by_size([sum(len(r[1]) for r in g) for g in groups], BUNDLE):
        rows = [r for g in groups[a:b] for r in g]
        ranks = np.empty(len(rows), np.int64)
        ranks[sorted(range(len(rows)), key=lambda k: rows[k][2:])] = np.arange(len(rows))
        found = repeated_windows([[r[1] for r in g] for g in groups[a:b]], ranks)
        out += [(r[2], r[3], r[4], f.astype("<i4").tobytes() if len(f) else None) for r, f in zip(rows, found, strict=True)]
    return out


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offsets of removed windows of each context, from rows that come by anchor. Alone, a context has no repeats."""
    names = ["doc", "hash", "start", "removed"]
    waiting: list[list[tuple]] = []
    size = 0

    def table() -> pa.RecordBatch:
        columns = list(zip(*_removed(waiting), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=names)

    for rows in _whole_anchors(batches):
        anchor = rows.column("anchor").to_numpy()
        edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        many = np.diff(np.append(edge, rows.num_rows))
        alone = rows.take(pa.array(edge[many == 1]))
        if alone.num_rows:
            yield pa.RecordBatch.from_arrays([*(alone.column(c) for c in names[:3]), pa.nulls(alone.num_rows, pa.binary())], names=names)
        for a, n in zip(edge[many > 1].tolist(), many[many > 1].tolist(), strict=True):
            group = list(zip(*(c.to_pylist() for c in rows.slice(a, n).columns), strict=True))
            waiting.append(group)
            size += sum(len(r[1]) for r in group)
            if size >= 4 * BUNDLE:
                yield table()
                waiting, size = [], 0
    if waiting:
        yield table()


def _whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows cut between anchors: the last anchor of a batch waits for the next one. There are MOST_CONTEXTS of it at most."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([*rest, batch])
        anchor = rows.column("anchor").to_numpy()
        last = int(np.searchsorted(anchor == anchor[-1], True))
        if last:
            yield rows.slice(0, last)
        rest = [rows.slice(last)]
    yield from rest


def _first_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of the windows that are not removed yet."""
    for batch in batches:
        contexts = batch.column("context").to_pylist()
        offsets = []
        for c, removed in zip(contexts, batch.column("removed").to_pylist(), strict=True):
            left = np.ones(len(c) - LENGTH + 1, bool)
            if removed is not None:
                left[np.frombuffer(removed, "<i4")] = False
            offsets.append(np.flatnonzero(left).astype(np.int32))
        rows = pa.array(np.repeat(np.arange(len(contexts)), [len(o) for o in offsets]))
        digests = [xxhash.xxh3_128_digest(c[k:k + LENGTH]) for c, o in zip(contexts, offsets, strict=True) for k in o.tolist()]
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), *(batch.column(c).take(rows) for c in ("doc", "hash", "start")),
             pa.array(np.concatenate(offsets or [np.zeros(0, np.int32)]))], names=["w1", "w2", "doc", "hash", "start", "offset"])


def _judged_across(contexts: DataFrame) -> DataFrame:
    """Offsets of windows that start earlier in another part of their anchor."""
    windows = contexts.mapInArrow(_first_windows, "w1 long, w2 long, doc long, hash long, start int, offset int")
    place = F.struct("doc", "hash", "start")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = windows.join(first, ["w1", "w2"]).where(place != F.col("first")).select("doc", "hash", "start", "offset")
    return late.groupBy("doc", "hash", "start").agg(F.collect_set("offset").alias("offsets"))


def _repeated_anchors(docs: DataFrame) -> DataFrame:
    """`anchors` of each document (doc, hash) that occur twice or more."""
    rows = _keyed(docs).select("doc", "hash", "text")
    places = stored(rows.mapInArrow(_anchor_rows, "anchor long, n long, doc long, hash long"), "anchors")
    repeated = places.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    found = places.select("anchor", "doc", "hash").join(repeated, "anchor").groupBy("doc", "hash").agg(F.collect_set("anchor").alias("anchors"))
    return stored(found, "repeated")


def _different_contexts(docs: DataFrame, at: DataFrame) -> DataFrame:
    """Each different context of a repeated anchor with its first place."""
    found = _keyed(docs).select("doc", "hash", "text").join(at, ["doc", "hash"]).mapInArrow(
        _contexts, "anchor long, context binary, doc long, hash long, start int")
    first = found.groupBy("anchor", "context").agg(F.min(F.struct("doc", "hash", "start")).alias("first"))
    return stored(first.select("anchor", "context", "first.*"), "contexts")


def _judged_contexts(contexts: DataFrame) -> DataFrame:
    """`firsts` of each document: start and removed windows of the contexts that have their first place in it."""
    large = stored(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MOST_CONTEXTS), "large")
    part = F.pmod(F.xxhash64("doc", "hash", "start"), F.ceil(2 * F.col("n") / MOST_CONTEXTS))
    group = F.when(F.col("n").isNull(), F.col("anchor")).otherwise(F.xxhash64("anchor", part))
    dealt = contexts.join(large, "anchor", "left").select(group.alias("anchor"), "context", "doc", "hash", "start")
    columns = ["doc", "hash", "start"]
    judged = stored(dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_judged, "doc long, hash long, start int, removed binary"), "judged")
    crowded = contexts.join(large.select("anchor"), "anchor", "left_semi").join(judged, columns)
    late = _judged_across(crowded).withColumn("removed", F.lit(None).cast("binary"))
    both = judged.withColumn("offsets", F.lit(None).cast("array<int>")).unionByName(late)
    return stored(both.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "removed", "offsets")).alias("firsts")), "firsts")


def removed_windows(docs: DataFrame) -> DataFrame:
    """`doc`, `hash` (a document's key), its repeated `anchors`, and `firsts`: the contexts that have their first place in it,
    by start, with the offsets of windows that start earlier elsewhere. All other contexts of those anchors are repeats.

    Each step is a stored table, and only these are held, so that Spark can drop the shuffle files of the steps before.
    """
    at = _repeated_anchors(docs)
    return at.join(_judged_contexts(_different_contexts(docs, at)), ["doc", "hash"], "left")


def cut(data: np.ndarray, repeated: np.ndarray, own: np.ndarray, offsets: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Which bytes of a text go: the windows of repeated anchors, but for the contexts that have their first place here (`own`,
    by start), of which only the windows at `offsets` go."""
    start, stop, key = anchors(data)
    change = np.zeros(len(data) + 1, np.int64)
    again = np.isin(key, repeated) & ~np.isin(start, own)
    change[start[again]] += 1
    change[stop[again] + LENGTH - 1] -= 1
    for first, places in offsets:
        change[first + places] += 1
        change[first + places + LENGTH] -= 1
    return np.cumsum(change[:-1]) > 0


def _own_contexts(column: pa.Array) -> Iterator[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
    """Of each document the starts of its own contexts, and the offsets of removed windows where there are some."""
    start, removed, offsets = (column.values.field(name) for name in ("start", "removed", "offsets"))
    starts = start.to_numpy()
    some = np.flatnonzero(pc.or_(removed.is_valid(), offsets.is_valid()).to_numpy(zero_copy_only=False))
    for k in range(len(column)):
        a, b = (column.offsets[k].as_py(), column.offsets[k + 1].as_py()) if column[k].is_valid else (0, 0)
        places = []
        for at in some[np.searchsorted(some, a):np.searchsorted(some, b)].tolist():
            packed = removed[at].as_py()
            places.append((int(starts[at]), np.frombuffer(packed, "<i4") if packed is not None else np.asarray(offsets[at].as_py(), np.int64)))
        yield starts[a:b], places


def _cut_rows(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data, repeated, (own, offsets) in zip(_bytes(batch), batch.column("anchors"), _own_contexts(batch.column("firsts")), strict=True):
            if repeated.is_valid:
                gone = cut(data, repeated.values.to_numpy(), own, offsets)
                kept = data[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
            else:
                kept, spans = data.tobytes(), 0
            rows.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else b""))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *arrays[:4 + with_text]],
                                         names=["doc_id", "hash", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:6 + with_text])


def _first_copies(docs: DataFrame, with_text: bool) -> DataFrame:
    keyed = _keyed(docs).join(removed_windows(docs), ["doc", "hash"], "left").select("doc_id", "hash", "text", "anchors", "firsts")
    schema = "doc_id long, hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return keyed.mapInArrow(lambda b: _cut_rows(b, with_text), schema)


def kept_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and `kept`, the bytes that stay, of the first row of each different
    (doc_id, text); what repeats such a row has no bytes left, or all if it is shorter than LENGTH."""
    return _first_copies(docs, True).dropDuplicates(["doc_id", "hash"]).drop("hash")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the remaining bytes.

    Texts are taken as UTF-8 bytes, whole and one by one; a null text is empty. Rows of one doc_id come in the order of a hash
    of their texts, rows without one come last. Of equal rows one counts as the first, so the others lose all they have (unless
    it is shorter than LENGTH). Other columns are left out; an empty table gives an empty one.
    """
    rows = _first_copies(docs, False).groupBy("doc_id", "hash", "n_bytes", "n_removed", "n_spans", "kept_sha256").agg(F.count("*").alias("copies"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    again = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.select("doc_id", "n_bytes", F.when(again, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
                       F.when(again, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
                       F.when(again, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
