"""Hashed similar pairs: recall against the exact form, crowded buckets, awkward vectors."""

import numpy as np
import pytest

from provalake.operators import similar_index as SX
from provalake.operators import vectors as V


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")


def exact(x, t):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    return {(i, j) for i, j in zip(*np.nonzero(s >= t)) if i < j}


@pytest.mark.parametrize("threshold, spread", [(0.30, 2.0), (0.75, 0.55), (0.9, 0.3)])
def test_recall(spark, threshold, spread):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(60, 24)), 6, 0) + spread * rng.normal(size=(360, 24))
    want = exact(x, threshold)
    got = {(r.id_1, r.id_2) for r in SX.hashed_pairs(table(spark, x), threshold).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.9 * len(want)


def test_crowded_buckets_are_cut_into_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(90, 8))
    got = {(r.id_1, r.id_2) for r in SX.hashed_pairs(table(spark, x), 0.9, bits=2, bands=6, block_rows=16).collect()}
    assert got == exact(x, 0.9)


def test_copies_and_vectors_without_direction(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.1]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [None, 1.0]), (8, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert {(r.id_1, r.id_2) for r in SX.hashed_pairs(df, 0.9).collect()} == {(1, 3)}
    assert SX.hashed_pairs(df.limit(0), 0.9).count() == 0


def test_plan_follows_the_threshold():
    for t in (0.3, 0.75, 0.9):
        bits, bands = SX.hash_plan(t)
        assert bands <= SX.MOST_BANDS and SX.expected_recall(t, bits, bands) >= 0.95
    assert SX.hash_plan(0.9)[0] > SX.hash_plan(0.75)[0] > SX.hash_plan(0.3)[0]


def test_measured_recall(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "id_1 long, id_2 long")
    row = SX.measured_recall(pairs([(1, 2), (3, 4), (7, 8)]), pairs([(1, 2), (3, 4), (5, 6)])).first()
    assert (row.exact, row.found, row.wrong) == (3, 2, 1)
    assert V.similar_pairs(table(spark, np.eye(3)), 0.5).count() == 0


def test_copies_of_a_vector_stay_few_as_rows_grow():
    for t in (0.3, 0.75, 0.9):
        plans = [SX.hash_plan(t, rows=n) for n in (100, 10_000, 100_000, 600_000)]
        assert all(bands <= 64 and SX.expected_recall(t, bits, bands) >= 0.95 for bits, bands in plans), plans
        assert [bits for bits, _ in plans] == sorted(bits for bits, _ in plans)


def test_found_pairs_are_there_once_without_a_shuffle_of_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(70, 8))
    found = SX.hashed_pairs(table(spark, x), 0.9, bits=3, bands=12, block_rows=32)
    got = [(r.id_1, r.id_2) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) <= exact(x, 0.9) and len(got) > 0.9 * len(exact(x, 0.9))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")]


def test_recall_is_measured_on_lists(spark, monkeypatch):
    monkeypatch.setattr(SX, "LIST", 3)
    monkeypatch.setattr(SX, "HELD_PAIRS", 50)
    rng = np.random.default_rng(7)
    e, f = ({(a, b) for a, b in rng.integers(0, 40, (n, 2)).tolist() if a < b} for n in (900, 700))
    for name, kind in (("long", int), ("string", "{:02d}".format)):
        rows = lambda s: spark.createDataFrame([(kind(a), kind(b)) for a, b in s], f"id_1 {name}, id_2 {name}").repartition(4)  # noqa: E731, B023
        assert tuple(SX.measured_recall(rows(f), rows(e)).first()) == (len(e), len(e & f), len(f - e))
    plan = SX.measured_recall(rows(f), rows(e))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
