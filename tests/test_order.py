"""Order-dependent operators against plain Python, with most rows under one key and many slices."""

import random

import pytest
from pyspark.sql import functions as F

from provalake.operators.joins import asof_last, segments
from provalake.operators.layout import lines_from_spans
from provalake.operators.quota import anchored_groups
from provalake.operators.scan_order import carry_last, next_in_key, row_numbers, running_sums
from provalake.operators.windows import chunk_rows, column_boundary, page_windows, start_page


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.randrange(400), rng.choice([None, i])) for i in range(600)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, id int, x int, v int").repartition(6)


def by_key(rows, order):
    out = {}
    for r in sorted(rows, key=order):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_sums(df, rows):
    got = {r.id: (r.s, r.n) for r in running_sums(df, ["k"], ["x", "id"], {"s": F.col("x").cast("long"), "n": F.lit(1).cast("long")}).collect()}
    for group in by_key(rows, lambda r: (r[2], r[1])).values():
        s = 0
        for n, r in enumerate(group, 1):
            s += r[2]
            assert got[r[1]] == (s, n)


def test_row_numbers_without_keys(df, rows):
    got = {r.id: r.rn for r in row_numbers(df, [], ["id"]).collect()}
    assert got == {r[1]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: r[1]))}


def test_carry_and_next(df, rows):
    last = {r.id: r.w for r in carry_last(df, ["k"], ["id"], "v", "w").collect()}
    nxt = {r.id: r.w for r in next_in_key(df, ["k"], ["id"], "id", "w").collect()}
    for group in by_key(rows, lambda r: r[1]).values():
        seen = None
        for i, r in enumerate(group):
            seen = r[3] if r[3] is not None else seen
            assert last[r[1]] == seen
            assert nxt[r[1]] == (group[i + 1][1] if i + 1 < len(group) else None)


@pytest.mark.parametrize("tol", [3, 25, 1000])
@pytest.mark.parametrize("slices", [1, 8, 40])
def test_anchored_groups(df, rows, tol, slices):
    got = {r.id: r.anchor for r in anchored_groups(df, ["k"], "x", tol, "id", slices).collect()}
    for group in by_key(rows, lambda r: (r[2], r[1])).values():
        anchor = None
        for r in group:
            if anchor is None or r[2] - anchor > tol:
                anchor = r[2]
            assert got[r[1]] == anchor


def test_asof_is_strict(spark):
    points = spark.createDataFrame([("d", 5, "old"), ("d", 10, "old"), ("d", 11, "old"), ("e", 1, "old")], "doc string, pos int, before string")
    marks = spark.createDataFrame([("d", 5, "A"), ("d", 10, "B")], "doc string, pos int, disciplina string")
    strict = {(r.doc, r.pos): r.disciplina for r in asof_last(points, marks, ["doc"], "pos", "disciplina", fallback=F.col("before")).collect()}
    loose = {(r.doc, r.pos): r.disciplina for r in asof_last(points, marks, ["doc"], "pos", "disciplina", strict=False).collect()}
    assert strict == {("d", 5): "old", ("d", 10): "A", ("d", 11): "B", ("e", 1): "old"}
    assert loose == {("d", 5): "A", ("d", 10): "B", ("d", 11): "B", ("e", 1): None}


def test_segments(spark):
    marks = spark.createDataFrame([("d", 1, 30), ("d", 12, 30), ("e", 4, 9)], "doc string, ini int, n int")
    assert {(r.doc, r.ini): r.fim for r in segments(marks, ["doc"], "ini", "n").collect()} == {("d", 1): 12, ("d", 12): 31, ("e", 4): 10}


def test_chunks_of_a_hot_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(45)] + [("b", 1)], "d string, id int")
    rows = chunk_rows(df, ["d"], ["id"], 20).groupBy("d", "chunk_id").count().collect()
    assert {(r.d, r.chunk_id): r["count"] for r in rows} == {("a", "chunk_1"): 20, ("a", "chunk_2"): 20, ("a", "chunk_3"): 5, ("b", "chunk_1"): 1}


def test_page_windows(spark):
    pages = spark.createDataFrame([("d", i, "p" * 300) for i in range(5)] + [("e", 0, "x")], "doc string, page int, text string")
    got = {(r.doc, r.primeira): r.ultima for r in page_windows(pages).collect()}
    assert got == {("d", 0): 2, ("d", 2): 4}  # the last window holds one page only and is too short


def test_start_page(spark):
    rows = [("a", 0, "capa"), ("a", 1, "QUESTÃO 01 (A) x"), ("b", 0, "capa"), ("b", 7, "questão 1 (a)"), ("c", 0, "nada"), ("d", 0, "rascunho questão 1 (a)")]
    got = {r.doc: r.inicio for r in start_page(spark.createDataFrame(rows, "doc string, page int, text string")).collect()}
    assert got == {"a": 1, "b": 7, "c": 0, "d": 0}


def test_lines_from_spans(spark):
    cols = "pg int, y double, x0 double, x1 double, text string"
    one = spark.createDataFrame([(1, 10., 50., 80., "mundo"), (1, 12., 10., 40., "Olá"), (1, 13., 80.2, 85., "!"), (1, 30., 10., 40., "fim")], cols)
    assert lines_from_spans(one, ["pg"]).first().texto == "Olá mundo!\nfim"
    two = spark.createDataFrame([(1, 10., 10., 40., "esq"), (1, 5., 300., 340., "B) cont"), (1, 40., 300., 340., "Questão 2"), (1, 60., 300., 340., "texto")], cols)
    border = spark.createDataFrame([(1, 200.)], "pg int, boundary double")
    assert lines_from_spans(two, ["pg"], border).first().texto == "esq\nB) cont\n\nQuestão 2\ntexto"


def test_columns(spark):
    rows = [(1, x, 600., "t") for x in (30., 35., 40., 300., 310., 305.)] + [(2, x, 600., "t") for x in (30., 40., 50., 60.)]
    got = {r.pg: r.boundary for r in column_boundary(spark.createDataFrame(rows, "pg int, x0 double, page_width double, text string"), ["pg"]).collect()}
    assert got == {1: 170.0, 2: None}


def test_anchored_groups_with_a_null_key(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(40)] + [("a", i, float(i)) for i in range(5)], "k string, id int, v double")
    got = {(r.k, r.id): r.anchor for r in anchored_groups(df, ["k"], "v", 3.0, "id", partitions=4).collect()}
    assert got == {(k, i): float(i - i % 4) for k, n in ((None, 40), ("a", 5)) for i in range(n)}


def test_lines_from_spans_moves_spans_once(spark):
    rows = [(1, y, 0.0, 1.0, t) for y, t in ((0.0, "a"), (4.0, "b"), (5.0, "c"), (5.5, "d"), (11.0, "e"), (None, "z"))]
    out = lines_from_spans(spark.createDataFrame(rows, "pg int, y double, x0 double, x1 double, text string").coalesce(1), ["pg"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    assert out.first().texto == "z\nabc\nd\ne"
