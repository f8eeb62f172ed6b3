"""Evidence search against comparing everything, and the pairs it looks at."""

import random
import re

import pytest

from provalake.operators import evidence as EV


def tables(spark, claims, pool):
    return (spark.createDataFrame(claims, "report_id long, claim_no int, claim string"), spark.createDataFrame(pool, "report_id long, evidence_no int, enunciado string"))


def naive(claims, pool, k=5):
    words = lambda t: set(re.findall(r"[^\W_]{3,}", (t or "").lower()))
    merged = lambda rows: {key: set().union(*(words(t) for r, n, t in rows if (r, n) == key)) for key in {(r, n) for r, n, _ in rows if r is not None}}
    c, e = merged(claims), merged(pool)
    out = []
    for (r, n), mine in c.items():
        found = sorted((-len(mine & other), m) for (q, m), other in e.items() if q == r and mine & other)[:k]
        out += [(r, n, m, -s, i + 1) for i, (s, m) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("rare_rows", [0, 3, 12, 10**6])
def test_same_rows_as_comparing_everything(spark, rare_rows):
    rng = random.Random(rare_rows)
    stop = ["que", "para", "com", "uma", "dos"]
    words = [f"palavra{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(stop, k=rng.randint(0, 5)) + [words[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randint(0, 7))])
    claims = [(rng.randint(1, 3), i, text()) for i in range(50)] + [(1, 90, None), (1, 91, ""), (None, 1, "que para"), (2, 5, "outra palavra1 que")]
    pool = [(rng.randint(1, 3), i, text()) for i in range(120)] + [(2, 500, None), (None, 3, "que"), (1, 7, "palavra2 com")]
    c, e = tables(spark, claims, pool)
    got = EV.claim_evidence(c, e, rare_rows=rare_rows).select("report_id", "claim_no", "evidence_no", "overlap", "rank").collect()
    assert sorted(tuple(r) for r in got) == naive(claims, pool)


def test_stop_words_alone_bring_few_pairs(spark):
    claims = [(1, i, f"que para com afirma{i} fala{i}") for i in range(300)]
    pool = [(1, i, f"que para com prova{i} texto{i}") for i in range(300)]
    c, e, rare = EV.search_tables(*tables(spark, claims, pool), "report_id", EV.RARE_ROWS)
    near = EV.rare_matches(c, e, rare, "report_id")
    assert near.count() == 0
    settled = near.selectExpr("report_id", "claim_no", "overlap AS score")
    assert EV.common_matches(c, e, settled, "report_id", 5).count() == 1500  # five rows each, not 300
    got = EV.claim_evidence(*tables(spark, claims, pool)).collect()
    assert len(got) == 1500 and {r["evidence_no"] for r in got} == {0, 1, 2, 3, 4} and {r["overlap"] for r in got} == {3}


def test_empty_pool(spark):
    c, e = tables(spark, [(1, 1, "que para")], [])
    assert EV.claim_evidence(c, e).count() == 0
