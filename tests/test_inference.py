"""Rows through a model that fails on some of them."""

from provalake.operators import inference as IN
from provalake.operators import vectors as V


def maker():
    """A model's builder, made here so that it travels to the tasks by value."""

    def make():
        seen = []

        def model(texts):
            seen.append(len(texts))
            if any(t is not None and "mau" in t for t in texts):
                raise RuntimeError("não sei ler")
            return [f"{len(t or '')}/{max(seen)}" for t in texts]

        return model

    return make


def test_only_the_rows_at_fault_fail(spark):
    rows = [(i, "x" * (i % 13) if i != 40 else "texto mau") for i in range(100)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, texto string").coalesce(1)
    out = IN.infer_table(df, "texto", maker(), "resposta", "string", batch_size=16)
    good, bad = IN.answered(out, "resposta")
    got = {r.id: r.resposta for r in good.collect()}
    assert len(got) == 100 and all(got[i].split("/")[0] == str(len(t or "")) and int(got[i].split("/")[1]) <= 16 for i, t in rows if i != 40)
    assert [(r.id, r.resposta_erro) for r in bad.collect()] == [(40, "RuntimeError: não sei ler")]
    assert out.columns == ["id", "texto", "resposta", "resposta_erro"]
    assert [r.id for r in out.collect()] == [i for i, _ in rows]


def test_a_model_that_forgets_answers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").coalesce(1)
    out = IN.infer_table(df, "t", lambda: lambda v: ["one"], "r", "string")
    assert {(r.id, r.r) for r in out.collect()} == {(1, "one"), (2, "one")}  # asked one by one, each has its answer
    assert IN.infer_table(df.limit(0), "t", maker(), "r", "string").count() == 0


def test_embed_with_a_model(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "mau"), (3, "c")], "id long, t string")
    model = lambda texts: [1 / 0 if t == "mau" else (len(t), 1) for t in texts]
    rows = {r.id: r for r in V.embed(df, "t", lambda: model).collect()}
    assert rows[1].embedding == [2.0, 1.0] and rows[3].embedding_erro is None
    assert rows[2].embedding is None and rows[2].embedding_erro.startswith("ZeroDivisionError")
