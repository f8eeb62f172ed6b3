"""Text scalars and scores on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from provalake.functions import jsontext as JS
from provalake.functions import text as X
from provalake.functions.scoring import confidence
from provalake.operators.filters import document_code, error_to_state, incomplete, phase_progress
from provalake.operators.quality import quality_score, word_quality


def value(spark, col, **row):
    names = list(row)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in names))
    return df.select(col).first()[0]


@pytest.mark.parametrize("text,expected", [
    ("Questão 42: Assinale a alternativa correta.", "Assinale a alternativa correta."),
    ("QUESTÃO 15 - Considerando...", "Considerando..."), ("Q.42: Sobre a lei...", "Sobre a lei..."),
    ("01) A administração pública...", "A administração pública..."), ("42 - Marque a opção...", "Marque a opção..."),
    ("(CESPE 2023) O princípio...", "O princípio..."), ("(TRF 3ª Região - Analista) A lei...", "A lei..."),
    (None, ""), ("   \n ", ""), ("Lei 8.112/90,  art. 5º", "Lei 8.112/90, art. 5º"),
])
def test_prune_context(spark, text, expected):
    assert value(spark, X.prune_context(F.col("t")), t=text) == expected


@pytest.mark.parametrize("raw,expected", [
    ("  MATEMÁTICA, ", "matematica"), ("Língua Portuguesa.", "lingua portuguesa"), (None, ""), ("...", ""),
])
def test_normalize(spark, raw, expected):
    assert value(spark, X.normalize_discipline(F.col("t")), t=raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("LÃ\xadngua Portuguesa", "Língua Portuguesa"), ("Redação", "Língua Portuguesa"), ("saúde-pública", "Saúde-Pública"),
    ("LEGISLAÇÃO BÁSICA", "Legislação e Administração Pública"), (None, ""), ("日本", "日本"),
])
def test_canonical(spark, raw, expected):
    assert value(spark, X.canonical_discipline(F.col("t")), t=raw) == expected


@pytest.mark.parametrize("raw,expected", [("Ã¡", "á"), ("água", "água"), ("日本", "日本"), ("\xff\xfe", "\xff\xfe"), (None, None)])
def test_mojibake(spark, raw, expected):
    assert value(spark, X.fix_mojibake(F.col("t")), t=raw) == expected


def test_title_case_like_python(spark):
    for raw in ["noções de direito", "3ª região", "o'neil straße ßä", "ÁGUA-viva 2x"]:
        assert value(spark, X.title_case(F.col("t")), t=raw) == raw.title()


def test_strip_accents_like_unicode(spark):
    assert value(spark, X.strip_accents(F.col("t")), t="ÁÉÍÓÚâêôãõçÜñ é 3ª") == "AEIOUaeoaocUn e 3a"


QUESTION = ("map('A','a','B','b','C','c','D','d','E','e')", "map('A','a','B','b','C','c','D','d')", "map('A','a','B','b','C','c')")


@pytest.mark.parametrize("stem,options,answer,disc,numero,syllabus,parts", [
    ("x" * 100, QUESTION[0], "A", "Português", 1, ["Língua Portuguesa", "portugues"], (25, 25, 20, 15, 15)),
    ("x" * 30, QUESTION[1], "X", "Física", 1, ["Português"], (15, 25, 10, 5, 15)),
    ("x" * 10, QUESTION[2], None, "Física", None, None, (0, 15, 0, 10, 10)),
    (None, "cast(null as map<string,string>)", None, None, None, None, (0, 0, 0, 0, 0)),
    ("x" * 3000, QUESTION[0], "AB", "", 1, [], (15, 25, 20, 0, 15)),
])
def test_confidence(spark, stem, options, answer, disc, numero, syllabus, parts):
    df = spark.createDataFrame([(stem, answer, disc, numero, syllabus)], "s string, g string, d string, n int, e array<string>")
    row = df.select(confidence(F.col("s"), F.expr(options), F.col("g"), F.col("d"), F.col("n"), F.col("e")).alias("c")).first()[0]
    names = ["enunciado_tamanho", "alternativas_validas", "gabarito_claro", "disciplina_match", "formato_consistente"]
    assert tuple(row["detalhes"][n] for n in names) == parts
    assert row["score"] == sum(parts)
    assert row["nivel"] == ("alta" if sum(parts) >= 80 else "media" if sum(parts) >= 50 else "baixa")


@pytest.mark.parametrize("err,lng,valid,n,check", [
    (0.0, 0.0, 1.0, 100, lambda s: s >= 0.95), (0.5, 0.2, 0.5, 100, lambda s: s < 0.5), (0.3, 0.1, 0.7, 100, lambda s: s < 0.8), (0.0, 0.0, 1.0, 9, lambda s: s == 0)])
def test_quality_score(spark, err, lng, valid, n, check):
    assert check(spark.range(1).select(quality_score(F.lit(err), F.lit(lng), F.lit(valid), F.lit(n))).first()[0])


def test_word_quality_sample(spark):
    docs = spark.createDataFrame([(1, " ".join(["casa"] * 12 + ["xyzt"])), (2, "casa curta")], "doc_id int, text string")
    lex = spark.createDataFrame([("casa",)], "word string")
    rows = {r.doc_id: r for r in word_quality(docs, lex).collect()}
    assert rows[1].word_count == 13 and rows[1].spell_error_rate == round(1 / 13, 4)
    assert rows[2].spell_error_rate == 1.0 and rows[2].score == 0.0
    assert {r.doc_id: r for r in word_quality(docs, lex, sample=12).collect()}[1].spell_error_rate == 0.0


def test_word_tokens(spark):
    df = spark.createDataFrame([("Olá, (mundo) a ab abc-def «ação» 123 word1 fim.",)], "t string")
    assert df.select(X.words(F.col("t"))).first()[0] == ["Olá", "mundo", "ação", "fim"]


def test_duration_text(spark):
    rows = spark.createDataFrame([(59,), (61,), (3600,), (7325,)], "s long").select(X.duration_text(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["59s", "1m 1s", "1h 0m", "2h 2m"]


def test_document_code(spark):
    cols = "path string, exists boolean, opens boolean, encrypted boolean, has_images boolean, text_length int, page_count int"
    rows = [("a.pdf", False, False, False, False, 0, 0), ("a.txt", True, True, False, False, 9999, 1), ("a.pdf", True, False, False, False, 0, 0),
            ("a.pdf", True, True, True, False, 0, 0), ("a.pdf", True, True, False, True, 99, 1), ("a.PDF", True, True, False, False, 999, 1), ("a.pdf", True, True, False, True, 5000, 3)]
    got = [r[0] for r in spark.createDataFrame(rows, cols).select(document_code()).collect()]
    assert got == ["FILE_NOT_FOUND", "NOT_PDF", "CORRUPTED", "PASSWORD_PROTECTED", "SCANNED_PDF", "INSUFFICIENT_TEXT", None]


def test_error_states(spark):
    rows = spark.createDataFrame([("Rate limit",), ("HTTP 429",), ("boom" * 200,)], "e string").select(error_to_state(F.col("e")).alias("s")).select("s.*").collect()
    assert [r.queue_status for r in rows] == ["retry", "retry", "failed"]
    assert len(rows[2].queue_error) == 500


def test_phase_progress(spark):
    df = spark.createDataFrame([("running", 0, 50), ("running", 2, 50), ("completed", 1, 0), ("running", 4, 100)], "s string, p int, w int")
    assert [r[0] for r in df.select(phase_progress(F.col("s"), F.col("p"), F.col("w"))).collect()] == [0.0, 37.5, 100.0, 100.0]


def test_incomplete(spark):
    df = spark.createDataFrame([({"A": "a", "B": "b", "C": "c", "D": "d", "E": "e"}, "x" * 20), ({"A": "a", "B": " ", "C": "c", "D": "d", "E": "e"}, "x" * 20), (None, "x" * 20)],
                               "m map<string,string>, s string")
    assert [r[0] for r in df.select(incomplete(F.col("m"), F.col("s"))).collect()] == [False, True, True]


def test_fences(spark):
    for raw in ['```json\n{"a":1}\n```', '```\n{"a":1}\n```', '{"a":1}', 'x ```json {"a":1}']:
        assert value(spark, JS.strip_fences(F.col("t")), t=raw) == '{"a":1}'


def test_sanitize(spark):
    import json

    raw = '{"a": "x\ny\t\\"q\\" z\x01", \n"b": "c\\\\"}'
    assert json.loads(value(spark, JS.sanitize_json(F.col("t")), t=raw)) == {"a": 'x\ny\t"q" z', "b": "c\\"}


@pytest.mark.parametrize("raw,numbers", [
    ('{"questoes":[{"numero":1,"anulada":false},{"numero":2,"an', [1]),
    ('```json\n{"questoes":[{"numero":1,"gabarito":"A"}]}\n```', [1]),
    ('texto antes {"questoes":[{"numero":7}]}', [7]),
    ('{"questoes":[{"numero":3,"enunciado":"a } b"},{"numero":4,"enunciado":"corte', [3]),
])
def test_repair(spark, raw, numbers):
    from provalake import schemas

    good, bad = JS.parse_responses(spark.createDataFrame([(raw,)], "r string"), "r", schemas.QUESTION_BATCH, ("questoes",), JS.repair_question_json)
    assert [q.numero for r in good.collect() for q in r.questoes] == numbers
    assert bad.count() == 0


def test_quarantine_required(spark):
    from provalake import schemas

    df = spark.createDataFrame([(1, '{"disciplina":"a","assunto":"b"}'), (2, '{"disciplina":"a"}'), (3, "nada")], "id int, r string")
    good, bad = JS.parse_responses(df, "r", schemas.CLASSIFICATION, ("disciplina", "assunto"))
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r._error for r in bad.collect()} == {2: "campo obrigatorio ausente", 3: "json invalido"}


def test_windows(spark):
    text = ("palavra " * 40 + "\n") * 3
    whole = value(spark, X.text_windows_at_space(F.col("t"), 100, 10, 30), t=text)
    assert all(len(w) <= 101 for w in whole) and all(w[-1] in " \n" for w in whole)
    assert whole[0] + "".join(w[10:] for w in whole[1:]) == text
    plain = value(spark, X.text_windows(F.col("t"), 100, 10), t=text)
    assert plain[0] + "".join(w[10:] for w in plain[1:]) == text
    assert value(spark, X.text_windows(F.col("t"), 100, 10), t="curto") == ["curto"]


@pytest.mark.parametrize("raw,expected", [("mbẽ ế ﬁm", "mbe e fim"), ("Ǖ ỹ Ώ", "U y Ω"), ("한글 çã", "한글 ca")])
def test_accents_of_all_unicode(spark, raw, expected):
    assert value(spark, X.strip_accents(F.col("t")), t=raw) == expected


def test_quote_after_very_many_backslashes(spark):
    import json

    from provalake.functions import jsontext as JT

    rows = ['{"a": "x\ny"}', '{"a": "' + "\\\\" * 70 + '"}', '{"a": "' + "\\\\" * 70 + '\\" b\n"}', '{"a":"q\\"\tz"}', '  {"k":"\\\\"}  ']
    got = [json.loads(r[0]) for r in spark.createDataFrame([(r,) for r in rows], "t string").select(JT.sanitize_json(F.col("t"))).collect()]
    assert got == [{"a": "x\ny"}, {"a": "\\" * 70}, {"a": "\\" * 70 + '" b\n'}, {"a": 'q"\tz'}, {"k": "\\"}]


def test_marks_of_all_blocks_are_dropped(spark):
    from provalake.functions.text import strip_accents

    assert spark.createDataFrame([("e᷄x⃐y︠ éá᪰",)], "t string").select(strip_accents(F.col("t"))).first()[0] == "exy ea"


def test_whole_texts_go_to_python_in_small_batches(spark):
    df = spark.createDataFrame([(None,), ("um dois " * 300,), ('{"questoes":[{"numero":1,"gabarito":"C"},{"numero":2,"enu',)], "t string")
    out = df.select(X.text_windows_at_space(F.col("t"), 800, 50, 100).alias("w"), JS.repair_question_json("t").alias("j"), JS.repair_syllabus_json("t").alias("s"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    rows = out.collect()
    assert rows[0] == (None, None, None) and [len(r.w) for r in rows[1:]] == [4, 1]
    assert [r.j for r in rows[1:]] == [None, '{"questoes":[{"numero":1,"gabarito":"C"}]}'] and rows[2].s == rows[2].j
