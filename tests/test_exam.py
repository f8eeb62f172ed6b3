"""Syllabus matching, trees, parsing, findings, counters and jobs on hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from provalake.operators import aggregates as G
from provalake.operators import findings as FD
from provalake.operators import evidence as EV
from provalake.operators import matching as N
from provalake.operators import mutations as M
from provalake.operators import parsing as P
from provalake.operators import taxonomy as T
from provalake.operators import windows as W
from provalake.plans import incidence as I
from provalake.plans import jobs as JB
from provalake.plans import report as R
from provalake.plans.requests import chunk_requests, classification_requests

SYLLABUS = {"disciplinas": [
    {"nome": "Língua Portuguesa", "itens": [
        {"id": "1", "texto": "Compreensão e interpretação de textos", "filhos": []},
        {"id": "2", "texto": "Sintaxe", "filhos": [{"id": "2.1", "texto": "Período Simples", "filhos": []}, {"id": "2.2", "texto": "Período Composto", "filhos": []}]}]},
    {"nome": "Raciocínio Lógico", "itens": [{"id": "1", "texto": "Proposições", "filhos": []}, {"id": "2", "texto": "Conectivos lógicos", "filhos": []}]}]}


def editais(spark, *docs):
    return spark.createDataFrame([(i + 1, None if d is None else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "edital_id int, taxonomia string")


def syllabi(spark, doc):
    return editais(spark, doc).select(F.col("edital_id").alias("p"), T.discipline_keys(F.col("taxonomia")).alias("nomes"))


def mixed(spark):
    rows = [(1, 1, "Português"), (1, 2, "Matemática"), (1, 3, "Inglês"), (1, 4, "Língua Portuguesa"), (1, 5, "Espanhol")]
    return spark.createDataFrame(rows, "p int, numero int, disciplina string")


def test_filter_by_syllabus(spark):
    kept = N.kept(mixed(spark), syllabi(spark, SYLLABUS), ["p"])
    assert sorted(r.numero for r in kept.collect()) == [1, 2, 4]
    assert sorted(r.numero for r in N.removed(mixed(spark), syllabi(spark, SYLLABUS), ["p"]).collect()) == [3, 5]
    stats = N.filter_stats(mixed(spark), syllabi(spark, SYLLABUS), ["p"]).first()
    assert (stats.total_original, stats.total_filtrado, stats.total_removido, stats.disciplinas_removidas) == (5, 3, 2, {"Inglês": 1, "Espanhol": 1})


@pytest.mark.parametrize("doc", [None, {"disciplinas": []}, {}])
def test_empty_syllabus_keeps_all(spark, doc):
    stats = N.filter_stats(mixed(spark), syllabi(spark, doc), ["p"]).first()
    assert (stats.total_filtrado, stats.total_removido) == (5, 0)


def test_blank_discipline_is_removed_and_counted(spark):
    q = spark.createDataFrame([(1, 1, None), (1, 2, ""), (1, 3, "Português")], "p int, numero int, disciplina string")
    stats = N.filter_stats(q, syllabi(spark, SYLLABUS), ["p"]).first()
    assert stats.total_removido == 2 and sum(stats.disciplinas_removidas.values()) == 2 and set(stats.disciplinas_removidas) == {"Sem disciplina"}


def test_flatten_and_totals(spark):
    nodes = T.flatten_taxonomy(editais(spark, SYLLABUS, None, {"disciplinas": []}))
    rows = nodes.collect()
    assert len(rows) == 8 and max(r.depth for r in rows) == 2
    t = T.taxonomy_totals(nodes).first()
    assert (t.disciplinas, t.itens) == (2, 6)
    assert "Língua Portuguesa > Sintaxe > Período Composto" in {r.full_path for r in rows}


def test_deep_syllabus(spark):
    item = {"id": "z", "texto": "fundo", "filhos": []}
    for d in range(5):
        item = {"id": str(d), "texto": f"n{d}", "filhos": [item]}
    doc = {"disciplinas": [{"nome": "D", "itens": [item]}]}
    assert T.flatten_taxonomy(editais(spark, doc)).agg(F.max("depth")).first()[0] == 6
    both = [sorted(map(str, T.flatten_taxonomy(editais(spark, doc, SYLLABUS, LEGACY), max_depth=m).collect())) for m in (6, 3, 1, 0)]
    assert both[0] == both[1] == both[2] == both[3] and len(both[0]) > 16


LEGACY = {"disciplinas": [{"nome": None, "assuntos": [{"nome": "A", "topicos": [{"nome": "T", "subtopicos": ["x", {"nome": "y"}, None]}, {}]}, None]},
                          {"nome": "Ç", "itens": [{"id": 7, "texto": ""}, None, {"texto": 'a [b] {c} " [', "filhos": [{"id": "", "texto": None}]}]}]}


def test_forty_levels_and_a_broken_document(spark):
    item = {"id": "z", "texto": "fundo"}
    for d in range(39):
        item = {"id": str(d), "texto": f"n{d}", "filhos": [item]}
    deep = editais(spark, {"disciplinas": [{"nome": "D", "itens": [item]}]}, SYLLABUS)
    broken = deep.limit(1).selectExpr("edital_id + 90 AS edital_id", "left(taxonomia, length(taxonomia) - 5) AS taxonomia")
    every = deep.select("edital_id", "taxonomia").unionByName(broken)
    nodes = T.flatten_taxonomy(every)
    assert nodes.agg(F.max("depth")).first()[0] == 40 and nodes.count() == 41 + 8
    assert nodes.filter("depth = 40").first().full_path.endswith("n0 > fundo")
    assert [r.edital_id for r in T.unreadable(every).collect()] == [r.edital_id for r in broken.collect()]


def test_incidence_tree_tiers(spark):
    q = spark.createDataFrame([(1, "língua portuguesa"), (1, "Língua Portuguesa"), (1, "Raciocínio Quantitativo"), (2, "Física")], "projeto_id int, disciplina string")
    labels = spark.createDataFrame([(1, "Língua Portuguesa", "sintaxe", "a"), (1, "Língua Portuguesa", "sintaxe", "a"), (1, "LINGUA PORTUGUESA", "Período Misto", "b")],
                                   "projeto_id int, disciplina string, assunto string, questao_id string")
    projects = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "projeto_id int, edital_id int")
    tree = I.incidence(projects, editais(spark, SYLLABUS), q, labels)
    one = {r.texto: r["count"] for r in tree.filter("projeto_id = 1").collect()}
    assert one == {"Língua Portuguesa": 1, "Raciocínio Lógico": 1, "Compreensão e interpretação de textos": 0, "Sintaxe": 1, "Período Simples": 1,
                   "Período Composto": 1, "Proposições": 0, "Conectivos lógicos": 0}
    assert {r["count"] for r in tree.filter("projeto_id = 2").collect()} == {0}
    nested = json.loads(T.nest_tree(tree.filter("projeto_id = 1"), ["projeto_id"], 3).first().arvore)
    assert [n["nome"] for n in nested] == ["Língua Portuguesa", "Raciocínio Lógico"]
    assert [c["nome"] for c in nested[0]["children"][1]["children"]] == ["Período Simples", "Período Composto"]


def test_brackets_are_bounded_by_counting(spark):
    doc = '{"disciplinas":[{"nome":"A","itens":[{"id":"1","filhos":[]},{"id":"2","filhos":[{"id":"2.1","filhos":[]},{"id":"2.2","filhos":[]}]}]},{"nome":"B","itens":[]}]}'
    rng = random.Random(4)
    odd = ["".join(rng.choices(["[", "]", "{", "}", "[]", "},{", ",", '"', "\\", "x"], k=rng.randrange(40))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in [doc, "", None, *odd]], "t string").select("t", T.nesting(F.col("t")).alias("n"), T.nesting_bound(F.col("t")).alias("b"))
    assert rows.filter("b < n").count() == 0
    first = rows.first()
    assert first.n <= first.b <= 9  # of 14 opening signs; the costly walk is left out for such documents


def test_names_of_counts_are_normalized_once(spark):
    nodes = spark.createDataFrame([(1, "SINTAXE"), (1, "sintaxe nova"), (1, "Outra")], "p int, nome string")
    counts = spark.createDataFrame([(1, "Sintaxe", 2), (1, "sintáxe", 3), (1, "sintaxe velha", 5), (1, None, 7), (1, " ", 9)], "p int, key string, n long")
    found = N.lookup_counts(nodes, counts, "nome", ["p"])
    assert {r.nome: r["count"] for r in found.collect()} == {"SINTAXE": 2, "sintaxe nova": 10, "Outra": 0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(key" not in plan and "translate(nome" in plan


def test_older_shape_counts_only_subjects(spark):
    doc = {"disciplinas": [{"nome": "D", "assuntos": [{"nome": "A", "topicos": [{"nome": "T", "subtopicos": ["S", {"nome": "U"}]}]}]}]}
    labels = spark.createDataFrame([(1, "D", t, str(i)) for i, t in enumerate("ATSU")], "projeto_id int, disciplina string, assunto string, questao_id string")
    projects = spark.createDataFrame([(1, 1)], "projeto_id int, edital_id int")
    q = spark.createDataFrame([(1, "D")], "projeto_id int, disciplina string")
    count = lambda scoped: {r.texto: r["count"] for r in I.incidence(projects, editais(spark, doc), q, labels, scoped).collect()}
    assert count(False) == {"D": 1, "A": 1, "T": 0, "S": 0, "U": 0}
    assert count(True) == {"D": 1, "A": 1, "T": 1, "S": 1, "U": 1}


PAPER = ("Prova\nLíngua Portuguesa\nQuestão 01 (Correta: C)\nLeia o texto com atenção.\nA) um\nB) dois\nC) três\nD) quatro\nE) cinco\nInformática\nQUESTÃO 02\n"
         "Qual atalho copia? ANULADA\nA) x\nB) y\nResposta: B")
BRACKETS = "15. [Português - Sintaxe - Período] Assinale a certa agora.\nA) um B) dois C) três D) quatro E) cinco Resposta: D\n16. [Matemática] Quanto vale x?\nA) 1 B) 2 Resposta: A"


def test_two_grammars(spark):
    docs = spark.createDataFrame([(1, PAPER), (2, BRACKETS), (3, "nada aqui")], "doc_id int, full_text string")
    rows = {(r.doc_id, r.numero): r for r in P.parse_blocks(P.segment_questions(docs)).collect()}
    assert set(rows) == {(1, 1), (1, 2), (2, 15), (2, 16)}
    a, b, c = rows[1, 1], rows[1, 2], rows[2, 15]
    assert (a.disciplina, a.gabarito, a.enunciado, a.status_extracao) == ("Língua Portuguesa", "C", "Leia o texto com atenção.", "ok")
    assert a.alternativas == {"A": "um", "B": "dois", "C": "três", "D": "quatro", "E": "cinco\nInformática"}
    assert (b.disciplina, b.gabarito, b.anulada, b.alertas) == ("Informática", None, True, ["Número de alternativas inválido: 2"])
    assert (c.disciplina, c.assunto_pci, c.gabarito, c.enunciado) == ("Português", "Sintaxe", "D", "Assinale a certa agora.")


def test_headers_and_positions(spark):
    text = "Língua Portuguesa\nQuestão 1\nx\nNoções de\n\nDireito Público\n2. Pergunta\n3 - Outra"
    docs = spark.createDataFrame([(1, text)], "doc_id int, full_text string")
    q = spark.createDataFrame([(1, n, "velha") for n in (1, 2, 3, 9)], "doc_id int, numero int, disciplina string")
    assert [(r.pos, r.disciplina) for r in P.detect_headers(docs).orderBy("pos").collect()] == [(1, "Língua Portuguesa"), (text.index("Noções") + 1, "Noções de Direito Público")]
    assert {r.numero: r.disciplina for r in P.assign_disciplines(q, docs).collect()} == {
        1: "Língua Portuguesa", 2: "Noções de Direito Público", 3: "Noções de Direito Público", 9: "velha"}


def test_repair(spark):
    text = "Questão 1 (Correta: A) Enunciado bem comprido que passa de vinte letras (A) a (B) b (C) c (D) d (E) e\nQuestão 2\nresto"
    docs = spark.createDataFrame([(1, text)], "doc_id int, full_text string")
    rows = [(1, 0, 1, "curto", {}, "ok"), (1, 1, 2, "x" * 30, {k: "t" for k in "ABCDE"}, "ok")]
    q = spark.createDataFrame(rows, "doc_id int, seq int, numero int, enunciado string, alternativas map<string,string>, status_extracao string")
    got = {r.numero: r for r in P.repair_incomplete(q, docs).collect()}
    assert got[1].status_extracao == "repaired" and got[1].alternativas == {"A": "a", "B": "b", "C": "c", "D": "d", "E": "e"}
    assert got[2].status_extracao == "ok" and got[2].fonte is None


def test_votes(spark):
    rows = [(p, 0, "temporal", "Pattern A", e) for p, e in ((1, "q1"), (2, "q2"), (3, "q3"))] + [(1, 1, "estilo", "Pattern B", "q4"), (1, 2, "estilo", "Pattern C", "q5"), (2, 2, "estilo", "Pattern C", "q5")]
    p = spark.createDataFrame(rows, "pass_no int, seq int, type string, description string, evidence_id string")
    got = {r.description: (r.votes, r.confidence, r.n_evidence) for r in FD.vote(p, F.struct("pass_no", "seq")).collect()}
    assert got == {"Pattern A": (3, "high", 3), "Pattern B": (1, "low", 1), "Pattern C": (2, "medium", 1)}


def test_histograms(spark):
    rows = [("easy", False, None), ("medium", True, "Negacao dupla"), ("medium", True, "Negacao dupla"), ("hard", True, "Exceto"), ("hard", True, "")]
    a = spark.createDataFrame(rows, "difficulty string, has_trap boolean, trap_description string")
    assert {r.difficulty: r.n for r in FD.difficulty_histogram(a).collect()} == {"easy": 1, "medium": 2, "hard": 2}
    assert {r.trap: r.n for r in FD.trap_histogram(a).collect()} == {"Negacao dupla": 2, "Exceto": 1}


def test_digest_defaults_and_errors(spark):
    df = spark.createDataFrame([("c1", '```json\n{"chunk_digest":"s","questions_analysis":[{"id":"1"}]}\n```'), ("c2", "erro"), ("c3", "{}")], "chunk_id string, response string")
    good, bad = FD.parse_digests(df)
    assert {r.chunk_id for r in bad.collect()} == {"c2"}
    assert {r.linha for r in FD.digest_lines(good).collect()} == {"- Chunk c1: s | Padroes: Nenhum padrao identificado", "- Chunk c3:  | Padroes: Nenhum padrao identificado"}
    q = FD.question_analysis(good, ["chunk_id"]).first()
    assert (q.difficulty, q.bloom_level, q.has_trap) == ("medium", "understand", False)


@pytest.mark.parametrize("limit", [60, 62, 67, 68, 500])
def test_report_concat_cut(spark, limit):
    df = spark.createDataFrame([(1, i, None if i == 3 else f"{i:03d}" * 20) for i in range(50)] + [(2, 0, "")], "job int, n int, t string")
    got = {r.job: r.texto for r in FD.report_concat(df, ["job"], ["n"], "t", limit=limit).collect()}
    assert got == {1: "\n\n---\n\n".join(f"{i:03d}" * 20 for i in range(50) if i != 3)[:limit]}


def test_flag_report(spark):
    reports = spark.createDataFrame([(1, "bom"), (2, "ruim")], "report_id int, texto string")
    claims = spark.createDataFrame([(1, 0, "a", True), (2, 0, "b", True), (2, 1, "c" * 120, False)], "report_id int, claim_no int, claim string, is_verified boolean")
    got = {r.report_id: r.texto for r in FD.flag_report(reports, claims).collect()}
    assert got[1] == "bom" and got[2].startswith("AVISO: As seguintes") and got[2].endswith("- " + "c" * 100 + "...\n\n---\n\nruim")
    assert {r.report_id: r.rejected_claims for r in FD.verify_rollup(claims, ["report_id"]).collect()} == {1: 0, 2: 1}


def test_queue_summary(spark):
    cols = "queue_status string, total_questoes int"
    items = spark.createDataFrame([("completed", 30), ("completed", 25), ("pending", None), ("processing", None), ("failed", None)], cols)
    r = G.queue_summary(items).first()
    assert (r.completed, r.total, r.pending, r.processing, r.failed) == (2, 5, 1, 1, 1)
    assert G.queue_summary(spark.createDataFrame([("completed", 60), ("completed", 48), ("pending", 9)], cols)).first().total_questoes == 108
    assert G.queue_summary(spark.createDataFrame([("partial", None), ("partial", None)], cols)).first().need_review == 2


def test_exam_status(spark):
    exams = spark.createDataFrame([(i,) for i in range(4)], "prova_id int")
    scored = spark.createDataFrame([(0, 90, "alta"), (1, 90, "alta"), (1, 10, "baixa"), (2, 10, "baixa")], "prova_id int, score int, nivel string")
    got = {r.prova_id: (r.status, r.error_code) for r in G.exam_status(exams, scored).collect()}
    assert got == {0: ("completed", None), 1: ("partial", None), 2: ("failed", None), 3: ("failed", "NO_QUESTIONS")}


def test_counters_are_idempotent(spark):
    base = spark.createDataFrame([(1, 0, 0, 0, 0, [])], "projeto_id int, total_provas int, total_questoes int, total_anuladas int, total_questoes_validas int, lotes array<string>")
    batch = spark.createDataFrame([(1, "b1", 10, 2), (1, "b1", 5, 0)], "projeto_id int, batch_id string, total int, anuladas int")
    once = G.apply_counters(base, batch)
    twice = G.apply_counters(once, batch).first()
    assert (twice.total_provas, twice.total_questoes, twice.total_questoes_validas, twice.lotes) == (2, 15, 13, ["b1"])


def test_dedupe_and_patch(spark):
    q = spark.createDataFrame([(1, 1, 5, "abc", 0), (1, 1, 5, "abcd", 1), (1, 1, 5, "abce", 2), (1, None, 5, "x", 3)], "p int, numero int, n int, enunciado string, seq int")
    best = W.dedupe_most_complete(q, W.completeness(F.col("n"), F.col("enunciado")), F.col("seq"), ["p", "numero"]).collect()
    assert [r.seq for r in best] == [1]
    assert sorted(r.seq for r in W.dedupe_first_seen(q, ["numero"], F.col("seq")).collect()) == [0, 3]
    base = spark.createDataFrame([(1, "a", 2020), (2, "b", 2021)], "id int, nome string, ano int")
    patch = spark.createDataFrame([(1, ["ano"], "ignorado", None)], "id int, campos array<string>, nome string, ano int")
    assert {r.id: (r.nome, r.ano) for r in M.update_patch(base, patch, "id", ["nome", "ano"]).collect()} == {1: ("a", None), 2: ("b", 2021)}


def test_evidence_is_ranked(spark):
    claims = spark.createDataFrame([("r", 0, "a crase ocorre antes de palavra feminina")], "report_id string, claim_no int, claim string")
    pool = spark.createDataFrame([("r", 1, "Crase antes de palavra"), ("r", 2, "Verbo transitivo"), ("r", 3, "palavra feminina"), ("s", 4, "crase palavra feminina antes")],
                                 "report_id string, evidence_no int, enunciado string")
    assert [(r.evidence_no, r.overlap) for r in EV.claim_evidence(claims, pool).orderBy("rank").collect()] == [(1, 3), (3, 2)]


def test_phases():
    def fail(_):
        raise RuntimeError("x")

    run = JB.run_phases([("a", [], lambda t: 1), ("b", [], fail), ("c", ["b"], lambda t: 2), ("d", ["a"], lambda t: t["a"] + 1), ("e", [], lambda t: 5)], skip=("e",))
    assert run.completed == ["a", "d"] and set(run.errors) == {"b", "c"} and run.status == "completed_with_errors"
    assert "missing input: b" == run.errors["c"] and "e" not in run.tables


def test_phase_that_fails_at_run_time(spark):
    broken = lambda t: spark.range(3).select(F.raise_error(F.lit("boom")).alias("x"))
    run = JB.run_phases([("a", [], lambda t: spark.range(3)), ("b", [], broken), ("c", ["b"], lambda t: t["b"]), ("d", ["a"], lambda t: {"x": t["a"].limit(2)})])
    assert run.completed == ["a", "d"] and "boom" in run.errors["b"] and run.errors["c"] == "missing input: b"
    assert run.tables["d"]["x"].count() == 2


def test_tables_of_phases_are_packed_by_column(spark):
    odd = lambda t: spark.range(2).select("id", F.col("id").alias("ID"), F.lit(None).alias("n"))
    run = JB.run_phases([("a", [], lambda t: spark.range(3)), ("b", [], odd)])
    assert run.completed == ["a", "b"] and [run.tables[x].count() for x in "ab"] == [3, 2]
    assert "FileScan parquet" in run.tables["a"]._jdf.queryExecution().executedPlan().toString()


def test_every_claim_meets_every_evidence_row(spark):
    claims = spark.createDataFrame([(1, i, f"claim palavra{i} unica{i}") for i in range(30)], "report_id int, claim_no int, claim string")
    pool = spark.createDataFrame([(1, i, f"linha palavra{i - 60} unica{i - 60}") for i in range(90)], "report_id int, evidence_no int, enunciado string")
    out = JB.verify(spark.createDataFrame([(1, "texto")], "report_id int, texto string"), claims, pool, min_overlap=2)
    assert {(r.claim_no, r.evidence_no) for r in out["evidence"].filter("rank = 1").collect()} == {(i, i + 60) for i in range(30)}
    assert tuple(out["rollup"].first()) == (1, 30, 30, 0)
    none = JB.verify(spark.createDataFrame([(1, "texto")], "report_id int, texto string"), claims, pool.filter("evidence_no < 60"), min_overlap=2)
    assert none["reports"].first().texto.count("- claim") == 30


def test_all_pages_and_whole_reports(spark):
    pages = spark.createDataFrame([("d", i, f"texto {i}") for i in range(60)], "doc string, page int, text string")
    from provalake.operators import parsing as PO

    assert PO.page_text(pages).first().paginas == 60 and PO.page_text(pages, max_pages=10).first().paginas == 10
    passes = spark.createDataFrame([(1, i, "x" * 900) for i in range(40)], "job int, n int, t string")
    assert len(FD.report_concat(passes, ["job"], ["n"], "t").first().texto) == 40 * 900 + 39 * 7


def test_report_and_requests(spark):
    q = spark.createDataFrame([(f"q{i}", "Direito", i, f"enunciado {i}", "A", 1) for i in range(10)], "questao_id string, disciplina string, numero int, enunciado string, gabarito string, edital_id int")
    labels = q.select("questao_id", "disciplina", F.when(F.col("numero") < 7, "Penal").otherwise("Civil").alias("assunto"), F.col("numero").alias("seq"))
    pairs = spark.createDataFrame([("Direito", "q1", "q2", 0.91)], "disciplina string, id_1 string, id_2 string, score double")
    text = R.markdown(labels, q, pairs).first().markdown
    for part in ("**Total de Questões:** 10", "- **Penal:** 7 questões (70.0%)", "### 2.1 Penal", "- Q0: enunciado 0...", "**1 pares**", "Similaridade: 91.0%", "1. **Penal** (Prioridade ALTA)", "35 horas"):
        assert part in text, part
    req = classification_requests(q, T.format_taxonomy_text(editais(spark, SYLLABUS))).first()
    assert "• Língua Portuguesa" in req.prompt and req.tokens == len(req.prompt) // 4
    assert chunk_requests(W.chunk_rows(q, ["disciplina"], ["questao_id"], 4), ["disciplina"]).count() == 3


def test_vectorize_job(spark):
    rows = [(f"q{i}", "a crase ocorre antes de palavra feminina") for i in range(6)] + [("z", "outro assunto bem diferente")]
    out = JB.vectorize(spark.createDataFrame(rows, "questao_id string, t string"), F.col("t"))
    labels = {r.id: r.label for r in out["clusters"].collect()}
    assert labels["z"] == -1 and {labels[f"q{i}"] for i in range(6)} == {0}
    assert out["pairs"].count() == 15


def test_vectorize_job_returns_the_clusters_too(spark):
    from conftest import SF
    from provalake.catalog.q_vectors import job_vectorize

    n = spark.read.parquet(f"{SF}/conversations.parquet").count()
    rows = job_vectorize(spark, SF).collect()
    label = {r.id_1: r.label for r in rows if r.parte == "grupo"}
    best = [r for r in rows if r.parte == "par"]
    assert len(label) == n and len(rows) == n + len(best) and all(r.label == label[r.id_1] for r in best)


def test_extract_job(spark):
    docs = spark.createDataFrame([(1, PAPER), (2, BRACKETS)], "doc_id int, full_text string")
    names = docs.select("doc_id", F.array(F.lit("lingua portuguesa")).alias("nomes"))
    kept, rollup = JB.extract(docs, names, ["doc_id"])
    assert {(r.doc_id, r.numero) for r in kept.collect()} == {(1, 1), (2, 15)}
    assert {r.prova_id: (r.total, r.anuladas) for r in rollup.collect()} == {1: (1, 0), 2: (1, 0)}


def parts(spark, text):
    return P.parse_parts(spark.createDataFrame([(1, text)], "id int, c string"), "c").first()


def test_sentence_that_begins_like_an_option_stays_in_the_stem(spark):
    r = parts(spark, "A. All rights reserved.\nA) um\nB. dois\nC- três")
    assert (r.enunciado, r.alternativas) == ("A. All rights reserved.", {"A": "um", "B": "dois", "C": "três"})
    r = parts(spark, "E-mail: x\nA) um\nB) dois")
    assert (r.enunciado, r.alternativas) == ("E-mail: x", {"A": "um", "B": "dois"})
    r = parts(spark, "Nada\nC) um\nB) dois")  # no A before a B: every mark counts
    assert (r.enunciado, r.alternativas) == ("Nada", {"C": "um", "B": "dois"})
    assert parts(spark, "só texto").enunciado == "só texto"


def test_carriage_return_begins_no_line(spark):
    r = parts(spark, "Texto\rE- isso\nA) um\rB) dentro\nB) dois")
    assert (r.enunciado, r.alternativas) == ("Texto\rE- isso", {"A": "um\rB) dentro", "B": "dois"})


def test_repair_keeps_a_stem_that_begins_like_an_option(spark):
    text = "Questão 1 (Correta: C) A.\nAll rights reserved. (A) um (B) dois (C) três (D) quatro (E) cinco\nQuestão 3\nresto"
    docs = spark.createDataFrame([(1, text)], "doc_id int, full_text string")
    q = spark.createDataFrame([(1, 1, 1, "", {}, "ok"), (1, 3, 3, "", {}, "ok")],
                              "doc_id int, seq int, numero int, enunciado string, alternativas map<string,string>, status_extracao string")
    got = {r.numero: r for r in P.repair_incomplete(q, docs).collect()}
    assert (got[1].status_extracao, got[1].enunciado, len(got[1].alternativas)) == ("repaired", "A. All rights reserved.", 5)


def test_mark_above_the_first_a_in_parentheses_stays_in_the_stem(spark):
    r = parts(spark, "(C) 2020 Acme. Veja (B) (A) um (B) dois (C) três")
    assert (r.enunciado, r.alternativas) == ("(C) 2020 Acme. Veja (B)", {"A": "um", "B": "dois", "C": "três"})
    r = parts(spark, "Nada (C) um (B) dois")  # no A: every mark counts
    assert (r.enunciado, r.alternativas) == ("Nada", {"C": "um", "B": "dois"})


def test_coverage_share_broadcasts_no_nodes(spark):
    nodes = T.flatten_taxonomy(editais(spark, SYLLABUS, SYLLABUS))
    out = T.coverage_share(nodes, spark.createDataFrame([("Língua Portuguesa", "Período Simples")], "disciplina string, texto string").hint("merge"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.folhas, r.cobertas) for r in out.filter("depth = 0").collect()} == {(3, 1), (2, 0)}
