"""Study report per discipline: shares, details, similar pairs, priorities, Markdown text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provalake.functions.text import format_pct, priority, study_hours
from provalake.operators.windows import top_per_group
from provalake.session import cut_lineage

RULE = "\n---\n\n"


def questions_per_discipline(questions: DataFrame) -> DataFrame:
    return questions.filter("disciplina IS NOT NULL").groupBy("disciplina").agg(F.count("*").alias("total"))


def topic_shares(labels: DataFrame, questions: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """R1: labels per (discipline, topic), their share of the discipline's questions, and their rank."""
    total = questions_per_discipline(questions) if total is None else total
    per = labels.groupBy("disciplina", F.coalesce("assunto", F.lit("Não classificado")).alias("assunto")).agg(
        F.count("*").alias("n"), F.min("seq").alias("primeiro"))
    out = per.join(total, "disciplina").withColumn("pct", F.round(F.col("n") / F.col("total") * 100, 6))
    w = Window.partitionBy("disciplina").orderBy(F.desc("n"), "primeiro")  # rows here are distinct topics
    return out.withColumn("posicao", F.row_number().over(w))


def sample_questions(shares: DataFrame, labels: DataFrame, questions: DataFrame, top: int = 5, k: int = 3) -> DataFrame:
    """R2, R3: first ``k`` questions of each of the ``top`` topics."""
    best = shares.filter(F.col("posicao") <= top).select("disciplina", "assunto", "posicao")
    q = labels.join(best, ["disciplina", "assunto"]).select("disciplina", "assunto", "posicao", "questao_id")
    q = q.join(questions.select("questao_id", "numero", "enunciado"), "questao_id")
    return top_per_group(q, ["disciplina", "assunto"], [F.col("numero"), F.col("questao_id")], k, rank="ordem")


def priorities(shares: DataFrame, top: int = 3) -> DataFrame:
    """R5: study priority and suggested hours of the leading topics."""
    return shares.filter(F.col("posicao") <= top).select(
        "disciplina", "posicao", "assunto", format_pct(F.col("pct")).alias("incidencia"), priority(F.col("pct")).alias("prioridade"),
        study_hours(F.col("pct")).alias("horas"))


def _lines(df: DataFrame, order: list[str], text, out: str) -> DataFrame:
    """Lines of a discipline in order; callers pass a handful of rows per discipline."""
    return df.groupBy("disciplina").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(*order, text.alias("_l")))), lambda s: s["_l"]), "").alias(out))


def markdown(labels: DataFrame, questions: DataFrame, pairs: DataFrame | None = None, stamp=None) -> DataFrame:
    """R6: one Markdown text per discipline from R1..R5. ``pairs`` holds (disciplina, id_1, id_2, score)."""
    out = cut_lineage(questions_per_discipline(questions))
    shares = cut_lineage(topic_shares(labels, questions, out))  # one row per topic, read by four sections
    pct = format_pct(F.col("pct"))
    r1 = _lines(shares, ["posicao"], F.concat(F.lit("- **"), "assunto", F.lit(":** "), F.col("n").cast("string"), F.lit(" questões ("), pct, F.lit(")\n")), "_r1")
    samples = sample_questions(shares, labels, questions)
    per_topic = samples.groupBy("disciplina", "assunto").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "ordem", F.concat(F.lit("- Q"), F.col("numero").cast("string"), F.lit(": "), F.substring("enunciado", 1, 100), F.lit("...\n")).alias("l")))),
        lambda s: s["l"]), "").alias("_q"))
    detail = shares.filter("posicao <= 5").join(per_topic, ["disciplina", "assunto"], "left")
    r2 = _lines(detail, ["posicao"], F.concat(
        F.lit("### 2."), F.col("posicao").cast("string"), F.lit(" "), "assunto", F.lit("\n\n**Incidência:** "), F.col("n").cast("string"),
        F.lit(" questões ("), pct, F.lit(")\n\n"), F.coalesce(F.concat(F.lit("**Questões:**\n"), "_q", F.lit("\n")), F.lit(""))), "_r2")
    r5 = _lines(priorities(shares), ["posicao"], F.concat(
        F.col("posicao").cast("string"), F.lit(". **"), "assunto", F.lit("** (Prioridade "), "prioridade", F.lit(")\n   - Incidência: "), "incidencia",
        F.lit("\n   - Tempo sugerido de estudo: "), F.col("horas").cast("string"), F.lit(" horas\n\n")), "_r5")
    for part in (r1, r2, r5):
        out = out.join(part, "disciplina", "left")
    r4 = F.lit("")
    if pairs is not None:
        five = top_per_group(pairs, ["disciplina"], [F.desc("score"), F.col("id_1"), F.col("id_2")], 5, rank="_k")
        text = F.concat(F.lit("### Cluster de Similaridade "), F.col("_k").cast("string"), F.lit("\n- Similaridade: "), format_pct(F.col("score") * 100),
                        F.lit("\n- Questões: "), F.col("id_1").cast("string"), F.lit(" ↔ "), F.col("id_2").cast("string"), F.lit("\n\n"))
        n = pairs.groupBy("disciplina").agg(F.count("*").alias("_np"))
        out = out.join(_lines(five, ["_k"], text, "_r4"), "disciplina", "left").join(n, "disciplina", "left")
        r4 = F.coalesce(F.concat(F.lit("## 3. Padrões e Questões Similares\n\nForam identificados **"), F.col("_np").cast("string"),
                                 F.lit(" pares** de questões com alta similaridade (>75%).\n\n"), "_r4"), F.lit(""))
    when = F.date_format(stamp, "dd/MM/yyyy HH:mm:ss") if stamp is not None else F.lit("-")
    z = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat(
        F.lit("# Análise Detalhada - "), "disciplina", F.lit("\n\n**Data de Geração:** "), when, F.lit("\n**Total de Questões:** "),
        F.col("total").cast("string"), F.lit("\n" + RULE + "## 1. Panorama Geral\n\n### Distribuição por Assunto\n\n"), z("_r1"), F.lit(RULE),
        F.lit("## 2. Análise Detalhada por Assunto\n\n"), z("_r2"), F.lit(RULE), r4, F.lit(RULE),
        F.lit("## 4. Recomendações de Estudo\n\nCom base na análise de incidência, recomenda-se priorizar:\n\n"), z("_r5"), F.lit(RULE))
    return out.select("disciplina", "total", text.alias("markdown"))
