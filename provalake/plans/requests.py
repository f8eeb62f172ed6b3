"""Request tables for an external inference system: one text per question or chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.functions.text import estimate_tokens, prune_context


def classification_requests(questions: DataFrame, outlines: DataFrame) -> DataFrame:
    """Classification request per question with the outline of its syllabus (edital_id, texto)."""
    q = questions.join(outlines.select("edital_id", F.col("texto").alias("_outline")), "edital_id", "left")
    parts = [
        F.lit("Classifique a questão de concurso segundo o conteúdo programático.\n\nTAXONOMIA:\n"), F.coalesce("_outline", F.lit("(sem taxonomia)")),
        F.lit("\n\nQUESTÃO:\nDisciplina: "), F.coalesce("disciplina", F.lit("não informada")), F.lit("\nEnunciado: "), prune_context(F.col("enunciado")),
        F.lit("\nGabarito: "), F.coalesce("gabarito", F.lit("não informado")), F.lit("\n\nResponda em JSON com disciplina, assunto, topico e subtopico."),
    ]
    out = q.withColumn("prompt", F.concat(*parts)).drop("_outline")
    return out.withColumn("tokens", estimate_tokens(F.col("prompt")))


def chunk_requests(chunked: DataFrame, by: list[str]) -> DataFrame:
    """One request per chunk: its questions as a JSON list. Chunks hold a fixed number of rows."""
    item = F.struct(F.col("questao_id").alias("id"), "enunciado", "gabarito")
    body = chunked.groupBy(*by, "chunk_id").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(item))).alias("_body"))
    return body.withColumn("prompt", F.concat(F.lit("Analise as questões e devolva JSON com chunk_digest, patterns_found e questions_analysis.\n"), "_body")).drop("_body")
