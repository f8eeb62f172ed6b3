"""Equi, semi, anti, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provalake.operators.scan_order import carry_last, next_in_key
from provalake.operators.windows import keep_first


def enrich_questions(questions: DataFrame, exams: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Question, its exam's name and year, and its first classification as a struct."""
    out = questions.join(exams.select("prova_id", F.col("nome").alias("prova_nome"), F.col("ano").alias("prova_ano")),
                         "prova_id", "left")
    if labels is None:
        return out
    first = primary_classification(labels)
    fields = [c for c in first.columns if c not in ("questao_id", "prova_id")]
    return out.join(first.select("questao_id", F.struct(*fields).alias("classificacao")), "questao_id", "left")


def primary_classification(labels: DataFrame, order: list[str] | None = None) -> DataFrame:
    return keep_first(labels, ["questao_id"], [F.col(c) for c in (order or ["disciplina", "assunto"])])


def class_question(labels: DataFrame, questions: DataFrame) -> DataFrame:
    return labels.join(questions, "questao_id", "inner")


def project_list(projects: DataFrame, syllabi: DataFrame, status: str | None = None) -> DataFrame:
    """Projects with their syllabus id, name and whether it holds any discipline."""
    from provalake.operators.taxonomy import has_taxonomy

    if status:
        projects = projects.filter(F.col("status") == status)
    right = syllabi.select("edital_id", F.col("nome").alias("edital_nome"), has_taxonomy(F.col("taxonomia")).alias("_has"))
    return projects.join(right, "edital_id", "left").withColumn("has_taxonomia", F.coalesce("_has", F.lit(False))).drop("_has")


def restrict(df: DataFrame, ids: DataFrame, on: list[str] | str, how: str = "left_semi") -> DataFrame:
    """Rows whose key is (``left_semi``) or is not (``left_anti``) in ``ids``."""
    return df.join(ids, on, how)


def asof_last(points: DataFrame, marks: DataFrame, by: list[str], pos: str, value: str, strict: bool = True,
              fallback: Column | None = None) -> DataFrame:
    """For each point the value of the last mark before it. ``strict`` ignores a mark at the same position."""
    point_rank, mark_rank = (0, 1) if strict else (1, 0)
    p = points.withColumns({"_mark": F.lit(None).cast(marks.schema[value].dataType), "_kind": F.lit(point_rank)})
    m = marks.select(*by, pos, F.col(value).alias("_mark"), F.lit(mark_rank).alias("_kind"), F.lit(True).alias("_is_mark"))
    both = p.withColumn("_is_mark", F.lit(False)).unionByName(m, allowMissingColumns=True)
    out = carry_last(both, by, [pos, "_kind"], "_mark", "_found").filter(~F.col("_is_mark"))
    found = F.col("_found") if fallback is None else F.coalesce("_found", fallback)
    return out.withColumn(value, found).drop("_mark", "_kind", "_is_mark", "_found")


def segments(marks: DataFrame, by: list[str], start: str, length: str) -> DataFrame:
    """Each mark with the position where its segment ends: the next mark, or one past the end of the text."""
    return next_in_key(marks, by, [start], start, "_next").withColumn(
        "fim", F.coalesce("_next", F.col(length) + 1)).drop("_next")
