"""Flagship job: questions per syllabus node of every project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.operators.taxonomy import flatten_taxonomy, incidence_tree


def discipline_counts(questions: DataFrame) -> DataFrame:
    """(projeto_id, disciplina, n) for questions that carry their project."""
    return questions.filter("disciplina IS NOT NULL").groupBy("projeto_id", "disciplina").agg(F.count("*").alias("n"))


def topic_counts(labels: DataFrame) -> DataFrame:
    """Distinct classified questions per (projeto_id, disciplina, assunto).

    A question has few labels, so its duplicates go first and the count itself is a plain partial aggregate.
    """
    uniq = labels.filter("assunto IS NOT NULL").select("projeto_id", "disciplina", "assunto", "questao_id").distinct()
    return uniq.groupBy("projeto_id", "disciplina", "assunto").agg(F.count("*").alias("n"))


def incidence(projects: DataFrame, syllabi: DataFrame, questions: DataFrame, labels: DataFrame, scoped: bool = False) -> DataFrame:
    """Node rows for every project that is linked to a syllabus; zero counts are kept."""
    links = projects.filter("edital_id IS NOT NULL").select("projeto_id", "edital_id")
    nodes = flatten_taxonomy(syllabi)
    return incidence_tree(nodes, links, discipline_counts(questions), topic_counts(labels), scoped=scoped)
