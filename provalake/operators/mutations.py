"""Table changes as whole-table transformations: upsert, patch, cascade delete, link, overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.operators.windows import keep_first


def upsert_natural_key(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing rows plus incoming rows whose natural key is new. Null key parts compare as equal."""
    fresh = keep_first(incoming, keys, [F.col(c) for c in order])
    old = existing.select(*[F.col(c).alias(f"_k_{c}") for c in keys])
    cond = None
    for c in keys:
        test = fresh[c].eqNullSafe(old[f"_k_{c}"])
        cond = test if cond is None else cond & test
    return existing.unionByName(fresh.join(old, cond, "left_anti"), allowMissingColumns=True)


def delete_cascade(exams: DataFrame, questions: DataFrame, labels: DataFrame, doomed: DataFrame) -> tuple[DataFrame, ...]:
    """Remaining exams, questions and classifications, and the number of questions removed per exam."""
    gone = questions.join(doomed, "prova_id", "left_semi")
    return (
        exams.join(doomed, "prova_id", "left_anti"),
        questions.join(doomed, "prova_id", "left_anti"),
        labels.join(gone.select("questao_id"), "questao_id", "left_anti"),
        gone.groupBy("prova_id").agg(F.count("*").alias("removidas")),
    )


def update_patch(base: DataFrame, patch: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Set only supplied fields. ``patch.campos`` lists them, so an explicit null differs from an absent field."""
    p = patch.select(F.col(on), F.col("campos").alias("_campos"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    pick = {c: F.when(F.array_contains("_campos", c), F.col(f"_p_{c}")).otherwise(F.col(c)) for c in columns}
    return base.join(p, on, "left").withColumns(pick).select(*base.columns)


def link_edital(projects: DataFrame, syllabi: DataFrame, links: DataFrame) -> DataFrame:
    """Attach a syllabus to a project: copy board and year, and move on to collecting once it names disciplines."""
    from provalake.operators.taxonomy import has_taxonomy

    return (
        links.join(projects.select("projeto_id", "nome"), "projeto_id")
        .join(syllabi.select("edital_id", "banca", "ano", "taxonomia"), "edital_id")
        .select("projeto_id", "nome", "edital_id", "banca", "ano",
                F.when(has_taxonomy(F.col("taxonomia")), "coletando").otherwise("configurando").alias("status"))
    )


def overlay(base: DataFrame, patch: DataFrame, on: list[str]) -> DataFrame:
    """Whole rows of ``patch`` replace the base rows with the same key."""
    rest = [c for c in base.columns if c not in on]
    p = patch.select(*on, F.struct(*rest).alias("_new"))
    row = F.coalesce("_new", F.struct(*rest))
    return base.join(p, on, "left").select(*on, row.alias("_row")).select(*on, "_row.*").select(*base.columns)


def stack(*dfs: DataFrame) -> DataFrame:
    """Append batches; columns missing from one of them become null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page of rows, each with the count before slicing."""
    total = df.agg(F.count("*")).scalar()
    return page(df, order, limit, offset).withColumn("total", total)
