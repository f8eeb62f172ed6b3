"""Row filters, validation rules and routing decisions (projections only: no shuffle)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provalake import constants as C
from provalake.functions.text import not_blank, trim_all


def filter_questions(df: DataFrame, status: str = "todas", years: Iterable[int] = (), boards: Iterable[str] = (),
                     discipline: str | None = None) -> DataFrame:
    """Voided status, years, boards and discipline; an empty choice does not filter."""
    if status == "regulares":
        df = df.filter(~F.coalesce("anulada", F.lit(False)))
    elif status == "anuladas":
        df = df.filter("anulada")
    years, boards = list(years), list(boards)
    if years:
        df = df.filter(F.col("ano").isin(years))
    if boards:
        df = df.filter(F.col("banca").isin(boards))
    return by_discipline(df, discipline)


def by_discipline(df: DataFrame, discipline: str | None) -> DataFrame:
    return df if not discipline or discipline == "all" else df.filter(F.col("disciplina") == discipline)


def by_prefix(df: DataFrame, prefix: str | None = None, topic: str | None = None) -> DataFrame:
    """Case-insensitive discipline prefix, taken literally, and an exact topic."""
    if prefix:
        df = df.filter(F.startswith(F.lower("disciplina"), F.lower(F.lit(prefix))))
    return df.filter(F.col("assunto_pci") == topic) if topic else df


def text_search(df: DataFrame, term: str) -> DataFrame:
    return df.filter(F.lower("enunciado").contains(term.lower()) | F.col("numero").cast("string").contains(term))


def drop_essays(df: DataFrame) -> DataFrame:
    name = trim_all(F.lower(F.coalesce("disciplina", F.lit(""))))
    return df.filter(~name.isin(C.ESSAY_DISCIPLINES))


def drop_essay_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.filter(~(F.upper(text).contains("REDAÇÃO") & F.lower(text).contains("dissertativo")))


def filled_options(options: Column) -> Column:
    """Number of options with visible text."""
    return F.coalesce(F.size(F.map_filter(options, lambda k, v: F.length(trim_all(v)) > 0)), F.lit(0))


def incomplete(options: Column, stem: Column) -> Column:
    return (F.when(options.isNull(), F.lit(0)).otherwise(filled_options(options)) < 5) | (
        F.length(F.coalesce(stem, F.lit(""))) < 20)


def validation_alerts(stem: Column, n_options: Column, strict: bool = True) -> Column:
    wrong = (n_options != 5) if strict else (n_options < 2)
    return F.array_compact(F.array(
        F.when(F.length(stem) < 10, F.lit(C.SHORT_STEM_ALERT)),
        F.when(wrong, F.concat(F.lit(C.OPTIONS_ALERT), n_options.cast("string"))),
    ))


def review_status(alerts: Column) -> Column:
    return F.when(F.size(alerts) > 0, "revisar_manual").otherwise("ok")


def rule_violations(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks; a rule over a null value is not broken."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def question_rules() -> dict[str, Column]:
    return {
        "numero": F.col("numero") >= 1,
        "gabarito": F.col("gabarito").rlike("^[A-E]$"),
        "ano": F.col("ano").between(1900, 2100),
        "enunciado": F.length("enunciado") >= 1,
    }


def classification_rules() -> dict[str, Column]:
    return {c: F.col(c).between(0, 1) for c in
            ("confianca_disciplina", "confianca_assunto", "confianca_topico", "confianca_subtopico")}


def split_by_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("violations", rule_violations(rules))
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def document_code(min_length: int = 1000) -> Column:
    """First failing rule of a document facts row; null when it may be processed."""
    return (
        F.when(~F.col("exists"), "FILE_NOT_FOUND")
        .when(~F.lower("path").endswith(".pdf"), "NOT_PDF")
        .when(~F.col("opens"), "CORRUPTED")
        .when(F.col("encrypted"), "PASSWORD_PROTECTED")
        .when(F.col("has_images") & (F.col("text_length") < 100 * F.col("page_count")), "SCANNED_PDF")
        .when(F.col("text_length") < min_length, "INSUFFICIENT_TEXT")
    )


def document_format(text: Column) -> Column:
    """Question paper with answers, bare answer key, or generic paper."""
    # Fixed patterns: marks of an answered paper, of question content, and of a bare answer key.
    hits = lambda *ps: sum((text.rlike(p).cast("int") for p in ps[1:]), text.rlike(ps[0]).cast("int"))
    paper = hits(r"\d+\.\s*\[.*?\]", r"Resposta:\s*[A-E]", r"(?i)ANULADA", r"(?i)PCI\s+Concursos")
    content = (
        text.rlike(r"[A-E]\)\s*.{15,}") | text.rlike(r"[A-E]\.\s+.{15,}")
        | text.rlike(r"[A-E]\s*[-–]\s*.{15,}") | text.rlike(r"(?iu)Quest[aã]o\s+\d+")
    )
    key = hits(r"(?i)gabarito", r"(?m)\d+[.\-\s]+[A-E]\s*$", r"(?ium)Quest[aã]o\s+\d+:\s*[A-E]\s*$")
    return (
        F.when((paper >= 2) | ((paper >= 1) & content), "PCI")
        .when((key >= 1) & ~content, "GABARITO").otherwise("PROVA_GENERICA")
    )


def document_type_ok(expected: str) -> Column:
    return (F.col("tipo") == "desconhecido") | (F.col("confianca") < 0.6) | (F.col("tipo") == expected)


def quality_tier(good: float = 0.80, fixable: float = 0.60) -> Column:
    return (
        F.when(F.col("quality") >= good, "docling")
        .when((F.col("quality") >= fixable) & (F.coalesce("corrected_quality", F.lit(0.0)) >= good), "text_llm")
        .otherwise("vision_llm")
    )


def image_shape() -> Column:
    ratio = F.col("width") / F.col("height")
    return (
        F.when((ratio > 0.8) & (ratio < 1.2) & (F.col("width") < 800), "figura_geometrica")
        .when((ratio > 1.5) | (ratio < 0.7), "grafico").otherwise("generico")
    )


def first_filled(*cols: Column, default: str | None = None) -> Column:
    """First value that is neither null nor the empty string."""
    tail = [F.lit(default)] if default is not None else []
    return F.coalesce(*[not_blank(c) for c in cols], *tail)


def start_guard(requests: DataFrame, exams: DataFrame, questions: DataFrame, jobs: DataFrame, min_questions: int = 5) -> DataFrame:
    """Why an analysis request (projeto_id, disciplina) is refused; null means it may start."""
    n_exams = exams.groupBy("projeto_id").agg(F.count("*").alias("n_provas"))
    # a request names a discipline or none: count once per (project, discipline), roll up for the project
    per_disc = questions.groupBy("projeto_id", "disciplina").agg(F.count("*").alias("n"))
    total = per_disc.groupBy("projeto_id").agg(F.sum("n").alias("n_total"))
    running = jobs.filter("status = 'running'").select("projeto_id", "disciplina").distinct().withColumn("busy", F.lit(True))
    n = F.coalesce(F.when(F.col("disciplina").isNull(), F.col("n_total")).otherwise(F.col("n")), F.lit(0))
    reason = (
        F.when(F.coalesce("n_provas", F.lit(0)) == 0, "sem_provas")
        .when(n < min_questions, "questoes_insuficientes")
        .when(F.coalesce("busy", F.lit(False)), "em_execucao")
    )
    return (
        requests.join(n_exams, "projeto_id", "left").join(per_disc, ["projeto_id", "disciplina"], "left")
        .join(total, "projeto_id", "left").join(running, ["projeto_id", "disciplina"], "left")
        .select("projeto_id", "disciplina", n.cast("long").alias("n_questoes"), reason.alias("motivo"), reason.isNull().alias("aceito"))
    )


def error_to_state(error: Column) -> Column:
    """Rate-limit errors are retried, any other error fails the item."""
    limited = F.lower(error).rlike("rate|429|limit")
    return F.struct(
        F.when(limited, "retry").otherwise("failed").alias("queue_status"),
        F.when(limited, "RATE_LIMIT").otherwise("PROCESSING_ERROR").alias("error_code"),
        F.when(~limited, F.substring(error, 1, 500)).alias("queue_error"),
    )


def retry_selection(items: DataFrame, action: str) -> DataFrame:
    """Rows a retry or cancel command acts on, with the state they move to."""
    states = {"retry": (["failed"], "retry"), "cancel": (C.CANCELLABLE_EXAM_STATES, "failed"),
              "cancel_job": (C.CANCELLABLE_JOB_STATES, "cancelled")}[action]
    column = "status" if action == "cancel_job" else "queue_status"
    return items.filter(F.col(column).isin(states[0])).withColumn("novo_status", F.lit(states[1]))


def progress_label(p: Column) -> Column:
    return (
        F.when(p == 0, "Iniciando...").when(p < 20, "Extraindo texto...").when(p < 40, "Detectando questoes...")
        .when(p < 60, "Processando questoes...").when(p < 80, "Classificando...").when(p < 100, "Finalizando...")
        .otherwise("Concluido")
    )


def phase_progress(status: Column, phase: Column, within: Column) -> Column:
    """Overall progress of four equal phases, never below zero."""
    raw = (F.coalesce(phase, F.lit(0)) - 1) * 25 + F.coalesce(within, F.lit(0)) / 100 * 25
    return F.when(status == "completed", 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
