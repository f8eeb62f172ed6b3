"""Question extraction over a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provalake.functions import parsing as P
from provalake.functions.once import once
from provalake.functions.text import clean_watermarks, not_blank, trim_all
from provalake.operators.filters import incomplete, review_status, validation_alerts
from provalake.operators.mutations import overlay
from provalake.operators.windows import next_value


def segment_questions(docs: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """One row per question block: number, discipline, topic, header answer and block text."""
    return (
        once(docs.select(key, text), {"_style": P.header_style(F.col(text))})
        .select(key, F.posexplode(P.question_blocks(F.col(text), F.col("_style"))).alias("seq", "q"))
        .select(key, "seq", "q.*"))


def parse_blocks(segments: DataFrame) -> DataFrame:
    """Voided flag, answer, options, stem, alerts and review status of each block."""
    b = F.col("bloco")
    out = once(segments, {
        "anulada": P.block_voided(b), "gabarito": P.block_answer(b, F.col("gabarito_cabecalho")), "alternativas": P.block_options(b)})
    out = once(out, {"enunciado": P.block_stem(b, F.col("alternativas"))})
    out = out.withColumn("alertas", validation_alerts(F.col("enunciado"), F.size("alternativas")))
    return out.withColumn("status_extracao", review_status(F.col("alertas"))).drop("bloco", "gabarito_cabecalho")


def parse_parts(df: DataFrame, text: str) -> DataFrame:
    return once(df, {"_p": P.content_parts(F.col(text))}).select(*df.columns, "_p.*")


def page_text(pages: DataFrame, by: str = "doc", max_pages: int | None = None, marker: str = "PAGINA") -> DataFrame:
    """The pages of each document joined in page order, each under a page marker; all, unless ``max_pages`` asks for the first ones."""
    numbered = pages.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("page")))
    kept = numbered if max_pages is None else numbered.filter(F.col("_n") <= max_pages)
    line = F.concat(F.lit(f"\n--- {marker} "), F.col("_n").cast("string"), F.lit(" ---\n"), clean_watermarks(F.col("text")))
    return kept.select(by, F.struct("_n", line.alias("t")).alias("_p")).groupBy(by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["t"]), "").alias("full_text"),
        F.count("*").alias("paginas"))


def split_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Page rows of a text with ``<!-- page n -->`` markers, marks of emphasis removed, plus the page count."""
    marks = F.regexp_count(F.col(text), F.lit("<!-- page"))
    pages = F.when(marks > 0, marks).otherwise(F.floor(F.length(text) / 3000) + 1).cast("int")
    return docs.select(key, pages.alias("total_paginas"), F.posexplode(F.split(text, r"<!-- page \d+ -->")).alias("pagina", "t")).select(
        key, "total_paginas", "pagina", trim_all(F.regexp_replace("t", r"[#*_`]", "")).alias("texto"))


def orphan_content(questions: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "full_text", min_chars: int = 30,
                   only: DataFrame | None = None) -> DataFrame:
    """Cleaned text between a question's header and the next number's header, where longer than ``min_chars``.

    ``only`` restricts the work to some (document, number) keys before any text is joined in.
    """
    nxt = next_value(questions, [key], "numero", "_next").filter("_next IS NOT NULL")
    if only is not None:
        nxt = nxt.join(only.select(key, "numero").distinct(), [key, "numero"], "left_semi")
    # Fixed patterns: header to header, then page marks, a running foot line and a leading page number are dropped.
    n, m = F.col("numero").cast("string"), F.col("_next").cast("string")
    pat = F.concat(F.lit(r"(?isuU)Quest[ãa]o\s*"), n, F.lit(r"\s*(?:\([^)]+\))?\s*(.*?)Quest[ãa]o\s*"), m)
    raw = trim_all(F.try_element_at(F.regexp_extract_all(F.col(text), pat, F.lit(1)), F.lit(1)))
    c = F.regexp_replace(raw, r"(?U)---\s*PAGINA\s*\d+\s*---", " ")
    c = F.regexp_replace(c, r"(?iuU)T[ée]cnico\s+Universit[áa]rio\s*-?\s*\d*", "")
    c = F.regexp_replace(c, r"(?U)^\s*\d+\s+", "")
    c = trim_all(F.regexp_replace(c, r"(?U)\s+", " "))
    found = once(nxt.join(docs.select(key, text), key), {"conteudo": c})
    return found.select(key, "numero", "conteudo").filter(F.length("conteudo") > min_chars)


def repair_incomplete(questions: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """Replace incomplete questions by what a second reading of the source text yields, when that is complete."""
    broken = questions.filter(incomplete(F.col("alternativas"), F.col("enunciado"))).filter("numero IS NOT NULL")
    content = orphan_content(questions, docs, key, text, only=broken)
    again = parse_parts(broken.drop("enunciado", "alternativas").join(content, [key, "numero"]), "conteudo")
    again = again.filter((F.size("alternativas") >= 4) & not_blank(F.col("enunciado")).isNotNull())
    again = again.filter(~incomplete(F.col("alternativas"), F.col("enunciado")))
    good = again.withColumns({"status_extracao": F.lit("repaired"), "fonte": F.lit("regex_repair")})
    base = questions if "fonte" in questions.columns else questions.withColumn("fonte", F.lit(None).cast("string"))
    return overlay(base, good.select(*base.columns), [key, "seq", "numero"])


def detect_headers(docs: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    return docs.select(key, F.inline(P.header_lines(F.col(text))))


def locate_questions(questions: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    return once(questions.join(docs.select(key, text), key), {"pos": P.question_position(F.col(text), F.col("numero"))}).drop(text)


def assign_disciplines(questions: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """Discipline of the last header line before each question; a question with none keeps its own.

    Headers live in the document row, so the as-of look-up is an array filter rather than a join.
    """
    d = docs.select(key, text, P.header_lines(F.col(text)).alias("_h"))
    pos = P.question_position(F.col(text), F.col("numero"))
    out = once(questions.join(d, key), {"_pos": pos})
    found = F.try_element_at(F.filter("_h", lambda h: h["pos"] < F.col("_pos")), F.lit(-1))["disciplina"]
    return out.withColumn("disciplina", F.coalesce(found, F.col("disciplina"))).drop(text, "_h", "_pos")
