"""Confidence score of an extracted question: five parts, 100 points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provalake.functions.text import not_blank, strip_accents
from provalake.operators.aggregates import confidence_level


def _fold(col: Column) -> Column:
    return strip_accents(F.lower(col))


def confidence(stem: Column, options: Column, answer: Column, discipline: Column, number: Column,
               syllabus: Column | None = None) -> Column:
    """Struct (score, detalhes, nivel). ``syllabus`` is an array of discipline names; null or empty means none."""
    length = F.coalesce(F.length(stem), F.lit(0))
    stem_pts = (
        F.when(length.between(50, 2000), 25)
        .when(length.between(20, 49) | length.between(2001, 5000), 15).otherwise(0))
    n_opt = F.coalesce(F.size(options), F.lit(0))
    keys_ok = F.forall(F.map_keys(options), lambda k: F.position(k, F.lit("ABCDE")) > 0)
    opt_pts = F.when(n_opt.between(4, 5) & keys_ok, 25).when(n_opt.between(3, 5), 15).otherwise(0)
    given = not_blank(answer)
    # an answer counts as clear when it is a run of ABCDE, so "AB" is clear as well
    ans_pts = F.when(F.position(given, F.lit("ABCDE")) > 0, 20).when(given.isNotNull(), 10).otherwise(0)
    disc = not_blank(discipline)
    names = syllabus if syllabus is not None else F.lit(None).cast("array<string>")
    some = F.coalesce(F.size(names), F.lit(0)) > 0
    hit = F.exists(names, lambda e: _fold(e).contains(_fold(disc)) | _fold(disc).contains(_fold(e)))
    disc_pts = F.when(disc.isNull(), 0).when(~some, 10).when(F.coalesce(hit, F.lit(False)), 15).otherwise(5)
    filled = (length > 0) & (n_opt > 0)
    fmt_pts = F.when(filled & number.isNotNull(), 15).when(filled, 10).otherwise(0)
    score = stem_pts + opt_pts + ans_pts + disc_pts + fmt_pts
    parts = {"enunciado_tamanho": stem_pts, "alternativas_validas": opt_pts, "gabarito_claro": ans_pts,
             "disciplina_match": disc_pts, "formato_consistente": fmt_pts}
    return F.struct(score.alias("score"), F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]).alias("detalhes"),
                    confidence_level(score).alias("nivel"))
