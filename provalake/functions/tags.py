"""Classification levels as display tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provalake.functions.text import not_blank

LEVELS = ["disciplina", "assunto", "topico", "subtopico"]


def classification_tags(compact: bool = False) -> Column:
    """Non-empty levels as structs (nivel, rotulo, confianca as whole percent; none for zero or missing)."""
    tags = []
    for level in LEVELS[:3] if compact else LEVELS:
        conf = F.col(f"confianca_{level}") if level != "subtopico" else F.lit(None).cast("double")
        pct = F.nullif(F.floor(conf * 100 + 0.5).cast("int"), F.lit(0))
        tags.append(F.when(not_blank(F.col(level)).isNotNull(), F.struct(
            F.lit(level).alias("nivel"), F.col(level).alias("rotulo"), pct.alias("confianca"))))
    return F.array_compact(F.array(*tags))


def compact_tags(tags: Column) -> Column:
    return F.slice(tags, 1, 2)


def hidden_tags(tags: Column) -> Column:
    return F.greatest(F.size(tags) - 2, F.lit(0))


def sorted_options(options: Column) -> Column:
    return F.array_sort(F.map_entries(options))
