"""Matching disciplines and topics by name: syllabus filter and tiered count look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provalake import constants as C
from provalake.functions.once import once
from provalake.functions.text import canonical_discipline, first_word, normalize_discipline, normalize_name, not_blank
from provalake.session import stored


def alias_map() -> Column:
    """Fixed name -> accepted spellings, as one map literal."""
    return F.create_map(*[x for k, v in C.DISCIPLINE_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def matches_any(name: Column, syllabus: Column) -> Column:
    """Does a normalized discipline match one of the normalized syllabus names (an array)?

    Tried: equal, one inside the other, alias, reverse alias. A syllabus names a few dozen disciplines, so the
    names travel with the syllabus row and no pair of rows is ever formed to compare substrings.
    """
    empty = F.array().cast("array<string>")
    aliases = F.coalesce(F.try_element_at(alias_map(), name), empty)
    return (
        F.exists(syllabus, lambda s: s.contains(name) | name.contains(s))
        | F.arrays_overlap(aliases, syllabus)
        | F.exists(syllabus, lambda s: F.array_contains(F.coalesce(F.try_element_at(alias_map(), s), empty), name))
    )


def match_flag(discipline: Column, syllabus: Column) -> Column:
    """Keep a question? All of them where the syllabus names nothing, else those whose discipline matches."""
    raw = not_blank(discipline)
    hit = F.coalesce(matches_any(normalize_discipline(raw), syllabus), F.lit(False))
    return F.when(F.coalesce(F.size(syllabus), F.lit(0)) == 0, True).when(raw.isNull(), False).otherwise(hit)


def match_relation(disciplines: DataFrame, syllabi: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, disciplina, match) for every distinct discipline of a scope.

    ``disciplines`` holds (scope, disciplina); ``syllabi`` holds (scope, nomes: array of normalized names). A scope
    without syllabus names keeps everything, including rows without a discipline.
    """
    names = disciplines.select(*scope, "disciplina").distinct()
    out = names.join(syllabi.select(*scope, "nomes"), scope, "left")
    return out.select(*scope, "disciplina", match_flag(F.col("disciplina"), F.col("nomes")).alias("match"))


def match_disciplines(questions: DataFrame, syllabi: DataFrame, scope: list[str]) -> DataFrame:
    """Questions with a ``match`` flag. Only distinct names are compared; questions join back on the name."""
    rel = match_relation(questions, syllabi, scope)
    r = rel.select(*[F.col(c).alias(f"_r_{c}") for c in scope], F.col("disciplina").alias("_r_disciplina"), "match")
    cond = questions["disciplina"].eqNullSafe(r["_r_disciplina"])
    for c in scope:
        cond = cond & (questions[c] == r[f"_r_{c}"])
    return questions.join(r, cond, "left").drop("_r_disciplina", *[f"_r_{c}" for c in scope])


def kept(questions: DataFrame, syllabi: DataFrame, scope: list[str]) -> DataFrame:
    return match_disciplines(questions, syllabi, scope).filter("match").drop("match")


def removed(questions: DataFrame, syllabi: DataFrame, scope: list[str]) -> DataFrame:
    """Questions that no syllabus discipline accounts for."""
    return match_disciplines(questions, syllabi, scope).filter(~F.coalesce("match", F.lit(False))).drop("match")


def filter_stats(questions: DataFrame, syllabi: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope: rows before, kept, removed, and removed rows by discipline. Names are counted first, then matched."""
    label = F.coalesce(not_blank(F.col("disciplina")), F.lit(C.NO_DISCIPLINE))
    named = questions.groupBy(*scope, "disciplina").agg(F.count("*").alias("n")).join(syllabi.select(*scope, "nomes"), scope, "left")
    per_name = once(named, {"match": match_flag(F.col("disciplina"), F.col("nomes"))}).groupBy(*scope, label.alias("d"), "match").agg(F.sum("n").alias("n"))
    gone = F.struct("d", "n")
    return per_name.groupBy(*scope).agg(
        F.sum("n").alias("total_original"), F.coalesce(F.sum(F.when(F.col("match"), F.col("n"))), F.lit(0)).alias("total_filtrado"),
        F.coalesce(F.sum(F.when(~F.col("match"), F.col("n"))), F.lit(0)).alias("total_removido"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("match"), gone)))).alias("disciplinas_removidas"))


def canonical_audit(df: DataFrame, col: str = "disciplina") -> DataFrame:
    """Per distinct raw spelling: canonical name, affected rows, and whether it changes (a dry run)."""
    raw = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("original")).agg(F.count("*").alias("linhas"))
    return raw.withColumn("canonico", canonical_discipline(F.col("original"))).withColumn(
        "muda", F.col("canonico") != F.col("original"))


def canonicalize(df: DataFrame, col: str = "disciplina") -> DataFrame:
    """Replace spellings by canonical names: a narrow projection, so a frequent name is no hot key."""
    return once(df, {"_name": F.coalesce(canonical_discipline(F.col(col)), F.lit(""))}).withColumn(col, F.col("_name")).drop("_name")


def lookup_counts(nodes: DataFrame, counts: DataFrame, name: str, scope: list[str], prefix_tier: bool = True,
                  raw: Column | None = None, out: str = "count") -> DataFrame:
    """Count for each node name, by the first tier that answers: raw name, normalized name, same first word.

    ``counts`` holds (scope, ``key``, ``n``). Each tier is an equi-join on a relation with one row per key, so a
    tier never multiplies rows. The normalized tier takes the smallest raw key; the prefix tier adds all keys
    that share the first word. ``raw`` selects the counts the first tier may use (one row per raw key). Every tier
    reads the counts, so they are computed once; scopes share their names, so each name is normalized once.
    """
    counts = stored(counts.select(*scope, "key", "n"), "counts")
    names = once(counts.select(F.col("key").alias("_key")).distinct(), {"_norm": normalize_name(F.col("_key"))})
    names = stored(names.withColumn("_first", first_word(F.col("_norm"))), "names")
    c = counts.join(names, F.col("key").eqNullSafe(F.col("_key")))
    by_norm = c.groupBy(*scope, "_norm").agg(F.min_by("n", F.struct("key", "n")).alias("_n_norm"))
    by_first = c.filter("_first IS NOT NULL").groupBy(*scope, "_first").agg(F.sum("n").alias("_n_first"))
    res = nodes.withColumn("_norm", normalize_name(F.col(name))).withColumn("_first", first_word(F.col("_norm")))
    tiers = []
    if raw is not None:
        res = res.join(counts.filter(raw).select(*scope, F.col("key").alias(name), F.col("n").alias("_n_raw")), [*scope, name], "left")
        tiers.append(F.col("_n_raw"))
    res = res.join(by_norm, [*scope, "_norm"], "left")
    tiers.append(F.col("_n_norm"))
    if prefix_tier:
        res = res.join(by_first, [*scope, "_first"], "left")
        tiers.append(F.col("_n_first"))
    return res.withColumn(out, F.coalesce(*tiers, F.lit(0)).cast("long")).drop("_norm", "_first", "_n_raw", "_n_norm", "_n_first")
