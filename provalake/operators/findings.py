"""Analysis findings: chunk digests, votes, histograms, verification and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provalake import constants as C
from provalake import schemas
from provalake.functions.jsontext import parse_responses
from provalake.functions.text import not_blank
from provalake.operators.scan_order import running_sums


def parse_digests(df: DataFrame, col: str = "response") -> tuple[DataFrame, DataFrame]:
    """Chunk answers to typed digests with defaults; unreadable answers go to quarantine."""
    good, bad = parse_responses(df, col, schemas.CHUNK_DIGEST)
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t.simpleString()))
    return good.withColumns({
        "chunk_digest": F.coalesce("chunk_digest", F.lit("")),
        "patterns_found": empty("patterns_found", schemas.CHUNK_DIGEST["patterns_found"].dataType),
        "questions_analysis": empty("questions_analysis", schemas.CHUNK_DIGEST["questions_analysis"].dataType)}), bad


def question_analysis(digests: DataFrame, keep: list[str]) -> DataFrame:
    """One row per analysed question, with the defaults of missing fields."""
    q = digests.select(*keep, F.inline("questions_analysis"))
    return q.select(*keep, F.coalesce("id", F.lit("")).alias("questao_id"), F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
                    F.coalesce("difficulty_reasoning", F.lit("")).alias("difficulty_reasoning"),
                    F.coalesce("bloom_level", F.lit("understand")).alias("bloom_level"),
                    F.coalesce("has_trap", F.lit(False)).alias("has_trap"), "trap_description")


def digest_patterns(digests: DataFrame, keep: list[str]) -> DataFrame:
    return digests.select(*keep, F.posexplode("patterns_found").alias("seq", "p")).select(*keep, "seq", "p.*")


def digest_lines(digests: DataFrame) -> DataFrame:
    """One line per chunk: summary and its patterns."""
    found = F.array_join(F.transform("patterns_found", lambda p: F.concat(p["type"], F.lit(": "), p["description"])), "; ")
    text = F.when(F.size("patterns_found") > 0, found).otherwise(C.NO_PATTERN)
    return digests.withColumn("linha", F.concat(F.lit("- Chunk "), "chunk_id", F.lit(": "), "chunk_digest", F.lit(" | Padroes: "), text))


def difficulty_histogram(analysis: DataFrame, by: list[str] | None = None) -> DataFrame:
    return analysis.groupBy(*(by or []), "difficulty").agg(F.count("*").alias("n"))


def trap_histogram(analysis: DataFrame, by: list[str] | None = None) -> DataFrame:
    traps = analysis.filter(F.col("has_trap") & not_blank(F.col("trap_description")).isNotNull())
    return traps.groupBy(*(by or []), F.substring("trap_description", 1, 30).alias("trap")).agg(F.count("*").alias("n"))


def vote_confidence(votes: Column, high: int = 3, medium: int = 2) -> Column:
    return F.when(votes >= high, "high").when(votes >= medium, "medium").otherwise("low")


def vote(patterns: DataFrame, order: Column, by: tuple[str, ...] = (), key_chars: int = 50, high: int = 3, medium: int = 2) -> DataFrame:
    """Findings of all passes grouped by type and the start of the description, with votes and confidence.

    Evidence is counted here and listed by ``evidence_rows``, so a finding with very many ids stays one small row.
    """
    key = F.substring(F.coalesce("description", F.lit("")), 1, key_chars).alias("key")
    kind = F.coalesce("type", F.lit("unknown")).alias("type")
    p = patterns.select(*by, kind, key, F.coalesce("description", F.lit("")).alias("_d"), order.alias("_o"), "evidence_id", "pass_no")
    return p.groupBy(*by, "type", "key").agg(
        F.min_by("_d", "_o").alias("description"), F.count("*").alias("votes"),
        F.count_distinct("evidence_id").alias("n_evidence"),
        F.count_distinct("pass_no").alias("distinct_passes"),
    ).withColumn("confidence", vote_confidence(F.col("votes"), high, medium))


def evidence_rows(patterns: DataFrame, by: tuple[str, ...] = (), key_chars: int = 50) -> DataFrame:
    """Distinct evidence ids of each finding, one row per id."""
    return patterns.select(*by, F.coalesce("type", F.lit("unknown")).alias("type"),
                           F.substring(F.coalesce("description", F.lit("")), 1, key_chars).alias("key"), "evidence_id").distinct()


def recommendations(rows: DataFrame, by: list[str], text: str, seq: str) -> DataFrame:
    """Order-preserving unique recommendations; a group with none gets the default text."""
    uniq = rows.filter(not_blank(F.col(text)).isNotNull()).groupBy(*by, text).agg(F.min(seq).alias("ordem"))
    none = rows.select(*by).distinct().join(uniq, by, "left_anti").select(
        *by, F.lit(C.NO_RECOMMENDATION).alias(text), F.lit(0).cast(uniq.schema["ordem"].dataType).alias("ordem"))
    return uniq.unionByName(none)


def report_concat(passes: DataFrame, by: list[str], order: list[str], text: str, limit: int | None = None, rule: str = "\n\n---\n\n") -> DataFrame:
    """Non-empty pass texts joined with a rule line; whole, unless ``limit`` asks for the first so many characters.

    With a limit, only texts whose leading rule line begins before the cut are gathered; a running length finds them.
    """
    used = passes.filter(not_blank(F.col(text)).isNotNull())
    if limit is not None:
        ran = running_sums(used, by, order, {"_end": F.length(text).cast("long") + len(rule)})
        used = ran.filter(F.col("_end") - F.length(text) - 2 * len(rule) < limit)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda s: s["_t"])
    whole = used.groupBy(*by).agg(F.array_join(parts, rule).alias("texto"))
    return whole if limit is None else whole.withColumn("texto", F.substring("texto", 1, limit))


def verify_rollup(claims: DataFrame, by: list[str]) -> DataFrame:
    return claims.groupBy(*by).agg(F.count("*").alias("original_claims"), F.count_if("is_verified").alias("verified_claims"),
                                   F.count_if(~F.col("is_verified")).alias("rejected_claims"))


def flag_report(reports: DataFrame, claims: DataFrame, by: str = "report_id") -> DataFrame:
    """Reports with a warning list of all their rejected claims in front: the list is part of the report's text."""
    line = F.concat(F.lit("- "), F.substring("claim", 1, 100), F.lit("..."))
    bad = claims.filter(~F.col("is_verified")).groupBy(by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", line.alias("l")))), lambda s: s["l"]), "\n").alias("_w"))
    text = F.concat(F.lit(C.WARNING_HEAD), F.col("_w"), F.lit("\n\n---\n\n"), F.col("texto"))
    return reports.join(bad, by, "left").withColumn("texto", F.coalesce(text, F.col("texto"))).drop("_w")


def job_result_row(jobs: DataFrame) -> DataFrame:
    """Result view of a job from its JSON columns: sizes and defaults instead of missing parts."""
    size_of = lambda c: F.coalesce(F.size(F.from_json(F.col(c), "array<string>")), F.lit(0))
    report = F.from_json("analysis_report", "disciplina string, total_questoes int, temporal_patterns array<string>,"
                         "similarity_patterns array<string>, study_recommendations array<string>")
    checked = F.from_json("verified_report", "original_claims int, verified_claims int, rejected_claims int")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return jobs.withColumns({"_r": report, "_v": checked}).select(
        "job_id", "status", size_of("similar_pairs").alias("similar_pairs_count"), size_of("chunk_digests").alias("chunk_digests_count"),
        F.col("_r").isNotNull().alias("has_report"), F.coalesce("_r.disciplina", "disciplina").alias("disciplina"),
        F.coalesce("_r.total_questoes", "total_questoes").alias("total_questoes"),
        zero(F.size("_r.temporal_patterns")).alias("n_temporal"), zero(F.size("_r.similarity_patterns")).alias("n_similarity"),
        zero(F.size("_r.study_recommendations")).alias("n_recomendacoes"),
        zero(F.col("_v.original_claims")).alias("original_claims"), zero(F.col("_v.verified_claims")).alias("verified_claims"),
        zero(F.col("_v.rejected_claims")).alias("rejected_claims"))
