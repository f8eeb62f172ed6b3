"""Composite jobs: extraction, vectors, chunk analysis, synthesis, verification, and all of them in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provalake.functions.once import once
from provalake.functions.scoring import confidence
from provalake.functions.text import normalize_discipline
from provalake.operators import aggregates as G
from provalake.operators import filters as X
from provalake.operators import findings as FD
from provalake.operators import evidence as EV
from provalake.operators import matching as N
from provalake.operators import parsing as P
from provalake.operators import vectors as V
from provalake.operators import windows as W
from provalake.plans.requests import chunk_requests
from provalake.session import cut_lineage, stored

Infer = Callable[[DataFrame], DataFrame]


def extract(docs: DataFrame, syllabi: DataFrame, scope: list[str], key: str = "doc_id", text: str = "full_text") -> tuple[DataFrame, DataFrame]:
    """Texts to scored questions that fit the syllabus, and the per-exam roll-up.

    ``docs`` carries the scope columns of ``syllabi`` (scope, nomes).
    """
    q = P.parse_blocks(P.segment_questions(docs, key, text))
    names = docs.select(key, *[c for c in scope if c != key]).join(syllabi, scope, "left")
    q = X.drop_essays(q.join(names, key, "left"))
    q = once(q, {"_s": confidence(F.col("enunciado"), F.col("alternativas"), F.col("gabarito"), F.col("disciplina"), F.col("numero"), F.col("nomes"))})
    q = q.withColumns({"confianca_score": F.col("_s.score"), "nivel": F.col("_s.nivel")}).drop("_s")
    best = W.dedupe_most_complete(q, W.completeness(F.size("alternativas"), F.col("enunciado")), F.col("seq"), [key, "numero"])
    # the names are on the row already: testing here keeps the parsing to one pass
    kept = best.filter(N.match_flag(F.col("disciplina"), F.transform(F.coalesce("nomes", F.array().cast("array<string>")), normalize_discipline))).drop("nomes")
    return kept, G.exam_rollup(kept.withColumnRenamed(key, "prova_id"))


def vectorize(questions: DataFrame, text: Column, threshold: float = 0.85, k: int = 20, model=None) -> dict[str, DataFrame]:
    """Vectors of the question texts, density clusters and the most similar pairs. Vectors are computed once, and dealt into blocks once."""
    vecs = cut_lineage(V.embed(questions.select(F.col("questao_id").alias("id"), text.alias("_t")), "_t", model).drop("_t"))
    distinct, members = V.with_copies(vecs)
    blocks = V.vector_blocks(distinct, threshold, also="n")
    return {"vectors": vecs, "clusters": cut_lineage(V.density_cluster(vecs, threshold, found=(distinct, members, blocks))),
            "pairs": V.top_pairs(vecs, threshold, k, V.block_pairs(blocks), members)}


def map_chunks(questions: DataFrame, infer: Infer, by: list[str], order: list[str], size: int = 20) -> tuple[DataFrame, DataFrame]:
    """Chunk requests through an inference table to typed digests; unreadable answers come back separately."""
    requests = chunk_requests(W.chunk_rows(questions, by, order, size), by)
    return FD.parse_digests(infer(requests))


def reduce_findings(digests: DataFrame, passes: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """Votes, histograms, recommendations and report text from chunk digests and synthesis passes.

    ``passes``: (by, pass_no, patterns, report_text, study_recommendations).
    """
    p = passes.select(*by, "pass_no", F.posexplode("patterns").alias("seq", "p")).select(
        *by, "pass_no", "seq", "p.type", "p.description", F.explode_outer("p.evidence_ids").alias("evidence_id"))
    # a pattern with several evidence ids is still one vote
    votes = p.withColumn("_first", F.row_number().over(_per_pattern(by)) == 1)
    analysis = FD.question_analysis(digests, by)
    recs = passes.select(*by, "pass_no", F.posexplode_outer("study_recommendations").alias("i", "texto")).withColumn(
        "seq", F.col("pass_no").cast("decimal(28,0)") * F.lit(2**31) + F.coalesce("i", F.lit(0)))  # pass first, then place, for any number of either
    order = F.struct("pass_no", "seq")
    return {
        "patterns": FD.vote(votes.filter("_first"), order, tuple(by)).drop("n_evidence"),
        "evidence": FD.evidence_rows(p.filter("evidence_id IS NOT NULL"), tuple(by)),
        "difficulty": FD.difficulty_histogram(analysis, by), "traps": FD.trap_histogram(analysis, by),
        "recommendations": FD.recommendations(recs, by, "texto", "seq"),
        "report": FD.report_concat(passes, by, ["pass_no"], "report_text"),
    }


def _per_pattern(by: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*by, "pass_no", "seq").orderBy("evidence_id")


def verify(reports: DataFrame, claims: DataFrame, pool: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None,
           by: str = "report_id", min_overlap: int = 3) -> dict[str, DataFrame]:
    """Evidence, verdicts, counts and flagged reports.

    ``judge`` maps (claim, best overlap) rows to ``is_verified``; by default a claim stands when its best evidence
    shares at least ``min_overlap`` words.
    """
    evidence = EV.claim_evidence(claims, pool, by)
    best = evidence.filter("rank = 1").select(by, "claim_no", "overlap")
    checked = claims.join(best, [by, "claim_no"], "left")
    verdicts = judge(checked) if judge else checked.withColumn("is_verified", F.coalesce(F.col("overlap") >= min_overlap, F.lit(False)))
    return {"evidence": evidence, "verdicts": verdicts, "rollup": FD.verify_rollup(verdicts, [by]), "reports": FD.flag_report(reports, verdicts, by)}


@dataclass
class PhaseRun:
    """Outcome of a run: tables per phase, phases done, errors per phase, overall status."""

    tables: dict[str, object] = field(default_factory=dict)
    completed: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def status(self) -> str:
        if not self.errors:
            return "completed"
        return "completed_with_errors" if self.completed else "failed"


def materialized(result: object) -> object:
    """The same result with every table in it written to the shared folder, so that failures at run time show here. Tables are packed
    by column: one of very many short rows takes a fraction of the room of a checkpoint, which only what Parquet can't hold still gets."""
    if isinstance(result, DataFrame):
        names = [c.lower() for c in result.columns]
        return stored(result, "fase") if len(set(names)) == len(names) > 0 and "void" not in result.schema.simpleString() else cut_lineage(result)
    if isinstance(result, dict):
        return {k: materialized(v) for k, v in result.items()}
    if isinstance(result, tuple):
        return tuple(materialized(v) for v in result)
    return result


def run_phases(phases: list[tuple[str, list[str], Callable[[dict], object]]], skip: tuple[str, ...] = ()) -> PhaseRun:
    """Run named phases in order. Each lists the phases whose tables it needs, and its own tables are written before it counts
    as completed. A phase that fails is recorded and the ones that need it are skipped with an error; phases to skip are left out."""
    run = PhaseRun()
    for name, needs, step in phases:
        if name in skip:
            continue
        missing = [n for n in needs if n not in run.tables]
        if missing:
            run.errors[name] = "missing input: " + ", ".join(missing)
            continue
        try:
            run.tables[name] = materialized(step(run.tables))
            run.completed.append(name)
        except Exception as error:  # recorded per phase; the run goes on
            run.errors[name] = str(error)[:500]
    return run


def canonicalize(df: DataFrame, col: str = "disciplina") -> tuple[DataFrame, DataFrame]:
    """Audit of the spellings that change, and the table with canonical names."""
    return N.canonical_audit(df, col).filter("muda"), N.canonicalize(df, col)
