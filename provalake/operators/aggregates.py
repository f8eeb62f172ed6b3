"""Counts, shares and roll-ups. All are hash aggregates with map-side partials, so a hot key costs one partial row
per task. Grand totals are scalar subqueries over counts that were computed once, so the base table is read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provalake import constants as C
from provalake.functions.text import not_blank
from provalake.session import cut_lineage


def counts(df: DataFrame, by: list[str], null_label: str | None = None, distinct: str | None = None,
           universe: DataFrame | None = None) -> DataFrame:
    """Rows (or distinct ``distinct`` values) per key. Null keys are dropped unless labelled; a ``universe`` keeps zeros."""
    if null_label is not None:
        df = df.withColumns({c: F.coalesce(not_blank(F.col(c)), F.lit(null_label)) for c in by})
    else:
        df = df.dropna(subset=by)
    measure = F.count_distinct(distinct) if distinct else F.count("*")
    out = df.groupBy(*by).agg(measure.alias("n"))
    if universe is None:
        return out
    return universe.join(out, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def share(count: Column, total: Column) -> Column:
    """Percentage; zero when there is nothing to divide by."""
    return F.when(total == 0, F.lit(0.0)).otherwise(count / total * 100)


def distribution(df: DataFrame, by: str, digits: int = 6) -> DataFrame:
    n = cut_lineage(df.groupBy(F.col(by).alias("categoria")).agg(F.count("*").alias("n")))
    total = n.agg(F.sum("n")).scalar()
    return n.withColumn(
        "percentual", F.round(share(F.col("n"), total), digits)).orderBy(F.desc("n"), "categoria")


def incidence_rollup(questions: DataFrame, discipline: Column, topic: Column, digits: int = 6) -> DataFrame:
    """Two-level tree as rows: discipline totals (nivel 0) and topics (nivel 1), shares of the grand total."""
    q = questions.select(discipline.alias("disciplina"), topic.alias("assunto"))
    rows = cut_lineage(q.rollup("disciplina", "assunto").agg(F.count("*").alias("n"), F.grouping_id().alias("_g")))
    total = rows.filter("_g = 3").select("n").scalar()
    return rows.filter("_g < 3").select("disciplina", "assunto", F.when(F.col("_g") == 0, 1).otherwise(0).alias("nivel"), "n",
                       F.round(share(F.col("n"), total), digits).alias("percentual"))


def dashboard_stats(q: DataFrame, k: int = 10) -> DataFrame:
    """Totals, discipline counts, top topics with shares, and counts per year as (secao, chave, n, pct) rows.

    One pass: grouping sets compute every section from a single scan.
    """
    base = q.select(
        F.coalesce(not_blank(F.col("disciplina")), F.lit(C.NO_DISCIPLINE)).alias("d"),
        F.coalesce(not_blank(F.col("assunto_pci")), F.lit(C.NO_TOPIC)).alias("t"),
        F.col("ano").alias("y"), F.coalesce("anulada", F.lit(False)).alias("a"))
    cube = base.groupingSets([[F.col("d")], [F.col("t")], [F.col("y")], [F.col("a")]],
                             F.col("d"), F.col("t"), F.col("y"), F.col("a")).agg(
        F.count("*").alias("n"), F.grouping_id("d", "t", "y", "a").alias("g"))
    # grouping_id bits: 7 -> d, 11 -> t, 13 -> y, 14 -> a
    key = (F.when(F.col("g") == 7, F.col("d")).when(F.col("g") == 11, F.col("t"))
           .when(F.col("g") == 13, F.col("y").cast("string")).otherwise(F.when(F.col("a"), "anuladas").otherwise("regulares")))
    section = (F.when(F.col("g") == 7, "disciplina").when(F.col("g") == 11, "assunto")
               .when(F.col("g") == 13, "ano").otherwise("status"))
    rows = cut_lineage(cube.select(section.alias("secao"), key.alias("chave"), "n"))
    total = rows.filter("secao = 'status'").agg(F.sum("n")).scalar()
    rank = F.row_number().over(Window.partitionBy("secao").orderBy(F.desc("n"), "chave"))
    topics = rows.filter("secao = 'assunto'").withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")
    others = rows.filter("secao <> 'assunto'")
    return topics.unionByName(others).withColumn("pct", F.round(share(F.col("n"), total), 6))


def distinct_sorted(df: DataFrame, col: str, desc: bool = False) -> DataFrame:
    return df.select(col).distinct().orderBy(F.desc(col) if desc else F.col(col))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("primeiro"), F.count("*").alias("n")).orderBy("primeiro", key)


def year_topic(df: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """Year by topic counts in long form; with a given topic list, in wide form."""
    base = df.select("ano", F.coalesce(not_blank(F.col("assunto_pci")), F.lit(C.NO_TOPIC)).alias("assunto"))
    if topics is not None:
        return base.groupBy("ano").pivot("assunto", topics).agg(F.count(F.lit(1))).na.fill(0)
    return base.groupBy("ano", "assunto").agg(F.count("*").alias("n"))


def year_summary(df: DataFrame) -> DataFrame:
    """Years covered, busiest year, mean per year, distinct topics."""
    both = cut_lineage(year_topic(df))
    topics = both.agg(F.count_distinct("assunto")).scalar()
    per_year = both.groupBy("ano").agg(F.sum("n").alias("n"))
    return per_year.agg(
        F.count("*").alias("anos"), F.max_by("ano", F.struct(F.col("n"), -F.col("ano"))).alias("ano_maior"),
        F.round(F.sum("n") / F.count("*"), 1).alias("media_ano"),
    ).withColumn("assuntos", topics)


def exam_rollup(questions: DataFrame) -> DataFrame:
    return questions.groupBy("prova_id").agg(
        F.count("*").alias("total"), F.count_if("anulada").alias("anuladas"),
        F.round(F.avg(F.coalesce("confianca_score", F.lit(50))), 6).alias("confianca_media"))


def with_exam_rollup(exams: DataFrame, questions: DataFrame) -> DataFrame:
    """Roll-up for every exam; one without questions has mean zero."""
    return exams.join(exam_rollup(questions), "prova_id", "left").na.fill(0, ["total", "anuladas", "confianca_media"])


def apply_counters(projects: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch's per-exam totals (projeto_id, batch_id, total, anuladas) to project counters.

    ``lotes`` lists batches already counted, so a replayed batch changes nothing.
    """
    inc = batch.groupBy("projeto_id", "batch_id").agg(
        F.count("*").alias("_p"), F.sum("total").alias("_t"), F.sum("anuladas").alias("_a"))
    fresh = inc.join(projects.select("projeto_id", "lotes"), "projeto_id").filter(~F.array_contains("lotes", F.col("batch_id")))
    add = fresh.groupBy("projeto_id").agg(F.sum("_p").alias("_p"), F.sum("_t").alias("_t"), F.sum("_a").alias("_a"),
                                          F.collect_set("batch_id").alias("_l"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return projects.join(add, "projeto_id", "left").select(
        "projeto_id", (F.col("total_provas") + z("_p")).alias("total_provas"),
        (F.col("total_questoes") + z("_t")).alias("total_questoes"), (F.col("total_anuladas") + z("_a")).alias("total_anuladas"),
        (F.col("total_questoes_validas") + z("_t") - z("_a")).alias("total_questoes_validas"),
        F.array_union("lotes", F.coalesce("_l", F.array().cast("array<string>"))).alias("lotes"))


def batch_outcome(results: DataFrame, by: list[str]) -> DataFrame:
    """Per batch: files, succeeded, failed, questions, and whether any file succeeded."""
    ok = F.col("success")
    return results.groupBy(*by).agg(
        F.count("*").alias("arquivos"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("falhas"),
        F.coalesce(F.sum(F.when(ok, F.col("total_questoes"))), F.lit(0)).alias("questoes"), F.bool_or(ok).alias("sucesso"))


def project_totals(projects: DataFrame) -> DataFrame:
    z = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return projects.agg(z("total_provas"), z("total_questoes"))


def project_counts(projects: DataFrame, exams: DataFrame, questions: DataFrame) -> DataFrame:
    """Exam and question counters per project (zero kept). Questions are first counted per exam."""
    per_exam = questions.groupBy("prova_id").agg(F.count("*").alias("t"), F.count_if("anulada").alias("a"))
    per_project = exams.join(per_exam, "prova_id", "left").groupBy("projeto_id").agg(
        F.count("*").alias("total_provas"), F.sum("t").alias("total_questoes"), F.sum("a").alias("total_anuladas"))
    out = projects.select("projeto_id").join(per_project, "projeto_id", "left").na.fill(0)
    return out.withColumn("total_questoes_validas", F.col("total_questoes") - F.col("total_anuladas"))


def project_stats(projects: DataFrame, exams: DataFrame, questions: DataFrame) -> DataFrame:
    """Counters, exams per year, questions per discipline and the ready flag, one row per project.

    The two maps hold one entry per distinct year or discipline, already aggregated, so their size is bounded by
    the number of distinct names.
    """
    years = exams.filter(F.coalesce("ano", F.lit(0)) != 0).groupBy("projeto_id", "ano").agg(F.count("*").alias("n")).groupBy("projeto_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("ano", "n")))).alias("provas_por_ano"))
    discs = counts(
        questions.join(exams.select("prova_id", "projeto_id"), "prova_id").withColumn(
            "disciplina", F.coalesce(not_blank(F.col("disciplina")), F.lit(C.NO_DISCIPLINE))),
        ["projeto_id", "disciplina"]).groupBy("projeto_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("disciplina", "n")))).alias("questoes_por_disciplina"))
    base = project_counts(projects, exams, questions)
    return base.join(years, "projeto_id", "left").join(discs, "projeto_id", "left").withColumn(
        "pronto_para_analise", ready(F.col("total_questoes_validas"), F.coalesce(F.size("provas_por_ano"), F.lit(0))))


def ready(valid: Column, years: Column) -> Column:
    return (valid >= 10) & (years >= 1)


def ready_flags(projects: DataFrame, exams: DataFrame, questions: DataFrame) -> DataFrame:
    n_years = exams.filter(F.coalesce("ano", F.lit(0)) != 0).groupBy("projeto_id").agg(F.count_distinct("ano").alias("anos"))
    return project_counts(projects, exams, questions).join(n_years, "projeto_id", "left").select(
        "projeto_id", ready(F.col("total_questoes_validas"), F.coalesce("anos", F.lit(0))).alias("pronto"),
        (F.col("total_questoes") >= 5).alias("analisavel"))


def global_counts(syllabi: DataFrame, questions: DataFrame, labels: DataFrame) -> DataFrame:
    """Table totals and the classified share by rows and by distinct questions."""
    q = questions.agg(F.count("*")).scalar()
    lab = labels.agg(F.count("*").alias("classificacoes"), F.count_distinct("questao_id").alias("_d"))
    pct = lambda c: F.when(q == 0, F.lit(0.0)).otherwise(F.round(c / q * 100, 1))
    return lab.select(
        syllabi.agg(F.count("*")).scalar().alias("editais"), q.alias("questoes"), "classificacoes",
        pct(F.col("classificacoes")).alias("pct_classificadas"), pct(F.col("_d")).alias("pct_distintas"))


def queue_summary(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    s = F.col("queue_status")
    done = s.isin(C.COMPLETED_STATES)
    aggs = [
        F.count_if(done).alias("completed"), F.count_if(s.isin(C.PROCESSING_STATES)).alias("processing"),
        F.count_if(s == "pending").alias("pending"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "partial").alias("need_review"),
        F.coalesce(F.sum(F.when(done, F.col("total_questoes"))), F.lit(0)).alias("total_questoes"), F.count("*").alias("total")]
    return items.groupBy(*by).agg(*aggs) if by else items.agg(*aggs)


def exam_status(exams: DataFrame, scored: DataFrame) -> DataFrame:
    """Status of each exam from the confidence level of its questions; an exam without questions fails."""
    per = scored.groupBy("prova_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("nivel") == "baixa").alias("_low"), F.avg("score").alias("_avg"))
    n, low = F.coalesce("_n", F.lit(0)), F.coalesce("_low", F.lit(0))
    status = F.when(n == 0, "failed").when(low == 0, "completed").when(low < n, "partial").otherwise("failed")
    return exams.join(per, "prova_id", "left").select(
        "prova_id", status.alias("status"), F.when(n == 0, "NO_QUESTIONS").alias("error_code"), n.alias("questoes_count"),
        low.alias("questoes_revisao"), F.round(F.coalesce("_avg", F.lit(0.0)), 6).alias("confianca_media"))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 80, "alta").when(score >= 50, "media").otherwise("baixa")


def years_covered(questions_with_year: DataFrame, by: list[str]) -> DataFrame:
    return questions_with_year.filter(F.coalesce("ano", F.lit(0)) != 0).groupBy(*by).agg(
        F.array_sort(F.collect_set("ano")).alias("anos"))


def analysis_summary(jobs: DataFrame, questions_with_project: DataFrame) -> DataFrame:
    """Progress of the analysis per project over all its runs."""
    done, running = F.col("status") == "completed", F.col("status") == "running"
    total = questions_with_project.groupBy("projeto_id").agg(F.count_distinct("disciplina").alias("disciplinas_total"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    agg = jobs.groupBy("projeto_id").agg(
        F.count_distinct(F.when(done, F.col("disciplina"))).alias("disciplinas_analisadas"),
        F.coalesce(F.sum(F.when(done, F.col("total_questoes"))), F.lit(0)).alias("questoes_analisadas"),
        F.coalesce(F.sum(F.when(done, z("n_padroes"))), F.lit(0)).alias("padroes_encontrados"),
        F.coalesce(F.sum(F.when(done, z("n_recomendacoes"))), F.lit(0)).alias("recomendacoes"),
        F.count_if(running).alias("_running"), F.max("created_at").alias("last_updated"))
    status = (
        F.when(F.col("_running") > 0, "running").when(F.col("disciplinas_analisadas") == 0, "pending")
        .when(F.col("disciplinas_analisadas") < z("disciplinas_total"), "partial").otherwise("completed"))
    return agg.join(total, "projeto_id", "left").withColumns(
        {"status": status, "disciplinas_total": z("disciplinas_total")}).drop("_running")


def topic_trend(counts: DataFrame, by: list[str], year: str = "ano", value: str = "n", span: int = 3) -> DataFrame:
    """Yearly counts of each key with the missing years as zero, the slope of the whole line, the change against the year before, the
    moving mean of `span` years, and the peak.

    ``counts`` has one row for each key and year at most; the years run from the first to the last of all rows. A key has as many
    rows as there are years, so its window is small.
    """
    first, last = counts.agg(F.min(year)).scalar(), counts.agg(F.max(year)).scalar()
    years = counts.select(*by).distinct().select(*by, F.explode(F.sequence(first, last)).alias(year))
    line = years.join(counts.select(*by, year, value), [*by, year], "left").withColumn(value, F.coalesce(value, F.lit(0)).cast("long"))
    key = Window.partitionBy(*by)
    order = key.orderBy(year)
    moving = order.rowsBetween(-(span - 1), 0)
    peak = F.first(year).over(key.orderBy(F.desc(value), year).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return line.withColumns({
        "inclinacao": F.regr_slope(F.col(value).cast("double"), F.col(year).cast("double")).over(key),
        "variacao": F.col(value) - F.lag(value).over(order), "media_movel": F.avg(value).over(moving), "pico": F.col(year) == peak})


def rate_alerts(rows: DataFrame, by: list[str], group: str, event: str, strength: float = 20.0, factor: float = 1.5, least: int = 5) -> DataFrame:
    """Groups in which an event is more frequent than the baseline of their keys: n, count, expected, baseline, and the shrunken rate.

    The rate of a group is drawn to the baseline as if `strength` more rows had it, so a small group needs more to stand out. An
    alert is a shrunken rate of `factor` times the baseline with `least` events or more. Two aggregates; the second reads the first.
    """
    groups = rows.groupBy(*by, group).agg(F.count("*").alias("n"), F.count_if(F.expr(event)).alias("ocorrencias"))
    base = groups.groupBy(*by).agg((F.sum("ocorrencias") / F.sum("n")).alias("base"))
    joined = groups.join(base, by)
    rate = (F.col("ocorrencias") + strength * F.col("base")) / (F.col("n") + strength)
    out = joined.withColumns({"esperado": F.col("n") * F.col("base"), "taxa": rate})
    return out.filter((F.col("ocorrencias") >= least) & (F.col("taxa") >= factor * F.col("base")))


def absence_alerts(rows: DataFrame, by: list[str], group: str, event: str, expected: float = 3.0) -> DataFrame:
    """Groups in which an event never happens although the baseline of their keys would give `expected` or more: n, expected, baseline."""
    groups = rows.groupBy(*by, group).agg(F.count("*").alias("n"), F.count_if(F.expr(event)).alias("_k"))
    base = groups.groupBy(*by).agg((F.sum("_k") / F.sum("n")).alias("base"))
    out = groups.filter("_k = 0").join(base, by).withColumn("esperado", F.col("n") * F.col("base"))
    return out.filter(F.col("esperado") >= expected).drop("_k")


def distinct_sketches(rows: DataFrame, by: list[str], col: str, precision: int = 12) -> DataFrame:
    """One mergeable sketch of the distinct values of a column for each key; stored, it serves any union of keys later."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(col, precision).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Estimated distinct values for coarser keys, from sketches alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_estimado"))
