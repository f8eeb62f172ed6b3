"""Coverage, trend, alerts and mergeable distinct counts."""

from pyspark.sql import functions as F

from provalake.catalog.ctes import with_
from provalake.catalog.registry import query
from provalake.operators import aggregates as G
from provalake.operators import taxonomy as T
from provalake.sources import adapters as A


@query("coverage_share", with_("v_nodes", "v_class", extra={
    "leaf": "SELECT n.* FROM v_nodes n WHERE NOT EXISTS (SELECT 1 FROM v_nodes k WHERE k.edital_id = n.edital_id AND starts_with(k.node_path, n.node_path || '.'))",
    "c": "SELECT DISTINCT disciplina, assunto AS texto, 1 AS hit FROM v_class WHERE assunto IS NOT NULL",
    "h": "SELECT leaf.edital_id, leaf.node_path, coalesce(hit, 0) AS hit FROM leaf LEFT JOIN c USING (disciplina, texto)"}) + """
 SELECT n.edital_id, n.node_path, n.depth, n.texto, count(*) AS folhas, sum(hit)::BIGINT AS cobertas, round(sum(hit) / count(*), 6) AS parcela
 FROM v_nodes n JOIN h ON h.edital_id = n.edital_id AND (h.node_path = n.node_path OR starts_with(h.node_path, n.node_path || '.')) GROUP BY ALL""")
def coverage_share(spark, sf):
    covered = A.classificacoes(spark, sf).filter("assunto IS NOT NULL").select("disciplina", F.col("assunto").alias("texto")).distinct()
    out = T.coverage_share(T.flatten_taxonomy(A.editais(spark, sf)), covered)
    return out.withColumns({"node_path": F.array_join(F.col("node_path").cast("array<string>"), "."), "parcela": F.round("parcela", 6)})


@query("topic_trend", with_("v_qp", extra={
    "c": "SELECT banca, assunto_pci, ano, count(*) AS n FROM v_qp WHERE assunto_pci IS NOT NULL GROUP BY ALL",
    "g": "SELECT banca, assunto_pci, unnest(range((SELECT min(ano) FROM c), (SELECT max(ano) FROM c) + 1))::INT AS ano FROM (SELECT DISTINCT banca, assunto_pci FROM c)",
    "f": "SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (banca, assunto_pci, ano)",
    "s": "SELECT banca, assunto_pci, regr_slope(n, ano) AS m, arg_min(ano, -n * 10000 + ano) AS top FROM f GROUP BY ALL"}) + """
 SELECT banca, assunto_pci, ano, n, round(m, 6) AS inclinacao, n - lag(n) OVER w AS variacao, round(avg(n) OVER (PARTITION BY banca, assunto_pci ORDER BY ano ROWS 2 PRECEDING), 6) AS media_movel,
 ano = top AS pico FROM f JOIN s USING (banca, assunto_pci) WINDOW w AS (PARTITION BY banca, assunto_pci ORDER BY ano)""")
def topic_trend(spark, sf):
    """Questions a year of each board and topic, years without any included."""
    q = A.questoes_provas(spark, sf).filter("assunto_pci IS NOT NULL")
    out = G.topic_trend(G.counts(q, ["banca", "assunto_pci", "ano"]), ["banca", "assunto_pci"])
    return out.withColumns({"inclinacao": F.round("inclinacao", 6), "media_movel": F.round("media_movel", 6)})


GROUPS = {"g": "SELECT banca, assunto_pci, count(*) AS n, count(*) FILTER (WHERE {0}) AS k FROM v_qp WHERE assunto_pci IS NOT NULL GROUP BY ALL", "b": "SELECT banca, sum(k) / sum(n) AS base FROM g GROUP BY 1"}


def groups_of(event):
    return {k: v.format(event) for k, v in GROUPS.items()}


@query("alert_voided", with_("v_qp", extra=groups_of("anulada")) + """SELECT banca, assunto_pci, n, k AS ocorrencias, round(n * base, 6) AS esperado, round(base, 6) AS base, round((k + 20 * base) / (n + 20), 6) AS taxa
 FROM g JOIN b USING (banca) WHERE k >= 5 AND (k + 20 * base) / (n + 20) >= 1.05 * base""")
def alert_voided(spark, sf):
    """Topics with more voided questions than their board usually has."""
    q = A.questoes_provas(spark, sf).filter("assunto_pci IS NOT NULL")
    out = G.rate_alerts(q, ["banca"], "assunto_pci", "anulada", factor=1.05)
    return out.withColumns({c: F.round(c, 6) for c in ("esperado", "base", "taxa")})


@query("alert_never_hard", with_("v_qp", extra=groups_of("confianca_score >= 100 AND numero = 7")) + "SELECT banca, assunto_pci, n, round(n * base, 6) AS esperado, round(base, 6) AS base FROM g JOIN b USING (banca) WHERE k = 0 AND n * base >= 1")
def alert_never_hard(spark, sf):
    """Topics that are asked often and never as the seventh question with a score of the highest band."""
    q = A.questoes_provas(spark, sf).filter("assunto_pci IS NOT NULL")
    out = G.absence_alerts(q, ["banca"], "assunto_pci", "confianca_score >= 100 AND numero = 7", expected=1.0)
    return out.withColumns({c: F.round(c, 6) for c in ("esperado", "base")})


@query("distinct_sketch_union", with_("v_qp") + "SELECT banca, count(DISTINCT questao_id) AS exato, TRUE AS perto_do_todo, TRUE AS erro_ate_2_por_cento FROM v_qp GROUP BY 1")
def distinct_sketch_union(spark, sf):
    """Distinct questions of each board from sketches a board and year: the union tells within a hundredth what one sketch of the whole does (that one counts in
    the order of arrival, a union can't)."""
    q = A.questoes_provas(spark, sf)
    merged = G.merged_distinct(G.distinct_sketches(q, ["banca", "ano"], "questao_id", 16), ["banca"])
    whole = G.merged_distinct(G.distinct_sketches(q, ["banca"], "questao_id", 16), ["banca"]).withColumnRenamed("n_estimado", "_todo")
    exact = q.groupBy("banca").agg(F.count_distinct("questao_id").alias("exato"))
    near = F.abs(F.col("n_estimado") - F.col("exato")) <= 0.02 * F.col("exato")
    return exact.join(merged, "banca").join(whole, "banca").select("banca", "exato", (F.abs(F.col("n_estimado") - F.col("_todo")) <= 0.01 * F.col("exato")).alias("perto_do_todo"), near.alias("erro_ate_2_por_cento"))
