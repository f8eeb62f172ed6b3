"""Scans, table changes, filters and validation."""

from pyspark.sql import functions as F

from provalake.catalog.ctes import with_
from provalake.catalog.registry import query
from provalake.operators import aggregates as G
from provalake.operators import filters as X
from provalake.operators import mutations as M
from provalake.operators import parsing as P
from provalake.sources import adapters as A
from provalake.sources.tables import accept_files, scan

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


@query("scan_tables", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
 WHERE l_shipdate >= TIMESTAMP '2000-01-01 00:00:00' AND l_returnflag = 'R'""")
def scan_tables(spark, sf):
    where = (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R")
    return scan(spark, sf, "lineitem", where, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("page_text_assemble", with_("v_pages") + r"""SELECT doc, max(rn)::BIGINT AS paginas, md5(string_agg(
 concat(chr(10), '--- PAGINA ', rn::VARCHAR, ' ---', chr(10), text), '' ORDER BY rn)) AS texto_md5 FROM (
 SELECT doc, text, row_number() OVER (PARTITION BY doc ORDER BY page) AS rn FROM v_pages) GROUP BY doc""")
def page_text_assemble(spark, sf):
    return P.page_text(A.page_texts(spark, sf)).select("doc", "paginas", F.md5("full_text").alias("texto_md5"))


MARKED_SQL = """SELECT doc_id, concat('<!-- page 1 -->', substring(text, 1, length(text)//2), '<!-- page 2 -->', substring(text, length(text)//2 + 1)) AS md
 FROM documents"""


@query("scan_pages_split", with_(extra={"m": MARKED_SQL, "s": r"SELECT doc_id, string_split_regex(md, '<!-- page \d+ -->') AS p FROM m"}) + f"""
 SELECT doc_id, 2 AS total_paginas, (i - 1)::INT AS pagina, md5({trim_sql("regexp_replace(p[i], '[#*_`]', '', 'g')")}) AS texto_md5
 FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM s)""")
def scan_pages_split(spark, sf):
    half = F.floor(F.length("text") / 2).cast("int")
    md = F.concat(F.lit("<!-- page 1 -->"), F.col("text").substr(F.lit(1), half), F.lit("<!-- page 2 -->"),
                  F.col("text").substr(half + 1, F.length("text")))
    out = P.split_pages(scan(spark, sf, "documents").select("doc_id", md.alias("md")), "doc_id", "md")
    return out.select("doc_id", "total_paginas", "pagina", F.md5("texto").alias("texto_md5"))


@query("upsert_natural_key", with_(extra={
    "ex": "SELECT p_partkey AS edital_id, p_name AS nome, p_brand AS banca, (2000 + p_size)::INT AS ano FROM part",
    "inc": """SELECT nome, banca, ano, min(edital_id) AS edital_id FROM (SELECT p_name AS nome, p_brand AS banca,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE (2000 + l_linenumber * 5)::INT END AS ano, 1000000000 + l_partkey AS edital_id
 FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL"""}) + """SELECT edital_id, nome, banca, ano FROM ex UNION ALL
 SELECT edital_id, nome, banca, ano FROM inc WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.nome IS NOT DISTINCT FROM inc.nome
 AND ex.banca IS NOT DISTINCT FROM inc.banca AND ex.ano IS NOT DISTINCT FROM inc.ano)""")
def upsert_natural_key(spark, sf):
    cols = ["edital_id", "nome", "banca", "ano"]
    incoming = scan(spark, sf, "lineitem").join(scan(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        (F.lit(1000000000) + F.col("l_partkey")).alias("edital_id"), F.col("p_name").alias("nome"), F.col("p_brand").alias("banca"),
        F.when(F.col("l_linenumber") != 7, F.lit(2000) + F.col("l_linenumber") * 5).cast("int").alias("ano"))
    return M.upsert_natural_key(A.editais(spark, sf).select(*cols), incoming, ["nome", "banca", "ano"], ["edital_id"])


@query("delete_cascade", with_("v_provas", "v_questoes") + """SELECT prova_id, count(*) AS removidas FROM v_questoes
 WHERE prova_id IN (SELECT prova_id FROM v_provas WHERE queue_status = 'failed') GROUP BY prova_id""")
def delete_cascade(spark, sf):
    exams = A.provas(spark, sf)
    doomed = exams.filter("queue_status = 'failed'").select("prova_id")
    return M.delete_cascade(exams, A.questoes(spark, sf), A.classificacoes(spark, sf), doomed)[3]


@query("delete_cascade_remaining", with_("v_provas", "v_class") + """SELECT 'provas' AS tabela, count(*) AS n FROM v_provas WHERE queue_status <> 'failed'
 UNION ALL SELECT 'questoes', count(*) FROM v_questoes WHERE prova_id NOT IN (SELECT prova_id FROM v_provas WHERE queue_status = 'failed')
 UNION ALL SELECT 'classificacoes', count(*) FROM v_class WHERE prova_id NOT IN (SELECT prova_id FROM v_provas WHERE queue_status = 'failed')""")
def delete_cascade_remaining(spark, sf):
    exams = A.provas(spark, sf)
    doomed = exams.filter("queue_status = 'failed'").select("prova_id")
    rest = M.delete_cascade(exams, A.questoes(spark, sf), A.classificacoes(spark, sf), doomed)
    count = lambda df, name: df.agg(F.lit(name).alias("tabela"), F.count("*").alias("n"))
    return M.stack(count(rest[0], "provas"), count(rest[1], "questoes"), count(rest[2], "classificacoes"))


@query("update_patch", with_("v_provas") + """SELECT prova_id, CASE WHEN queue_status='retry' THEN concat('novo-', prova_id::VARCHAR) ELSE nome END AS nome,
 CASE WHEN queue_status='failed' THEN NULL ELSE ano END AS ano, fonte FROM v_provas""")
def update_patch(spark, sf):
    base = A.provas(spark, sf)
    patch = base.filter("queue_status IN ('retry', 'failed')").select(
        "prova_id", F.when(F.col("queue_status") == "retry", F.array(F.lit("nome"))).otherwise(F.array(F.lit("ano"))).alias("campos"),
        F.concat(F.lit("novo-"), F.col("prova_id").cast("string")).alias("nome"), F.lit(None).cast("int").alias("ano"))
    return M.update_patch(base, patch, "prova_id", ["nome", "ano"]).select("prova_id", "nome", "ano", "fonte")


@query("link_edital", with_("v_projetos", "v_edital_src") + """SELECT projeto_id, v_projetos.nome, edital_id, p_brand AS banca, (2000 + size::INT)::INT AS ano,
 CASE WHEN shape = 'none' THEN 'configurando' ELSE 'coletando' END AS status FROM v_projetos JOIN v_edital_src USING (edital_id)""")
def link_edital(spark, sf):
    projects = A.projetos(spark, sf)
    return M.link_edital(projects, A.editais(spark, sf), projects.filter("edital_id IS NOT NULL").select("projeto_id", "edital_id"))


# --- filters ---------------------------------------------------------------------------------------------------

@query("filter_status_year_board", with_("v_qp") + """SELECT questao_id, disciplina, ano, banca FROM v_qp WHERE NOT anulada AND ano IN (1996, 1998)
 AND banca IN ('1-URGENT', '5-LOW')""")
def filter_status_year_board(spark, sf):
    return X.filter_questions(A.questoes_provas(spark, sf), "regulares", [1996, 1998], ["1-URGENT", "5-LOW"]).select(
        "questao_id", "disciplina", "ano", "banca")


@query("filter_eq_discipline", with_("v_questoes") + "SELECT questao_id, numero FROM v_questoes WHERE disciplina = 'Matemática'")
def filter_eq_discipline(spark, sf):
    return X.by_discipline(A.questoes(spark, sf), "Matemática").select("questao_id", "numero")


@query("filter_prefix_ci", with_("v_questoes") + """SELECT questao_id, disciplina FROM v_questoes WHERE starts_with(lower(disciplina), lower('LÍNGUA'))
 AND assunto_pci = 'Brand#3'""")
def filter_prefix_ci(spark, sf):
    return X.by_prefix(A.questoes(spark, sf), "LÍNGUA", "Brand#3").select("questao_id", "disciplina")


@query("filter_text_search", with_("v_questoes") + """SELECT questao_id, numero, enunciado FROM v_questoes WHERE contains(lower(enunciado), '7')
 OR contains(numero::VARCHAR, '7')""")
def filter_text_search(spark, sf):
    return X.text_search(A.questoes(spark, sf), "7").select("questao_id", "numero", "enunciado")


@query("filter_essay_sections", with_(extra={"q": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Redação ' WHEN 1 THEN 'DISCURSIVA' WHEN 2 THEN NULL ELSE source END AS disciplina,
 text FROM documents"""}) + """SELECT doc_id, disciplina FROM q WHERE lower(trim(coalesce(disciplina, ''))) NOT IN ('redação','redacao','prova discursiva','discursiva')
 AND NOT (contains(upper(text), 'REDAÇÃO') AND contains(lower(text), 'dissertativo'))""")
def filter_essay_sections(spark, sf):
    d = F.col("doc_id") % 4
    q = scan(spark, sf, "documents").select("doc_id", F.when(d == 0, " Redação ").when(d == 1, "DISCURSIVA").when(
        d == 3, F.col("source")).alias("disciplina"), "text")
    return X.drop_essay_pages(X.drop_essays(q)).select("doc_id", "disciplina")


OPTS_SQL = """SELECT doc_id, text, lang, source, CASE doc_id % 4 WHEN 0 THEN ['A','B','C','D','E'] WHEN 1 THEN ['A','B'] WHEN 2 THEN ['A','B','C','F'] ELSE ['A','B','C','D','E'] END AS ks,
 CASE doc_id % 4 WHEN 0 THEN [source, lang, 'x', 'y', 'z'] WHEN 1 THEN [source, lang] WHEN 2 THEN [source, lang, 'x', ' '] ELSE [source, '  ', '', lang, 'z'] END AS vs FROM documents"""


def options_docs(spark, sf):
    d = F.col("doc_id") % 4
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    five = lit("A", "B", "C", "D", "E")
    keys = F.when(d == 0, five).when(d == 1, lit("A", "B")).when(d == 2, lit("A", "B", "C", "F")).otherwise(five)
    s, g = F.col("source"), F.col("lang")
    vals = F.when(d == 0, F.array(s, g, F.lit("x"), F.lit("y"), F.lit("z"))).when(d == 1, F.array(s, g)).when(
        d == 2, F.array(s, g, F.lit("x"), F.lit(" "))).otherwise(F.array(s, F.lit("  "), F.lit(""), g, F.lit("z")))
    return scan(spark, sf, "documents").select("doc_id", "text", "lang", "source", F.map_from_arrays(keys, vals).alias("alternativas"))


@query("filter_incomplete", with_(extra={"o": OPTS_SQL}) + """SELECT doc_id, len(list_filter(vs, lambda v: length(trim(v, ' ')) > 0)) < 5 OR length(text) < 20 AS incompleta FROM o""")
def filter_incomplete(spark, sf):
    return options_docs(spark, sf).select("doc_id", X.incomplete(F.col("alternativas"), F.col("text")).alias("incompleta"))


@query("map_quality", with_(extra={"o": OPTS_SQL}) + """SELECT doc_id, len(ks)::INT AS n, len(list_filter(ks, lambda k: NOT contains('ABCDE', k))) = 0 AS chaves_ok,
 len(list_filter(vs, lambda v: length(trim(v, ' ')) > 0))::INT AS preenchidas FROM o""")
def map_quality(spark, sf):
    m = F.col("alternativas")
    return options_docs(spark, sf).select("doc_id", F.size(m).alias("n"), F.forall(F.map_keys(m), lambda k: F.lit("ABCDE").contains(k)).alias("chaves_ok"),
                                          X.filled_options(m).alias("preenchidas"))


@query("validate_rules", with_(extra={"o": OPTS_SQL}) + """SELECT doc_id, concat_ws('|', CASE WHEN length(text) < 10 THEN 'Enunciado muito curto' END,
 CASE WHEN len(ks) <> 5 THEN 'Número de alternativas inválido: ' || len(ks)::VARCHAR END) AS alertas,
 CASE WHEN length(text) < 10 OR len(ks) <> 5 THEN 'revisar_manual' ELSE 'ok' END AS status_extracao,
 CASE WHEN length(text) < 10 OR len(ks) < 2 THEN 'revisar_manual' ELSE 'ok' END AS status_tolerante FROM o""")
def validate_rules(spark, sf):
    n, t = F.size("alternativas"), F.col("text")
    alerts = X.validation_alerts(t, n)
    return options_docs(spark, sf).select("doc_id", F.array_join(alerts, "|").alias("alertas"), X.review_status(alerts).alias("status_extracao"),
                                          X.review_status(X.validation_alerts(t, n, strict=False)).alias("status_tolerante"))


@query("validate_schema", with_("v_qp", extra={"c": """SELECT questao_id, concat_ws('|', CASE WHEN NOT (numero >= 2) THEN 'numero' END,
 CASE WHEN NOT regexp_matches(gabarito, '^[A-D]$') THEN 'gabarito' END, CASE WHEN NOT (ano BETWEEN 1994 AND 2100) THEN 'ano' END,
 CASE WHEN NOT (confianca_score / 100.0 BETWEEN 0 AND 0.9) THEN 'confianca' END) AS violations FROM v_qp"""}) + "SELECT * FROM c WHERE violations <> ''")
def validate_schema(spark, sf):
    rules = {"numero": F.col("numero") >= 2, "gabarito": F.col("gabarito").rlike("^[A-D]$"), "ano": F.col("ano").between(1994, 2100),
             "confianca": (F.col("confianca_score") / 100.0).between(0, 0.9)}
    bad = X.split_by_rules(A.questoes_provas(spark, sf), rules)[1]
    return bad.select("questao_id", F.array_join("violations", "|").alias("violations"))


@query("validate_schema_defaults", with_("v_qp", extra={"c": """SELECT count(*) FILTER (WHERE numero >= 1 AND regexp_matches(gabarito, '^[A-E]$')
 AND ano BETWEEN 1900 AND 2100 AND length(enunciado) >= 1) AS validas, count(*) AS total FROM v_qp"""}) + "SELECT validas, total - validas AS quarentena FROM c")
def validate_schema_defaults(spark, sf):
    good, bad = X.split_by_rules(A.questoes_provas(spark, sf), X.question_rules())
    return good.agg(F.count("*").alias("validas")).withColumn("quarentena", bad.agg(F.count("*")).scalar())


@query("validate_unique", with_("v_questoes") + "SELECT prova_id, numero, count(*) AS n FROM v_questoes GROUP BY ALL HAVING count(*) > 1")
def validate_unique(spark, sf):
    return G.counts(A.questoes(spark, sf), ["prova_id", "numero"]).filter("n > 1")


FACTS_SQL = """SELECT doc_id, concat('prova', doc_id::VARCHAR, CASE WHEN doc_id % 11 = 0 THEN '.txt' ELSE '.PDF' END) AS path, doc_id % 17 <> 0 AS exists_, doc_id % 13 <> 0 AS opens,
 doc_id % 19 = 0 AS encrypted, doc_id % 2 = 0 AS has_images, n_chars AS text_length, n_chars // 80 + doc_id % 5 AS page_count FROM documents"""


@query("validate_document", with_(extra={"f": FACTS_SQL}) + """SELECT doc_id, CASE WHEN NOT exists_ THEN 'FILE_NOT_FOUND' WHEN lower(path) NOT LIKE '%.pdf' THEN 'NOT_PDF'
 WHEN NOT opens THEN 'CORRUPTED' WHEN encrypted THEN 'PASSWORD_PROTECTED' WHEN has_images AND text_length < 100 * page_count THEN 'SCANNED_PDF'
 WHEN text_length < 1000 THEN 'INSUFFICIENT_TEXT' END AS codigo FROM f""")
def validate_document(spark, sf):
    k = F.col("doc_id")
    facts = scan(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("prova"), k.cast("string"), F.when(k % 11 == 0, ".txt").otherwise(".PDF")).alias("path"),
        (k % 17 != 0).alias("exists"), (k % 13 != 0).alias("opens"), (k % 19 == 0).alias("encrypted"), (k % 2 == 0).alias("has_images"),
        F.col("n_chars").alias("text_length"), (F.floor(F.col("n_chars") / 80) + k % 5).alias("page_count"))
    return facts.select("doc_id", X.document_code().alias("codigo"))


@query("detect_format", with_(extra={"t": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(text, chr(10), 'Questão 01', chr(10), 'Resposta: B') WHEN 1 THEN concat('GABARITO ', text)
 WHEN 2 THEN concat(text, chr(10), '12. C', chr(10), '13. D') ELSE text END AS t FROM documents""",
 "h": r"""SELECT doc_id, regexp_matches(t, '\d+\.\s*\[.*?\]')::INT + regexp_matches(t, 'Resposta:\s*[A-E]')::INT + regexp_matches(t, '(?i)ANULADA')::INT
 + regexp_matches(t, '(?i)PCI\s+Concursos')::INT AS paper, regexp_matches(t, '[A-E]\)\s*.{15,}') OR regexp_matches(t, '[A-E]\.\s+.{15,}') OR regexp_matches(t, '[A-E]\s*[-–]\s*.{15,}')
 OR regexp_matches(t, '(?i)Quest[aã]o\s+\d+') AS content, regexp_matches(t, '(?i)gabarito') OR regexp_matches(t, '(?m)\d+[.\-\s]+[A-E]\s*$')
 OR regexp_matches(t, '(?im)Quest[aã]o\s+\d+:\s*[A-E]\s*$') AS akey FROM t"""}) + """SELECT doc_id, CASE WHEN paper >= 2 OR (paper >= 1 AND content) THEN 'PCI'
 WHEN akey AND NOT content THEN 'GABARITO' ELSE 'PROVA_GENERICA' END AS formato FROM h""")
def detect_format(spark, sf):
    d, t = F.col("doc_id") % 4, F.col("text")
    text = F.when(d == 0, F.concat(t, F.lit("\nQuestão 01\nResposta: B"))).when(d == 1, F.concat(F.lit("GABARITO "), t)).when(
        d == 2, F.concat(t, F.lit("\n12. C\n13. D"))).otherwise(t)
    return scan(spark, sf, "documents").select("doc_id", X.document_format(text).alias("formato"))


@query("doc_type_gate", """SELECT doc_id, tipo, aceito FROM (SELECT doc_id, tipo, tipo = 'desconhecido' OR confianca < 0.6 OR tipo = 'prova' AS aceito FROM (
 SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'desconhecido' WHEN 1 THEN 'edital' WHEN 2 THEN 'prova' ELSE 'conteudo_programatico' END AS tipo,
 (doc_id % 100) / 100.0::DOUBLE AS confianca FROM documents))""")
def doc_type_gate(spark, sf):
    d = F.col("doc_id") % 4
    docs = scan(spark, sf, "documents").select("doc_id", F.when(d == 0, "desconhecido").when(d == 1, "edital").when(d == 2, "prova").otherwise(
        "conteudo_programatico").alias("tipo"), (F.col("doc_id") % 100 / 100.0).alias("confianca"))
    return docs.select("doc_id", "tipo", X.document_type_ok("prova").alias("aceito"))


@query("route_quality_tier", """SELECT tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS parcela FROM (SELECT CASE WHEN q >= 0.8 THEN 'docling'
 WHEN q >= 0.6 AND c >= 0.8 THEN 'text_llm' ELSE 'vision_llm' END AS tier FROM (SELECT (doc_id % 100) / 100.0::DOUBLE AS q, (doc_id * 7 % 100) / 100.0::DOUBLE AS c FROM documents)) GROUP BY tier""")
def route_quality_tier(spark, sf):
    docs = scan(spark, sf, "documents").select((F.col("doc_id") % 100 / 100.0).alias("quality"), (F.col("doc_id") * 7 % 100 / 100.0).alias("corrected_quality"))
    tiers = docs.select(X.quality_tier().alias("tier"))
    total = tiers.agg(F.count("*")).scalar()
    return tiers.groupBy("tier").agg(F.count("*").alias("n")).withColumn("parcela", F.round(F.col("n") / total, 6))


@query("classify_image_shape", """SELECT p_partkey, CASE WHEN r > 0.8 AND r < 1.2 AND w < 800 THEN 'figura_geometrica' WHEN r > 1.5 OR r < 0.7 THEN 'grafico' ELSE 'generico' END AS tipo
 FROM (SELECT p_partkey, p_size * 40 AS w, p_size * 40 / p_retailprice AS r FROM part)""")
def classify_image_shape(spark, sf):
    img = scan(spark, sf, "part").select("p_partkey", (F.col("p_size") * 40).alias("width"), F.col("p_retailprice").alias("height"))
    return img.select("p_partkey", X.image_shape().alias("tipo"))


READY = {"e": """SELECT p.projeto_id, count(DISTINCT p.prova_id) AS tp, count(DISTINCT p.ano) AS anos FROM v_provas p GROUP BY 1""",
         "qq": """SELECT projeto_id, count(*) AS tq, count(*) FILTER (WHERE anulada) AS ta FROM v_qp GROUP BY 1"""}


@query("ready_flag", with_("v_projetos", "v_qp", extra=READY) + """SELECT projeto_id, coalesce(tq, 0) - coalesce(ta, 0) >= 10 AND coalesce(anos, 0) >= 1 AS pronto,
 coalesce(tq, 0) >= 5 AS analisavel FROM v_projetos LEFT JOIN e USING (projeto_id) LEFT JOIN qq USING (projeto_id)""")
def ready_flag(spark, sf):
    return G.ready_flags(A.projetos(spark, sf), A.provas(spark, sf), A.questoes(spark, sf))


@query("accept_files", """SELECT url AS path, length(html) AS length, CASE WHEN NOT ends_with(lower(url), 'ref=x') THEN 'tipo' WHEN length(html) > 3000 THEN 'tamanho' END AS motivo,
 ends_with(lower(url), 'ref=x') AND length(html) <= 3000 AS aceito FROM pages""")
def accept(spark, sf):
    files = scan(spark, sf, "pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("length"))
    return accept_files(files, max_bytes=3000, suffix="ref=x")


@query("start_guard", with_("v_projetos", "v_qp", "v_jobs", extra={
    "np": "SELECT projeto_id, count(*) AS n FROM v_provas GROUP BY 1", "nq": "SELECT projeto_id, banca AS disciplina, count(*) AS n FROM v_qp GROUP BY ALL",
    "run": "SELECT DISTINCT projeto_id, disciplina FROM v_jobs WHERE status = 'running'"}) + """SELECT projeto_id, disciplina, coalesce(nq.n, 0) AS n_questoes,
 CASE WHEN coalesce(np.n, 0) = 0 THEN 'sem_provas' WHEN coalesce(nq.n, 0) < 5 THEN 'questoes_insuficientes' WHEN run.projeto_id IS NOT NULL THEN 'em_execucao' END AS motivo,
 coalesce(np.n, 0) > 0 AND coalesce(nq.n, 0) >= 5 AND run.projeto_id IS NULL AS aceito
 FROM (SELECT DISTINCT o_custkey AS projeto_id, o_orderpriority AS disciplina FROM orders) r LEFT JOIN np USING (projeto_id) LEFT JOIN nq USING (projeto_id, disciplina) LEFT JOIN run USING (projeto_id, disciplina)""")
def start_guard(spark, sf):
    jobs = A.jobs(spark, sf)
    q = A.questoes_provas(spark, sf).select("projeto_id", F.col("banca").alias("disciplina"))
    return X.start_guard(jobs.select("projeto_id", "disciplina").distinct(), A.provas(spark, sf), q, jobs)


@query("default_fallbacks", with_("v_questoes", "v_class") + """SELECT q.questao_id, coalesce(nullif(c.disciplina, ''), nullif(q.disciplina, ''), 'Não classificada') AS disciplina,
 coalesce(nullif(c.assunto, ''), nullif(q.assunto_pci, ''), 'Sem assunto') AS assunto FROM v_questoes q LEFT JOIN (SELECT DISTINCT questao_id, disciplina, assunto FROM v_class) c
 ON q.questao_id = c.questao_id""")
def default_fallbacks(spark, sf):
    c = A.classificacoes(spark, sf).select("questao_id", F.col("disciplina").alias("c_disc"), "assunto").distinct()
    return A.questoes(spark, sf).join(c, "questao_id", "left").select(
        "questao_id", X.first_filled(F.col("c_disc"), F.col("disciplina"), default="Não classificada").alias("disciplina"),
        X.first_filled(F.col("assunto"), F.col("assunto_pci"), default="Sem assunto").alias("assunto"))


@query("error_to_state", """SELECT event_id, CASE WHEN lim THEN 'retry' ELSE 'failed' END AS queue_status, CASE WHEN lim THEN 'RATE_LIMIT' ELSE 'PROCESSING_ERROR' END AS error_code,
 CASE WHEN NOT lim THEN substring(e, 1, 500) END AS queue_error FROM (SELECT event_id, e, regexp_matches(lower(e), 'rate|429|limit') AS lim FROM (
 SELECT event_id, concat('Error ', event_id::VARCHAR, CASE WHEN event_type = 'error' THEN ' Rate exceeded' ELSE ' in step ' || event_type END) AS e FROM events))""")
def error_to_state(spark, sf):
    text = F.concat(F.lit("Error "), F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", " Rate exceeded").otherwise(
        F.concat(F.lit(" in step "), "event_type")))
    return scan(spark, sf, "events").select("event_id", X.error_to_state(text).alias("s")).select("event_id", "s.*")


@query("retry_selection", with_("v_provas", "v_jobs") + """SELECT 'retry' AS acao, prova_id AS id, 'retry' AS novo_status FROM v_provas WHERE queue_status = 'failed'
 UNION ALL SELECT 'cancel', prova_id, 'failed' FROM v_provas WHERE queue_status IN ('pending','validating','processing')
 UNION ALL SELECT 'cancel_job', job_id, 'cancelled' FROM v_jobs WHERE status IN ('pending','running')""")
def retry_selection(spark, sf):
    exams, jobs = A.provas(spark, sf), A.jobs(spark, sf)
    pick = lambda df, action, key: X.retry_selection(df, action).select(F.lit(action).alias("acao"), F.col(key).alias("id"), "novo_status")
    return M.stack(pick(exams, "retry", "prova_id"), pick(exams, "cancel", "prova_id"), pick(jobs, "cancel_job", "job_id"))


@query("progress_bucket", """SELECT event_id, CASE WHEN p = 0 THEN 'Iniciando...' WHEN p < 20 THEN 'Extraindo texto...' WHEN p < 40 THEN 'Detectando questoes...'
 WHEN p < 60 THEN 'Processando questoes...' WHEN p < 80 THEN 'Classificando...' WHEN p < 100 THEN 'Finalizando...' ELSE 'Concluido' END AS rotulo
 FROM (SELECT event_id, event_id % 101 AS p FROM events)""")
def progress_bucket(spark, sf):
    return scan(spark, sf, "events").select("event_id", X.progress_label(F.col("event_id") % 101).alias("rotulo"))


@query("phase_progress", with_("v_jobs") + """SELECT job_id, CASE WHEN status = 'completed' THEN 100.0::DOUBLE ELSE greatest(0.0, least(100.0, (job_id % 5 - 1) * 25 + (job_id % 101) / 100 * 25))::DOUBLE END AS pct
 FROM v_jobs""")
def phase_progress(spark, sf):
    return A.jobs(spark, sf).select("job_id", X.phase_progress(F.col("status"), F.col("job_id") % 5, F.col("job_id") % 101).alias("pct"))
