"""Text scalars, question parsing, JSON answers and syllabus trees."""

from pyspark.sql import functions as F

from provalake import constants as C
from provalake import schemas
from provalake.catalog.ctes import with_
from provalake.catalog.q_sources import OPTS_SQL, WS, options_docs, trim_sql
from provalake.catalog.registry import query
from provalake.functions import jsontext as JS
from provalake.functions import text as X
from provalake.functions.scoring import confidence
from provalake.operators import findings as FD
from provalake.operators import layout as L
from provalake.operators import matching as N
from provalake.operators import parsing as P
from provalake.operators import quality as Q
from provalake.operators import taxonomy as T
from provalake.plans import incidence as I
from provalake.sources import adapters as A
from provalake.sources.tables import scan, spread


def docs(spark, sf):
    return spread(scan(spark, sf, "documents"), "doc_id")


@query("strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS h FROM documents")
def strip_accents(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.strip_accents(F.col("text"), compat=False)).alias("h"))


def norm(x):
    return f"strip_accents(regexp_replace(lower({x}), '^(?:[.,;:!?]|{WS})+|(?:[.,;:!?]|{WS})+$', '', 'g'))"


@query("normalize_discipline", with_(extra={"d": "SELECT doc_id, concat(' .,', upper(source), ' Ção! ', lang, ' ;: ') AS x, text FROM documents"}) + f"""
 SELECT doc_id, {norm('x')} AS a, md5({norm('text')}) AS b FROM d""")
def normalize_discipline(spark, sf):
    x = F.concat(F.lit(" .,"), F.upper("source"), F.lit(" Ção! "), "lang", F.lit(" ;: "))
    return docs(spark, sf).select("doc_id", X.normalize_discipline(x).alias("a"), F.md5(X.normalize_discipline(F.col("text"))).alias("b"))


def canon_sql():
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in C.CANONICAL_DISCIPLINES.items()) + ") t(k, v)"


TITLE = r"array_to_string(list_transform(regexp_extract_all({0}, '\pL+|\PL+'), lambda w: replace(upper(w[1]), 'ẞ', 'Ss') || lower(w[2:])), '')"
RAW_NAMES = """SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'PORTUGUÊS.' WHEN 2 THEN ' raciocínio lógico' WHEN 3 THEN 'Redação' WHEN 4 THEN 'noções de legislação;' WHEN 5 THEN lower(d) ELSE concat(d, ' ', p_name) END AS raw
 FROM (SELECT l_orderkey, l_linenumber, p_name, """ + """CASE WHEN p_type='STANDARD' THEN 'Português' WHEN p_type='PROMO' THEN 'LÍNGUA PORTUGUESA' WHEN p_type='SMALL' THEN 'Matemática'
 WHEN p_type='LARGE' THEN 'Raciocínio Lógico' WHEN p_type='ECONOMY' THEN 'Legislação Básica' ELSE 'Inglês' END AS d FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def raw_names(spark, sf):
    n, d = F.col("l_linenumber"), A.discipline_of(F.col("p_type"))
    raw = (F.when(n == 1, F.lit("PORTUGUÊS.")).when(n == 2, " raciocínio lógico").when(n == 3, "Redação").when(n == 4, "noções de legislação;")
           .when(n == 5, F.lower(d)).otherwise(F.concat(d, F.lit(" "), "p_name")))
    return scan(spark, sf, "lineitem").join(scan(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", raw.alias("disciplina"))


AUDIT = with_(extra={"r": RAW_NAMES, "c": canon_sql(), "a": f"SELECT raw, count(*) AS linhas, {norm('raw')} AS k FROM r GROUP BY raw",
                     "x": f"SELECT raw AS original, linhas, coalesce(c.v, {TITLE.format('trim(raw)')}) AS canonico FROM a LEFT JOIN c USING (k)"})


@query("canonical_discipline", AUDIT + "SELECT original, canonico FROM x")
def canonical_discipline(spark, sf):
    return raw_names(spark, sf).select("disciplina").distinct().select(F.col("disciplina").alias("original"), X.canonical_discipline(F.col("disciplina")).alias("canonico"))


@query("canonical_audit", AUDIT + "SELECT original, linhas, canonico, canonico <> original AS muda FROM x")
def canonical_audit(spark, sf):
    return N.canonical_audit(raw_names(spark, sf))


@query("fix_mojibake", "SELECT doc_id, TRUE AS igual, md5(text) AS h FROM documents")
def fix_mojibake(spark, sf):
    """Whole texts are damaged as Latin-1 read-outs of UTF-8 where that is possible, then mended."""
    d = docs(spark, sf)
    broken = F.when(F.col("text").rlike(r"^[\x{0}-\x{FF}]*$"), F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return d.select("doc_id", (X.fix_mojibake(broken) == F.col("text")).alias("igual"), F.md5(X.fix_mojibake(F.col("text"))).alias("h"))


@query("title_case", f"SELECT doc_id, md5({TITLE.format('text')}) AS h FROM documents")
def title_case(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.title_case(F.col("text"))).alias("h"))


PREFIXED = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('QUESTÃO ', doc_id::VARCHAR, ' - ', text) WHEN 1 THEN concat('Questão 4: (CESPE 2023) ', text) WHEN 2 THEN concat('Q.42: ', text)
 WHEN 3 THEN concat('01) ', text) WHEN 4 THEN concat('42 - (TRF 3ª Região) ', text) ELSE text END AS t FROM documents"""
TAGS = "|".join(C.EXAM_TAG_WORDS)


def prefixed(spark, sf):
    k, t = F.col("doc_id") % 6, F.col("text")
    full = (F.when(k == 0, F.concat(F.lit("QUESTÃO "), F.col("doc_id").cast("string"), F.lit(" - "), t)).when(k == 1, F.concat(F.lit("Questão 4: (CESPE 2023) "), t))
            .when(k == 2, F.concat(F.lit("Q.42: "), t)).when(k == 3, F.concat(F.lit("01) "), t)).when(k == 4, F.concat(F.lit("42 - (TRF 3ª Região) "), t)).otherwise(t))
    return docs(spark, sf).select("doc_id", full.alias("t"))


def prune_sql(x):
    for p in (r"^Questão\s+\d+[.:]\s*", r"^QUESTÃO\s+\d+\s*[-–]\s*", r"^Q\.\s*\d+[.:]\s*", r"^\d+\)\s*", r"^\d+\s*[-–]\s*", rf"^\s*\([^)]*(?:{TAGS})[^)]*\)\s*"):
        x = f"regexp_replace({x}, '{p}', '', 'i')"
    return trim_sql(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


@query("prune_context", with_(extra={"p": PREFIXED}) + f"SELECT doc_id, md5({prune_sql('t')}) AS h FROM p")
def prune_context(spark, sf):
    return prefixed(spark, sf).select("doc_id", F.md5(X.prune_context(F.col("t"))).alias("h"))


@query("estimate_tokens", with_(extra={"p": PREFIXED}) + f"SELECT doc_id, (length(t) // 4)::INT AS antes, (length(t) // 4 - length({prune_sql('t')}) // 4)::INT AS poupados FROM p")
def estimate_tokens(spark, sf):
    before, after = X.estimate_tokens(F.col("t")), X.estimate_tokens(X.prune_context(F.col("t")))
    return prefixed(spark, sf).select("doc_id", before.alias("antes"), (before - after).alias("poupados"))


LOW, UP = C.LOWER_LETTERS, C.UPPER_LETTERS


@query("preprocess_ocr", with_(extra={"t": "SELECT doc_id, replace(replace(text, ', ', ','), '. ', '') AS t FROM documents"}) + rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '([,;:])([{LOW}])', '\1 \2', 'g'),
 '([{LOW}])([{UP}][{LOW}])', '\1 \2', 'g'), ' +', ' ', 'g')) AS h FROM t""")
def preprocess_ocr(spark, sf):
    t = F.replace(F.replace("text", F.lit(", "), F.lit(",")), F.lit(". "), F.lit(""))
    return docs(spark, sf).select("doc_id", F.md5(X.preprocess_ocr(t)).alias("h"))


@query("clean_watermarks", """SELECT doc_id, md5(concat(substring(text, 1, length(text) // 2), ' x ', substring(text, length(text) // 2 + 1), ' ')) AS h FROM documents""")
def clean_watermarks(spark, sf):
    half = F.floor(F.length("text") / 2).cast("int")
    t = F.concat(F.col("text").substr(F.lit(1), half), F.lit(" pcimarkpci MDAwMDo=x "[:20] + " x "), F.col("text").substr(half + 1, F.length("text")), F.lit(" www.pciconcursos.com.br"))
    # the mark and its token go, the text around them stays: " pcimarkpci MDAwMDo=" leaves one blank before " x "
    clean = X.clean_watermarks(t)
    return docs(spark, sf).select("doc_id", F.md5(F.replace(clean, F.lit("  x "), F.lit(" x "))).alias("h"))


FILES = """SELECT o_orderkey, concat('/in/', CASE o_orderkey % 5 WHEN 0 THEN 'FCC' WHEN 1 THEN 'vunesp' WHEN 2 THEN 'cespe' WHEN 3 THEN 'xyz' ELSE 'Quadrix' END, CASE WHEN o_orderkey % 2 = 0 THEN '_' ELSE '-' END,
 'analista_de_', lower(o_orderstatus), '_', year(o_orderdate)::VARCHAR, '.pdf') AS path, o_orderpriority AS sample FROM orders"""


@query("infer_metadata", with_(extra={"f": FILES, "s": "SELECT o_orderkey, lower(regexp_replace(string_split(path, '/')[-1], '[.][^.]+$', '')) AS n, lower(sample) AS t FROM f"}) + "SELECT o_orderkey, "
 + "coalesce(" + ", ".join(f"CASE WHEN contains(n, '{b}') OR contains(t, '{b}') THEN '{b.upper()}' END" for b in C.FILE_BOARDS) + ") AS banca, "
 + TITLE.format(r"replace(nullif(regexp_extract(n, '(?:fcc|cespe|vunesp)[-_](.+?)[-_](?:20\d{2})', 1), ''), '_', ' ')") + r" AS cargo, try_cast(nullif(regexp_extract(n, '20\d{2}'), '') AS INT) AS ano FROM s")
def infer_metadata(spark, sf):
    k = F.col("o_orderkey")
    board = F.when(k % 5 == 0, "FCC").when(k % 5 == 1, "vunesp").when(k % 5 == 2, "cespe").when(k % 5 == 3, "xyz").otherwise("Quadrix")
    path = F.concat(F.lit("/in/"), board, F.when(k % 2 == 0, "_").otherwise("-"), F.lit("analista_de_"), F.lower("o_orderstatus"), F.lit("_"),
                    F.year("o_orderdate").cast("string"), F.lit(".pdf"))
    return scan(spark, sf, "orders").select("o_orderkey", X.infer_file_metadata(path, F.col("o_orderpriority")).alias("m")).select("o_orderkey", "m.*")


COVER = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('Prova IDCAP 2023', chr(10), 'Cargo: ', source, chr(10), text) WHEN 1 THEN concat('fgv', chr(10), 'Técnico Judiciário', chr(10), text) ELSE text END AS t FROM documents"""


@query("infer_cover_metadata", with_(extra={"c": COVER}) + "SELECT doc_id, coalesce(" + ", ".join(f"CASE WHEN contains(upper(t), '{b}') THEN '{b}' END" for b in C.COVER_BOARDS)
 + r""") AS banca, substring(trim(coalesce(nullif(regexp_extract(t, '(?i)(?:cargo|função)[:\s]*([^\n]+)', 1), ''), nullif(regexp_extract(t, '(?i)técnico[^\n]*'), ''), nullif(regexp_extract(t, '(?i)analista[^\n]*'), ''))), 1, 100) AS cargo,
 try_cast(nullif(regexp_extract(t, '20\d{2}'), '') AS INT) AS ano FROM c""")
def infer_cover_metadata(spark, sf):
    k, t = F.col("doc_id") % 4, F.col("text")
    cover = F.when(k == 0, F.concat(F.lit("Prova IDCAP 2023\nCargo: "), "source", F.lit("\n"), t)).when(k == 1, F.concat(F.lit("fgv\nTécnico Judiciário\n"), t)).otherwise(t)
    return docs(spark, sf).select("doc_id", X.infer_cover_metadata(cover).alias("m")).select("doc_id", "m.*")


@query("section_slice", with_(extra={"s": """SELECT doc_id, concat(substring(text, 1, length(text) // 2), chr(10), 'Analista Judiciário', chr(10), substring(text, length(text) // 2 + 1), chr(10), 'CONHECIMENTOS GERAIS', chr(10), 'fim') AS t FROM documents""",
 "p": "SELECT doc_id, t, position(upper('analista judiciário') IN upper(t)) AS k FROM s"}) + r"""SELECT doc_id, md5(CASE WHEN k = 0 THEN t ELSE concat(substring(t, k, 19),
 regexp_replace(substring(t, k + 19), '(?s)\n\s*[A-ZÁÉÍÓÚÃÕÂÊÔÇ][A-ZÁÉÍÓÚÃÕÂÊÔÇ\s]{10,}\n.*$', '')) END) AS h FROM p""")
def section_slice(spark, sf):
    half = F.floor(F.length("text") / 2).cast("int")
    t = F.concat(F.col("text").substr(F.lit(1), half), F.lit("\nAnalista Judiciário\n"), F.col("text").substr(half + 1, F.length("text")), F.lit("\nCONHECIMENTOS GERAIS\nfim"))
    return docs(spark, sf).select("doc_id", F.md5(X.section_slice(t, F.lit("analista judiciário"))).alias("h"))


WORDS_SQL = f"""SELECT doc_id, list_filter(list_transform(string_split_regex(text, '{WS}+'), lambda w: regexp_replace(w, '^[^\\pL\\pN\\pM_]+|[^\\pL\\pN\\pM_]+$', '', 'g')),
 lambda w: regexp_full_match(w, '[{C.WORD_LETTERS}]{{3,}}')) AS w FROM documents"""


@query("word_quality", with_(extra={"w": WORDS_SQL, "lex": "SELECT word FROM (SELECT lower(unnest(w)) AS word FROM w) GROUP BY 1 HAVING count(*) >= 3",
 "u": "SELECT doc_id, count(*) AS unk FROM (SELECT DISTINCT doc_id, lower(unnest(w)) AS word FROM w) WHERE word NOT IN (SELECT word FROM lex) GROUP BY 1",
 "m": """SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: length(x) > 18)) AS lg, coalesce(unk, 0) AS unk FROM w LEFT JOIN u USING (doc_id)""",
 "r": """SELECT doc_id, n::INT AS word_count, CASE WHEN n < 10 THEN 1.0 ELSE round(unk / n, 4) END::DOUBLE AS e, CASE WHEN n < 10 THEN 0.0 ELSE round(lg / n, 4) END::DOUBLE AS l, CASE WHEN n < 10 THEN 0.0 ELSE round(1 - unk / n, 4) END::DOUBLE AS v FROM m""",
 "s": """SELECT *, CASE WHEN word_count < 10 THEN 0.0 ELSE greatest(0.0, least(1.0, v * (1 - least(e, 0.5) * 2) * (1 - least(l * 5, 0.5)))) END AS sc FROM r"""}) + """
 SELECT doc_id, word_count, e AS spell_error_rate, l AS long_word_ratio, v AS valid_word_ratio, floor(sc * 1000000 + 0.5) / 1000000 AS score, sc < 0.8 OR l > 0.05 AS needs_correction, sc < 0.75 AS needs_vision FROM s""")
def word_quality(spark, sf):
    d = docs(spark, sf)
    return Q.word_quality(d, Q.build_lexicon(d)).withColumn("score", F.floor(F.col("score") * 1000000 + 0.5) / 1000000)


@query("broken_layout_flag", with_(extra={"t": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', chr(10)) ELSE text END AS t FROM documents",
 "l": f"SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: {trim_sql('x')}), lambda x: x <> '') AS l FROM t"}) + """
 SELECT doc_id, len(l) > 10 AND len(list_filter(l, lambda x: NOT contains(x, ' '))) / greatest(len(l), 1) > 0.5 AS quebrado FROM l""")
def broken_layout_flag(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", X.broken_layout(t).alias("quebrado"))


@query("format_taxonomy_text", with_("v_edital_src") + """SELECT edital_id, CASE shape WHEN 'none' THEN '' WHEN 'legacy' THEN concat('• ', disc, chr(10), '  ├─ ', p_brand, chr(10), '    └─ ', p_name)
 ELSE concat_ws(chr(10), '• Língua Portuguesa', '  ├─ Compreensão e interpretação de textos', '  ├─ Sintaxe', '    └─ Período Simples', '    └─ Período Composto', '• ' || disc, '  ├─ ' || p_brand, '    └─ ' || p_name, '  ├─ ', '  ├─ Proposições') END AS texto FROM v_edital_src""")
def format_taxonomy_text(spark, sf):
    return T.format_taxonomy_text(A.editais(spark, sf))


OUTLINE = """CASE shape WHEN 'none' THEN '' WHEN 'legacy' THEN concat('• ', disc, chr(10), '  ├─ ', p_brand, chr(10), '    └─ ', p_name)
 ELSE concat_ws(chr(10), '• Língua Portuguesa', '  ├─ Compreensão e interpretação de textos', '  ├─ Sintaxe', '    └─ Período Simples', '    └─ Período Composto', '• ' || disc, '  ├─ ' || p_brand, '    └─ ' || p_name, '  ├─ ', '  ├─ Proposições') END"""


@query("render_prompt", with_("v_qp", "v_projetos", "v_edital_src", extra={"ol": f"SELECT edital_id, {OUTLINE} AS t FROM v_edital_src", "p": """SELECT questao_id, concat('Classifique a questão de concurso segundo o conteúdo programático.', chr(10), chr(10), 'TAXONOMIA:', chr(10),
 coalesce(t, '(sem taxonomia)'), chr(10), chr(10), 'QUESTÃO:', chr(10), 'Disciplina: ', coalesce(q.disciplina, 'não informada'), chr(10), 'Enunciado: ', enunciado, chr(10), 'Gabarito: ', gabarito, chr(10), chr(10), 'Responda em JSON com disciplina, assunto, topico e subtopico.') AS prompt
 FROM v_qp q JOIN v_projetos USING (projeto_id) LEFT JOIN ol USING (edital_id)"""}) + "SELECT questao_id, md5(prompt) AS h, (length(prompt) // 4)::INT AS tokens FROM p")
def render_prompt(spark, sf):
    """Classification request text per question, carrying its project's syllabus outline."""
    from provalake.plans.requests import classification_requests

    q = A.questoes_provas(spark, sf).join(A.projetos(spark, sf).select("projeto_id", "edital_id"), "projeto_id")
    out = classification_requests(q, T.format_taxonomy_text(A.editais(spark, sf)))
    return out.select("questao_id", F.md5("prompt").alias("h"), "tokens")


@query("text_variants", with_(extra={"o": OPTS_SQL}) + """SELECT doc_id, md5(text) AS a, md5(concat(text, array_to_string(list_transform(list_zip(ks, vs), lambda z: concat(chr(10), z[1], ') ', z[2])), ''))) AS b,
 coalesce(vs[list_position(ks, substring('ABCDE', (doc_id % 5 + 1)::INT, 1))], '') AS c FROM o""")
def text_variants(spark, sf):
    from provalake.operators.vectors import text_variant

    o = options_docs(spark, sf)
    answer = F.lit("ABCDE").substr((F.col("doc_id") % 5 + 1).cast("int"), F.lit(1))
    v = lambda kind: text_variant(kind, F.col("text"), F.col("alternativas"), answer)
    return o.select("doc_id", F.md5(v("enunciado")).alias("a"), F.md5(v("enunciado_completo")).alias("b"), v("resposta_correta").alias("c"))


@query("format_pct_hours", with_("v_questoes", extra={"c": "SELECT disciplina, count(*) / (SELECT count(*) FROM v_questoes) * 100 AS p FROM v_questoes GROUP BY 1"}) + """
 SELECT disciplina, printf('%.1f%%', p) AS pct, CASE WHEN p > 20 THEN 'ALTA' WHEN p > 10 THEN 'MÉDIA' ELSE 'BAIXA' END AS prioridade, floor(p * 0.5)::INT AS horas FROM c""")
def format_pct_hours(spark, sf):
    q = A.questoes(spark, sf)
    c = q.groupBy("disciplina").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / q.agg(F.count("*")).scalar() * 100)
    return c.select("disciplina", X.format_pct(F.col("p")).alias("pct"), X.priority(F.col("p")).alias("prioridade"), X.study_hours(F.col("p")).alias("horas"))


@query("split_roles", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN contains(r, ' e ') THEN array_to_string(list_transform(string_split(r, ' e '), lambda x: trim(x)), '|') ELSE r END AS cargos FROM (
 SELECT event_id, CASE event_id % 5 WHEN 1 THEN concat('Analista de ', event_type, ' e  Técnico ') WHEN 2 THEN concat(event_type, ' e gestor e médico') ELSE event_type END AS r FROM events)""")
def split_roles(spark, sf):
    k, t = F.col("event_id") % 5, F.col("event_type")
    r = F.when(k == 0, "").when(k == 1, F.concat(F.lit("Analista de "), t, F.lit(" e  Técnico "))).when(k == 2, F.concat(t, F.lit(" e gestor e médico"))).otherwise(t)
    return scan(spark, sf, "events").select("event_id", F.array_join(X.split_roles(r), "|").alias("cargos"))


@query("duration", """SELECT event_id, s, CASE WHEN s < 60 THEN s::VARCHAR || 's' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm ' || (s % 60)::VARCHAR || 's' ELSE (s // 3600)::VARCHAR || 'h ' || (s % 3600 // 60)::VARCHAR || 'm' END AS texto
 FROM (SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000 % 9000)::BIGINT END AS s FROM events)""")
def duration(spark, sf):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    whole = X.duration_seconds(start, F.when(F.col("user_id") % 7 != 0, F.col("ts")))
    e = scan(spark, sf, "events").select("event_id", (whole % 9000).alias("s"))
    return e.select("event_id", "s", X.duration_text(F.col("s")).alias("texto"))


@query("classification_tags", with_("v_class", extra={"t": """SELECT questao_id, concat_ws('|', disciplina || ':' || 'null', assunto || ':' || coalesce(nullif(round(confianca_assunto * 100)::INT, 0)::VARCHAR, 'null')) AS tags,
 (disciplina IS NOT NULL)::INT + (assunto IS NOT NULL)::INT + (disciplina IS NOT NULL)::INT AS n, assunto, disciplina FROM v_class"""}) + """SELECT questao_id, tags, n, greatest(n - 2, 0) AS resto FROM t""")
def classification_tags(spark, sf):
    from provalake.functions.tags import classification_tags as tags_of
    from provalake.functions.tags import hidden_tags

    c = A.classificacoes(spark, sf).withColumns({"topico": F.col("disciplina"), "confianca_disciplina": F.lit(None).cast("double"), "confianca_topico": F.lit(0.0), "subtopico": F.lit("")})
    t = c.withColumn("t", tags_of())
    show = F.array_join(F.transform(F.filter("t", lambda x: x["nivel"] != "topico"), lambda x: F.concat(x["rotulo"], F.lit(":"), F.coalesce(x["confianca"].cast("string"), F.lit("null")))), "|")
    return t.select("questao_id", show.alias("tags"), F.size("t").alias("n"), hidden_tags(F.col("t")).alias("resto"))


@query("safe_slug", with_("v_provas", extra={}).rstrip() + """ SELECT prova_id, concat(replace(lower(fonte), ' ', '_'), '_', strftime(created_at, '%Y%m%d_%H%M%S')) AS slug FROM v_provas""")
def safe_slug(spark, sf):
    return A.provas(spark, sf).select("prova_id", X.safe_slug(F.col("fonte"), F.col("created_at")).alias("slug"))


# --- parsing ---------------------------------------------------------------------------------------------------

# The comparison SQL cuts at a mark placed before each header, because its regex engine has no look-around.
SEG = {
    "st": r"""SELECT doc_id, full_text, len(regexp_extract_all(full_text, '\d+\.\s*\[[^\]]+\]')) AS nb, len(regexp_extract_all(full_text, '(?i)Quest[aã]o\s*\d+')) AS nm FROM v_exam_text""",
    "pc": r"""SELECT doc_id, nb >= nm AND nb > 0 AS br, CASE WHEN nb >= nm AND nb > 0 THEN string_split(regexp_replace(full_text, '(^|[^\d])(\d+\.\s*\[[^\]]+\])', '\1' || chr(1) || '\2', 'g'), chr(1))
 ELSE string_split(regexp_replace(full_text, '(Quest[aã]o\s*\d+)', chr(1) || '\1', 'gi'), chr(1)) END AS p FROM st WHERE nb > 0 OR nm > 0""",
    "ex": """SELECT doc_id, br, p, i, p[i] AS t FROM (SELECT doc_id, br, p, unnest(range(1, len(p) + 1)) AS i FROM pc)""",
    "hd": r"""SELECT doc_id, i, br, t, list_filter(list_transform(p[1:i - 1], lambda x: list_last(regexp_extract_all(x, '(?i)(?:^|\n)\s*((?:Língua\s+Portuguesa|Matemática|Raciocínio\s+Lógico|Informática|Legislação|Conhecimentos\s+Específicos|Noções\s+de)[^\n]*)', 1))), lambda h: h IS NOT NULL) AS hs FROM ex
 WHERE CASE WHEN br THEN regexp_matches(t, '^\d+\.\s*\[[^\]]+\]') ELSE regexp_matches(t, '^(?i)Quest[aã]o\s*\d+') END""",
    "seg": rf"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS seq, CASE WHEN br THEN regexp_extract(t, '^(\d+)', 1) ELSE regexp_extract(t, '(?i)Quest[aã]o\s*(\d+)', 1) END::INT AS numero,
 CASE WHEN br THEN trim(string_split(regexp_extract(t, '\[([^\]]+)\]', 1), '-')[1]) ELSE {trim_sql('list_last(hs)')} END AS disciplina, CASE WHEN br THEN trim(string_split(regexp_extract(t, '\[([^\]]+)\]', 1), '-')[2]) END AS assunto_pci,
 CASE WHEN NOT br THEN nullif(regexp_extract(t, '^(?i)Quest[aã]o\s*\d+\s*\(Correta:\s*([A-E])\)', 1), '') END AS gab,
 {trim_sql("CASE WHEN br THEN regexp_replace(t, '^[0-9]+[.][ ]*[[][^]]+[]]', '') ELSE regexp_replace(t, '^Quest[aã]o[ ]*[0-9]+[ \n]*([(]Correta:[ ]*[A-E][)])?', '', 'i') END")} AS bloco FROM hd""",
}


@query("segment_questions", with_("v_exam_text", extra=SEG) + "SELECT doc_id, seq, numero, disciplina, assunto_pci, gab AS gabarito_cabecalho, md5(bloco) AS bloco_md5 FROM seg")
def segment_questions(spark, sf):
    s = P.segment_questions(A.exam_text(spark, sf))
    return s.withColumn("bloco_md5", F.md5("bloco")).drop("bloco")


PB = {**SEG, "b": r"""SELECT *, contains(upper(bloco), 'ANULADA') AS anulada, regexp_extract_all(bloco, '([A-E])\)', 1) AS ls, string_split_regex(bloco, '[A-E]\)') AS xs FROM seg""",
 "o": rf"""SELECT *, list_transform(xs[2:], lambda x: {trim_sql("string_split(x, 'Resposta:')[1]")}) AS vs FROM b"""}


@query("parse_block", with_("v_exam_text", extra=PB) + rf"""SELECT doc_id, seq, anulada, CASE WHEN NOT anulada THEN coalesce(gab, nullif(regexp_extract(bloco, 'Resposta:\s*([A-E])', 1), ''), nullif(regexp_extract(bloco, '\(Correta:\s*([A-E])\)', 1), '')) END AS gabarito,
 array_to_string(list_transform(list_zip(ls, vs), lambda z: z[1] || '=' || z[2]), ';') AS opcoes, md5({trim_sql('xs[1]')}) AS enunciado_md5,
 concat_ws('|', CASE WHEN length({trim_sql('xs[1]')}) < 10 THEN 'Enunciado muito curto' END, CASE WHEN len(ls) <> 5 THEN 'Número de alternativas inválido: ' || len(ls)::VARCHAR END) AS alertas,
 CASE WHEN length({trim_sql('xs[1]')}) < 10 OR len(ls) <> 5 THEN 'revisar_manual' ELSE 'ok' END AS status_extracao FROM o""")
def parse_block(spark, sf):
    q = P.parse_blocks(P.segment_questions(A.exam_text(spark, sf)))
    opts = F.array_join(F.transform(F.map_entries("alternativas"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return q.select("doc_id", "seq", "anulada", "gabarito", opts.alias("opcoes"), F.md5("enunciado").alias("enunciado_md5"),
                    F.array_join("alertas", "|").alias("alertas"), "status_extracao")


PAREN = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(t, ' (A) ', source, ' (B) ', lang, ' (C) x (A) z') ELSE concat(t, chr(10), 'A) ', source, chr(10), 'B. ', lang, chr(10), 'C- x') END AS c, doc_id % 2 = 0 AS par, source, lang, t FROM (
 SELECT doc_id, source, lang, replace(replace(text, '(', '['), chr(10), ' ') AS t FROM documents)"""


@query("parse_parts", with_(extra={"p": PAREN}) + f"""SELECT doc_id, CASE WHEN par THEN concat('A=z;B=', lang, ';C=x') ELSE concat('A=', source, ';B=', lang, ';C=x') END AS opcoes, md5({trim_sql('t')}) AS enunciado_md5 FROM p""")
def parse_parts(spark, sf):
    t = F.replace(F.replace("text", F.lit("("), F.lit("[")), F.lit("\n"), F.lit(" "))
    c = F.when(F.col("doc_id") % 2 == 0, F.concat(t, F.lit(" (A) "), "source", F.lit(" (B) "), "lang", F.lit(" (C) x (A) z"))).otherwise(
        F.concat(t, F.lit("\nA) "), "source", F.lit("\nB. "), "lang", F.lit("\nC- x")))
    out = P.parse_parts(docs(spark, sf).select("doc_id", c.alias("c")), "c")
    opts = F.array_join(F.transform(F.map_entries("alternativas"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("doc_id", opts.alias("opcoes"), F.md5("enunciado").alias("enunciado_md5"))


ORPHAN = """SELECT doc_id, 1 AS numero, concat('Questão 1 (Correta: C) ', text, ' --- PAGINA 2 --- fim (A) ', source, ' (B) b2 (C) c3 (D) d4 (E) e5', chr(10), 'Questão 3', chr(10), 'resto') AS full_text, text, source FROM documents"""


def orphan_docs(spark, sf):
    t = F.concat(F.lit("Questão 1 (Correta: C) "), "text", F.lit(" --- PAGINA 2 --- fim (A) "), "source", F.lit(" (B) b2 (C) c3 (D) d4 (E) e5\nQuestão 3\nresto"))
    return docs(spark, sf).select("doc_id", t.alias("full_text"))


def orphan_questions(spark, sf):
    empty = F.create_map().cast("map<string,string>")
    d = docs(spark, sf).select("doc_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("numero"))
    return d.select("doc_id", F.col("numero").alias("seq"), "numero", F.lit("").alias("enunciado"), empty.alias("alternativas"), F.lit("ok").alias("status_extracao"))


def orphan_sql():
    x = f"concat({trim_sql('text')}, '   fim (A) ', source, ' (B) b2 (C) c3 (D) d4 (E) e5')"
    x = f"regexp_replace({x}, '^{WS}*[0-9]+{WS}+', '')"
    return trim_sql(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


@query("orphan_content", with_(extra={"o": ORPHAN}) + f"SELECT doc_id, numero, md5({orphan_sql()}) AS h FROM o WHERE length({orphan_sql()}) > 30")
def orphan_content(spark, sf):
    out = P.orphan_content(orphan_questions(spark, sf), orphan_docs(spark, sf))
    return out.select("doc_id", "numero", F.md5("conteudo").alias("h"))


@query("repair_incomplete", with_(extra={"o": ORPHAN, "c": f"SELECT doc_id, {orphan_sql()} AS c FROM o", "s": f"SELECT doc_id, c, {trim_sql("string_split(c, '(A)')[1]")} AS stem FROM c"}) + """
 SELECT doc_id, 1 AS numero, CASE WHEN length(c) > 30 AND length(stem) >= 20 THEN 'repaired' ELSE 'ok' END AS status_extracao, CASE WHEN length(c) > 30 AND length(stem) >= 20 THEN 'regex_repair' END AS fonte,
 CASE WHEN length(c) > 30 AND length(stem) >= 20 THEN length(stem) ELSE 0 END::INT AS n, CASE WHEN length(c) > 30 AND length(stem) >= 20 THEN 5 ELSE 0 END AS opcoes FROM s
 UNION ALL SELECT doc_id, 3, 'ok', NULL, 0, 0 FROM documents""")
def repair_incomplete(spark, sf):
    out = P.repair_incomplete(orphan_questions(spark, sf), orphan_docs(spark, sf))
    return out.select("doc_id", "numero", "status_extracao", "fonte", F.length("enunciado").alias("n"), F.size("alternativas").alias("opcoes"))


HEADERS = """SELECT doc_id, concat('Língua Portuguesa', chr(10), t, chr(10), chr(10), 'Legislação Básica aplicada à', chr(10), '', chr(10), 'Administração Pública', chr(10), t, chr(10), 'Noções de', chr(10), 'Questão 12 x') AS x, length(t) AS n FROM (
 SELECT doc_id, regexp_replace(text, '[\\n\\r]+', ' ', 'g') AS t FROM documents)"""


def header_docs(spark, sf):
    t = F.regexp_replace("text", r"[\n\r]+", " ")
    x = F.concat(F.lit("Língua Portuguesa\n"), t, F.lit("\n\nLegislação Básica aplicada à\n\nAdministração Pública\n"), t, F.lit("\nNoções de\nQuestão 12 x"))
    return docs(spark, sf).select("doc_id", x.alias("full_text"))


@query("detect_headers", with_(extra={"h": HEADERS}) + """SELECT doc_id, 1 AS pos, 'Língua Portuguesa' AS disciplina FROM h UNION ALL SELECT doc_id, (21 + n)::INT, 'Legislação Básica aplicada à Administração Pública' FROM h
 UNION ALL SELECT doc_id, (21 + n + 28 + 1 + 1 + 21 + 1 + n + 1)::INT, 'Noções de' FROM h""")
def detect_headers(spark, sf):
    return P.detect_headers(header_docs(spark, sf))


@query("locate_question", with_("v_exam_text", extra={"n": "SELECT doc_id, unnest([1, 2, 7]) AS numero, full_text AS t FROM v_exam_text",
 "m": r"""SELECT doc_id, numero, t, nullif(regexp_extract(t, '(?is)^(.*?)Quest[aã]o\s*0*' || numero::VARCHAR || '(?:$|[^\pL\pN_])'), '') AS a, regexp_extract(t, '(?is)^(.*?)Quest[aã]o\s*0*' || numero::VARCHAR || '(?:$|[^\pL\pN_])', 1) AS a1,
 nullif(regexp_extract(t, '(?s)^(.*?)(?:^|\n)\s*0*' || numero::VARCHAR || '\s*[.)]\s'), '') AS b, regexp_extract(t, '(?s)^(.*?)(?:^|\n)\s*0*' || numero::VARCHAR || '\s*[.)]\s', 1) AS b1,
 nullif(regexp_extract(t, '(?s)^(.*?)(?:^|\n)\s*0*' || numero::VARCHAR || '\s*[-–]\s'), '') AS c, regexp_extract(t, '(?s)^(.*?)(?:^|\n)\s*0*' || numero::VARCHAR || '\s*[-–]\s', 1) AS c1 FROM n"""}) + """
 SELECT doc_id, numero, CASE WHEN a IS NOT NULL THEN length(a1) + 1 WHEN b IS NOT NULL THEN length(b1) + 1 WHEN c IS NOT NULL THEN length(c1) + 1 END::INT AS pos FROM m""")
def locate_question(spark, sf):
    d = A.exam_text(spark, sf)
    q = d.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(7))).alias("numero"))
    return P.locate_questions(q, d)


@query("assign_disciplines", with_("v_exam_text") + """SELECT doc_id, numero, CASE WHEN doc_id % 3 = 0 THEN 'antiga' WHEN numero = 1 THEN 'Língua Portuguesa' ELSE 'Informática' END AS disciplina
 FROM (SELECT doc_id, unnest([1, 2]) AS numero FROM v_exam_text)""")
def assign_disciplines(spark, sf):
    d = A.exam_text(spark, sf)
    q = d.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("numero"), F.lit("antiga").alias("disciplina"))
    return P.assign_disciplines(q, d)


SCORE = with_(extra={"o": OPTS_SQL, "q": """SELECT *, len(ks) AS n, len(list_filter(ks, lambda k: NOT contains('ABCDE', k))) = 0 AS kok, CASE doc_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'X' WHEN 2 THEN NULL WHEN 3 THEN 'AB' WHEN 4 THEN '' ELSE 'E' END AS g,
 CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'PORTUGUÊS' WHEN 2 THEN 'Matemática aplicada' ELSE source END AS d, CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS num, length(text) AS len FROM o""",
 "s": """SELECT doc_id, CASE WHEN len BETWEEN 50 AND 2000 THEN 25 WHEN len BETWEEN 20 AND 49 OR len BETWEEN 2001 AND 5000 THEN 15 ELSE 0 END AS p1, CASE WHEN n BETWEEN 4 AND 5 AND kok THEN 25 WHEN n BETWEEN 3 AND 5 THEN 15 ELSE 0 END AS p2,
 CASE WHEN nullif(g, '') IS NULL THEN 0 WHEN contains('ABCDE', g) THEN 20 ELSE 10 END AS p3,
 CASE WHEN d IS NULL THEN 0 WHEN len(list_filter(['lingua portuguesa', 'matematica'], lambda e: contains(e, strip_accents(lower(d))) OR contains(strip_accents(lower(d)), e))) > 0 THEN 15 ELSE 5 END AS p4,
 CASE WHEN len > 0 AND n > 0 AND num IS NOT NULL THEN 15 WHEN len > 0 AND n > 0 THEN 10 ELSE 0 END AS p5 FROM q"""})


@query("confidence_score", SCORE + """SELECT doc_id, p1 + p2 + p3 + p4 + p5 AS score, p4 AS disciplina_match, CASE WHEN p1 + p2 + p3 + p4 + p5 >= 80 THEN 'alta' WHEN p1 + p2 + p3 + p4 + p5 >= 50 THEN 'media' ELSE 'baixa' END AS nivel FROM s""")
def confidence_score(spark, sf):
    k = F.col("doc_id")
    g = F.when(k % 6 == 0, "A").when(k % 6 == 1, "X").when(k % 6 == 3, "AB").when(k % 6 == 4, "").when(k % 6 == 5, "E")
    d = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "PORTUGUÊS").when(k % 5 == 2, "Matemática aplicada").otherwise(F.col("source"))
    s = confidence(F.col("text"), F.col("alternativas"), g, d, F.when(k % 7 != 0, k), F.array(F.lit("Língua Portuguesa"), F.lit("Matemática")))
    return options_docs(spark, sf).select("doc_id", s.alias("s")).select("doc_id", "s.score", F.col("s.detalhes")["disciplina_match"].alias("disciplina_match"), "s.nivel")


@query("lines_from_spans", with_(extra={"w": f"SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS t, unnest(range(len(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')))) AS i FROM documents",
 "k": "SELECT doc_id, i // 10 AS ln, i, t, lag(t) OVER (PARTITION BY doc_id, i // 10 ORDER BY i) AS pv FROM w WHERE trim(t, ' ') <> ''",
 "l": "SELECT doc_id, ln, string_agg(CASE WHEN pv IS NOT NULL AND NOT regexp_matches(t, '^[ .,;:!?)]') THEN concat(' ', t) ELSE t END, '' ORDER BY i) AS line FROM k GROUP BY ALL"}) + """
 SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY ln)) AS h, count(*)::INT AS linhas FROM l GROUP BY doc_id""")
def lines_from_spans(spark, sf):
    """Words of every document laid out ten to a line, read back as text."""
    w = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("i", "text"))
    i = F.col("i")
    spans = w.select("doc_id", (F.floor(i / 10) * 12 + i % 3).alias("y"), (i % 10 * 50).alias("x0"), (i % 10 * 50 + 40).alias("x1"), "text")
    out = L.lines_from_spans(spans, ["doc_id"])
    return out.select("doc_id", F.md5("texto").alias("h"), F.size(F.split("texto", "\n")).alias("linhas"))


# --- JSON ------------------------------------------------------------------------------------------------------

@query("strip_fences", with_("v_responses") + f"""SELECT doc_id, CASE WHEN contains(response, '```json') THEN {trim_sql("string_split(string_split(response, '```json')[2], '```')[1]")} ELSE response END AS corpo FROM v_responses""")
def strip_fences(spark, sf):
    return A.responses(spark, sf).select("doc_id", JS.strip_fences(F.col("response")).alias("corpo"))


@query("parse_response", with_("v_responses", extra={"j": "SELECT doc_id, trim(replace(replace(response, '```json', ''), '```', ''), ' ' || chr(10)) AS j FROM v_responses"}) + """SELECT doc_id, j::JSON->>'disciplina' AS disciplina, j::JSON->>'assunto' AS assunto,
 coalesce((j::JSON->>'confianca_assunto')::DOUBLE, 0) AS confianca_assunto FROM j WHERE json_valid(j)""")
def parse_response(spark, sf):
    good, _ = JS.parse_responses(A.responses(spark, sf), "response", schemas.CLASSIFICATION, ("disciplina", "assunto"))
    return good.select("doc_id", "disciplina", "assunto", F.coalesce("confianca_assunto", F.lit(0.0)).alias("confianca_assunto"))


@query("quarantine", with_("v_responses") + "SELECT doc_id, response, 'json invalido' AS _error FROM v_responses WHERE doc_id % 10 = 0")
def quarantine(spark, sf):
    return JS.parse_responses(A.responses(spark, sf), "response", schemas.CLASSIFICATION, ("disciplina", "assunto"))[1]


@query("sanitize_json", """SELECT doc_id, md5(replace(replace(replace(replace(text, chr(92), ' '), '"', ' '), chr(9), ' '), chr(13), ' ')) AS h FROM documents""")
def sanitize_json(spark, sf):
    clean = F.replace(F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit(" ")), F.lit('"'), F.lit(" ")), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    raw = F.concat(F.lit('{\n"t": "'), clean, F.lit('",\n\t"u": "a\\"b"}'))
    back = F.from_json(JS.sanitize_json(raw), "t string, u string")
    return docs(spark, sf).select("doc_id", F.md5(back["t"]).alias("h"))


CUT_Q = """SELECT doc_id, concat('{"questoes":[{"numero":1,"enunciado":"', regexp_replace(text, '[\\x00-\\x1f"\\\\]', ' ', 'g'), '","gabarito":"C","anulada":false},{"numero":2,"enunciado":"cort') AS r, text FROM documents"""


@query("repair_json", """SELECT doc_id, 1 AS numero, 'C' AS gabarito, md5(regexp_replace(text, '[\\x00-\\x1f"\\\\]', ' ', 'g')) AS h FROM documents""")
def repair_json(spark, sf):
    clean = F.regexp_replace("text", r'[\x00-\x1f"\\]', " ")
    r = F.concat(F.lit('{"questoes":[{"numero":1,"enunciado":"'), clean, F.lit('","gabarito":"C","anulada":false},{"numero":2,"enunciado":"cort'))
    good, _ = JS.parse_responses(docs(spark, sf).select("doc_id", r.alias("r")), "r", schemas.QUESTION_BATCH, ("questoes",), repair=JS.repair_question_json)
    return good.select("doc_id", F.inline("questoes")).select("doc_id", "numero", "gabarito", F.md5("enunciado").alias("h"))


@query("repair_syllabus_json", with_("v_edital_src", extra={}).rstrip() + """ SELECT edital_id, 'Língua Portuguesa' AS disciplina, 3 AS itens FROM v_edital_src WHERE shape = 'nested'""")
def repair_syllabus_json(spark, sf):
    """Syllabus documents cut inside their second discipline come back with the first one whole."""
    ed = A.editais(spark, sf).filter("taxonomia LIKE '%\"itens\"%'")
    cut = F.regexp_replace("taxonomia", r'(?s),"filhos":\[\]\}\]\}\]\},\{"nome":.*$', ',"filhos":[]},{"id":"2.3","te')
    fixed = JS.repair_syllabus_json(cut)
    nodes = T.flatten_taxonomy(ed.select("edital_id", fixed.alias("taxonomia")))
    return nodes.groupBy("edital_id", "disciplina").agg(F.count_if(F.col("depth") == 2).cast("int").alias("f"), (F.count("*") - 2).cast("int").alias("itens")).drop("f")


DIG = """SELECT l_orderkey AS job_id, concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR) AS chunk_id, l_linenumber AS n, l_suppkey FROM lineitem"""


def parsed_digests(spark, sf):
    return FD.parse_digests(A.digests(spark, sf))[0]


@query("explode_analysis", with_(extra={"d": DIG}) + """SELECT chunk_id, 'a' AS questao_id, ['easy','medium','hard','very_hard'][(n % 4 + 1)::INT] AS difficulty, n % 3 < 2 AS has_trap, 'understand' AS bloom_level,
 CASE n % 3 WHEN 0 THEN 'Negação dupla no enunciado da questão' WHEN 1 THEN '' END AS trap_description FROM d UNION ALL SELECT chunk_id, 'b', 'medium', FALSE, 'understand', NULL FROM d""")
def explode_analysis(spark, sf):
    return FD.question_analysis(parsed_digests(spark, sf), ["chunk_id"]).drop("difficulty_reasoning")


@query("digest_patterns", with_(extra={"d": DIG}) + "SELECT chunk_id, 0 AS seq, 'estilo' AS type, concat('padrão ', n::VARCHAR) AS description FROM d WHERE n % 2 = 0")
def digest_patterns(spark, sf):
    return FD.digest_patterns(parsed_digests(spark, sf), ["chunk_id"]).select("chunk_id", "seq", "type", "description")


@query("digest_lines", with_(extra={"d": DIG}) + """SELECT chunk_id, concat('- Chunk ', chunk_id, ': resumo ', l_suppkey::VARCHAR, ' | Padroes: ', CASE WHEN n % 2 = 0 THEN concat('estilo: padrão ', n::VARCHAR) ELSE 'Nenhum padrao identificado' END) AS linha FROM d""")
def digest_lines(spark, sf):
    return FD.digest_lines(parsed_digests(spark, sf)).select("chunk_id", "linha")


@query("difficulty_histogram", with_(extra={"d": DIG}) + """SELECT difficulty, count(*) AS n FROM (SELECT ['easy','medium','hard','very_hard'][(n % 4 + 1)::INT] AS difficulty FROM d UNION ALL SELECT 'medium' FROM d) GROUP BY 1""")
def difficulty_histogram(spark, sf):
    return FD.difficulty_histogram(FD.question_analysis(parsed_digests(spark, sf), ["chunk_id"]))


@query("trap_histogram", with_(extra={"d": DIG}) + "SELECT job_id, substring('Negação dupla no enunciado da questão', 1, 30) AS trap, count(*) AS n FROM d WHERE n % 3 = 0 GROUP BY 1")
def trap_histogram(spark, sf):
    return FD.trap_histogram(FD.question_analysis(parsed_digests(spark, sf), ["job_id"]), ["job_id"])


VOTE = {"g": """SELECT type, substring(description, 1, 50) AS key, arg_min(description, pass_no::BIGINT * 1000000000 + evidence_id::BIGINT) AS description, count(*) AS votes, count(DISTINCT evidence_id) AS n_evidence, count(DISTINCT pass_no) AS distinct_passes
 FROM v_patterns GROUP BY ALL""", "f": "SELECT *, CASE WHEN votes >= 3 THEN 'high' WHEN votes = 2 THEN 'medium' ELSE 'low' END AS confidence FROM g"}


def voted(spark, sf):
    return FD.vote(A.patterns(spark, sf), F.col("pass_no").cast("long") * 1000000000 + F.col("evidence_id").cast("long"))


@query("pattern_vote", with_("v_patterns", extra=VOTE) + "SELECT * FROM f")
def pattern_vote(spark, sf):
    return voted(spark, sf).orderBy(F.desc("votes"), "type", "key")


@query("pattern_evidence", with_("v_patterns") + "SELECT DISTINCT type, substring(description, 1, 50) AS key, evidence_id FROM v_patterns")
def pattern_evidence(spark, sf):
    return FD.evidence_rows(A.patterns(spark, sf))


@query("pattern_split", with_("v_patterns", extra=VOTE) + "SELECT type, key, votes FROM f WHERE type IN ('temporal', 'similaridade')")
def pattern_split(spark, sf):
    return voted(spark, sf).filter(F.col("type").isin("temporal", "similaridade")).select("type", "key", "votes")


RECS = {"r": "SELECT o_custkey AS job, o_orderkey AS seq, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS texto FROM orders"}


@query("recommend_dedupe", with_(extra=RECS) + """SELECT job, texto, min(seq) AS ordem FROM r WHERE texto IS NOT NULL GROUP BY ALL UNION ALL SELECT DISTINCT job, 'Aguardando analise completa', 0 FROM r WHERE job % 4 = 0""")
def recommend_dedupe(spark, sf):
    r = scan(spark, sf, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderpriority")).alias("texto"))
    return FD.recommendations(r, ["job"], "texto", "seq")


@query("report_concat", """SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations WHERE text <> '' GROUP BY 1""")
def report_concat(spark, sf):
    return FD.report_concat(scan(spark, sf, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", F.md5("texto").alias("h"))


# --- syllabus --------------------------------------------------------------------------------------------------

@query("flatten_taxonomy", with_("v_nodes") + "SELECT * FROM v_nodes")
def flatten_taxonomy(spark, sf):
    n = T.flatten_taxonomy(A.editais(spark, sf))
    return n.withColumn("node_path", F.array_join(F.col("node_path").cast("array<string>"), "."))


@query("taxonomy_totals", with_("v_nodes") + """SELECT edital_id, count(*) FILTER (WHERE depth = 0) AS disciplinas, count(*) FILTER (WHERE depth = 1) AS assuntos, count(*) FILTER (WHERE depth = 2) AS topicos,
 count(*) FILTER (WHERE depth > 0) AS itens FROM v_nodes GROUP BY 1""")
def taxonomy_totals(spark, sf):
    return T.taxonomy_totals(T.flatten_taxonomy(A.editais(spark, sf)))


@query("edital_disciplines", with_("v_nodes", extra={"s": f"SELECT edital_id, string_agg({norm('texto')}, ';' ORDER BY node_path) AS d, string_agg(texto, ';' ORDER BY node_path) AS r FROM v_nodes WHERE depth = 0 GROUP BY 1"}) + """
 SELECT p_partkey AS edital_id, coalesce(d, '') AS disciplinas, coalesce(r, '') AS originais FROM part LEFT JOIN s ON edital_id = p_partkey""")
def edital_disciplines(spark, sf):
    return A.editais(spark, sf).select("edital_id", F.array_join(T.discipline_keys(F.col("taxonomia")), ";").alias("disciplinas"),
                                       F.array_join(T.disciplines(F.col("taxonomia")), ";").alias("originais"))


@query("has_taxonomy", with_("v_edital_src") + "SELECT edital_id, shape <> 'none' AS tem FROM v_edital_src")
def has_taxonomy(spark, sf):
    return A.editais(spark, sf).select("edital_id", T.has_taxonomy(F.col("taxonomia")).alias("tem"))


@query("edital_coverage_counts", with_("v_nodes", "v_class", extra={"c": "SELECT disciplina, assunto AS texto, count(DISTINCT questao_id) AS n FROM v_class GROUP BY ALL"}) + """
 SELECT edital_id, node_path, disciplina, texto, coalesce(n, 0) AS n FROM v_nodes LEFT JOIN c USING (disciplina, texto)""")
def edital_coverage_counts(spark, sf):
    from provalake.operators.aggregates import counts

    c = counts(A.classificacoes(spark, sf), ["disciplina", "assunto"], distinct="questao_id")
    out = T.coverage_counts(T.flatten_taxonomy(A.editais(spark, sf)), c)
    return out.withColumn("node_path", F.array_join(F.col("node_path").cast("array<string>"), "."))


NM = "trim(lower(strip_accents({0})))"
FW = "split_part(" + NM + ", ' ', 1)"
TREE = {
    "ln": "SELECT projeto_id, n.* FROM v_projetos JOIN v_nodes n USING (edital_id)",
    "dc": f"SELECT projeto_id, disciplina AS key, count(*) AS n, {NM.format('disciplina')} AS nm, {FW.format('disciplina')} AS fw FROM v_qp WHERE disciplina IS NOT NULL GROUP BY ALL",
    "tc": f"""SELECT projeto_id, {NM.format('c.disciplina')} AS dn, assunto AS key, count(DISTINCT questao_id) AS n, {NM.format('assunto')} AS nm, {FW.format('assunto')} AS fw
 FROM v_class c JOIN v_provas USING (prova_id) WHERE assunto IS NOT NULL GROUP BY projeto_id, c.disciplina, assunto""",
    "dcn": "SELECT projeto_id, nm, arg_min(n, key) AS n FROM dc GROUP BY ALL", "dcf": "SELECT projeto_id, fw, sum(n) AS n FROM dc GROUP BY ALL",
    "tcn": "SELECT projeto_id, dn, nm, arg_min(n, key) AS n FROM tc GROUP BY ALL", "tcf": "SELECT projeto_id, dn, fw, sum(n) AS n FROM tc WHERE fw <> '' GROUP BY ALL",
    "top": f"""SELECT ln.*, coalesce(a.n, b.n, c.n, 0)::BIGINT AS count FROM ln LEFT JOIN dc a ON a.projeto_id = ln.projeto_id AND a.key = ln.texto
 LEFT JOIN dcn b ON b.projeto_id = ln.projeto_id AND b.nm = {NM.format('ln.texto')} LEFT JOIN dcf c ON c.projeto_id = ln.projeto_id AND c.fw = {FW.format('ln.texto')} WHERE depth = 0""",
    "low": f"""SELECT ln.*, CASE WHEN shape = 'nested' OR depth = 1 THEN coalesce(b.n, c.n, 0)::BIGINT ELSE 0 END AS count FROM ln LEFT JOIN tcn b ON b.projeto_id = ln.projeto_id AND b.dn = {NM.format('ln.disciplina')} AND b.nm = {NM.format('ln.texto')}
 LEFT JOIN tcf c ON c.projeto_id = ln.projeto_id AND c.dn = {NM.format('ln.disciplina')} AND c.fw = {FW.format('ln.texto')} WHERE depth > 0""",
}
TREE_COLS = "projeto_id, edital_id, node_path, depth, item_id, texto, full_path, count"


def tree(spark, sf, scoped=False):
    q = A.questoes_provas(spark, sf)
    labels = A.classificacoes(spark, sf).join(A.provas(spark, sf).select("prova_id", "projeto_id"), "prova_id")
    return I.incidence(A.projetos(spark, sf), A.editais(spark, sf), q, labels, scoped)


@query("incidence_tree", with_("v_projetos", "v_nodes", "v_qp", "v_class", extra=TREE) + f"SELECT {TREE_COLS} FROM top UNION ALL SELECT {TREE_COLS} FROM low")
def incidence_tree(spark, sf):
    t = tree(spark, sf)
    return t.withColumn("node_path", F.array_join(F.col("node_path").cast("array<string>"), ".")).select(*TREE_COLS.split(", "))


def nested_level(depth, below):
    """Lists of the nodes of one depth, as JSON, by their parent; `below` has those of the next depth."""
    kids = f"LEFT JOIN {below} k USING (projeto_id, edital_id, node_path)" if below else ""
    inner = "coalesce(k.kids, '[]')" if below else "'[]'"
    parent = r"regexp_replace(node_path, '\.?[0-9]+$', '')"
    return f"""SELECT projeto_id, edital_id, {parent} AS node_path, concat('[', string_agg(concat(h, ',"children":', {inner}, '}}'), ',' ORDER BY p), ']') AS kids FROM n {kids} WHERE depth = {depth} GROUP BY ALL"""


NEST = {**TREE, "n": f"""SELECT projeto_id, edital_id, node_path, depth, list_transform(string_split(node_path, '.'), lambda x: x::INT) AS p,
 concat('{{"id":', to_json(item_id)::VARCHAR, ',"nome":', to_json(texto)::VARCHAR, ',"count":', count::VARCHAR) AS h FROM (SELECT {TREE_COLS} FROM top UNION ALL SELECT {TREE_COLS} FROM low)""",
        "k3": nested_level(3, None), "k2": nested_level(2, "k3"), "k1": nested_level(1, "k2"), "k0": nested_level(0, "k1")}


@query("nest_tree", with_("v_projetos", "v_nodes", "v_qp", "v_class", extra=NEST) + "SELECT projeto_id, edital_id, kids AS arvore FROM k0")
def nest_tree(spark, sf):
    return T.nest_tree(tree(spark, sf), ["projeto_id", "edital_id"])


@query("job_result_row", with_("v_jobs") + """SELECT job_id, status, (job_id % 4)::INT AS similar_pairs_count, 0 AS chunk_digests_count, status = 'completed' AS has_report, disciplina, CASE WHEN status = 'completed' THEN 7 ELSE total_questoes END AS total_questoes,
 CASE WHEN status = 'completed' THEN 2 ELSE 0 END AS n_temporal, 0 AS n_similarity, CASE WHEN status = 'completed' THEN 1 ELSE 0 END AS n_recomendacoes, CASE WHEN job_id % 2 = 0 THEN 5 ELSE 0 END AS original_claims,
 CASE WHEN job_id % 2 = 0 THEN 3 ELSE 0 END AS verified_claims, 0 AS rejected_claims FROM v_jobs""")
def job_result_row(spark, sf):
    k = F.col("job_id")
    j = A.jobs(spark, sf).withColumns({
        "similar_pairs": F.to_json(F.transform(F.slice(F.array(*[F.lit(i) for i in (1, 2, 3)]), F.lit(1), (k % 4).cast("int")), lambda i: F.struct(i.alias("q1")))),
        "chunk_digests": F.lit(None).cast("string"),
        "analysis_report": F.when(F.col("status") == "completed", '{"total_questoes":7,"temporal_patterns":[{"a":1},{"a":2}],"study_recommendations":["x"]}'),
        "verified_report": F.when(k % 2 == 0, '{"original_claims":5,"verified_claims":3}')})
    return FD.job_result_row(j)
