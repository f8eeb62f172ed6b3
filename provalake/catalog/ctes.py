"""Comparison SQL for the adapter views, written for DuckDB and inlined as CTEs."""

DISC = """CASE WHEN p_type='STANDARD' THEN 'Português' WHEN p_type='PROMO' THEN 'LÍNGUA PORTUGUESA' WHEN p_type='SMALL' THEN 'Matemática'
 WHEN p_type='LARGE' THEN 'Raciocínio Lógico' WHEN p_type='ECONOMY' THEN 'Legislação Básica' ELSE 'Inglês' END"""

VIEWS = {
    "v_projetos": """SELECT c_custkey AS projeto_id, c_name AS nome, c_mktsegment AS banca,
 CASE WHEN c_custkey % 10 = 0 THEN 'configurando' ELSE 'coletando' END AS status, c_nationkey AS ano_base,
 CASE WHEN c_custkey % 13 <> 0 THEN c_custkey END AS edital_id FROM customer""",
    "v_provas": """SELECT o_orderkey AS prova_id, o_custkey AS projeto_id, 'prova-' || o_orderkey::VARCHAR AS nome,
 year(o_orderdate)::INT AS ano, o_orderpriority AS fonte, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 THEN 'retry'
 WHEN o_orderstatus='F' THEN 'completed' WHEN o_orderstatus='O' THEN 'processing' ELSE 'partial' END AS queue_status,
 o_orderdate AS created_at FROM orders""",
    "v_questoes": f"""SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR,
 l_quantity::INT::VARCHAR) AS questao_id, l_orderkey AS prova_id, l_linenumber AS numero,
 CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE {DISC} END AS disciplina, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_brand END AS assunto_pci,
 p_name AS enunciado, substring('ABCDE', (1 + l_linenumber % 5)::INT, 1) AS gabarito, l_returnflag='R' AS anulada,
 round(l_discount*1000)::INT AS confianca_score FROM lineitem JOIN part ON l_partkey=p_partkey""",
    "v_qp": """SELECT q.*, p.projeto_id, p.ano, p.fonte AS banca FROM v_questoes q JOIN v_provas p ON q.prova_id=p.prova_id""",
    "v_class": """SELECT questao_id, prova_id, CASE WHEN disciplina IN ('Português','LÍNGUA PORTUGUESA') THEN 'Língua Portuguesa'
 ELSE coalesce(disciplina,'Inglês') END AS disciplina, CASE numero WHEN 1 THEN 'Sintaxe' WHEN 2 THEN 'Sintaxe do período'
 WHEN 3 THEN 'Período Composto' WHEN 4 THEN 'Proposições' WHEN 5 THEN NULL ELSE assunto_pci END AS assunto,
 confianca_score::DOUBLE/100 AS confianca_assunto FROM v_questoes WHERE NOT anulada""",
    "v_jobs": """SELECT o_orderkey AS job_id, o_custkey AS projeto_id, o_orderpriority AS disciplina,
 CASE WHEN o_orderstatus='F' THEN 'completed' WHEN o_orderstatus='O' THEN 'running' ELSE 'failed' END AS status,
 o_orderdate AS created_at, (o_orderkey % 50)::INT AS total_questoes FROM orders""",
    "v_quota": """SELECT event_id, ts, CASE WHEN user_id % 2 = 0 THEN 'groq' ELSE 'anthropic' END AS provider,
 floor(value*10)::INT AS tokens_used, event_type <> 'error' AS success FROM events""",
    "v_patterns": """SELECT (['temporal','similaridade','dificuldade','estilo','pegadinha'])[(l_linenumber % 5 + 1)::INT] AS type,
 p_name || ' in ' || p_brand || ' and ' || p_type AS description, l_suppkey::VARCHAR AS evidence_id, l_linenumber AS pass_no
 FROM lineitem JOIN part ON l_partkey=p_partkey""",
    "v_exam_text": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('1. [Português - Sintaxe] ', one, opts, 'Resposta: D', chr(10), '2. [Informática] ',
 two, voided, chr(10), 'A) sim', chr(10), 'B) não', chr(10), 'Resposta: B') ELSE concat('Língua Portuguesa', chr(10), 'Questão 01 (Correta: C)', chr(10), one, opts,
 'Informática', chr(10), 'Questão 02', chr(10), two, voided, chr(10), 'A) sim', chr(10), 'B) não', chr(10), 'Resposta: B') END AS full_text FROM (
 SELECT doc_id, substring(text, 1, length(text)//2) AS one, substring(text, length(text)//2 + 1) AS two,
 CASE WHEN doc_id % 5 = 0 THEN ' ANULADA' ELSE '' END AS voided,
 concat(chr(10), 'A) opção ', source, chr(10), 'B) opção ', lang, chr(10), 'C) item ', doc_id::VARCHAR, chr(10), 'D) nenhuma', chr(10), 'E) todas', chr(10)) AS opts
 FROM documents)""",
    "v_responses": """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN concat('```json', chr(10), '{"disciplina":"Língua Portuguesa","assunto":')
 WHEN doc_id % 3 = 0 THEN concat('```json', chr(10), '{"disciplina":"Língua Portuguesa","assunto":"', lang, '","confianca_assunto":0.8}', chr(10), '```')
 ELSE concat('{"disciplina":"Informática","assunto":"', source, '"}') END AS response FROM documents""",
    "v_claims": "SELECT conv_id AS report_id, turn AS claim_no, text AS claim FROM conversations WHERE role='user'",
    "v_evidence": "SELECT conv_id AS report_id, turn AS evidence_no, text AS enunciado FROM conversations WHERE role='assistant'",
    "v_pages": "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS doc, page_id AS page, html AS text FROM pages",
    # Syllabus nodes straight from the part table (the Spark side parses JSON documents instead).
    "v_edital_src": f"""SELECT p_partkey AS edital_id, {DISC} AS disc, p_brand, p_name, p_size::VARCHAR AS size,
 CASE WHEN p_partkey % 10 IN (0, 5) THEN 'none' WHEN p_partkey % 3 = 0 THEN 'legacy' ELSE 'nested' END AS shape FROM part""",
    "v_nodes": """
 SELECT edital_id, 'nested' AS shape, '0' AS node_path, 0 AS depth, 'disciplina-0' AS item_id, 'Língua Portuguesa' AS disciplina, 'Língua Portuguesa' AS texto, 'Língua Portuguesa' AS full_path, NULL AS parent_path FROM v_edital_src WHERE shape='nested'
 UNION ALL SELECT edital_id, 'nested', '0.0', 1, '1', 'Língua Portuguesa', 'Compreensão e interpretação de textos', 'Língua Portuguesa > Compreensão e interpretação de textos', 'Língua Portuguesa' FROM v_edital_src WHERE shape='nested'
 UNION ALL SELECT edital_id, 'nested', '0.1', 1, '2', 'Língua Portuguesa', 'Sintaxe', 'Língua Portuguesa > Sintaxe', 'Língua Portuguesa' FROM v_edital_src WHERE shape='nested'
 UNION ALL SELECT edital_id, 'nested', '0.1.0', 2, '2.1', 'Língua Portuguesa', 'Período Simples', 'Língua Portuguesa > Sintaxe > Período Simples', 'Língua Portuguesa > Sintaxe' FROM v_edital_src WHERE shape='nested'
 UNION ALL SELECT edital_id, 'nested', '0.1.1', 2, '2.2', 'Língua Portuguesa', 'Período Composto', 'Língua Portuguesa > Sintaxe > Período Composto', 'Língua Portuguesa > Sintaxe' FROM v_edital_src WHERE shape='nested'
 UNION ALL SELECT edital_id, 'nested', '1', 0, 'disciplina-1', disc, disc, disc, NULL FROM v_edital_src WHERE shape='nested'
 UNION ALL SELECT edital_id, 'nested', '1.0', 1, '1', disc, p_brand, disc || ' > ' || p_brand, disc FROM v_edital_src WHERE shape='nested'
 UNION ALL SELECT edital_id, 'nested', '1.0.0', 2, 'item-0', disc, p_name, disc || ' > ' || p_brand || ' > ' || p_name, disc || ' > ' || p_brand FROM v_edital_src WHERE shape='nested'
 UNION ALL SELECT edital_id, 'nested', '1.1', 1, size, disc, size, disc || ' > ' || size, disc FROM v_edital_src WHERE shape='nested'
 UNION ALL SELECT edital_id, 'nested', '1.2', 1, '3', disc, 'Proposições', disc || ' > Proposições', disc FROM v_edital_src WHERE shape='nested'
 UNION ALL SELECT edital_id, 'legacy', '0', 0, 'disciplina-0', disc, disc, disc, NULL FROM v_edital_src WHERE shape='legacy'
 UNION ALL SELECT edital_id, 'legacy', '0.0', 1, 'assunto-0', disc, p_brand, disc || ' > ' || p_brand, disc FROM v_edital_src WHERE shape='legacy'
 UNION ALL SELECT edital_id, 'legacy', '0.0.0', 2, 'topico-0', disc, p_name, disc || ' > ' || p_brand || ' > ' || p_name, disc || ' > ' || p_brand FROM v_edital_src WHERE shape='legacy'
 UNION ALL SELECT edital_id, 'legacy', '0.0.0.0', 3, 'subtopico-0', disc, size, disc || ' > ' || p_brand || ' > ' || p_name || ' > ' || size, disc || ' > ' || p_brand || ' > ' || p_name FROM v_edital_src WHERE shape='legacy'
 UNION ALL SELECT edital_id, 'legacy', '0.0.0.1', 3, 'subtopico-1', disc, 'Sintaxe', disc || ' > ' || p_brand || ' > ' || p_name || ' > Sintaxe', disc || ' > ' || p_brand || ' > ' || p_name FROM v_edital_src WHERE shape='legacy'""",
}

DEPS = {
    "v_qp": ["v_questoes", "v_provas"],
    "v_class": ["v_questoes"],
    "v_nodes": ["v_edital_src"],
}


def with_(*names: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``WITH`` prefix that defines the named views, what they need, and any extra CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPS.get(name, []):
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
