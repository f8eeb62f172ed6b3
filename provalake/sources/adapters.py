"""Exam-shaped views over the star-schema tables, built with DataFrame expressions.

None of these views samples or truncates: each keeps every row of its base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provalake.sources.tables import scan, spread


def discipline_of(p_type):
    return (
        F.when(p_type == "STANDARD", "Português")
        .when(p_type == "PROMO", "LÍNGUA PORTUGUESA")
        .when(p_type == "SMALL", "Matemática")
        .when(p_type == "LARGE", "Raciocínio Lógico")
        .when(p_type == "ECONOMY", "Legislação Básica")
        .otherwise("Inglês")
    )


def projetos(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, "customer").select(
        F.col("c_custkey").alias("projeto_id"),
        F.col("c_name").alias("nome"),
        F.col("c_mktsegment").alias("banca"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("configurando")).otherwise("coletando").alias("status"),
        F.col("c_nationkey").alias("ano_base"),
        F.when(F.col("c_custkey") % 13 != 0, F.col("c_custkey")).alias("edital_id"),
    )


def provas(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = (
        F.when(key % 7 == 0, "failed").when(key % 11 == 0, "retry")
        .when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing")
        .otherwise("partial")
    )
    return scan(spark, root, "orders").select(
        key.alias("prova_id"),
        F.col("o_custkey").alias("projeto_id"),
        F.concat(F.lit("prova-"), key.cast("string")).alias("nome"),
        F.year("o_orderdate").cast("int").alias("ano"),
        F.col("o_orderpriority").alias("fonte"),
        status.alias("queue_status"),
        F.col("o_orderdate").alias("created_at"),
    )


def questoes(spark: SparkSession, root: str) -> DataFrame:
    line, part = spread(scan(spark, root, "lineitem"), "l_orderkey", "l_partkey"), scan(spark, root, "part")
    text = lambda c: F.col(c).cast("string")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"),
                    F.col("l_quantity").cast("int").cast("string")).alias("questao_id"),
        F.col("l_orderkey").alias("prova_id"),
        F.col("l_linenumber").alias("numero"),
        F.when(F.col("l_suppkey") % 20 == 0, F.lit(None).cast("string")).otherwise(discipline_of(F.col("p_type"))).alias("disciplina"),
        F.when(F.col("p_size") % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("assunto_pci"),
        F.col("p_name").alias("enunciado"),
        F.lit("ABCDE").substr(1 + F.col("l_linenumber") % 5, F.lit(1)).alias("gabarito"),
        (F.col("l_returnflag") == "R").alias("anulada"),
        F.round(F.col("l_discount") * 1000).cast("int").alias("confianca_score"),
    )


def questoes_provas(spark: SparkSession, root: str) -> DataFrame:
    """Questions with their exam's project, year and board."""
    exams = provas(spark, root).select("prova_id", "projeto_id", "ano", F.col("fonte").alias("banca"))
    return questoes(spark, root).join(exams, "prova_id")


def classificacoes(spark: SparkSession, root: str) -> DataFrame:
    n = F.col("numero")
    topic = (
        F.when(n == 1, F.lit("Sintaxe")).when(n == 2, "Sintaxe do período").when(n == 3, "Período Composto")
        .when(n == 4, "Proposições").when(n == 5, F.lit(None).cast("string")).otherwise(F.col("assunto_pci"))
    )
    return questoes(spark, root).filter(~F.col("anulada")).select(
        "questao_id", "prova_id",
        F.when(F.col("disciplina").isin("Português", "LÍNGUA PORTUGUESA"), "Língua Portuguesa")
        .otherwise(F.coalesce("disciplina", F.lit("Inglês"))).alias("disciplina"),
        topic.alias("assunto"),
        (F.col("confianca_score").cast("double") / 100).alias("confianca_assunto"),
    )


def editais(spark: SparkSession, root: str) -> DataFrame:
    """One syllabus document per part: the nested form, the older topic form, or empty."""
    disc, brand, name = discipline_of(F.col("p_type")), F.col("p_brand"), F.col("p_name")
    size = F.col("p_size").cast("string")
    nested = F.concat(
        F.lit('{"disciplinas":[{"nome":"Língua Portuguesa","itens":[{"id":"1","texto":"Compreensão e interpretação de textos","filhos":[]},'
              '{"id":"2","texto":"Sintaxe","filhos":[{"id":"2.1","texto":"Período Simples","filhos":[]},'
              '{"id":"2.2","texto":"Período Composto","filhos":[]}]}]},{"nome":"'), disc,
        F.lit('","itens":[{"id":"1","texto":"'), brand, F.lit('","filhos":[{"id":null,"texto":"'), name,
        F.lit('","filhos":[]}]},{"id":"'), size,
        F.lit('","texto":null,"filhos":[]},{"id":"3","texto":"Proposições"}]}]}'),
    )
    legacy = F.concat(
        F.lit('{"disciplinas":[{"nome":"'), disc, F.lit('","assuntos":[{"nome":"'), brand,
        F.lit('","topicos":[{"nome":"'), name, F.lit('","subtopicos":["'), size, F.lit('",{"nome":"Sintaxe"}]}]}]}]}'),
    )
    key = F.col("p_partkey")
    doc = F.when(key % 10 == 0, F.lit('{"disciplinas":[]}')).when(key % 10 == 5, F.lit(None).cast("string")).when(
        key % 3 == 0, legacy).otherwise(nested)
    return spread(scan(spark, root, "part"), "p_partkey").select(
        key.alias("edital_id"), name.alias("nome"), brand.alias("banca"),
        (F.lit(2000) + F.col("p_size")).cast("int").alias("ano"), doc.alias("taxonomia"),
    )


def jobs(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("projeto_id"),
        F.col("o_orderpriority").alias("disciplina"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
        .otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderkey") % 50).cast("int").alias("total_questoes"),
    )


def quota_events(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, "events").select(
        "event_id", "ts",
        F.when(F.col("user_id") % 2 == 0, "groq").otherwise("anthropic").alias("provider"),
        F.floor(F.col("value") * 10).cast("int").alias("tokens_used"),
        (F.col("event_type") != "error").alias("success"),
    )


def patterns(spark: SparkSession, root: str) -> DataFrame:
    """Findings of several passes over the whole line table."""
    kind = F.element_at(F.array(*map(F.lit, ["temporal", "similaridade", "dificuldade", "estilo", "pegadinha"])),
                        F.col("l_linenumber") % 5 + 1)
    return spread(scan(spark, root, "lineitem"), "l_orderkey", "l_partkey").join(
        scan(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select(
        kind.alias("type"),
        F.concat("p_name", F.lit(" in "), "p_brand", F.lit(" and "), "p_type").alias("description"),
        F.col("l_suppkey").cast("string").alias("evidence_id"),
        F.col("l_linenumber").alias("pass_no"),
    )


def exam_text(spark: SparkSession, root: str) -> DataFrame:
    """Two questions per document in one of two header grammars; the stems are the two halves of the whole text."""
    half = F.floor(F.length("text") / 2).cast("int")
    one = F.col("text").substr(F.lit(1), half)
    two = F.col("text").substr(half + 1, F.length("text"))
    voided = F.when(F.col("doc_id") % 5 == 0, " ANULADA").otherwise("")
    options = F.concat(F.lit("\nA) opção "), "source", F.lit("\nB) opção "), "lang", F.lit("\nC) item "),
                       F.col("doc_id").cast("string"), F.lit("\nD) nenhuma\nE) todas\n"))
    marked = F.concat(F.lit("Língua Portuguesa\nQuestão 01 (Correta: C)\n"), one, options,
                      F.lit("Informática\nQuestão 02\n"), two, voided, F.lit("\nA) sim\nB) não\nResposta: B"))
    legacy = F.concat(F.lit("1. [Português - Sintaxe] "), one, options, F.lit("Resposta: D\n2. [Informática] "), two,
                      voided, F.lit("\nA) sim\nB) não\nResposta: B"))
    return spread(scan(spark, root, "documents"), "doc_id").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, legacy).otherwise(marked).alias("full_text"))


def responses(spark: SparkSession, root: str) -> DataFrame:
    """Model answers: fenced but cut short, fenced, and bare."""
    key, fence = F.col("doc_id"), "```"
    return scan(spark, root, "documents").select(
        "doc_id",
        F.when(key % 10 == 0, F.lit(fence + 'json\n{"disciplina":"Língua Portuguesa","assunto":'))
        .when(key % 3 == 0, F.concat(F.lit(fence + 'json\n{"disciplina":"Língua Portuguesa","assunto":"'), "lang",
                                     F.lit('","confianca_assunto":0.8}\n' + fence)))
        .otherwise(F.concat(F.lit('{"disciplina":"Informática","assunto":"'), "source", F.lit('"}'))).alias("response"),
    )


def digests(spark: SparkSession, root: str) -> DataFrame:
    """Chunk analyses as model answers: one per order line, two questions and up to one pattern each."""
    n = F.col("l_linenumber")
    level = F.when(n % 4 == 0, "easy").when(n % 4 == 1, "medium").when(n % 4 == 2, "hard").otherwise("very_hard")
    trap = F.when(n % 3 == 0, F.lit('true,"trap_description":"Negação dupla no enunciado da questão"')).when(
        n % 3 == 1, F.lit('true,"trap_description":""')).otherwise(F.lit("false"))
    body = F.concat(
        F.lit('{"chunk_digest":"resumo '), F.col("l_suppkey").cast("string"), F.lit('","patterns_found":['),
        F.when(n % 2 == 0, F.concat(F.lit('{"type":"estilo","description":"padrão '), n.cast("string"),
                                    F.lit('","evidence_ids":["1"],"confidence":"low"}'))).otherwise(F.lit("")),
        F.lit('],"questions_analysis":[{"id":"a","difficulty":"'), level, F.lit('","has_trap":'), trap,
        F.lit('},{"id":"b"}]}'),
    )
    lines = spread(scan(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", "l_partkey")
    return lines.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string")).alias("chunk_id"),
        F.col("l_orderkey").alias("job_id"), body.alias("response"),
    )


def vectors(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def claims(spark: SparkSession, root: str) -> DataFrame:
    """User turns as claims of a report (the conversation)."""
    return scan(spark, root, "conversations").filter("role = 'user'").select(
        F.col("conv_id").alias("report_id"), F.col("turn").alias("claim_no"), F.col("text").alias("claim"))


def evidence(spark: SparkSession, root: str) -> DataFrame:
    """Assistant turns as the evidence pool of the same report."""
    return scan(spark, root, "conversations").filter("role = 'assistant'").select(
        F.col("conv_id").alias("report_id"), F.col("turn").alias("evidence_no"), F.col("text").alias("enunciado"))


def page_texts(spark: SparkSession, root: str) -> DataFrame:
    """Pages grouped into documents by host, in page order."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return scan(spark, root, "pages").select(host.alias("doc"), F.col("page_id").alias("page"), F.col("html").alias("text"))
