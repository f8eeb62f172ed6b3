"""Row types of the exam tables and of the JSON documents that enter as text."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, MapType, StringType, StructField,
                               StructType)


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, I, D, B = StringType(), IntegerType(), DoubleType(), BooleanType()

IMAGE = _struct(arquivo=S, tipo=S, descricao_ocr=S, essencial=B)
QUESTION = _struct(
    numero=I, disciplina=S, assunto_pci=S, enunciado=S, alternativas=MapType(S, S), gabarito=S, anulada=B,
    motivo_anulacao=S, imagens=ArrayType(IMAGE), status_extracao=S, alertas=ArrayType(S),
)
CLASSIFICATION = _struct(
    questao_numero=I, disciplina=S, assunto=S, topico=S, subtopico=S, conceito_especifico=S, item_edital_path=S,
    confianca_disciplina=D, confianca_assunto=D, confianca_topico=D, confianca_subtopico=D, conceito_testado=S,
    habilidade_bloom=S, nivel_dificuldade=S, fora_taxonomia=B, motivo_fora_taxonomia=S,
)
QUESTION_FILE = _struct(
    metadados=_struct(banca=S, cargo=S, ano=I), questoes=ArrayType(QUESTION), classificacoes=ArrayType(CLASSIFICATION)
)
QUESTION_BATCH = _struct(questoes=ArrayType(QUESTION), disciplinas_encontradas=ArrayType(S))
PATTERN = _struct(type=S, description=S, evidence_ids=ArrayType(S), confidence=S)
QUESTION_ANALYSIS = _struct(
    id=S, difficulty=S, difficulty_reasoning=S, bloom_level=S, has_trap=B, trap_description=S
)
CHUNK_DIGEST = _struct(
    chunk_digest=S, patterns_found=ArrayType(PATTERN), questions_analysis=ArrayType(QUESTION_ANALYSIS)
)
SYNTHESIS = _struct(patterns=ArrayType(PATTERN), report_text=S, study_recommendations=ArrayType(S))


def item_type(depth: int) -> StructType:
    """Syllabus item with children down to ``depth`` levels; anything deeper stays as raw JSON text."""
    children = ArrayType(item_type(depth - 1)) if depth > 1 else S
    return _struct(id=S, texto=S, filhos=children)


def taxonomy_type(depth: int) -> StructType:
    topic = _struct(nome=S, subtopicos=ArrayType(S))
    subject = _struct(nome=S, topicos=ArrayType(topic))
    discipline = _struct(nome=S, itens=ArrayType(item_type(depth)), assuntos=ArrayType(subject))
    return _struct(disciplinas=ArrayType(discipline))
