"""Names, word lists, patterns and limits that results depend on."""

# Discipline spellings treated as the same subject (keys and entries are normalized names).
DISCIPLINE_ALIASES = {
    "portugues": ["lingua portuguesa", "portugues", "redacao", "interpretacao de texto"],
    "lingua portuguesa": ["portugues", "lingua portuguesa", "redacao"],
    "matematica": ["matematica", "raciocinio logico", "raciocinio logico-matematico", "rlm",
                   "matematica e raciocinio logico"],
    "raciocinio logico": ["matematica", "raciocinio logico", "raciocinio logico-matematico", "rlm",
                          "matematica e raciocinio logico"],
    "raciocinio logico-matematico": ["matematica", "raciocinio logico", "rlm"],
    "matematica e raciocinio logico": ["matematica", "raciocinio logico", "rlm"],
    "informatica": ["informatica", "nocoes de informatica", "tecnologia da informacao", "ti", "tecnologia"],
    "nocoes de informatica": ["informatica", "nocoes de informatica"],
    "tecnologia": ["informatica", "tecnologia"],
    "direito constitucional": ["direito constitucional", "constitucional"],
    "direito administrativo": ["direito administrativo", "administrativo"],
    "direito penal": ["direito penal", "penal"],
    "direito civil": ["direito civil", "civil"],
    "direito tributario": ["direito tributario", "tributario"],
    "direito processual": ["direito processual", "processual"],
    "administracao": ["administracao", "administracao publica", "adm"],
    "administracao publica": ["administracao", "administracao publica"],
    "contabilidade": ["contabilidade", "contabilidade geral", "contabilidade publica"],
    "contabilidade geral": ["contabilidade", "contabilidade geral"],
    "economia": ["economia", "economia brasileira", "macroeconomia", "microeconomia"],
    "afo": ["afo", "administracao financeira e orcamentaria", "orcamento publico"],
    "administracao financeira e orcamentaria": ["afo", "administracao financeira e orcamentaria"],
    "legislacao": ["legislacao", "legislacao basica", "nocoes de legislacao"],
    "legislacao basica": ["legislacao", "legislacao basica"],
    "atualidades": ["atualidades", "conhecimentos gerais", "realidade brasileira"],
    "conhecimentos gerais": ["atualidades", "conhecimentos gerais"],
    "redacao": ["redacao", "portugues", "lingua portuguesa"],
}

# Normalized discipline name -> display name ("redacao" counts as Língua Portuguesa).
CANONICAL_DISCIPLINES = {
    "lingua portuguesa": "Língua Portuguesa",
    "portugues": "Língua Portuguesa",
    "redacao": "Língua Portuguesa",
    "matematica": "Matemática e Raciocínio Lógico",
    "raciocinio logico": "Matemática e Raciocínio Lógico",
    "logica": "Matemática e Raciocínio Lógico",
    "raciocinio logico-matematico": "Matemática e Raciocínio Lógico",
    "matematica e raciocinio logico": "Matemática e Raciocínio Lógico",
    "informatica": "Informática",
    "nocoes de informatica": "Noções de Informática",
    "direito constitucional": "Direito Constitucional",
    "direito administrativo": "Direito Administrativo",
    "direito penal": "Direito Penal",
    "direito civil": "Direito Civil",
    "direito tributario": "Direito Tributário",
    "direito processual": "Direito Processual",
    "administracao": "Administração",
    "administracao publica": "Legislação e Administração Pública",
    "legislacao": "Legislação e Administração Pública",
    "legislacao basica": "Legislação e Administração Pública",
    "legislacao basica aplicada a administracao publica": "Legislação e Administração Pública",
    "nocoes de legislacao": "Legislação e Administração Pública",
    "nocoes de administracao publica": "Legislação e Administração Pública",
    "contabilidade": "Contabilidade",
    "contabilidade geral": "Contabilidade Geral",
    "contabilidade publica": "Contabilidade Pública",
    "economia": "Economia",
    "afo": "AFO",
    "administracao financeira e orcamentaria": "Administração Financeira e Orçamentária",
    "atualidades": "Atualidades",
    "conhecimentos gerais": "Conhecimentos Gerais",
    "tecnologia": "Tecnologia",
    "tecnologia da informacao": "Tecnologia da Informação",
}

# Sections that hold essays, not multiple-choice questions.
ESSAY_DISCIPLINES = ["redação", "redacao", "prova discursiva", "discursiva"]

# Exam boards, in the order they are tried (file names; cover pages).
FILE_BOARDS = ["fcc", "cespe", "cesgranrio", "vunesp", "fgv", "quadrix", "ibfc", "aocp", "fundatec"]
COVER_BOARDS = ["IDCAP", "FCC", "CESPE", "CEBRASPE", "VUNESP", "FGV", "CESGRANRIO", "QUADRIX", "IBFC", "AOCP",
                "FUNDATEC", "IADES", "FUNDEP"]

# Words that mark a leading parenthesis as an exam tag.
EXAM_TAG_WORDS = ["CESPE", "FCC", "VUNESP", "CEBRASPE", "FGV", "ESAF", "IBFC", "CESGRANRIO", "Prova", "TRF", "TRT",
                  "TRE", "STF", "STJ", "MPU", "MPF", "Região", "Analista", "Técnico"]

# Accented letters accepted in words and in joined-word repair.
WORD_LETTERS = "a-zA-ZáéíóúâêîôûãõçÁÉÍÓÚÂÊÎÔÛÃÕÇ"
LOWER_LETTERS = "a-záéíóúâêôãõç"
UPPER_LETTERS = "A-ZÁÉÍÓÚÂÊÔÃÕÇ"

# Section names that open a discipline in exam text with question headers.
SECTION_NAMES = [r"Língua\s+Portuguesa", "Matemática", r"Raciocínio\s+Lógico", "Informática", "Legislação",
                 r"Conhecimentos\s+Específicos", r"Noções\s+de"]

# Stand-alone discipline header lines in scanned text ("." stands for a damaged accent).
HEADER_LINES = [r"L.ngua\s+Portuguesa", "Portugu.s", r"Matem.tica\s+e\s+Racioc.nio\s+L.gico",
                r"Racioc.nio\s+L.gico", "Inform.tica", r"Legisla..o[^\n]{0,60}", r"No..es\s+de[^\n]{0,60}",
                r"Conhecimentos\s+(?:Espec.ficos|Gerais)[^\n]{0,60}",
                r"Direito\s+(?:Constitucional|Administrativo|Penal|Civil|Tribut.rio|Processual)[^\n]{0,30}"]

# Processing states.
COMPLETED_STATES = ["completed", "partial"]
PROCESSING_STATES = ["validating", "processing", "retry"]
CANCELLABLE_EXAM_STATES = ["pending", "validating", "processing"]
CANCELLABLE_JOB_STATES = ["pending", "running"]

# Per-provider usage limits (requests/tokens per minute/day).
QUOTA_LIMITS = [
    # provider, requests_per_minute, requests_per_day, tokens_per_minute, tokens_per_day
    ("groq", 1000, 100000, 300000, 100000000),
    ("anthropic", 50, 10000, 100000, 1000000),
]

# Texts written into results.
NO_DISCIPLINE = "Sem disciplina"
NO_TOPIC = "Sem assunto"
NOT_CLASSIFIED = "Não classificada"
NO_PATTERN = "Nenhum padrao identificado"
NO_RECOMMENDATION = "Aguardando analise completa"
SHORT_STEM_ALERT = "Enunciado muito curto"
OPTIONS_ALERT = "Número de alternativas inválido: "
WARNING_HEAD = "AVISO: As seguintes afirmacoes nao puderam ser verificadas:\n"
