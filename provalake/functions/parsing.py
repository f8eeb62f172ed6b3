"""Cutting exam text into questions, as array expressions over one text column.

Everything about a document happens inside its row, so parsing needs no shuffle and no per-document task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provalake import constants as C
from provalake.functions.once import let
from provalake.functions.text import not_blank, trim_all

# Fixed patterns: the two question header grammars, option marks and answer marks.
BRACKET_HEADER = r"(\d+)\.\s*\[([^\]]+)\]"
MARKED_HEADER = r"(?iu)Quest[aã]o\s*(\d+)\s*(?:\(Correta:\s*([A-E])\))?"
BRACKET_CUT = r"(?<!\d)(?=\d+\.\s*\[[^\]]+\])"
MARKED_CUT = r"(?iu)(?=Quest[aã]o\s*\d+)"
SECTION = r"(?iu)(?:^|\n)\s*((?:" + "|".join(C.SECTION_NAMES) + r")[^\n]*)"
OPTION = r"(?s)([A-E])\)\s*(.+?)(?=[A-E]\)|Resposta:|$)"
OPTION_DOT = r"(?s)([A-E])\.?\s*(.+?)(?=[A-E]\.?\s|Resposta:|$)"
PAREN_OPTION = r"(?s)\(([A-E])\)\s*([^(]*?)(?=\([A-E]\)|$)"
LINE_OPTION = r"(?dms)(?:^|\n)\s*([A-E])\s*[).\-]\s*([^\n]*?)(?=(?:^|\n)\s*[A-E]\s*[).\-]|$)"
PAREN_MARK = r"\([A-E]\)"
LINE_MARK = r"(?:^|\n)\s*([A-E])\s*[).\-]"


def all_matches(col: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def header_style(text: Column) -> Column:
    """Header grammar with more hits; the bracket form wins a tie, null when neither occurs."""
    bracket = F.regexp_count(text, F.lit(BRACKET_HEADER))
    marked = F.regexp_count(text, F.lit(MARKED_HEADER))
    return F.when((bracket >= marked) & (bracket > 0), "bracket").when(marked > 0, "marked")


def question_blocks(text: Column, style: Column) -> Column:
    """Structs (numero, disciplina, assunto_pci, gabarito_cabecalho, bloco) in document order."""
    bracket_parts = F.filter(F.split(text, BRACKET_CUT), lambda p: p.rlike("^" + BRACKET_HEADER))
    bracket = F.transform(bracket_parts, lambda p: _bracket_block(p))
    pieces = F.split(text, MARKED_CUT)
    heads = F.transform(pieces, lambda p: F.try_element_at(all_matches(p, SECTION, 1), F.lit(-1)))
    starts = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    marked_parts = F.filter(starts, lambda s: s["p"].rlike(r"^(?iu)Quest[aã]o\s*\d+"))
    marked = F.transform(marked_parts, lambda s: _marked_block(s, heads))
    return F.when(style == "bracket", bracket).when(style == "marked", marked)


def _bracket_block(p: Column) -> Column:
    labels = F.split(F.regexp_extract(p, BRACKET_HEADER, 2), "-")
    part = lambda n: trim_all(F.try_element_at(labels, F.lit(n)))
    return F.struct(
        F.regexp_extract(p, BRACKET_HEADER, 1).cast("int").alias("numero"), part(1).alias("disciplina"),
        part(2).alias("assunto_pci"), F.lit(None).cast("string").alias("gabarito_cabecalho"),
        trim_all(F.regexp_replace(p, "^" + BRACKET_HEADER, "")).alias("bloco"))


def _marked_block(s: Column, heads: Column) -> Column:
    p = s["p"]
    # the last section header of an earlier piece starts before this question
    before = F.filter(F.slice(heads, F.lit(1), s["i"]), lambda h: h.isNotNull())
    return F.struct(
        F.regexp_extract(p, MARKED_HEADER, 1).cast("int").alias("numero"),
        trim_all(F.try_element_at(before, F.lit(-1))).alias("disciplina"), F.lit(None).cast("string").alias("assunto_pci"),
        not_blank(F.regexp_extract(p, MARKED_HEADER, 2)).alias("gabarito_cabecalho"),
        trim_all(F.regexp_replace(p, "^" + MARKED_HEADER, "")).alias("bloco"))


def options_map(letters: Column, texts: Column) -> Column:
    """Letter -> text. A repeated letter keeps its last text, at the place of its first mention."""
    keys = F.array_distinct(letters)
    last = F.transform(keys, lambda k: trim_all(F.element_at(F.filter(
        F.arrays_zip(letters.alias("l"), texts.alias("t")), lambda z: z["l"] == k), -1)["t"]))
    return F.map_from_arrays(keys, last)


def block_options(block: Column) -> Column:
    first, second = all_matches(block, OPTION, 1), all_matches(block, OPTION_DOT, 1)
    return F.when(F.size(first) > 0, options_map(first, all_matches(block, OPTION, 2))).otherwise(
        options_map(second, all_matches(block, OPTION_DOT, 2)))


def block_voided(block: Column) -> Column:
    return F.upper(block).contains("ANULADA")


def block_answer(block: Column, header_answer: Column) -> Column:
    """Answer letter: from the header, else ``Resposta:``, else ``(Correta:)``; none for a voided question."""
    found = F.coalesce(header_answer, not_blank(F.regexp_extract(block, r"Resposta:\s*([A-E])", 1)),
                       not_blank(F.regexp_extract(block, r"\(Correta:\s*([A-E])\)", 1)))
    return F.when(~block_voided(block), found)


def block_stem(block: Column, options: Column) -> Column:
    """Text before the first option, without any answer line."""
    first = F.try_element_at(F.map_keys(options), F.lit(1))
    at = F.position(F.concat(first, F.lit(")")), block, F.lit(2))  # a mark at the very start is no end of a stem
    stem = F.when(at > 1, block.substr(F.lit(1), at - 1)).otherwise(block)
    return trim_all(F.regexp_replace(trim_all(stem), r"(?m)Resposta:.*$", ""))


def line_list_start(text: Column) -> Column:
    """Characters before the list of options at line starts. The list begins at the first A that B follows, so that a sentence like
    "A. All rights reserved." above it is no option; without such a pair it begins at the first mark."""
    letters, marks, pieces = all_matches(text, LINE_MARK, 1), all_matches(text, LINE_MARK, 0), F.split(text, LINE_MARK)
    pairs = F.zip_with(letters, F.slice(letters, F.lit(2), F.size(letters)), lambda x, y: F.concat(x, y))
    above = F.greatest(F.array_position(pairs, "AB").cast("int"), F.lit(1)) - 1
    chars = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    return let(F.struct(marks.alias("m"), pieces.alias("p"), above.alias("n")), lambda s: chars(s["p"], s["n"] + 1) + chars(s["m"], s["n"]))


def content_parts(text: Column) -> Column:
    """Struct (alternativas, enunciado): options written ``(A)``, or at line starts as ``A)``, ``A.`` or ``A-``, and the text before
    the first mark of the form they have. A list in parentheses begins at its first ``(A)``, so that a "(C) 2020" above it is no
    option; without one it begins at the first mark."""
    paren = all_matches(text, PAREN_OPTION, 1)
    first = F.position(F.lit("(A)"), text)
    listed = F.when(first > 0, text.substr(first, F.length(text))).otherwise(text)
    stem = F.when(first > 0, text.substr(F.lit(1), first - 1)).otherwise(F.element_at(F.split(text, PAREN_MARK, 2), 1))
    in_paren = F.struct(options_map(all_matches(listed, PAREN_OPTION, 1), all_matches(listed, PAREN_OPTION, 2)).alias("alternativas"),
                        trim_all(stem).alias("enunciado"))

    def at_lines(start: Column) -> Column:
        rest = text.substr(start + 1, F.length(text))
        options = options_map(all_matches(rest, LINE_OPTION, 1), all_matches(rest, LINE_OPTION, 2))
        return F.struct(options.alias("alternativas"),
                        F.when(F.size(options) > 0, trim_all(text.substr(F.lit(1), start))).otherwise(text).alias("enunciado"))

    return F.when(F.size(paren) > 0, in_paren).otherwise(let(line_list_start(text), at_lines))


def question_position(text: Column, number: Column) -> Column:
    """1-based position of a question's header: "Questão n", else "n." or "n)", else "n -"; null if absent."""
    n = number.cast("string")
    tries = [
        F.concat(F.lit(r"(?iuU)Quest[aã]o\s*0*"), n, F.lit(r"\b")),
        F.concat(F.lit(r"(?U)(?:^|\n)\s*0*"), n, F.lit(r"\s*[\.\)]\s")),
        F.concat(F.lit(r"(?U)(?:^|\n)\s*0*"), n, F.lit(r"\s*[-–]\s")),
    ]
    return F.coalesce(*[F.nullif(F.regexp_instr(text, p), F.lit(0)) for p in tries])


def header_lines(text: Column) -> Column:
    """Stand-alone discipline header lines as structs (pos, disciplina), in order.

    A header that ends in a preposition takes over the next non-empty line when that is short and no question.
    """
    lines = F.split(text, "\n")
    head = r"(?iuU)^\s*(" + "|".join(C.HEADER_LINES) + r")\s*$"
    rows = F.transform(lines, lambda x, i: F.struct(x.alias("t"), i.alias("i")))
    hits = F.filter(rows, lambda r: r["t"].rlike(head))

    def one(r):
        own = trim_all(r["t"])
        rest = F.filter(F.slice(lines, r["i"] + 2, F.size(lines)), lambda x: trim_all(x) != "")
        nxt = trim_all(F.try_element_at(rest, F.lit(1)))
        joins = own.rlike(r"(?iuU)\b(?:à|a|ao|de|do|e|em|para)\s*$") & (F.length(nxt) < 60) & ~nxt.rlike(
            r"(?iu)quest[aã]o|correta|\d{2,}")
        # lengths of the lines before this one, each with its line break
        pos = F.aggregate(F.slice(lines, F.lit(1), r["i"]), F.lit(1), lambda acc, x: acc + F.length(x) + 1)
        return F.struct(pos.alias("pos"),
                        F.when(F.coalesce(joins, F.lit(False)), F.concat(own, F.lit(" "), nxt)).otherwise(own).alias("disciplina"))

    return F.transform(hits, one)
