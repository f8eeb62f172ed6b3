"""Text scalars as Column -> Column expressions, all evaluated inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from provalake import constants as C

_EDGE_SPACE = r"(?U)^\s+|\s+$"


@lru_cache
def _accent_table(form: str) -> tuple[str, str]:
    """Source and target alphabets for translate(), derived from Unicode decompositions."""
    src, dst = [], []
    for code in range(0x80, 0x20000):
        ch = chr(code)
        if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xE000:  # composed syllables keep their parts; surrogates are no letters
            continue
        base = "".join(c for c in unicodedata.normalize(form, ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    blocks = (0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE20, 0xFE30)  # the blocks of combining marks
    marks = "".join(chr(c) for a, b in blocks for c in range(a, b) if unicodedata.combining(chr(c)))  # no target: translate drops them
    return "".join(src) + marks, "".join(dst)


def strip_accents(col: Column, compat: bool = True) -> Column:
    """Drop diacritics. ``compat`` also folds compatibility letters such as the ordinal signs and Latin ligatures."""
    src, dst = _accent_table("NFKD" if compat else "NFD")
    for code in [*range(0xFB00, 0xFB07), 0x132, 0x133] if compat else []:
        col = F.replace(col, F.lit(chr(code)), F.lit(unicodedata.normalize("NFKD", chr(code))))
    return F.translate(col, src, dst)


def trim_all(col: Column) -> Column:
    return F.regexp_replace(col, _EDGE_SPACE, "")


def not_blank(col: Column) -> Column:
    """The value, or null where it is the empty string."""
    return F.nullif(col, F.lit(""))


def normalize_discipline(col: Column) -> Column:
    edges = F.regexp_replace(F.lower(col), r"(?U)^[.,;:!?\s]+|[.,;:!?\s]+$", "")
    return F.coalesce(strip_accents(edges), F.lit(""))


def normalize_name(col: Column) -> Column:
    """Looser form used for syllabus look-ups: no accents, lower case, trimmed."""
    return F.coalesce(trim_all(F.lower(strip_accents(col, compat=False))), F.lit(""))


def first_word(col: Column) -> Column:
    return not_blank(F.regexp_extract(col, r"(?U)^\s*(\S+)", 1))


def fix_mojibake(col: Column) -> Column:
    """Undo UTF-8 text that was read as Latin-1; anything else passes through."""
    as_bytes = F.encode(col, "ISO-8859-1")
    return F.when(
        col.rlike(r"^[\x{0}-\x{FF}]*$"), F.coalesce(F.try_validate_utf8(as_bytes.cast("string")), col)
    ).otherwise(col)


def _title_letter(c: Column) -> Column:
    """Title form of one letter; a letter that widens in upper case (ß) keeps only its first part capital."""
    wide = F.upper(c)
    return F.concat(F.substring(wide, 1, 1), F.lower(wide.substr(F.lit(2), F.length(wide))))


def title_case(col: Column) -> Column:
    runs = F.regexp_extract_all(col, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(_title_letter(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))),
        "",
    )


def canonical_discipline(col: Column) -> Column:
    fixed = fix_mojibake(col)
    names = F.create_map(*[F.lit(x) for kv in C.CANONICAL_DISCIPLINES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, normalize_discipline(fixed)), title_case(trim_all(fixed)), F.lit(""))


def prune_context(col: Column) -> Column:
    """Drop a question-number prefix, a leading exam tag and surplus white space."""
    out = col
    # Fixed patterns: number prefixes, in the order they are tried, then the exam tag.
    for pattern in (
        r"(?iuU)^Questão\s+\d+[.:]\s*",
        r"(?iuU)^QUESTÃO\s+\d+\s*[-–]\s*",
        r"(?iuU)^Q\.\s*\d+[.:]\s*",
        r"(?U)^\d+\)\s*",
        r"(?U)^\d+\s*[-–]\s*",
        r"(?iuU)^\s*\([^)]*(?:" + "|".join(C.EXAM_TAG_WORDS) + r")[^)]*\)\s*",
    ):
        out = F.regexp_replace(out, pattern, "")
    return F.coalesce(trim_all(F.regexp_replace(out, r"(?U)\s+", " ")), F.lit(""))


def estimate_tokens(col: Column) -> Column:
    return F.coalesce(F.floor(F.length(col) / 4).cast("int"), F.lit(0))


def preprocess_ocr(col: Column) -> Column:
    out = F.regexp_replace(col, rf"([,;:])([{C.LOWER_LETTERS}])", "$1 $2")
    out = F.regexp_replace(out, rf"([{C.LOWER_LETTERS}])([{C.UPPER_LETTERS}][{C.LOWER_LETTERS}])", "$1 $2")
    return F.regexp_replace(out, " +", " ")


def clean_watermarks(col: Column) -> Column:
    out = F.regexp_replace(col, r"(?U)pcimarkpci\s+\S+", "")
    return F.regexp_replace(out, r"www\.pciconcursos\.com\.br", "")


def strip_markup(col: Column) -> Column:
    return trim_all(F.regexp_replace(col, r"[#*_`]", ""))


def words(col: Column) -> Column:
    """Alphabetic words of three letters or more after edge punctuation is dropped."""
    return F.regexp_extract_all(
        col, F.lit(rf"(?U)(?<!\S)[^\w\s]*([{C.WORD_LETTERS}]{{3,}})[^\w\s]*(?!\S)"), F.lit(1)
    )


def broken_layout(col: Column) -> Column:
    lines = F.filter(F.transform(F.split(col, "\n"), trim_all), lambda x: x != "")
    single = F.filter(lines, lambda x: ~x.contains(" "))
    return (F.size(lines) > 10) & (F.size(single) / F.greatest(F.size(lines), F.lit(1)) > 0.5)


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def infer_file_metadata(path: Column, sample: Column) -> Column:
    """Board, role and year read from a file name, the board also from the text."""
    name, text = F.lower(file_stem(path)), F.lower(F.coalesce(sample, F.lit("")))
    board = F.coalesce(*[F.when(name.contains(b) | text.contains(b), F.lit(b.upper())) for b in C.FILE_BOARDS])
    role = not_blank(F.regexp_extract(name, r"(?:fcc|cespe|vunesp)[-_](.+?)[-_](?:20\d{2})", 1))
    return F.struct(
        board.alias("banca"),
        title_case(F.replace(role, F.lit("_"), F.lit(" "))).alias("cargo"),
        not_blank(F.regexp_extract(name, r"20\d{2}", 0)).cast("int").alias("ano"),
    )


def infer_cover_metadata(cover: Column) -> Column:
    """Board, role and year read from the text of a cover page."""
    board = F.coalesce(*[F.when(F.upper(cover).contains(b), F.lit(b)) for b in C.COVER_BOARDS])
    labelled = F.regexp_extract(cover, r"(?iuU)(?:cargo|função)[:\s]*([^\n]+)", 1)
    role = F.coalesce(
        not_blank(labelled),
        not_blank(F.regexp_extract(cover, r"(?iu)técnico[^\n]*", 0)),
        not_blank(F.regexp_extract(cover, r"(?iu)analista[^\n]*", 0)),
    )
    return F.struct(
        board.alias("banca"),
        F.substring(trim_all(role), 1, 100).alias("cargo"),
        not_blank(F.regexp_extract(cover, r"20\d{2}", 0)).cast("int").alias("ano"),
    )


def section_slice(text: Column, role: Column) -> Column:
    """Text from the role name up to the next all-capitals heading line; the whole text if absent."""
    # searched in the text itself: upper-casing first can change its length
    at = F.regexp_instr(text, F.concat(F.lit(r"(?iu)\Q"), role, F.lit(r"\E")))
    rest = text.substr(at + F.length(role), F.length(text))
    caps = "A-ZÁÉÍÓÚÃÕÂÊÔÇ"
    heading = rf"(?U)\n\s*[{caps}][{caps}\s]{{10,}}\n"
    body = F.element_at(F.split(rest, heading, 2), 1)
    return F.when(at == 0, text).otherwise(F.concat(text.substr(at, F.length(role)), body))


def format_pct(pct: Column) -> Column:
    return F.format_string("%.1f%%", pct)


def priority(pct: Column) -> Column:
    return F.when(pct > 20, F.lit("ALTA")).when(pct > 10, F.lit("MÉDIA")).otherwise(F.lit("BAIXA"))


def study_hours(pct: Column) -> Column:
    return F.floor(pct * 0.5).cast("int")


def split_roles(col: Column) -> Column:
    empty = F.array().cast("array<string>")
    return (
        F.when(F.coalesce(col, F.lit("")) == "", empty)
        .when(col.contains(" e "), F.transform(F.split(col, " e "), trim_all))
        .otherwise(F.array(col))
    )


def duration_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def duration_text(seconds: Column) -> Column:
    hours, minutes = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "),
                                       (seconds % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m")))
    )


def safe_slug(name: Column, at: Column) -> Column:
    return F.concat(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def text_windows(col: Column, size: int = 8000, overlap: int = 1000) -> Column:
    """Overlapping character windows; a text no longer than one window stays whole."""
    starts = F.sequence(F.lit(0), F.length(col) - 1, F.lit(size - overlap))
    cut = F.transform(starts, lambda s: col.substr(s + 1, F.lit(size)))
    return F.when(F.length(col) <= size, F.array(col)).otherwise(cut)


def text_windows_at_space(col: Column, size: int = 6000, overlap: int = 200, reach: int = 500) -> Column:
    """Overlapping windows that end after the last blank or line break within their final ``reach`` characters.

    Where a window starts depends on where the one before ended, so this walks each text in Python, a hundred rows at a time: an
    Arrow batch would hold ten thousand whole texts and all their windows.
    """
    def cut(text: str | None) -> list[str] | None:
        if text is None:
            return None
        out, start = [], 0
        while start < len(text):
            end = min(start + size, len(text))
            if end < len(text):
                low = max(start + size - reach, start) + 1
                at = max(text.rfind(" ", low, end + 1), text.rfind("\n", low, end + 1))
                end = at + 1 if at >= 0 else end
            out.append(text[start:end])
            start = end - overlap if end < len(text) else end
        return out

    return F.udf(cut, "array<string>", useArrow=False)(col)
