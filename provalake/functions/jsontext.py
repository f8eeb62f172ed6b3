"""JSON answers from language models: unfence, clean, repair, parse to typed rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from provalake.functions.once import once
from provalake.functions.text import trim_all


def strip_fences(col: Column) -> Column:
    """Content of a json code fence, else of any fence, else the text itself. An unclosed fence runs to the end."""
    tagged = F.regexp_extract(col, r"(?s)```json(.*?)(?:```|\z)", 1)
    plain = F.regexp_extract(col, r"(?s)```(.*?)(?:```|\z)", 1)
    return F.when(col.contains("```json"), trim_all(tagged)).when(col.contains("```"), trim_all(plain)).otherwise(col)


_PAIR = "\ufdd0"


def sanitize_json(col: Column) -> Column:
    """Escape raw line breaks and tabs inside strings and drop other control characters there.

    A quote is real when an even number of backslashes precedes it: pairs of them, however many, are set aside as a character that no
    text may hold, then a quote after a backslash is none. Splitting at real quotes makes every second piece the inside of a string.
    """
    pieces = F.split(F.replace(trim_all(col), F.lit("\\\\"), F.lit(_PAIR)), r'(?<!\\)"')
    inside = lambda p: F.regexp_replace(F.replace(F.replace(F.replace(
        p, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")), r"[\x00-\x1f]", "")
    joined = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, inside(p)).otherwise(p)), '"')
    return F.replace(joined, F.lit(_PAIR), F.lit("\\\\"))


# Fixed patterns: text that ends a complete question object or syllabus item.
QUESTION_ENDS = [r'"motivo_anulacao"\s*:\s*(?:null|"[^"]*")\s*\}', r'"anulada"\s*:\s*(?:true|false)\s*\}',
                 r'"gabarito"\s*:\s*"[A-E]"\s*\}']
ITEM_ENDS = [r'"filhos"\s*:\s*\[\s*\]\s*\}']

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"?', re.S)


def _blank_strings(text: str) -> str:
    return _STRING.sub(lambda m: " " * len(m.group(0)), text)


def _last_end(text: str, patterns: list[str]) -> int:
    return max((m.end() for p in patterns for m in re.finditer(p, text)), default=-1)


def _close(text: str, pairs_first: bool) -> str:
    bare = _blank_strings(text)
    braces, brackets = bare.count("{") - bare.count("}"), bare.count("[") - bare.count("]")
    if not pairs_first:
        return text + "]" * brackets + "}" * braces
    pairs = max(0, min(braces, brackets))
    return text + "]}" * pairs + "]" * max(0, brackets - pairs) + "}" * max(0, braces - pairs)


def _cut_and_close(text: str | None, syllabus: bool) -> str | None:
    """Cut a truncated document after its last complete object and close what is open; null if that fails."""
    if not text or "{" not in text:
        return None
    text = text[text.index("{"):]
    end = _last_end(text, ITEM_ENDS if syllabus else QUESTION_ENDS)
    if end <= 0:  # last bracket that closes outside any string
        blank = _blank_strings(text)
        end = max(blank.rfind("}"), -1 if syllabus else blank.rfind("]")) + 1
    if end <= 0:
        return None
    fixed = _close(text[:end], pairs_first=syllabus)
    try:
        json.loads(fixed)
    except ValueError:
        return None
    return fixed


# Row by row, a hundred rows at a time: ten thousand whole documents in one Arrow batch would need gigabytes.
@F.udf(StringType(), useArrow=False)
def repair_question_json(text: str | None) -> str | None:
    return _cut_and_close(text, False)


@F.udf(StringType(), useArrow=False)
def repair_syllabus_json(text: str | None) -> str | None:
    return _cut_and_close(text, True)


def parse_responses(df: DataFrame, col: str, schema: StructType, required: tuple[str, ...] = (), repair=None) -> tuple[DataFrame, DataFrame]:
    """Typed answers and quarantined rows (with ``_error``).

    Texts are unfenced, parsed, and parsed again from the first brace. With ``repair`` (one of the functions above)
    only rows that still fail go through Python.
    """
    typed = StructType(list(schema.fields)).add("_corrupt", "string")
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowUnquotedControlChars": "true"}
    ok = lambda c: c.isNotNull() & c["_corrupt"].isNull()
    text = strip_fences(F.col(col))
    from_brace = F.when(text.contains("{"), F.regexp_extract(text, r"(?s)\{.*", 0))
    first = F.from_json(text, typed, opts)
    work = once(df, {"_a": first, "_b": from_brace})
    work = once(work, {"_p": F.when(ok(F.col("_a")), F.col("_a")).otherwise(F.from_json("_b", typed, opts))}).drop("_a", "_b")
    if repair is not None:
        good, rest = work.filter(ok(F.col("_p"))), work.filter(~F.coalesce(ok(F.col("_p")), F.lit(False)))
        fixed = rest.withColumn("_p", F.from_json(repair(strip_fences(F.col(col))), typed, opts))
        work = good.unionByName(fixed)
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(f"_p.{name}").isNull()
    bad = F.when(~F.coalesce(ok(F.col("_p")), F.lit(False)), "json invalido").when(missing, "campo obrigatorio ausente")
    work = work.withColumn("_error", bad)
    keep = [c for c in df.columns if c != col]
    return (
        work.filter("_error IS NULL").select(*keep, *[F.col(f"_p.{f.name}") for f in schema.fields]),
        work.filter("_error IS NOT NULL").select(*df.columns, "_error"),
    )
