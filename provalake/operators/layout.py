"""Text lines from positioned spans of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provalake.functions.once import let
from provalake.functions.text import trim_all


def _line_text(spans: Column) -> Column:
    """Spans of one line by x, with a space at a gap unless the texts already have one or punctuation follows."""
    def joined(by_x: Column) -> Column:
        shifted = F.concat(F.slice(by_x, 1, 1), by_x)  # element i of this is the span before span i; the first meets itself

        def piece(s: Column, prev: Column) -> Column:
            gap = (s["x0"] - prev["x1"] > 0.5) & ~prev["text"].endswith(" ") & ~s["text"].rlike(r"^[ .,;:!?)]")
            return F.concat(F.when(gap, " ").otherwise(""), s["text"])

        return F.array_join(F.zip_with(by_x, F.slice(shifted, F.lit(1), F.size(by_x)), piece), "")

    return let(F.array_sort(F.transform(spans, lambda s: F.struct(s["x0"], s["x1"], s["text"]))), joined)


def line_bounds(parts: list[int], ys: list[float | None], tol: float) -> list[tuple[int, int, str]]:
    """First place (from 1), length and lead of each line of the spans of a page, which are sorted by part and y. A line opens at the
    first y more than ``tol`` above the one that opened the line before; spans without y are a line of their own."""
    out, part, anchor = [], None, None
    for i, (p, y) in enumerate(zip(parts, ys, strict=True), 1):
        new = p != part
        if new or (y is not None and (anchor is None or y > anchor + tol or y != y and anchor == anchor)):
            # a blank line goes before the right column, a single break before the continuation
            out.append([i, 0, ("", "\n", "\n\n")[p] if new else "\n"])
            part, anchor = p, y
        out[-1][1] += 1
    return [tuple(line) for line in out]


def lines_from_spans(spans: DataFrame, by: list[str], boundary: DataFrame | None = None, tol: float = 5.0) -> DataFrame:
    """Page text from spans (y, x0, x1, text). With two columns the left one is read first; what stands above the
    first question of the right column continues the left one.

    A page becomes one text, so its spans meet in one row and are cut into lines there: they are moved once.
    """
    num = lambda c: F.col(c).cast("double").alias(c)
    s = spans.filter(trim_all(F.col("text")) != "").select(*by, num("y"), num("x0"), num("x1"), "text")
    if boundary is None:
        s = s.withColumn("_part", F.lit(0))
    else:
        s = s.join(boundary.select(*by, F.col("boundary").alias("_b")), by, "left")
        right = F.col("x0") >= F.col("_b")
        head = F.col("text").contains("Questão") | F.col("text").contains("QUESTÃO")
        first = s.filter(right & head).groupBy(*by).agg(F.min("y").alias("_q"))
        s = s.join(first, by, "left").withColumn("_part", F.when(~F.coalesce(right, F.lit(False)), 0).when(
            F.col("y") < F.col("_q") - 10, 1).otherwise(2)).drop("_b", "_q")
    pages = s.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", "y", "x0", "x1", "text"))).alias("_s"))
    bounds = F.udf(lambda parts, ys: line_bounds(parts, ys, tol), "array<struct<a:int,n:int,lead:string>>", useArrow=False)
    pages = pages.withColumn("_b", bounds(F.col("_s._part"), F.col("_s.y")))
    lines = F.transform("_b", lambda b: F.concat(b["lead"], _line_text(F.slice("_s", b["a"], b["n"]))))
    return pages.select(*by, F.array_join(lines, "").alias("texto"))
