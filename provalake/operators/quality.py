"""Text quality against a lexicon table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provalake.functions.once import once
from provalake.functions.text import words


def build_lexicon(docs: DataFrame, text: str = "text", min_count: int = 3) -> DataFrame:
    """Known words: those that occur at least ``min_count`` times in the corpus."""
    tok = docs.select(F.explode(F.transform(words(F.col(text)), F.lower)).alias("word"))
    return tok.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).select("word")


def quality_score(err: Column, long_ratio: Column, valid: Column, n: Column) -> Column:
    raw = valid * (1 - F.least(err, F.lit(0.5)) * 2) * (1 - F.least(long_ratio * 5, F.lit(0.5)))
    return F.when(n < 10, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def word_quality(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", sample: int | None = None) -> DataFrame:
    """Share of unknown and of overlong words, and the score they give.

    Unknown words are counted once per document over its first ``sample`` words (all of them by default). Each
    (document, word) pair is made distinct inside the row before the join, so frequent words shuffle once per document.
    """
    w = F.col("_w")
    base = once(docs.select(key, text), {"_w": words(F.col(text))}).select(key, F.size(w).alias("word_count"), F.size(F.filter(w, lambda x: F.length(x) > 18)).alias("_long"),
                       (F.slice(w, 1, sample) if sample else w).alias("_s"))
    tok = base.select(key, "word_count", "_long", F.size("_s").alias("_n"),
                      F.explode_outer(F.array_distinct(F.transform("_s", F.lower))).alias("word"))
    known = lexicon.select("word", F.lit(True).alias("_known"))
    per = tok.join(known, "word", "left").groupBy(key).agg(
        F.first("word_count").alias("word_count"), F.first("_long").alias("_long"), F.first("_n").alias("_n"),
        F.count_if(F.col("word").isNotNull() & F.col("_known").isNull()).alias("_unknown"))
    short = F.col("word_count") < 10
    err = F.when(short, 1.0).otherwise(F.round(F.col("_unknown") / F.greatest("_n", F.lit(1)), 4))
    lng = F.when(short, 0.0).otherwise(F.round(F.col("_long") / F.greatest("word_count", F.lit(1)), 4))
    val = F.when(short, 0.0).otherwise(F.round(1 - F.col("_unknown") / F.greatest("_n", F.lit(1)), 4))
    out = per.select(key, "word_count", err.alias("spell_error_rate"), lng.alias("long_word_ratio"), val.alias("valid_word_ratio"))
    out = out.withColumn("score", quality_score(F.col("spell_error_rate"), F.col("long_word_ratio"),
                                                F.col("valid_word_ratio"), F.col("word_count")))
    return out.withColumns({"needs_correction": (F.col("score") < 0.80) | (F.col("long_word_ratio") > 0.05),
                            "needs_vision": F.col("score") < 0.75})
