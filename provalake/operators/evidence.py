"""Evidence search: the rows of a pool that share most words with a claim, without meeting on stop words.

Words are ranked by the number of pool rows that have them. Rare words are joined row by row: a rare word brings few rows. What
a claim can still gain from common words alone is bounded by how many of them it has, so most claims are settled there. The
others ask the pool once for each different set of common words: pool rows with the same common words are one entry that keeps
its k smallest numbers, and a claim whose k-th best score is s looks only under its rarest common words, all but the last s - 1 of
them, because an entry that shares s words has at least one of those. The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provalake.operators.windows import top_per_group
from provalake.session import cut_lineage

#: A word of so many pool rows of a report is rare.
RARE_ROWS = 64


def word_set(text: Column) -> Column:
    """Distinct words of three letters or digits at least, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))


def _word_rows(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return rows.select(*keys, F.explode(word_set(F.col(text))).alias("word")).distinct()


def search_tables(claims: DataFrame, pool: DataFrame, by: str, rare_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims and pool rows with their `rare` and `common` words, and the rows of rare pool words."""
    pool_words = _word_rows(pool, [by, "evidence_no"], "enunciado")
    known = cut_lineage(pool_words.groupBy(by, "word").agg(F.count("*").alias("rows")))
    split = lambda rare: F.transform(F.filter("_w", lambda w: (w["rows"] <= rare_rows) if rare else (w["rows"] > rare_rows)), lambda w: w["word"])

    def with_words(rows: DataFrame, keys: list[str]) -> DataFrame:
        ranked = rows.join(known, [by, "word"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rows", "word"))).alias("_w"))
        return cut_lineage(ranked.select(*keys, split(True).alias("rare"), split(False).alias("common")))

    c = with_words(_word_rows(claims, [by, "claim_no"], "claim"), [by, "claim_no"])
    e = with_words(pool_words, [by, "evidence_no"])
    return c, e, e.select(by, "evidence_no", F.explode("rare").alias("word"))


def rare_matches(c: DataFrame, e: DataFrame, rare: DataFrame, by: str) -> DataFrame:
    """Claims and pool rows that share a rare word, with all the words they share."""
    pairs = c.select(by, "claim_no", F.explode("rare").alias("word")).join(rare, [by, "word"]).select(by, "claim_no", "evidence_no").distinct()
    words = lambda d, key, name: d.select(by, key, F.concat("rare", "common").alias(name))
    both = pairs.join(words(c, "claim_no", "_c"), [by, "claim_no"]).join(words(e, "evidence_no", "_e"), [by, "evidence_no"])
    return both.select(by, "claim_no", "evidence_no", F.size(F.array_intersect("_c", "_e")).alias("overlap"))


def common_matches(c: DataFrame, e: DataFrame, settled: DataFrame, by: str, k: int) -> DataFrame:
    """Matches by common words alone, for the claims whose k-th best score they could reach."""
    asked = c.join(settled, [by, "claim_no"], "left").withColumn("least", F.greatest(F.coalesce("score", F.lit(0)), F.lit(1)))
    asked = asked.filter(F.size("common") >= F.col("least")).select(by, "claim_no", "common", "least")
    queries = asked.select(by, F.col("common").alias("asked"), "least").distinct()
    first = top_per_group(e.filter(F.size("common") > 0).select(by, "common", "evidence_no"), [by, "common"], [F.col("evidence_no")], k)
    entries = first.groupBy(by, "common").agg(F.collect_list("evidence_no").alias("numbers"))  # k at most
    prefix = F.slice("asked", F.lit(1), F.size("asked") - F.col("least") + 1)
    met = queries.withColumn("word", F.explode(prefix)).join(entries.select(by, "common", F.explode("common").alias("word")), [by, "word"])
    met = met.select(by, "asked", "least", "common").distinct().withColumn("overlap", F.size(F.array_intersect("asked", "common")))
    met = met.filter(F.col("overlap") >= F.col("least")).join(entries, [by, "common"]).select(by, "asked", "least", "overlap", F.explode("numbers").alias("evidence_no"))
    best = top_per_group(met, [by, "asked", "least"], [F.desc("overlap"), F.col("evidence_no")], k)
    return asked.withColumnRenamed("common", "asked").join(best, [by, "asked", "least"]).select(by, "claim_no", "evidence_no", "overlap")


def claim_evidence(claims: DataFrame, pool: DataFrame, by: str = "report_id", k: int = 5, rare_rows: int = RARE_ROWS) -> DataFrame:
    """The ``k`` evidence rows of the same report that share most words with a claim: (by, claim_no, evidence_no, overlap, rank).

    Rows that share no word don't count. Of equal overlaps the smaller evidence number comes first. Rows with the same number are
    one claim, or one piece of evidence, with the words of all of them.
    """
    c, e, rare = search_tables(claims, pool, by, rare_rows)
    near = cut_lineage(rare_matches(c, e, rare, by))
    order = [F.desc("overlap"), F.col("evidence_no")]
    kth = F.row_number().over(Window.partitionBy(by, "claim_no").orderBy(*order))
    settled = near.withColumn("_r", kth).filter(F.col("_r") == k).select(by, "claim_no", F.col("overlap").alias("score"))
    both = near.unionByName(common_matches(c, e, settled, by, k)).groupBy(by, "claim_no", "evidence_no").agg(F.max("overlap").alias("overlap"))
    return top_per_group(both, [by, "claim_no"], order, k, rank="rank")
