"""Order-dependent work that stays parallel when one key holds most of the rows.

A window over ``partitionBy(key)`` puts a whole key into one task. Here rows are range-partitioned on
(key, order), so a large key spreads over many partitions. Each partition works on its own slice, and one small
row per slice carries state from the slices before it. Only slices that continue a key from an earlier partition
need such a row, so there are fewer of them than partitions: that bound is what makes the broadcast safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provalake.session import cut_lineage

SLICE = "_slice"


def sliced(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows with the number of the range slice they fall in, fixed by a reliable checkpoint."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn(SLICE, F.spark_partition_id()))


def _carry(per_slice: DataFrame, keys: list[str], exprs: dict) -> DataFrame:
    """State from earlier slices, only for slices that continue a key."""
    w = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    out = per_slice.select(*keys, SLICE, *[e(w).alias(n) for n, e in exprs.items()],
                           F.min(SLICE).over(Window.partitionBy(*keys)).alias("_first"))
    return out.filter(F.col(SLICE) > F.col("_first")).drop("_first")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
                 partitions: int | None = None) -> DataFrame:
    """Adds inclusive running sums of the given expressions per key, in the given order."""
    base = sliced(df.withColumns({f"_v_{n}": e for n, e in sums.items()}), keys, order, partitions)
    totals = base.groupBy(*keys, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = _carry(totals, keys, {f"_b_{n}": (lambda w, n=n: F.sum(f"_t_{n}").over(w)) for n in sums})
    local = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _null_safe_join(base, F.broadcast(before), [*keys, SLICE])
    return joined.withColumns(
        {n: F.sum(f"_v_{n}").over(local) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n in sums}
    ).drop(SLICE, *[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """1-based position of each row within its key."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")})


def carry_last(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its key (last observation carried forward)."""
    base = sliced(df, keys, order)
    rank = F.struct(*order)
    ends = base.groupBy(*keys, SLICE).agg(
        F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), rank)).alias("_end"))
    before = _carry(ends, keys, {"_before": lambda w: F.last("_end", ignorenulls=True).over(w)})
    local = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _null_safe_join(base, F.broadcast(before), [*keys, SLICE]).withColumn(
        name, F.coalesce(F.last(value, ignorenulls=True).over(local), F.col("_before"))).drop(SLICE, "_before")


def next_in_key(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Value of the following row of the same key."""
    base = sliced(df, keys, order)
    heads = base.groupBy(*keys, SLICE).agg(F.min_by(F.struct(value), F.struct(*order)).alias("_head"))
    w = Window.partitionBy(*keys).orderBy(SLICE)
    after = heads.select(*keys, SLICE, F.lead("_head").over(w).alias("_after")).filter("_after IS NOT NULL")
    local = Window.partitionBy(*keys, SLICE).orderBy(*order)
    # fewer rows than slices again: only a slice whose key goes on in a later slice has one
    joined = _null_safe_join(base, F.broadcast(after), [*keys, SLICE])
    here = F.lead(F.struct(value)).over(local)
    return joined.withColumn(name, F.coalesce(here, F.col("_after"))[value]).drop(SLICE, "_after")


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        test = left[c].eqNullSafe(renamed[f"_r_{c}"])
        cond = test if cond is None else cond & test
    return left.join(renamed, cond, "left").drop(*[f"_r_{c}" for c in on])
