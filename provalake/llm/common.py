"""Small helpers of the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provalake.session import scratch_dir

#: The ASCII white space that separates words.
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text (null: empty) of any table that has both; other columns stay out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


#: Spark's setting that removes the shuffle files of a finished write.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors, computed once. The shuffle files
    of the write go when it is done, nothing reads them again."""
    spark = df.sparkSession
    path, before = scratch_dir(spark, name), spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, for caches that outlive a task."""
    name = "provalake_worker_store"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def filtered(docs: DataFrame, make_test: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows whose text passes a Python test, which each task makes once. All columns go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make_test()
        for batch in batches:
            for part in text_slices(batch, 1_000_000):
                yield part.filter(pa.array([test(t) for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def groups_by_size(sizes: list[int], most: int):
    """Consecutive index ranges whose sizes add up to about `most`; a single larger item stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `most` bytes in their column `text`; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    for start, stop in groups_by_size(sizes, most):
        yield batch.slice(start, stop - start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the splitmix64 finalizer; its constants are fixed values)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
