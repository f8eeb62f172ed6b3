"""Scans and sinks. Every reader takes an explicit schema or a self-describing format."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provalake import schemas
from provalake.functions.once import once


def scan(spark: SparkSession, root: str, name: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """One parquet table; filter and projection reach the scan."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores, for work that costs far more per row than moving the row.

    Only a table read in fewer partitions than there are cores is moved, so a large table never is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def pack_files(files: DataFrame, path: str) -> None:
    """Many documents to a file: one row (arquivo, value) each. A file of its own costs a document far more than its few kilobytes,
    and the driver keeps a list of all files."""
    files.select("arquivo", "value").write.parquet(path)


def scan_packed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Documents of `pack_files` whose file name fits the pattern, as (arquivo, value)."""
    name = F.element_at(F.split("arquivo", "/"), -1)
    return spark.read.schema("arquivo string, value string").parquet(path).filter(name.rlike("^" + fnmatch.translate(pattern)))


def scan_questions_json(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Exam files ``{metadados, questoes: [...]}`` as one row per question, in file order. ``packed``: `pack_files` wrote them."""
    if packed:
        files = once(scan_packed(spark, path), {"doc": F.from_json("value", schemas.QUESTION_FILE)}).select("arquivo", "doc.*")
    else:
        files = spark.read.schema(schemas.QUESTION_FILE).option("multiLine", True).json(path).withColumn("arquivo", F.col("_metadata.file_path"))
    return (
        files.select("arquivo", "metadados", F.posexplode("questoes").alias("seq", "q"))
        .select("arquivo", "seq", "metadados.banca", "metadados.cargo", "metadados.ano", "q.*")
    )


def scan_classifications_json(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema(schemas.QUESTION_FILE).option("multiLine", True).json(path)
    return (
        files.select(F.col("_metadata.file_path").alias("arquivo"), F.posexplode("classificacoes").alias("seq", "c"))
        .select("arquivo", "seq", "c.*")
    )


def scan_dir(spark: SparkSession, path: str, pattern: str = "*.json", packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Read every exam file below a folder. A file that does not parse becomes an error row, never a failure. ``packed``: the folder
    holds the files as `pack_files` wrote them."""
    schema = StructType(list(schemas.QUESTION_FILE.fields)).add("_corrupt", "string")
    files = scan_packed(spark, path, pattern) if packed else (
        spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("arquivo"), F.col("value"))
    )
    files = once(files, {"doc": F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})})
    bad = F.col("doc._corrupt").isNotNull() | F.col("doc.questoes").isNull()
    good = files.filter(~bad).select("arquivo", F.posexplode("doc.questoes").alias("seq", "q")).select("arquivo", "seq", "q.*")
    errors = files.filter(bad).select("arquivo", F.lit("arquivo invalido").alias("_error"), F.col("value").alias("conteudo"))
    return good, errors


def accept_files(files: DataFrame, max_bytes: int = 50 * 1024 * 1024, suffix: str = ".pdf") -> DataFrame:
    """File listing (path, length) with a reason for each rejected file; null means accepted."""
    reason = (
        F.when(~F.lower("path").endswith(suffix), F.lit("tipo"))
        .when(F.col("length") > max_bytes, F.lit("tamanho"))
    )
    return files.select("path", "length", reason.alias("motivo"), reason.isNull().alias("aceito"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of every file; the content column is pruned, so file bytes are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def sink_json(df: DataFrame, path: str, partition_by: str | None = "disciplina", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def sink_report(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Markdown text per discipline folder; expects (disciplina, markdown)."""
    reports.select("disciplina", F.col("markdown").alias("value")).write.mode(mode).partitionBy("disciplina").text(path)


def sink_related(parent: DataFrame, questions: DataFrame, labels: DataFrame, path: str, batch: str = "0") -> list[str]:
    """Write exams, then questions, then classifications, each batch into its own folder (partition ``lote``).

    A batch written again replaces itself, so a retry doubles nothing. A later failure leaves the earlier tables in place.
    """
    done: list[str] = []
    for name, df in (("provas", parent), ("questoes", questions), ("classificacoes", labels)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/lote={batch}")
        done.append(name)
    return done
