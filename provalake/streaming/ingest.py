"""Arriving exam files: parse, score and merge into the question and exam tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provalake.functions.once import once
from provalake.functions.scoring import confidence
from provalake.operators import aggregates, windows
from provalake.operators.parsing import parse_blocks, segment_questions
from provalake.sources.tables import spread


def read_exam_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    return (
        spark.readStream.option("pathGlobFilter", pattern).text(path, wholetext=True)
        .select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^.]+$", 1).alias("prova_id"), F.col("value").alias("full_text")))


def scored_questions(docs: DataFrame, key: str = "prova_id") -> DataFrame:
    """Parsed questions with their score. Stateless, so it runs the same on a stream and on a batch."""
    q = parse_blocks(segment_questions(docs if docs.isStreaming else spread(docs, key), key))
    s = confidence(F.col("enunciado"), F.col("alternativas"), F.col("gabarito"), F.col("disciplina"), F.col("numero"))
    return once(q, {"_s": s}).withColumns({"score": F.col("_s.score"), "nivel": F.col("_s.nivel")}).drop("_s")


def best_per_number(questions: DataFrame, key: str = "prova_id") -> DataFrame:
    score = windows.completeness(F.size("alternativas"), F.col("enunciado"))
    return windows.dedupe_most_complete(questions, score, F.col("seq"), [key, "numero"])


def start_ingest(docs: DataFrame, out: str, checkpoint: str, key: str = "prova_id") -> StreamingQuery:
    """Write each micro-batch under its own batch folder. A replayed batch overwrites its folder, so it counts once;
    an exam sent again is resolved by ``current_questions``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        q = best_per_number(scored_questions(batch, key), key)
        q.withColumn("lote", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/questoes/batch={batch_id}")
        # statuses come from the table just written, so the texts are parsed once
        done = batch.sparkSession.read.parquet(f"{out}/questoes/batch={batch_id}").withColumnRenamed(key, "prova_id")
        status = aggregates.exam_status(batch.select(F.col(key).alias("prova_id")).distinct(), done)
        status.withColumn("lote", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/provas/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_questions(spark: SparkSession, out: str) -> DataFrame:
    """Question table after all batches: the newest batch of each exam replaces earlier ones."""
    q = spark.read.option("basePath", f"{out}/questoes").parquet(f"{out}/questoes")
    p = spark.read.option("basePath", f"{out}/provas").parquet(f"{out}/provas")
    newest = p.groupBy("prova_id").agg(F.max("lote").alias("lote"))  # also batches in which an exam had no question
    return q.join(newest, ["prova_id", "lote"], "left_semi")


def current_exams(spark: SparkSession, out: str) -> DataFrame:
    p = spark.read.option("basePath", f"{out}/provas").parquet(f"{out}/provas")
    return windows.keep_first(p, ["prova_id"], [F.desc("lote")])
