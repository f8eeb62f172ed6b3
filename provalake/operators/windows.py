"""Ranking, de-duplication, chunking and other order-based operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provalake.functions.text import trim_all
from provalake.operators.scan_order import row_numbers


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. The ``= 1`` test lets Spark drop all but one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key; each map task passes on at most ``k`` of them."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(rank or "_rn", F.row_number().over(w)).filter(F.col(rank or "_rn") <= k)
    return out if rank else out.drop("_rn")


def latest_per_discipline(jobs: DataFrame) -> DataFrame:
    return keep_first(jobs, ["projeto_id", "disciplina"], [F.desc("created_at"), F.col("job_id")])


def latest_overall(jobs: DataFrame, discipline: str | None = None) -> DataFrame:
    if discipline:
        jobs = jobs.filter(F.col("disciplina") == discipline)
    return keep_first(jobs, ["projeto_id"], [F.desc("created_at"), F.col("job_id")])


def completeness(n_options: Column, stem: Column) -> Column:
    return F.coalesce(n_options, F.lit(0)) * 10 + F.length(F.coalesce(stem, F.lit("")))


def dedupe_most_complete(df: DataFrame, score: Column, seq: Column, keys: list[str]) -> DataFrame:
    """Per question number the fullest version; ties keep the earliest; rows without a number are dropped."""
    return keep_first(df.filter(F.col("numero").isNotNull()).withColumn("_score", score), keys,
                      [F.desc("_score"), seq]).drop("_score")


def dedupe_first_seen(df: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    return keep_first(df, keys, [seq])


def next_value(df: DataFrame, by: list[str], col: str, name: str = "proximo") -> DataFrame:
    """Distinct values per key with the next larger one. Duplicates go before the window, so a key's task sees
    each question number once."""
    uniq = df.select(*by, col).filter(F.col(col).isNotNull()).distinct()
    return uniq.withColumn(name, F.lead(col).over(Window.partitionBy(*by).orderBy(col)))


def start_page(pages: DataFrame, by: str = "doc") -> DataFrame:
    """First page that opens the questions: strict test on 5 pages, looser test on 10, else page 0."""
    text = F.lower("text")
    # Fixed patterns: first question header and option marks.
    options = text.rlike(r"\([a-e]\)")
    question = text.rlike(r"(?U)quest[aã]o\s*0?1\b")
    scratch = text.contains("rascunho") & (F.length("text") < 500)
    strict = (F.col("page") < 5) & question & options & ~scratch
    loose = (F.col("page") < 10) & text.rlike(r"(?U)(quest[aã]o\s*0?1\b|^0?1\.)") & options
    return pages.groupBy(by).agg(F.coalesce(F.min(F.when(strict, F.col("page"))), F.min(F.when(loose, F.col("page"))),
                                            F.lit(0)).alias("inicio"))


def chunk_rows(df: DataFrame, by: list[str], order: list[str], size: int = 20) -> DataFrame:
    """Rows numbered per key and cut into chunks ``chunk_1``, ``chunk_2``… of ``size`` rows."""
    out = row_numbers(df, by, order, "_pos")
    return out.withColumn("chunk_id", F.concat(F.lit("chunk_"), (F.floor((F.col("_pos") - 1) / size) + 1).cast("string"))).drop("_pos")


def page_windows(pages: DataFrame, by: str = "doc", size: int = 3, overlap: int = 1, min_chars: int = 500) -> DataFrame:
    """Overlapping windows of pages (0-based ``page``), each one text with page markers.

    A page is sent to the few windows that hold it, so there is no range join, and a window never holds more than
    ``size`` pages.
    """
    stride = max(1, size - overlap)
    first = F.greatest(F.lit(0), F.ceil((F.col("page") - size + 1) / stride)).cast("int")
    last = F.floor(F.col("page") / stride).cast("int")
    marked = F.concat(F.lit("\n--- PAGINA "), (F.col("page") + 1).cast("string"), F.lit(" ---\n"), "text")
    return (
        pages.select(by, "page", marked.alias("_t"), F.explode(F.sequence(first, last)).alias("_w"))
        .groupBy(by, (F.col("_w") * stride).alias("primeira"))
        .agg(F.max("page").alias("ultima"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("page", "_t"))), lambda s: s["_t"]), "").alias("texto"))
        .filter(F.length(trim_all(F.col("texto"))) >= min_chars)
    )


def history(events: DataFrame, keep: int = 100, recent: int = 20) -> DataFrame:
    """Last ``keep`` events per provider with mean tokens and success rate over the ``recent`` latest up to each."""
    kept = top_per_group(events, ["provider"], [F.desc("ts"), F.desc("event_id")], keep)
    w = Window.partitionBy("provider").orderBy("ts", "event_id").rowsBetween(-(recent - 1), 0)
    return kept.withColumns({
        "avg_tokens": F.round(F.avg("tokens_used").over(w), 6),
        "success_pct": F.round(F.avg(F.col("success").cast("int")).over(w) * 100, 6),
    })


def column_boundary(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Two-column pages and the x position between the columns (null for one column)."""
    text = trim_all(F.col("text")) != ""
    left, right = text & (F.col("x0") < F.col("page_width") * 0.4), text & (F.col("x0") > F.col("page_width") * 0.45)
    agg = blocks.groupBy(*by).agg(
        F.count_if(text).alias("n"), F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"),
        F.max(F.when(left, F.col("x0"))).alias("left_max"), F.min(F.when(right, F.col("x0"))).alias("right_min"))
    two = (F.col("n") >= 4) & (F.col("n_left") >= 3) & (F.col("n_right") >= 3)
    return agg.select(*by, F.when(two, (F.col("left_max") + F.col("right_min")) / 2).alias("boundary"))
