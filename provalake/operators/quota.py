"""Usage quotas from event rows: windows, limits, status."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provalake import constants as C
from provalake.operators.scan_order import SLICE, running_sums, sliced

_LIMIT_COLS = "provider string, requests_per_minute long, requests_per_day long, tokens_per_minute long, tokens_per_day long"


def limits(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or C.QUOTA_LIMITS, _LIMIT_COLS)


def usage(events: DataFrame, every: str = "1 minute") -> DataFrame:
    """Requests, tokens and success rate per provider and clock window. Works on batches and on streams."""
    return events.groupBy("provider", F.window("ts", every).alias("w")).agg(
        F.count("*").alias("requests"), F.sum("tokens_used").alias("tokens"),
        F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"),
    ).select("provider", F.col("w.start").alias("inicio"), "requests", "tokens", "success_rate")


def day_usage(events: DataFrame) -> DataFrame:
    """Requests and tokens since the start of the day, after each event."""
    e = events.withColumn("dia", F.to_date("ts"))
    return running_sums(e, ["provider", "dia"], ["ts", "event_id"],
                        {"requests_today": F.lit(1).cast("long"), "tokens_today": F.col("tokens_used").cast("long")})


def quota_check(used: DataFrame, limit_table: DataFrame) -> DataFrame:
    """May a provider go on? Day requests, minute requests, day tokens are tested in this order.

    ``used`` has requests_today, tokens_today, requests_this_minute per row. The limit table has one row per provider.
    """
    lim = F.broadcast(limit_table.withColumn("_known", F.lit(True)))
    c = F.col
    reason = (
        F.when(c("_known").isNull(), F.concat(F.lit("Unknown provider: "), "provider"))
        .when(c("requests_today") >= c("requests_per_day"), F.concat(F.lit("Daily request limit reached ("), c("requests_per_day").cast("string"), F.lit(")")))
        .when(c("requests_this_minute") >= c("requests_per_minute"),
              F.concat(F.lit("Per-minute request limit reached ("), c("requests_per_minute").cast("string"), F.lit(")")))
        .when(c("tokens_today") >= c("tokens_per_day"), F.concat(F.lit("Daily token limit reached ("), c("tokens_per_day").cast("string"), F.lit(")"))))
    return used.join(lim, "provider", "left").select(
        *used.columns, reason.isNull().alias("can_proceed"), reason.alias("reason"),
        (c("requests_per_day") - c("requests_today")).alias("remaining_requests"),
        (c("tokens_per_day") - c("tokens_today")).alias("remaining_tokens"))


def status_of(pct: Column) -> Column:
    return F.when(pct >= 90, "critical").when(pct >= 70, "warning").when(pct >= 50, "moderate").otherwise("healthy")


def quota_status(used: DataFrame, limit_table: DataFrame) -> DataFrame:
    """Share of the limits used, status and advice per provider."""
    c = F.col
    req, tok = c("requests_today") / c("requests_per_day") * 100, c("tokens_today") / c("tokens_per_day") * 100
    groq, anthropic = c("provider") == "groq", c("provider") == "anthropic"
    left = c("requests_per_day") - c("requests_today")
    # Advice texts
    tips = F.array_compact(F.array(
        F.when(groq & (c("status") == "critical"), "Groq quota quase esgotada - considere usar Anthropic como alternativa"),
        F.when(groq & c("status").isin("warning", "critical"), "Reduza o número de classificações em lote para preservar quota"),
        F.when(anthropic & (c("status") == "critical"), "Anthropic quota baixa - pause operações não essenciais"),
        F.when(groq & (left < 100), F.concat(F.lit("Apenas "), left.cast("string"), F.lit(" requests restantes no Groq hoje")))))
    healthy = F.array(F.lit("Quota saudável - operações normais disponíveis"))
    return used.join(F.broadcast(limit_table), "provider").withColumn("status", status_of(F.greatest(req, tok))).select(
        *used.columns, F.round(req, 1).alias("pct_requests"), F.round(tok, 1).alias("pct_tokens"), "status", left.alias("remaining_requests"),
        F.when(F.size(tips) > 0, tips).otherwise(healthy).alias("recommendations"))


def current_usage(events: DataFrame, until: Column | None = None) -> DataFrame:
    """Counters of the latest day and the latest clock minute of each provider.

    Totals per minute are taken first, so the later steps see one row per provider and minute.
    """
    e = events if until is None else events.filter(F.col("ts") <= until)
    minute = e.groupBy("provider", F.date_trunc("minute", "ts").alias("m")).agg(F.count("*").alias("r"), F.sum("tokens_used").alias("t"))
    last = minute.groupBy("provider").agg(F.max("m").alias("_m"))
    day = minute.join(last, "provider").filter(F.to_date("m") == F.to_date("_m"))
    return day.groupBy("provider").agg(
        F.sum("r").alias("requests_today"), F.sum("t").alias("tokens_today"),
        F.sum(F.when(F.col("m") == F.col("_m"), F.col("r")).otherwise(0)).alias("requests_this_minute"))


# --- anchored windows ------------------------------------------------------------------------------------------

def _next_anchor(values: np.ndarray, tol: float) -> np.ndarray:
    """For each sorted value the index of the first one more than ``tol`` above it (len(values) if none)."""
    return np.searchsorted(values, values + tol, side="right")


def _walk(values: np.ndarray, start: int, nxt: np.ndarray) -> list[int]:
    out = []
    while start < len(values):
        out.append(start)
        start = int(nxt[start])
    return out


def _plain(key) -> tuple:
    """A group key with null for the missing values that pandas shows as NaN."""
    return tuple(None if pd.isna(k) else k for k in key)


def anchored_groups(df: DataFrame, by: list[str], value: str, tol: float, tiebreak: str, partitions: int | None = None) -> DataFrame:
    """Adds ``anchor``: the value that opened the row's group. A new group opens at the first value more than
    ``tol`` above the current anchor (not above the previous row).

    The rule is sequential, so a plain fold would put a whole key into one task. Rows are range-sliced instead:
    (1) each slice reports, for every value that could open its first own group, the anchor in force at its end;
    (2) these small reports are chained per key; (3) each slice assigns its rows from its entry anchor.
    """
    base = sliced(df.withColumn("_x", F.col(value).cast("double")), by, [value, tiebreak], partitions)
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    slim = base.select(*by, SLICE, "_x").filter("_x IS NOT NULL").distinct()
    # keys that go over a slice border: fewer than there are slices
    spread = slim.select(*by, SLICE).distinct().groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    same_key = [slim[c].eqNullSafe(spread[c]) for c in by]
    split = slim.join(F.broadcast(spread), same_key, "left_semi")

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, g in pdf.groupby(by, dropna=False, sort=False):
            v = np.sort(g["_x"].to_numpy())
            nxt = _next_anchor(v, tol)
            end = np.arange(len(v))
            for i in range(len(v) - 1, -1, -1):  # anchor in force at the slice's end when v[i] opens a group
                if nxt[i] < len(v):
                    end[i] = end[nxt[i]]
            n = min(len(v), int(np.searchsorted(v, v[0] + tol, side="right")) + 1)
            names = {c: np.array([k] * n, dtype=object) for c, k in zip(by, _plain(key))}
            out.append(pd.DataFrame({**names, SLICE: pdf[SLICE].iloc[0], "open": v[:n], "leave": v[end[:n]]}))
        return pd.concat(out)

    reports = split.groupBy(SLICE).applyInPandas(report, f"{keys}, {SLICE} int, open double, leave double")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, anchor = [], None
        key = dict(zip(by, _plain(pdf[c].iloc[0] for c in by)))
        for part, g in pdf.sort_values([SLICE, "open"]).groupby(SLICE, sort=True):
            rows.append({**key, SLICE: part, "entry": anchor})
            opens = g["open"].to_numpy()
            at = 0 if anchor is None else int(np.searchsorted(opens, anchor + tol, side="right"))
            if at < len(opens):
                anchor = float(g["leave"].to_numpy()[at])
        return pd.DataFrame(rows, columns=[*by, SLICE, "entry"])

    entries = reports.groupBy(*by).applyInPandas(chain, f"{keys}, {SLICE} int, entry double")

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {_plain(r[:-1]): r[-1] for r in right[[*by, "entry"]].itertuples(index=False) if pd.notna(r[-1])}
        left = left.sort_values("_x", kind="stable").reset_index(drop=True)
        anchor = np.empty(len(left))
        for key, rows in left.groupby(by, dropna=False, sort=False).indices.items():
            v = left["_x"].to_numpy()[rows]
            entry = known.get(_plain(key if isinstance(key, tuple) else (key,)))
            first = 0 if entry is None else int(np.searchsorted(v, entry + tol, side="right"))
            opens = v[_walk(v, first, _next_anchor(v, tol))]
            starts = opens if entry is None else np.concatenate([[entry], opens])
            anchor[rows] = starts[np.searchsorted(starts, v, side="right") - 1]
        names = {c: np.array(_plain(left[c]), dtype=object) for c in by}
        return left[[SLICE, "_x"]].assign(anchor=anchor, **names)[[*by, SLICE, "_x", "anchor"]]

    anchors = slim.groupBy(SLICE).cogroup(entries.groupBy(SLICE)).applyInPandas(assign, f"{keys}, {SLICE} int, _x double, anchor double")
    found = anchors.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col(SLICE).alias("_ks"), F.col("_x").alias("_kx"), "anchor")
    same = (base[SLICE] == found["_ks"]) & (base["_x"] == found["_kx"])
    for i, c in enumerate(by):
        same = same & base[c].eqNullSafe(found[f"_k{i}"])
    return base.join(found, same, "left").drop(SLICE, "_x", "_ks", "_kx", *(f"_k{i}" for i in range(len(by))))


def anchored_minute(events: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Requests and tokens per provider and anchored minute: a window opens at the first event after the last one expired."""
    e = events.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")))
    g = anchored_groups(e, ["provider"], "_s", seconds * 1e6, "event_id")
    return g.groupBy("provider", "anchor").agg(F.count("*").alias("requests"), F.sum("tokens_used").alias("tokens"))
