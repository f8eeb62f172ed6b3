"""Soft-membership mixing: rates for documents such that expected tokens of each domain meet target weights.

A classifier that learns from a table of labelled documents gives every document posteriors over the domains, from the byte
pairs of its whole text. Documents with the same posteriors, in steps of 1/1000, get the same rate, so they are one cell of
summed tokens. Projected gradient descent fits the rates: a step is one distributed sum of expected tokens by domain over the
cells, then every rate moves against the residuals, weighed by its posteriors, and is cut off at zero; Newton steps finish what the plain ones leave. It starts at one
common rate and so ends at rates near it. Only the steps, one number per domain each, pass through the driver: a rate is
recomputed from them wherever it is needed.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.llm.common import mix64, stored, texts
from provalake.llm.training import chosen_texts

#: Bounds of the classifier: labelled documents of each domain, and hashed byte pairs.
PER_DOMAIN, FEATURES = 500, 1024
#: Posteriors are counted in this many parts.
PARTS = 1000
MOST_STEPS, TOLERANCE = 300, 1e-4
#: So many steps of the fit are plain ones.
PLAIN_STEPS = 20
#: By default no document is taken more often than this on average, so a domain that would need more falls short of its target.
MOST_RATE = 4.0
#: The default total is this share of the tokens there are, or more where no domain has to be repeated for it. What is left
#: below 1 makes room for the chance of the draws, so that a mix hardly ever has more rows than its input.
KEEP = 0.9
#: Target weights of the registered query and of the pipeline.
TARGETS = {"en": 0.55, "de": 0.18, "fr": 0.17, "es": 0.10}

_LOG = logging.getLogger(__name__)
_FEATURE = (mix64(np.arange(65536, dtype=np.uint64)) % np.uint64(FEATURES)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs; zeros for a text of fewer than two bytes."""
    data = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    if len(data) < 2:
        return np.zeros(FEATURES)
    return np.sqrt(np.bincount(_FEATURE[data[:-1] << 8 | data[1:]], minlength=FEATURES) / (len(data) - 1))


@dataclass(frozen=True)
class Model:
    domains: tuple[str, ...]
    weights: np.ndarray  # features and a constant by domains

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([x, np.ones((len(x), 1))], 1) @ self.weights
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "domain": b["domain"], "x": [features(t).astype("<f4").tobytes() for t in b["text"]]})


def train(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], per_domain: int = PER_DOMAIN, rounds: int = 300) -> Model:
    """Softmax regression on a bounded sample of `labelled` (doc_id, domain): per_domain documents of each domain, chosen by a
    hash of the id, with one text for each id. Their ids are broadcast; per_domain * domains rows of FEATURES numbers reach the driver. Domains without
    a labelled document get no membership, unless none has one."""
    key = F.xxhash64("doc_id")
    ids = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").where(F.col("doc_id").isNotNull())
    ids = ids.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = None
    for d in domains:
        some = ids.where(F.col("domain") == d).orderBy(key, "doc_id").limit(per_domain)
        chosen = some if chosen is None else chosen.unionByName(some)
    sample = chosen_texts(docs, chosen)
    rows = sorted(sample.mapInPandas(_features, "doc_id long, domain string, x binary").collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    weights = np.zeros((FEATURES + 1, len(domains)))
    if rows:
        x = np.concatenate([np.stack([np.frombuffer(bytes(r["x"]), "<f4") for r in rows]).astype(float), np.ones((len(rows), 1))], 1)
        y = np.array([[r["domain"] == d for d in domains] for r in rows], float)
        balance = (y / np.maximum(y.sum(0), 1)).sum(1, keepdims=True) / (y.sum(0) > 0).sum()
        speed = np.zeros_like(weights)
        for _ in range(rounds):
            z = x @ weights
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed - 2.0 * (x.T @ (balance * (p - y)) + 1e-5 * weights)
            weights = weights + speed
        weights[-1, y.sum(0) == 0] = -1e9
    return Model(domains, weights)


def parts_of(model: Model, values: list[str | None]) -> np.ndarray:
    """The posteriors of texts in parts of 1/1000; what rounding down leaves goes to the likeliest domain."""
    p = model.posteriors(np.stack([features(t or "") for t in values]))
    parts = np.floor(p * PARTS).astype(np.int32)
    parts[np.arange(len(p)), p.argmax(1)] += PARTS - parts.sum(1)
    return parts


def _members(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for b in batches:
        for start in range(0, len(b), 500):
            part = b.iloc[start:start + 500]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [len(t.split()) for t in part["text"]],
                                "member": list(parts_of(model, part["text"].tolist()))})


def memberships(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens (words of the whole text) and `member`: the posteriors in parts of 1/1000, in the model's order."""
    return texts(docs).mapInPandas(lambda it: _members(it, model), "doc_id long, n_tokens long, member array<int>")


def rates(member: np.ndarray, start: float, steps: list[np.ndarray], most: float = np.inf) -> np.ndarray:
    """The rates of cells (rows of posteriors) after the given steps; none above `most`."""
    r = np.full(len(member), start)
    for s in steps:
        r = np.clip(r - member @ s, 0.0, most)
    return r


def _sums(cells: DataFrame, start: float, steps: list[np.ndarray], n: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the present rates, and the second moments of membership of the tokens whose rates can
    still move both ways: partial sums by batch, then n + n * n numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, moments = np.zeros(n), np.zeros((n, n))
        for b in batches:
            member = np.stack(b["member"].to_list()).reshape(-1, n) / PARTS
            r, tokens = rates(member, start, steps, most), b["tokens"].to_numpy(float)
            total += (r * tokens) @ member
            moments += (member * (tokens * ((r > 0) & (r < most)))[:, None]).T @ member
        yield pd.DataFrame({"place": range(n + n * n), "tokens": np.concatenate([total, moments.ravel()])})

    found = cells.mapInPandas(run, "place int, tokens double").groupBy("place").agg(F.sum("tokens").alias("tokens")).collect()
    out = np.zeros(n + n * n)
    for r in found:
        out[r["place"]] = r["tokens"]
    return out[:n], out[n:].reshape(n, n)


def fit(cells: DataFrame, targets: dict[str, float], total: float | None = None) -> tuple[float, list[np.ndarray], np.ndarray, np.ndarray]:
    """Start rate, steps, target tokens and expected tokens by domain, for cells (member, tokens).

    Domains without tokens are left out, and the weights of the others shared out anew. `total` tokens are shared out by the
    weights, at whatever rates it takes. By default they are KEEP of those there are, or more where every domain can give its
    part once: scarce domains are repeated, up to MOST_RATE times; one that would need more gives what it can, and the others
    keep their parts.

    The first PLAIN_STEPS steps are the residuals over the largest eigenvalue of the tokens' second moments of membership. They
    are slow for small domains, so what is left is solved by Newton steps over the rates that can move; one that doesn't halve
    the error is taken back for a step of the residuals over each domain's own tokens, which never makes it worse. The fit ends at
    the tolerance, at a point that no step betters (targets that can't be met), or after MOST_STEPS sums.
    """
    n = len(targets)
    share = np.array(list(targets.values())) / sum(targets.values())
    at = [F.col("member")[d].cast("double") / PARTS for d in range(n)]
    sums = [F.sum(F.col("tokens") * at[d]) for d in range(n)] + [F.sum(F.col("tokens") * at[d] * at[e]) for d in range(n) for e in range(n)]
    found = np.array([float(v or 0) for v in cells.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()])
    have, moments = found[:n], found[n:].reshape(n, n)
    share = np.where(have > 0, share, 0.0)
    share /= share.sum() or 1.0
    most = np.inf if total is not None else MOST_RATE
    if total is None:
        total = max(KEEP * have.sum(), float(min((have[d] / share[d] for d in range(n) if share[d] > 0), default=0.0)))
    start = total / have.sum() if have.sum() else 1.0
    want = share * total if np.isinf(most) else np.minimum(share * total, most * have)
    largest = float(np.linalg.eigvalsh(moments)[-1]) or 1.0
    scale = np.maximum(have, 1.0)

    def error(at: np.ndarray) -> float:
        return float(((at - want) ** 2 / scale).sum())

    def met(at: np.ndarray) -> bool:
        return bool(np.abs(at - want).max() <= TOLERANCE * max(total, 1.0))

    steps: list[np.ndarray] = []
    expected = have * start
    while len(steps) < PLAIN_STEPS and not met(expected):
        steps.append((expected - want) / largest)
        expected, moments = _sums(cells, start, steps, n, most)
    sums = len(steps)
    while sums < MOST_STEPS and not met(expected):
        newton = np.linalg.lstsq(moments, expected - want, rcond=1e-12)[0]
        for step in (newton, (expected - want) / scale):
            after, later = _sums(cells, start, [*steps, step], n, most)
            sums += 1
            if error(after) <= error(expected) / 4:
                break
        if error(after) > error(expected) * (1 - 1e-4):
            break
        steps.append(step)
        expected, moments = after, later
    return start, steps, want, expected


@dataclass(frozen=True)
class Plan:
    model: Model
    start: float
    steps: list[np.ndarray]
    most: float
    want: np.ndarray
    expected: np.ndarray

    def rates(self, member: np.ndarray) -> np.ndarray:
        return rates(member / PARTS, self.start, self.steps, self.most)


def planned(members: DataFrame, model: Model, targets: dict[str, float], total: float | None = None) -> Plan:
    """Fit the rates over the cells of a table of memberships. A warning names the domains that miss their target."""
    cells = members.groupBy("member").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    start, steps, want, expected = fit(stored(cells, "cells"), targets, total)
    weight = np.array(list(targets.values())) / sum(targets.values())
    got = expected / (expected.sum() or 1.0)
    missed = [f"{d} {g:.4f} instead of {w:.4f}" for d, w, g in zip(targets, weight, got, strict=True) if abs(g - w) > 2 * TOLERANCE]
    if missed and expected.sum():
        _LOG.warning("shares that differ from their targets: %s", ", ".join(missed))
    return Plan(model, start, steps, np.inf if total is not None else MOST_RATE, want, expected)


def _draw():
    """A number from 0 to 1 that depends on the doc_id alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mixing"), "doc_id"), 11) / float(1 << 53)


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None) -> DataFrame:
    """doc_id, n_tokens, `member` (posteriors in 1/1000, in the order of `targets`), `rate` and `copies` of every document.

    `copies` is the rate rounded down, and one more with the probability of what is left, decided by a hash of the doc_id. An
    empty or null text has no tokens and the posteriors of the constant alone; repeated rows are mixed each; documents with a
    null id share one draw; an empty table gives an empty one.
    """
    model = train(docs, labelled, tuple(targets))
    members = stored(memberships(docs, model), "members")
    plan = planned(members, model, targets, total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(rate=plan.rates(np.stack(b["member"].to_list())))

    rated = members.mapInPandas(run, "doc_id long, n_tokens long, member array<int>, rate double")
    whole = F.floor("rate")
    return rated.withColumn("copies", (whole + (_draw() < F.col("rate") - whole).cast("long")).cast("long"))


def resampled(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None) -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as `mixed` says. The fit reads one narrow table; the rows
    themselves are drawn where they lie, with their posteriors computed anew, and nothing is shuffled."""
    model = train(docs, labelled, tuple(targets))
    plan = planned(memberships(docs, model), model, targets, total)
    name = "draw"
    while name in docs.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                rate = plan.rates(parts_of(model, batch.column("text").to_pylist()))
                copies = np.floor(rate) + (batch.column(name).to_numpy() < rate - np.floor(rate))
                yield batch.drop_columns(name).take(pa.array(np.repeat(np.arange(batch.num_rows), copies.astype(int))))

    return docs.withColumn(name, _draw()).mapInArrow(run, docs.schema)


def labelled_by(docs: DataFrame, column: str) -> DataFrame:
    return docs.select("doc_id", F.col(column).alias("domain"))
