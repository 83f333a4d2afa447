"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives each document a posterior over domains. A document of ``t`` tokens and posterior
``p`` adds ``r * t * p`` to the domains' expected totals at rate ``r``. Rates start at one and follow scaled, projected
gradient steps, ``r = max(0, 1 - p . L)``: each round adds to ``L`` what solves the normal equations of the documents whose
rate is above zero, so that the end is the rates nearest one that meet the targets. Where none do, plain projected gradient
steps of the least squares between totals and targets follow, ``r <- max(0, r - p . L)``. Only ``L``, of one number a domain,
passes between rounds: a document's rate is replayed from the rounds' ``L``, so there is no table of rates to hold, join or send.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.llm.columns import string_bytes, text_of
from ontomill.plans.rounds import durable
from ontomill.plans.ship import arrow_rows

BUCKETS = 1 << 13
#: Rounds of scaled steps before plain ones; they end in some ten where the target can be met.
SCALED = 40


def word_counts(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash buckets of a text's words and word ends, the damped number of times (``log(1 + n)``) that each occurs, and the number of words."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0), 0
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    crc = zlib.crc32
    n = len(distinct)
    at = np.fromiter((crc(w) for w in distinct), np.int64, n)
    ends = np.fromiter((crc(w[-2:], 1) for w in distinct), np.int64, n)
    times = np.log1p(np.fromiter(distinct.values(), np.float64, n))
    return np.concatenate([at % BUCKETS, BUCKETS + ends % BUCKETS]), np.concatenate([times, times]), len(words)


@dataclass(frozen=True)
class DomainModel:
    """Naive Bayes over hashed words; the evidence is divided by the root of the text's length, so that posteriors stay soft."""

    domains: tuple[str, ...]
    prior: np.ndarray
    table: np.ndarray

    def posterior(self, data: bytes) -> tuple[np.ndarray, int]:
        at, times, n = word_counts(data)
        z = np.log(self.prior) + (self.table[:, at] @ times / np.sqrt(max(n, 1)) if n else 0.0)
        e = np.exp(z - z.max())
        return e / e.sum(), n


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", max_train: int = 40_000) -> DomainModel:
    """Fits word counts of each domain over labelled documents (``labelled``: id, domain), by distributed sums.

    A hash of the id bounds the sample at about ``max_train`` rows. Domains without labels get a flat table.
    """
    y = labelled.where("id is not null").groupBy("id").agg(F.min("domain").alias("domain"))
    share = min(1.0, max_train / max(y.count(), 1))
    y = y.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20))))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")).join(F.broadcast(y), "id").select("domain", "t")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((len(domains), 2 * BUCKETS)), np.zeros(len(domains))
        for batch in batches:
            for domain, data in zip(batch.column(0).to_pylist(), string_bytes(batch.column(1)), strict=True):
                k = domains.index(domain)
                at, times, _ = word_counts(data)
                np.add.at(sums[k], at, times)
                seen[k] += 1
        for k in range(len(domains)):
            at = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, k, np.int32)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(sums[k][at], seen[k]))], ["k", "at", "n"])

    table, prior = np.full((len(domains), 2 * BUCKETS), 0.1), np.full(len(domains), 1.0)
    for k, at, n in arrow_rows(rows, counts, "k int, at int, n double").groupBy("k", "at").agg(F.sum("n")).collect():
        if at < 0:
            prior[k] += n
        else:
            table[k, at] += n
    table = np.concatenate([np.log(part / part.sum(1, keepdims=True)) for part in (table[:, :BUCKETS], table[:, BUCKETS:])], axis=1)
    return DomainModel(domains, prior / prior.sum(), table)


def memberships(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, p`` of every row; a text without words has the prior as posterior and no tokens."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.posterior(x) for x in string_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([np.round(p, 9) for p, _ in found], pa.list_(pa.float64()))], ["id", "n_tokens", "p"])

    return arrow_rows(docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")), rows, f"id {kind}, n_tokens long, p array<double>")


def replay(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors ``p`` (one a row) after the given steps."""
    r = np.ones(len(p))
    for step in steps:
        r = np.maximum(0.0, r - p @ step)
    return r


def fit_rates(members: DataFrame, weights: tuple[float, ...], total: float | None = None, rounds: int = 60, tolerance: float = 1e-7) -> tuple[list[np.ndarray], dict]:
    """Steps that bring the domains' expected totals to ``weights`` times ``total``, and what was reached.

    ``total`` defaults to the tokens that there are. Scaled steps come first, all added up in one: of the rates that meet the
    target they seek those with the least sum of ``t * (r - 1) ** 2``, through its convex dual ``sum(t * r ** 2) / 2 + goal . L``,
    and are halved where that doesn't fall (the totals may lead away for a while). If they don't end within ``SCALED`` rounds,
    or show that no rates meet the target, up to ``rounds`` plain projected-gradient steps follow from the nearest totals so far,
    which can't lead away from the nearest ones (longer steps while that gains more). ``met`` in the report says whether the
    target was reached; if it was not (an unreachable target, or ``rounds`` too few) a warning is given too and the totals are
    the nearest that were found.
    """
    k = len(weights)
    weights = np.array(weights) / np.sum(weights)

    def sums(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Totals, normal equations, squares of the rates, and the least ``p . L`` over all steps."""
        size = k + k * k + 1
        whole = np.sum(steps, axis=0) if steps else np.zeros(k)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, low = np.zeros(size), np.inf
            for batch in batches:
                if batch.num_rows:
                    t = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                    p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                    r = replay(p, steps)
                    out[:k] += (r * t) @ p
                    out[k:-1] += ((p * (t * (r > 0))[:, None]).T @ p).ravel()
                    out[-1] += (t * r) @ r
                    low = min(low, float(np.min(p @ whole, where=t > 0, initial=np.inf)))
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(out), pa.array(np.full(size, low))], ["i", "x", "low"])

        got = {i: (x, low) for i, x, low in arrow_rows(members.select("n_tokens", "p"), part, "i int, x double, low double").groupBy("i").agg(F.sum("x"), F.min("low")).collect()}
        x = np.array([got.get(i, (0.0, 0.0))[0] for i in range(size)])
        return x[:k], x[k:-1].reshape(k, k), x[-1], got.get(0, (0.0, np.inf))[1]

    reached, normal, squares, _ = sums([])
    goal = weights * (reached.sum() if total is None else total)
    natural, steps, n, close = reached, [], 0, tolerance * max(weights.sum() if total is None else total, reached.sum(), 1)
    best = np.linalg.norm(reached - goal)
    least = 1 / max(np.linalg.eigvalsh(normal).max(), 1e-12)  # what the curvature of all documents allows
    at, totals, curve, dual, part_of = np.zeros(k), reached, normal, squares / 2, 1.0
    while n < SCALED and np.abs(reached - goal).max() > close and part_of > 1e-6:
        n += 1
        away = totals - goal
        step = part_of * np.linalg.solve(curve + 1e-12 * max(np.trace(curve), 1e-12) * np.eye(k), away)
        then, curve_then, squares, low = sums([at + step])
        fell = squares / 2 + goal @ (at + step)
        if not (np.isfinite(then).all() and fell <= dual - 1e-4 * (away @ step) + 1e-12 * abs(dual)):
            part_of /= 2
            continue
        at, totals, curve, dual, part_of = at + step, then, curve_then, fell, 1.0
        off = np.linalg.norm(then - goal)
        if off < best:
            steps, reached, best = [at], then, off
        if low >= 0 and goal @ at < 0:
            break  # totals of any rates stand on one side of a plane, the target on the other
    last, rate = n + rounds, 16 * least
    while n < last and np.abs(reached - goal).max() > close:
        n += 1
        step = rate * (reached - goal)
        then = sums([*steps, step])[0]
        off = np.linalg.norm(then - goal)
        if np.isfinite(off) and off < best * (1 - 1e-6):
            steps.append(step)
            reached, best = then, off
            rate *= 4
        elif rate > least:
            rate = max(rate / 4, least)
        else:
            break  # the plain step gains nothing more: these are the nearest totals
    met = bool(np.abs(reached - goal).max() <= close)
    if not met:
        warnings.warn(f"the domains' totals are {reached.tolist()}, not {goal.tolist()}, after {n} rounds", stacklevel=2)
    return steps, {"natural": natural, "goal": goal, "reached": reached, "rounds": n, "met": met}


def keep_all_total(members: DataFrame, weights: tuple[float, ...]) -> float:
    """The largest total at which no domain needs more tokens than it has."""
    k = len(weights)
    have = members.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i]).alias(f"p{i}") for i in range(k)]).first()
    share = np.array(weights) / np.sum(weights)
    return float(min((have[i] or 0.0) / share[i] for i in range(k) if share[i] > 0))


def whole_total(members: DataFrame, weights: tuple[float, ...], whole: int) -> float | None:
    """The total at which domain ``whole`` is not lowered to make up for scarcer ones.

    If it is the scarcest, that is ``keep_all_total``. Else rates are ``1 + p . x``, where ``x`` is zero at ``whole`` and nowhere
    negative: no rate is below one, and the other domains are repeated as far as they are short. None if there is no such total.
    """
    k = len(weights)
    t, p = F.col("n_tokens"), [F.col("p")[i] for i in range(k)]
    sums = members.agg(*[F.sum(t * p[i]).alias(f"h{i}") for i in range(k)], *[F.sum(t * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k) if j != whole]).first()
    have, normal = (np.array([x or 0.0 for x in part]) for part in (sums[:k], sums[k:]))
    share = np.array(weights) / np.sum(weights)
    natural = [h / w if w > 0 else np.inf for h, w in zip(have, share, strict=True)]
    if natural[whole] <= min(natural):
        return float(natural[whole])
    try:
        *x, total = np.linalg.solve(np.column_stack([normal.reshape(k, k - 1), -share]), -have)
    except np.linalg.LinAlgError:
        return None
    return float(total) if np.isfinite(total) and total > 0 and min(x, default=0.0) >= 0 else None


def rate_of(steps: list[np.ndarray], p: Column) -> Column:
    """The rate as an expression over the posterior array."""
    r = F.lit(1.0)
    for step in steps:
        r = F.greatest(F.lit(0.0), r - sum((p[i] * F.lit(float(x)) for i, x in enumerate(step)), F.lit(0.0)))
    return r


def mixed(docs: DataFrame, model: DomainModel, weights: tuple[float, ...], id_col: str = "doc_id", text_col: str = "text", seed: int = 42, whole: int | None = None) -> DataFrame:
    """The rows of ``docs`` sampled at their rates, columns as they were.

    The total is the largest at which no domain is short, so that rates stay about one or below and documents of the scarcest
    domain stay. If another domain than ``whole`` is the scarcest, the total is that of ``whole_total``, so that no rate falls
    below one and the others are repeated; where no repeating meets the shares, every row stays once. A row of rate ``r`` stands ``floor(r)`` times, and once more if a hash of its id is below the remainder; null
    ids share one draw.
    """
    members = durable(memberships(docs, model, id_col, text_col))
    total = keep_all_total(members, weights) if whole is None else whole_total(members, weights, whole)
    steps = [] if total is None else fit_rates(members, weights, total)[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns, ids, texts = docs.columns, docs.columns.index(id_col), docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.array([np.round(m.posterior(x)[0], 9) for x in string_bytes(batch.column(texts))])
            r = np.round(replay(p, steps), 6)
            draw = np.array([zlib.crc32(f"{seed}:{i}".encode()) / 2**32 for i in batch.column(ids).to_pylist()])
            times = np.floor(r).astype(np.int64) + (draw < r - np.floor(r))
            yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))

    return arrow_rows(docs.select(*[F.col(f"`{c}`") for c in columns]), rows, docs.schema)
