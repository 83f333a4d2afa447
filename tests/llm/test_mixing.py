import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ontomill.llm import mixing as M
from ontomill.llm import registry
from tests.llm.awkward import ROWS, awkward, empty

SF = "/root/testdata/sf0.01"


def labelled(spark):
    return registry.labelled_domains(spark.read.parquet(f"{SF}/labels.parquet"))


def test_classifier_beats_the_base_rate(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    y = labelled(spark)
    model = M.fit_domains(docs, y.where("id % 2 = 0"), registry.DOMAINS)
    rows = M.memberships(docs, model).join(y.where("id % 2 = 1"), "id").select("domain", "p").collect()
    right = np.mean([registry.DOMAINS[int(np.argmax(r.p))] == r.domain for r in rows])
    base = max(np.mean([r.domain == d for r in rows]) for d in registry.DOMAINS)
    assert right > base + 0.02
    assert all(abs(sum(r.p) - 1) < 1e-6 for r in rows)


def brute_totals(members, rate):
    return sum(np.array(r.p) * r.n_tokens * rate(np.array(r.p)) for r in members)


def test_totals_meet_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 400)), rng.dirichlet([0.3, 0.5, 0.2]).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, n_tokens long, p array<double>")
    for weights in ((1, 1, 1), (0.9, 0.05, 0.05)):
        steps, said = M.fit_rates(df, weights)
        members = df.withColumn("rate", M.rate_of(steps, df.p)).collect()
        totals = sum(np.array(r.p) * r.n_tokens * r.rate for r in members)
        share = totals / totals.sum()
        assert np.abs(share - np.array(weights) / sum(weights)).max() < 1e-4
        assert min(r.rate for r in members) >= 0
        assert np.allclose(totals, said["reached"]) and np.allclose(totals, brute_totals(members, lambda p, s=steps: M.replay(p[None], s)[0]))


def test_rates_meet_a_target_that_totals_lead_away_from(spark):
    """Few documents with hardly any of the third domain: the rates nearest one meet its small share, in some ten rounds."""
    rng = np.random.default_rng(1)
    p = np.vstack([np.column_stack([1 - q, np.zeros_like(q), q]) for q in (rng.uniform(0.0, 0.02, 60), rng.uniform(0.05, 0.12, 700), rng.uniform(0.2, 0.9, 200))] + [np.tile([0.0, 1.0, 0.0], (40, 1))])
    t = rng.integers(20, 900, len(p)).astype(float)
    df = spark.createDataFrame([(i, int(n), q.tolist()) for i, (n, q) in enumerate(zip(t, p, strict=True))], "id long, n_tokens long, p array<double>")
    steps, said = M.fit_rates(df, registry.SHARES)
    r = M.replay(p, steps)
    assert said["met"] and said["rounds"] <= 20
    assert np.allclose((r * t) @ p / t.sum(), registry.SHARES, atol=1e-6) and min(r) >= 0
    # the nearest rates to one: no others that meet the target have a smaller sum of squares
    away = rng.normal(size=(len(p), 50))
    a = p * t[:, None]
    held = r[:, None] > 1e-3
    away = np.where(held, away, 0) - np.where(held, a @ np.linalg.solve((a * held).T @ a, a.T @ np.where(held, away, 0)), 0)
    assert np.abs((t * (r - 1)) @ away).max() < 1e-6 * t.sum()


def test_unreachable_target_stays_nonnegative(spark):
    df = spark.createDataFrame([(1, 10, [0.5, 0.5]), (2, 10, [0.5, 0.5])], "id long, n_tokens long, p array<double>")
    steps, said = M.fit_rates(df, (0.9, 0.1), rounds=5)
    assert np.isfinite(said["reached"]).all()
    assert all(M.replay(np.array([[0.5, 0.5]]), steps) >= 0)


def test_mixed_and_awkward(spark):
    df = awkward(spark)
    model = M.fit_domains(df, labelled(spark).limit(0), registry.DOMAINS)
    assert M.memberships(df, model).count() == len(ROWS)
    out = M.mixed(df, model, (1, 1, 1))
    assert out.columns == df.columns
    assert M.mixed(empty(spark), model, (1, 1, 1)).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = M.fit_domains(docs, labelled(spark).where("domain <> 'toxic'"), ("good", "poor"))
    kept = M.mixed(docs, model, (0.95, 0.05))
    p = {r.id: r.p[0] for r in M.memberships(docs, model).collect()}
    ids = {r.doc_id for r in kept.collect()}
    good = [i for i in p if p[i] > 0.9]
    assert sum(i in ids for i in good) > 0.97 * len(good)
    assert 0 < kept.count() < docs.count()


def nearest(t, p, goal, rounds=200_000):
    """Non-negative least squares of the totals by many small projected gradient steps."""
    r, a = np.ones(len(t)), p * t[:, None]
    step = 1 / np.linalg.eigvalsh(a.T @ p).max()
    for _ in range(rounds):
        r = np.maximum(0, r - step * p @ (a.T @ r - goal))
    return a.T @ r


def test_unreachable_totals_are_the_nearest(spark):
    rng = np.random.default_rng(8)
    for k, weights in ((2, (0.95, 0.05)), (3, (0.9, 0.02, 0.08))):
        p = rng.dirichlet(np.full(k, 4.0), 60)
        t = rng.integers(1, 300, 60).astype(float)
        df = spark.createDataFrame([(i, int(n), q.tolist()) for i, (n, q) in enumerate(zip(t, p, strict=True))], "id long, n_tokens long, p array<double>")
        with pytest.warns(UserWarning, match="totals"):
            _, said = M.fit_rates(df, weights, rounds=150)
        want = nearest(t, p, said["goal"], 20_000)
        assert not said["met"]
        off, least = np.linalg.norm(said["reached"] - said["goal"]), np.linalg.norm(want - said["goal"])
        assert off <= 1.05 * least + 1e-6 * t.sum()


def test_query_equals_brute_force(spark):
    """The registered query: posteriors by a plain naive Bayes, rates that bring the totals to the shares."""
    out = {r.doc_id: r for r in registry.op5_mixing(spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    y = {r.id: r.domain for r in labelled(spark).collect()}
    counts, prior = np.full((3, 2 * M.BUCKETS), 0.1), np.ones(3)
    features = {i: Counter(t.lower().encode().split()) if t.isascii() else Counter("".join(c.lower() if c.isascii() else c for c in t).encode().split()) for i, t in docs.items()}
    places = {i: [(zlib.crc32(w) % M.BUCKETS, M.BUCKETS + zlib.crc32(w[-2:], 1) % M.BUCKETS, math.log1p(n)) for w, n in c.items()] for i, c in features.items()}
    for i, domain in y.items():
        k = registry.DOMAINS.index(domain)
        prior[k] += 1
        for a, b, n in places[i]:
            counts[k, a] += n
            counts[k, b] += n
    table = np.log(counts / np.repeat(np.stack([counts[:, : M.BUCKETS].sum(1), counts[:, M.BUCKETS :].sum(1)], 1), M.BUCKETS, axis=1))
    assert set(out) == set(docs)
    for i in sorted(docs)[::5]:
        n = sum(features[i].values())
        z = np.log(prior / prior.sum()) + sum(((table[:, a] + table[:, b]) * w for a, b, w in places[i]), np.zeros(3)) / math.sqrt(max(n, 1))
        p = np.exp(z - z.max())
        p /= p.sum()
        assert np.allclose([out[i][f"p_{d}"] for d in registry.DOMAINS], p, atol=2e-6) and out[i].n_tokens == n
    totals = sum(r.n_tokens * r.rate * np.array([r[f"p_{d}"] for d in registry.DOMAINS]) for r in out.values())
    assert np.abs(totals / totals.sum() - np.array(registry.SHARES)).max() < 1e-4


def test_posteriors_rank_held_out_rows(spark):
    """On rows that it wasn't fitted on, posteriors rank toxic before other rows, and poor before good ones."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    y = registry.labelled_domains(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    model = M.fit_domains(docs, y.where("id % 2 = 0"), registry.DOMAINS)
    rows = M.memberships(docs, model).join(y.where("id % 2 = 1"), "id").select("domain", "p").collect()
    p, domain = np.array([r.p for r in rows]), np.array([r.domain for r in rows])

    def auc(score, y):
        ranks = score.argsort().argsort()
        return (ranks[y].mean() - (y.sum() - 1) / 2) / (~y).sum()

    clean = domain != "toxic"
    assert auc(p[:, 2], ~clean) > 0.75
    assert auc(p[clean, 1] / (p[clean, 0] + p[clean, 1]), domain[clean] == "poor") > 0.95
