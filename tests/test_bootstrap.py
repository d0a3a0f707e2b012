"""Distributed bootstrap: against a plain walk of the same tree, against theory, on the exact branch, on any layout."""

import math
import random

import numpy as np
import pytest

from cinderloom.operators import comparison as cmp


def test_chunk_counts_are_multinomial():
    n, size, resamples = 1000, 128, 4000
    counts = np.array([cmp.chunk_draws(5, n, c, resamples, size) for c in range(8)])
    assert (counts.sum(0) == n).all()
    shares = np.array([size] * 7 + [n - 7 * size]) / n
    assert np.allclose(counts.mean(1), n * shares, rtol=0.02)
    assert np.allclose(counts.var(1), n * shares * (1 - shares), rtol=0.12)
    assert abs(np.cov(counts[0], counts[5])[0, 1] + n * shares[0] * shares[5]) < 4


def plain_interval(values, seed, resamples, size):
    """The same draws in one place: all chunks of all resamples, then sorted means."""
    n, total = len(values), np.zeros(resamples)
    for c in range(-(-n // size)):
        part, rng = np.array(values[c * size : (c + 1) * size]), cmp._draws(seed, f"chunk {c}")
        for r, k in enumerate(cmp.chunk_draws(seed, n, c, resamples, size)):
            if k:
                total[r] += sum(part[i] for i in rng.integers(0, len(part), k))
    means = sorted(total / n)

    def at(p):
        x = p * (resamples - 1)
        lo = math.floor(x)
        return means[lo] + (means[min(lo + 1, resamples - 1)] - means[lo]) * (x - lo)

    return at(0.025), at(0.975)


def test_equals_the_plain_walk(spark):
    rng = random.Random(1)
    values = [(i, rng.gauss(3, 2)) for i in range(37)]
    df = spark.createDataFrame([("a", i, v) for i, v in values] + [("b", 0, 4.0), ("c", 0, None), (None, 1, 1.0), (None, 2, 2.0)], "k string, ord bigint, x double").repartition(5)
    got = {r["k"]: r for r in cmp.bootstrap_interval(df, ["k"], "x", "ord", resamples=300, chunk=10).collect()}
    from pyspark.sql import functions as F

    seed = df.select(F.xxhash64(F.lit(0), F.lit("a"), F.lit(False))).first()[0]
    low, high = plain_interval([v for _, v in values], seed, 300, 10)
    assert got["a"]["method"] == "sampled" and abs(got["a"]["ci_low"] - low) < 1e-9 and abs(got["a"]["ci_high"] - high) < 1e-9
    assert (got["b"]["n"], got["b"]["method"], got["b"]["ci_low"], got["b"]["ci_high"]) == (1, "point", 4.0, 4.0)
    assert "c" not in got and got[None]["method"] == "exact" and (got[None]["ci_low"], got[None]["ci_high"]) == (1.0375, 1.9625)


def test_draws_in_slices_have_the_right_sums():
    values = np.arange(50.0)
    whole = cmp.chunk_sums(3, 50, 0, values, 2000, 64)
    assert abs(whole.mean() / 50 - 24.5) < 0.2


@pytest.mark.parametrize("n", [7, 5000])
def test_interval_is_the_normal_one_for_many_values(spark, n):
    rng = np.random.default_rng(n)
    values = rng.exponential(2.0, n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "ord bigint, x double")
    one, two = (cmp.bootstrap_interval(df.repartition(p), [], "x", "ord", resamples=2000, chunk=512).first() for p in (1, 6))
    assert one == two
    half = 1.96 * values.std() / math.sqrt(n)
    assert abs(one["ci_low"] - (values.mean() - half)) < 0.35 * half and abs(one["ci_high"] - (values.mean() + half)) < 0.35 * half


def test_every_group_beside_the_exact_branch(spark, sf_dir):
    from cinderloom.plans.catalogue import QUERIES, _cell_deltas

    every = {(r["subset"], r["baseline_policy"], r["budget"]): r for r in QUERIES["bootstrap_ci"](spark, sf_dir).collect()}
    exact = {(r["subset"], r["baseline_policy"], r["budget"]): r for r in QUERIES["bootstrap_ci_exact"](spark, sf_dir).collect()}
    groups = {(r[0], r[1], r[2]) for r in _cell_deltas(spark, sf_dir).where("delta is not null").select("subset", "baseline_policy", "budget").distinct().collect()}
    assert set(every) == groups and set(exact) <= groups
    for k, r in exact.items():
        assert abs(every[k]["ci_low"] - r["ci_low"]) < 1e-3 and abs(every[k]["ci_high"] - r["ci_high"]) < 1e-3
