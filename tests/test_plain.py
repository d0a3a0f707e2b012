"""Operators whose queries have no SQL, against plain Python; gaps that the driver's tables don't have."""

import random
import statistics
from hashlib import sha256
import json

from cinderloom.operators import comparison, policy


def test_bootstrap_sampled_equals_plain(spark):
    rows = [("a", i, v) for i, v in enumerate([0.5, -1.0, 2.25, 3.0, -0.125, 7.5, 1.0])] + [("b", 0, 4.0), ("c", 0, None)]
    got = {r.k: r for r in comparison.bootstrap_sampled(spark.createDataFrame(rows, "k string, ord long, x double"), ["k"], "x", "ord", resamples=500).collect()}
    values = [v for k, _, v in rows if k == "a"]
    rng = random.Random(int(sha256(json.dumps(values).encode()).hexdigest()[:16], 16))
    means = sorted(statistics.fmean(rng.choices(values, k=0) or [values[rng.randrange(7)] for _ in range(7)]) for _ in range(500))

    def at(p):
        x = p * 499
        return means[int(x)] + (means[int(x) + 1] - means[int(x)]) * (x - int(x))

    assert abs(got["a"].ci_low - at(0.025)) < 1e-9 and abs(got["a"].ci_high - at(0.975)) < 1e-9
    assert (got["b"].ci_low, got["b"].ci_high, got["b"].n) == (4.0, 4.0, 1) and "c" not in got


def test_random_feasible_takes_only_feasible_actions(spark):
    states = spark.createDataFrame([(i, 0, 5, 1000.0, float(r)) for i, r in enumerate([0, 1024, 1024, 1e9] + [4096] * 300)], "state_id long, cycle int, cycles int, budget double, remaining double")
    got = {r.state_id: r for r in policy.chosen(states, "random_feasible", seed=7).collect()}
    again = {r.state_id: r for r in policy.chosen(states, "random_feasible", seed=7).collect()}
    left = {r.state_id: r.remaining for r in states.collect()}
    assert got == again and len(got) == 304 and got[0].action == "STOP"
    assert all(r.action == "STOP" or r.cost <= left[i] for i, r in got.items())
    assert len({r.action for i, r in got.items() if i > 3}) >= 10


def test_grid_gaps(spark):
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "policy string, seed int")
    found = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("c", 1)], "policy string, seed int")
    assert sorted(tuple(r) for r in comparison.grid_gaps(expected, found).collect()) == [("a", 2, "missing"), ("b", 1, "missing"), ("c", 1, "unexpected")]
