"""Change points against a plain quadratic search, exactly and with ties, and through Spark on awkward rows."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from cinderloom.llm import changepoints as cp


def plain(x, least, penalty):
    """Every start of every end; ties by segments, then start."""
    n, x = len(x), [int(v) for v in x]
    s, q = [0], [0]
    for v in x:
        s.append(s[-1] + v)
        q.append(q[-1] + v * v)
    best = {0: (0, 0, None)}
    for t in range(1, n + 1):
        found = []
        for a in range(t):
            m = t - a
            if a not in best or (m < least and not (a == 0 and t == n)):
                continue
            v = 1 + (m * (q[t] - q[a]) - (s[t] - s[a]) ** 2) // (m * m)
            found.append((best[a][0] + (penalty if a else 0) + m * math.floor(1000 * math.log(v)), best[a][1] + 1, a))
        if found:
            best[t] = min(found)
    out, t = [], n
    while t:
        a = best[t][2]
        out.append((a, t - a))
        t = a
    return out[::-1], best[n][0]


def made(rng):
    n = rng.choice([1, 5, 13, 14, 20, 27, 28, 29, 40, 80, 150, 300])
    kind = rng.randrange(6)
    if kind == 0:
        return [0] * n
    if kind == 1:
        return [rng.choice([0, 0, 0, 5]) for _ in range(n)]
    if kind == 2:
        return [int(rng.gauss(100 * (1 + (i // 37) % 3), 10 * (1 + i // 50))) for i in range(n)]
    if kind == 3:
        return [rng.randrange(-(10**12), 10**12) for _ in range(n)]
    if kind == 4:
        return [7 * (i // 20 % 2) for i in range(n)]  # equal costs on both sides of many cuts
    return [int(rng.expovariate(1 / 300)) for _ in range(n)]


@pytest.mark.parametrize(("least", "penalty"), [(14, 40_000), (14, 0), (3, 0), (1, 5_000), (2, 1_000)])
def test_search_equals_the_quadratic_one(least, penalty):
    rng = random.Random(least * 7 + penalty)
    series = [np.array(made(rng), np.int64) for _ in range(60)]
    for x, (parts, best) in zip(series, cp.solved(series, least, penalty)):
        wanted, cost = plain(x, least, penalty)
        assert ([(a, n) for a, n, *_ in parts], best) == (wanted, cost)
        assert sum(p[4] for p in parts) + penalty * (len(parts) - 1) == best
        assert sum(p[2] for p in parts) == int(x.sum())


def test_bounds_close_most_blocks():
    rng = np.random.default_rng(5)
    series = [rng.poisson(30, 600) * 25 for _ in range(8)]
    lot = cp.Lot(series, 14, 40_000)
    lot.solve()
    blocks = sum(-(-s // cp.FAN) for s in range(28, 601))
    assert lot.opened < 0.25 * 8 * blocks


def test_rows_with_nulls_gaps_repeats_and_clashing_columns(spark):
    day = dt.datetime(1969, 12, 20, 23, 59)
    rng = random.Random(3)
    rows = []
    for key in (1, 2, None):
        for i in range(90):
            if i % 7 == 3:
                continue
            for _ in range(1 + (key == 1) * 2):
                rows.append((key, rng.choice([5, 5, 60 if i > 45 else 6]), day + dt.timedelta(days=i), "x"))
    rows += rows[:40]
    rows += [(1, None, day, "n"), (2, 4, None, "n"), (9, None, None, None), (8, 3, day, "one")]
    df = spark.createDataFrame(rows, "vendor bigint, amount int, at timestamp, day string").selectExpr("*", "1 AS key", "2 AS total", "3 AS value", "4 AS time")
    got = defaultdict(list)
    for r in cp.segments(df, "vendor", "amount", "at").collect():
        got[r["key"]].append(r)
    sums = defaultdict(lambda: defaultdict(int))
    for key, amount, at, _ in rows:
        if amount is not None and at is not None:
            sums[key][(at.date() - dt.date(1970, 1, 1)).days] += amount
    assert set(got) == set(sums) == {1, 2, 8, None}
    for key, by_day in sums.items():
        first = min(by_day)
        x = [by_day.get(d, 0) for d in range(first, max(by_day) + 1)]
        wanted, best = plain(x, 14, 40_000)
        mine = sorted(got[key], key=lambda r: r["segment_no"])
        assert [(r["first_day"] - first, r["n_days"]) for r in mine] == wanted
        assert {(r["n_segments"], r["best_cost"]) for r in mine} == {(len(wanted), best)}


def test_text_keys_and_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, v int, t timestamp")
    assert cp.segments(empty, "k", "v", "t").collect() == []
    one = spark.createDataFrame([("a", 3, dt.datetime(2024, 1, 1))], "k string, v int, t timestamp")
    r = cp.segments(one, "k", "v", "t").first()
    assert (r["key"], r["n_days"], r["total"], r["spread"], r["cost"], r["n_segments"], r["best_cost"]) == ("a", 1, 3, 1, 0, 1, 0)


def test_settings_are_checked():
    with pytest.raises(ValueError):
        cp.solved([np.array([1])], least=0)
