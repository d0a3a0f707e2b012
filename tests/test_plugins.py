"""Metric plug-ins and sample contexts, against plain versions and with plug-ins of one's own."""

import json
import random
from collections import Counter, defaultdict

import pytest

from cinderloom.operators import contexts, metrics


def predictions(seed, n=600):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 1, 2, None]), rng.randrange(4), rng.choice([0, 1, 2, 3, None]), rng.choice([None, 0.1, 0.25, 0.5, 0.9]), rng.random(), rng.random() < 0.4) for i in range(n)]


SCHEMA = "idx bigint, run bigint, pred int, true int, score double, entropy double, positive boolean"


def test_metrics_equal_plain_versions(spark):
    rows = predictions(1)
    got = {(r["run"], r["metric"]): r["value"] for r in metrics.evaluated(spark.createDataFrame(rows, SCHEMA).repartition(5), ["kappa", "matthews", "auroc"], "run").collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    assert {g for g, _ in got} == set(by)
    for g, some in by.items():
        pairs = [(r[3], r[2]) for r in some if r[3] is not None]
        n, t, p = len(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
        po, pe = sum(a == b for a, b in pairs) / n, sum(t[k] * p[k] for k in t) / n / n
        assert got[g, "kappa"] == pytest.approx((po - pe) / (1 - pe))
        top = sum(sum((a == k) * (b == k) for a, b in pairs) / n - t[k] / n * p[k] / n for k in range(4))
        assert got[g, "matthews"] == pytest.approx(top / (sum(t[k] / n * (1 - t[k] / n) for k in t) * sum(p[k] / n * (1 - p[k] / n) for k in p)) ** 0.5)
        pos, neg = ([r[4] for r in some if r[4] is not None and r[6] is want] for want in (True, False))
        assert got[g, "auroc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))


def test_constant_empty_and_own_metrics(spark):
    rows = spark.createDataFrame([(1, 1, 2, 2, 0.5, 0.0, True), (2, 1, 2, 2, 0.5, 0.0, True)], SCHEMA)
    got = {r["metric"]: r["value"] for r in metrics.evaluated(rows, ["kappa", "matthews", "auroc"], "run").collect()}
    assert got == {"kappa": None, "matthews": 0.0, "auroc": None}
    assert metrics.evaluated(rows.limit(0), ["kappa", "auroc"], "run").collect() == []
    metrics.register("longest", metrics.Metric(("idx",), lambda c: len(c["idx"]), max, float))
    try:
        assert metrics.evaluated(rows.coalesce(1), ["longest"], "run").first()["value"] == 2.0
    finally:
        del metrics.METRICS["longest"]
    with pytest.raises(KeyError):
        metrics.evaluated(rows, ["nothing"], "run")


def test_contexts_name_their_collections(spark):
    rows = [(i, i % 3, i % 2, (i // 2) % 2, 0.0, i / 100, True) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("score", "s").selectExpr("*", "idx / 200D AS conf")
    got = defaultdict(list)
    for r in sorted(contexts.contexts(contexts.candidates(df)).collect(), key=lambda r: r["place"]):
        got[r["run"], r["collection"]].append(r["idx"])
        assert set(json.loads(r["payload"])) == {"pred", "true"}
    for run in range(3):
        own = [r for r in rows if r[1] == run]
        assert got[run, "high_entropy_samples"] == [r[0] for r in sorted(own, key=lambda r: (-r[5], r[0]))[:5]]
        assert got[run, "hard_negative_samples"] == [r[0] for r in sorted((r for r in own if r[2] != r[3]), key=lambda r: (-r[0], r[0]))[:5]]
        assert got[run, "few_shot_samples"] == [r[0] for k in (0, 1) for r in [r for r in own if r[3] == k][:2]]


class Reversed(contexts.SampleContext):
    def collections(self, run, rows):
        return {"mine": sorted(rows, key=lambda r: -r["idx"])[:2], "none": []}


def test_an_overridden_context_from_sql(spark):
    contexts.register(spark, "own_context", Reversed)
    spark.createDataFrame([(1, "a", 1, 10, None), (1, "b", 1, 30, "{}"), (1, "a", 2, 20, '{"x": 1}'), (2, "a", 1, 5, None)], contexts.CANDIDATE).createOrReplaceTempView("candidate_rows")
    got = spark.sql("SELECT run, collection, place, idx, payload FROM own_context(TABLE(candidate_rows) PARTITION BY run ORDER BY place)").collect()
    assert sorted(map(tuple, got)) == [(1, "mine", 1, 30, "{}"), (1, "mine", 2, 20, '{"x": 1}'), (2, "mine", 1, 5, "{}")]
