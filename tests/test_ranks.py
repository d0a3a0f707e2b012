"""Distributed ranks against plain Python: nulls, hot groups, repeated rows, empty tables, plans without group windows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cinderloom.operators import ranks, selection


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    labels = ["hot"] * 4 + ["a", "b", None]
    return [(i, rng.choice(labels), rng.randrange(40), rng.choice([None, 1.5, 2.0])) for i in range(2000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, label string, k int, x double").repartition(7)


def test_places_in_groups(spark, rows):
    got = ranks.ranked(frame(spark, rows), ["label"], ["k", F.desc("id")], "at", "n").collect()
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    wanted = {r[0]: (i, len(v)) for v in by.values() for i, r in enumerate(sorted(v, key=lambda r: (r[2], -r[0])), 1)}
    assert {r["id"]: (r["at"], r["n"]) for r in got} == wanted and len(got) == len(rows)


def test_places_in_the_whole_table_and_by_two_keys(spark, rows):
    got = {r["id"]: r["place"] for r in ranks.ranked(frame(spark, rows), [], ["id"]).collect()}
    assert got == {r[0]: r[0] + 1 for r in rows}
    two = ranks.ranked(frame(spark, rows), ["label", "x"], ["id"]).collect()
    by = defaultdict(list)
    for r in rows:
        by[r[1], r[3]].append(r[0])
    assert {r["id"]: r["place"] for r in two} == {i: n for v in by.values() for n, i in enumerate(sorted(v), 1)}


def test_equal_rows_get_each_place_once_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", 1)], "label string, k int").selectExpr("*", "1 AS _n", "2 AS `odd.name`")
    got = ranks.ranked(df.withColumnRenamed("_n", "n"), ["label"], ["k"]).collect()
    assert Counter((r["label"], r["place"]) for r in got) == Counter([("a", i) for i in range(1, 6)] + [("b", 1)])


def test_empty(spark, rows):
    assert ranks.ranked(frame(spark, rows).limit(0), ["label"], ["id"]).collect() == []


def test_a_hot_group_spreads_over_ranges(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = frame(spark, rows).where("label = 'hot'").repartitionByRange("label", "k", "id")
        sizes = [r["count"] for r in laid.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_splits_are_exact_and_have_no_window(spark, rows):
    df = frame(spark, rows)
    split = selection.stratified_split(df, "label", 0.8, "k", "id")
    assert "Window" not in plan_of(split)
    counts = Counter((r["label"], r["split"]) for r in split.collect())
    for label, n in Counter(r[1] for r in rows).items():
        assert counts[label, "train"] == int(n * 0.8 + 0.5) and counts[label, "train"] + counts[label, "validation"] == n
    plain = selection.plain_split(df, 0.75, "k", "id")
    assert "Window" not in plan_of(plain)
    assert Counter(r["split"] for r in plain.collect()) == {"train": 1500, "validation": 500}
    assert Counter(r["split"] for r in selection.plain_split(df.limit(2), 0.999, "id").collect()) == {"train": 1, "validation": 1}
    with pytest.raises(Exception, match="two rows"):
        selection.plain_split(df.limit(1), 0.5, "id").collect()


def test_sample_keeps_shares_and_null_labels(spark, rows):
    got = Counter(r["label"] for r in selection.stratified_sample(frame(spark, rows), "label", 100, "k", "id").collect())
    counts = Counter(r[1] for r in rows)
    assert sum(got.values()) == 100
    assert all(abs(got[k] - 100 * n / 2000) < 1 for k, n in counts.items())
    assert "Window" not in plan_of(selection.stratified_sample(frame(spark, rows), "label", 100, "k", "id"))


@pytest.mark.parametrize("k", [0, 1, 3, 4, 5, 50, 5000])
def test_cover_then_fill(spark, rows, k):
    df = selection.cover_then_fill(frame(spark, rows), "label", "id", k)
    assert "Window" not in plan_of(df)
    first = {}
    for r in rows:
        first.setdefault(r[1], r[0])
    lead = sorted(first.items(), key=lambda x: (x[0] is not None, x[0] or ""))
    rest = [r[0] for r in rows if r[0] not in first.values()]
    wanted = ([i for _, i in lead] + rest)[:k]
    assert [r["id"] for r in df.collect()] == wanted


def test_best_of_each_group(spark, rows):
    df = selection.best_per_group(frame(spark, rows), "label", "x", "id")
    assert "Window" not in plan_of(df)
    kept = {r["label"]: r["id"] for r in df.collect() if r["keep"]}
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    assert kept == {k: min(v, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))[0] for k, v in by.items()}
