"""The stateful budget stream: disorder, replays, restarts and closed runs against the batch rule."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cinderloom.operators import ledger
from cinderloom.streaming import budget

SCHEMA = "run_id bigint, attempt_id bigint, ord bigint, tokens double, ts timestamp"
DAY = dt.datetime(2024, 1, 1)


def made(seed, n=240, runs=5):
    rng = random.Random(seed)
    rows = [(i % runs if i % 3 else 0, i, i, rng.choice([None, 0.0, 10.0, 25.0, 60.0]), DAY + dt.timedelta(minutes=i)) for i in range(n)]
    return rows, rng


def batch_rule(spark, rows, limit):
    df = spark.createDataFrame(sorted(set(rows), key=lambda r: r[1]), SCHEMA).withColumnRenamed("tokens", "ledger")
    return {r["run_id"]: (r["stop_at"], round(r["spent"], 6)) for r in ledger.budget_stop(df, F.lit(limit)).collect()}


def told(updates):
    return {r["run_id"]: (r["stop_at"], round(r["spent"], 6)) for r in updates.latest().collect()}


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_disorder_replays_and_restarts(spark, tmp_path, seed):
    rows, rng = made(seed)
    folder = str(tmp_path / "log")
    dealt = rows[:]
    rng.shuffle(dealt)
    parts = [dealt[i::3] for i in range(3)]
    updates = budget.Updates(spark)
    sent = []
    for k, part in enumerate(parts):
        again = rng.sample(sent, min(len(sent), 20)) + part[:5]  # attempts of earlier files, and of this one twice
        spark.createDataFrame(part + again, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        sent += part
        # A new query each time: it finds its state in the checkpoint.
        updates.run(budget.budget_stops(source(spark, folder), 400.0, lateness="30 days"))
        assert told(updates) == batch_rule(spark, sent, 400.0)
    updates.run(budget.budget_stops(source(spark, folder), 400.0, lateness="30 days"))
    assert told(updates) == batch_rule(spark, rows, 400.0)


def test_rows_without_ids_or_times(spark, tmp_path):
    folder = str(tmp_path / "log")
    spark.createDataFrame([(1, None, 1, 5.0, DAY), (1, 2, None, 5.0, DAY), (1, 3, 3, 7.0, None), (None, 4, 4, 9.0, DAY)], SCHEMA).coalesce(1).write.parquet(folder)
    updates = budget.Updates(spark)
    updates.run(budget.budget_stops(source(spark, folder), 8.0))
    got = told(updates)
    assert got[None] == (4, 9.0) and 1 not in got


def test_a_silent_run_is_closed_and_its_state_goes(spark, tmp_path):
    folder = str(tmp_path / "log")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    updates = budget.Updates(spark)
    go = lambda: updates.run(budget.budget_stops(source(spark, folder), 100.0, idle_ms=3_600_000, lateness="10 minutes"))
    put([(1, 1, 1, 60.0, DAY), (2, 2, 2, 10.0, DAY)])
    go()
    put([(2, 3, 3, 95.0, DAY + dt.timedelta(days=2))])
    go()
    put([(2, 4, 4, 1.0, DAY + dt.timedelta(days=2, minutes=1))])
    go()
    last = {r["run_id"]: r for r in updates.latest().collect()}
    assert last[1]["closed"] and last[1]["spent"] == 60.0 and last[1]["stop_at"] is None
    assert not last[2]["closed"]


TENTHS = [(run, 20 * run + i, i, 0.1, DAY + dt.timedelta(minutes=i)) for run in range(3) for i in range(12)]


def test_a_total_that_equals_the_budget_reaches_it(spark):
    # Ten tenths add up to less than 1 in doubles, whatever the order of rows.
    assert batch_rule(spark, TENTHS, 1.0) == {run: (9, 1.2) for run in range(3)}


def test_the_stream_reaches_such_a_budget_too(spark, tmp_path):
    folder = str(tmp_path / "log")
    spark.createDataFrame(TENTHS, SCHEMA).coalesce(1).write.parquet(folder)
    updates = budget.Updates(spark)
    updates.run(budget.budget_stops(source(spark, folder), 1.0))
    assert told(updates) == {run: (9, 1.2) for run in range(3)}
