"""Leased teacher calls against the one-by-one rule; retries, outcomes, bounded concurrency."""

import asyncio
import random

import pytest
from pyspark.sql import functions as F

from cinderloom.operators import ranks, teaching

SCHEMA = "id bigint, prompt string, bound bigint"


def reply_of(prompt):
    """A fixed teacher: its reply and real tokens follow from the prompt."""
    kind, bound = prompt.split(":")[1:3]
    n = sum(map(ord, prompt)) % (int(bound) + 1)
    if kind == "fail":
        raise RuntimeError("down")
    if kind == "over":
        return teaching.Reply("yes", 1, 1, int(bound) + 5)
    if kind == "empty":
        return teaching.Reply("", 1, 0, n)
    if kind == "quiet":
        return teaching.Reply("yes")
    return teaching.Reply("no" if kind == "no" else "yes", n, 0, n)


def teacher():
    async def call(prompt):
        await asyncio.sleep(0)
        return reply_of(prompt)

    return call


def one_by_one(rows, budget, target):
    spent, accepted, log = 0, [], []
    for i, prompt, bound in sorted(rows):
        if target is not None and len(accepted) >= target:
            return spent, accepted, log, "target"
        if budget is not None and spent + bound > budget:
            return spent, accepted, [*log, (i, "masked", 0)], "budget"
        try:
            r = reply_of(prompt)
        except RuntimeError:
            r = None
        paid = bound if r is None or r.total_tokens is None else r.total_tokens
        status = "failed" if r is None else "budget_violation" if paid > bound else "empty_response" if not r.text else "success"
        spent += paid
        log.append((i, status, paid))
        if status == "budget_violation":
            return spent, accepted, log, "violation"
        if r is not None and r.text == "yes":
            accepted.append(i)
    return spent, accepted, log, "target" if target is not None and len(accepted) >= target else "rows"


def made(seed, n=120, kinds=("yes", "yes", "no", "empty", "fail", "quiet")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bound = rng.choice([0, 5, 20, 50])
        out.append((i, f"{i}:{rng.choice(kinds)}:{bound}", bound))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "budget", "target"), [(1, None, None), (2, 700, None), (5, 900, 12), (6, 0, None)])
def test_equals_the_one_by_one_rule(spark, seed, budget, target):
    rows = made(seed)
    got = teaching.taught(spark.createDataFrame(rows, SCHEMA), ["id"], "prompt", "bound", teacher, budget, target, F.col("reply") == "yes", tries=2, pause=0.0)
    spent, accepted, log, cause = one_by_one(rows, budget, target)
    assert (got.spent, got.accepted, got.stop_cause) == (spent, len(accepted), cause)
    told = {r["id"]: r for r in got.attempts.collect()}
    assert sorted((i, r["status"], r["ledger"]) for i, r in told.items()) == sorted(log)
    assert sorted(r["id"] for r in got.records.collect()) == accepted
    assert budget is None or got.spent <= budget
    left = budget
    for i, _, paid in log:
        if budget is not None:
            assert told[i]["before"] == left and told[i]["after"] == left - paid
            left -= paid
    assert got.rounds < 15 or target is not None


def test_a_broken_bound_stops_it_there(spark):
    rows = made(8, 40, ("yes", "no")) + [(100, "100:over:20", 20), (101, "101:yes:5", 5)]
    got = teaching.taught(spark.createDataFrame(rows, SCHEMA), ["id"], "prompt", "bound", teacher, None, None, F.col("reply") == "yes")
    _, accepted, _, cause = one_by_one(rows, None, None)
    assert got.stop_cause == cause == "violation" and sorted(r["id"] for r in got.records.collect()) == accepted
    assert got.attempts.where("status = 'budget_violation'").count() == 1


def test_empty_and_rows_without_prompts(spark):
    none = teaching.taught(spark.createDataFrame([], SCHEMA), ["id"], "prompt", "bound", teacher, 10)
    assert (none.spent, none.stop_cause, none.attempts.count()) == (0, "rows", 0)
    got = teaching.taught(spark.createDataFrame([(1, None, 4), (2, "2:yes:5", None)], SCHEMA), ["id"], "prompt", "bound", teacher, 10)
    assert {r["id"]: (r["status"], r["error"]) for r in got.attempts.collect()} == {1: ("failed", "no prompt"), 2: ("budget_violation", None)}


def test_retries_and_bounded_concurrency(spark):
    def flaky():
        state = {"open": 0, "most": 0, "failed": set()}

        async def call(prompt):
            state["open"] += 1
            state["most"] = max(state["most"], state["open"])
            await asyncio.sleep(0.001)
            state["open"] -= 1
            if prompt not in state["failed"] and hash(prompt) % 2:
                state["failed"].add(prompt)
                raise OSError("once")
            return teaching.Reply(str(state["most"]), total_tokens=1)

        return call

    rows = spark.createDataFrame([(i, f"p{i}", 1) for i in range(60)], SCHEMA).coalesce(1)
    got = teaching.called(rows, "prompt", flaky, concurrency=4, tries=2, pause=0.0).collect()
    assert max(int(r["reply"]) for r in got) <= 4 and {r["tries"] for r in got} <= {1, 2} and all(r["error"] is None for r in got)
    with pytest.raises(ValueError):
        teaching.called(rows, "prompt", flaky, concurrency=0)


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 3, -1, 10**12])) for i in range(500)]
    got = {r["i"]: (r["place"], r["total"]) for r in ranks.running_total(spark.createDataFrame(rows, "i bigint, v bigint").repartition(9), ["i"], "v").collect()}
    total = 0
    for i, v in rows:
        total += v or 0
        assert got[i] == (i + 1, total)


def test_the_loop_admits_and_stops_at_a_broken_bound(spark, tmp_path, monkeypatch):
    from cinderloom.operators import config, loop, policy
    from cinderloom.operators.students import HashedLogistic

    rows = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad poor'} text {i % 7}", i % 2) for i in range(40)], "id long, text string, class_id int")
    calls = []

    def teacher(wrong, n):
        calls.append(n)
        return spark.createDataFrame([(1000 + i, "good fine words", 1) for i in range(n)], "id long, text string, class_id int"), 10**9

    c = config.from_dict({"name": "over", "cycles": 3, "token_budget": 100_000, "policy_name": "fixed_repair"})
    out = loop.run(c, rows, rows, HashedLogistic(64, 2), teacher, str(tmp_path))
    assert out.stop_cause == "budget_violation" and [a["status"] for a in out.attempts] == ["budget_violation"] and not (tmp_path / "over").exists()
    monkeypatch.setattr(policy, "chosen", lambda state, name: state.selectExpr("'repair:cheap:b16' AS action", "1e9 AS cost"))
    out = loop.run(c, rows, rows, HashedLogistic(64, 2), teacher, str(tmp_path))
    assert [(a["status"], a["ledger"]) for a in out.attempts] == [("masked", 0), ("masked", 0)] and len(calls) == 1
