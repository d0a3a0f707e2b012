"""The generation cache: no second call, invalidation by version, appends, compaction, records."""

import pytest

from cinderloom.functions.scalars import canonical_label
from cinderloom.operators.generation import Cache, Key, evaluated


def counted(folder):
    """A model that leaves a file for each prompt that it sees."""

    def make():
        import uuid
        from pathlib import Path

        def say(prompts):
            for p in prompts:
                (Path(folder) / uuid.uuid4().hex).write_text(p)
            return [p.upper() for p in prompts]

        return say

    return make


@pytest.fixture()
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def seen(calls):
    return sorted(p.read_text() for p in calls.iterdir())


def test_cache(spark, tmp_path, calls):
    cache, model = Cache(spark, str(tmp_path / "cache")), counted(str(calls))
    rows = spark.createDataFrame([(1, "a", "A"), (2, "b", "x"), (3, "a", "A"), (4, None, "A"), (5, "e", "E")], "id int, prompt string, gold string")
    one = Key(1, "m", "validation")
    first = {r["id"]: (r["reply"], r["cached"]) for r in cache.replies(rows, "prompt", model, one, "id").collect()}
    assert first == {1: ("A", False), 2: ("B", False), 3: ("A", False), 4: (None, None), 5: ("E", False)} and seen(calls) == ["a", "b", "e"]
    again = cache.replies(rows, "prompt", model, one, "id").collect()
    assert all(r["cached"] for r in again if r["prompt"]) and seen(calls) == ["a", "b", "e"]
    # A row more is one call more; another version, model, split or limit knows nothing.
    more = rows.unionByName(spark.createDataFrame([(6, "f", "F")], rows.schema))
    told = {r["id"]: r["cached"] for r in cache.replies(more, "prompt", model, one, "id").collect()}
    assert told == {1: True, 2: True, 3: True, 4: None, 5: True, 6: False} and seen(calls) == ["a", "b", "e", "f"]
    assert cache.compact(one) == 2 and cache.compact(one) == 0 and len(cache._generations(one)) == 1
    assert cache.rows(one).count() == 4
    cache.replies(rows, "prompt", model, Key(2, "m", "validation"), "id").collect()
    assert seen(calls) == sorted(["a", "b", "e", "f", "a", "b", "e"])
    limited = cache.replies(rows, "prompt", model, Key(2, "m", "validation", 2), "id").collect()
    assert [r["id"] for r in sorted(limited, key=lambda r: r["id"])] == [1, 2] and len(seen(calls)) == 9
    cache.forget(one)
    assert cache.rows(one).count() == 0 and cache.rows(Key(2, "m", "validation")).count() == 3


def test_records_of_an_evaluation(spark):
    rows = spark.createDataFrame([(1, " Cash-Withdrawal.", "cash_withdrawal"), (2, "other", "cash_deposit"), (3, None, "x")], "id int, reply string, gold string")
    got = {r["id"]: (r["normalized_prediction"], r["prediction_is_valid_label"], r["exact_match"]) for r in evaluated(rows, "gold", canonical_label, ["cash_withdrawal", "cash_deposit"]).collect()}
    assert got == {1: ("cash_withdrawal", True, True), 2: ("other", False, False), 3: ("", False, False)}


def test_a_model_that_loses_replies_raises(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id int, prompt string")
    with pytest.raises(Exception, match="0 replies to 1 prompts"):
        Cache(spark, str(tmp_path / "c")).replies(rows, "prompt", lambda: lambda prompts: [], Key(1, "m", "s"), "id")
