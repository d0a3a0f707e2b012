"""Flattened documents against plain recursion; fingerprints, differences, same-count reconciliation."""

import json

import pytest

from cinderloom.operators import documents
from cinderloom.plans import same_count

TEXTS = {
    1: '{"a": {"b": [1, "x", null, true, 2.5, {"c": []}]}, "d": {}, "e": "ü"}', 2: "[[], [1, [2]], {}]", 3: "5", 4: '"text"', 5: "null", 6: "{broken", 7: None, 8: "", 9: '{"e": "ü", "d": {}, "a": {"b": [1, "x", null, true, 2.5, {"c": []}]}}', None: '{"k": 1}',
}


def plain(x, path="$"):
    if isinstance(x, dict) and x:
        return [r for k, v in x.items() for r in plain(v, f"{path}.{k}")]
    if isinstance(x, list) and x:
        return [r for i, v in enumerate(x) for r in plain(v, f"{path}[{i}]")]
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number")
    return [(path, kind, json.dumps(x, ensure_ascii=False))]


@pytest.fixture(scope="module")
def flat(spark):
    rows = spark.createDataFrame(list(TEXTS.items()), "k int, t string").selectExpr("*", "'x' AS path", "1 AS value")
    return documents.flattened(rows, ["k"], "t")


def test_flattened(flat):
    wanted = []
    for k, t in TEXTS.items():
        try:
            wanted += [(k, *r) for r in plain(json.loads(t))]
        except (TypeError, ValueError):
            pass
    assert sorted(map(tuple, flat.collect()), key=repr) == sorted(wanted, key=repr)


def test_fingerprints_forget_key_order_and_volatile_keys(flat):
    got = {r["k"]: r["sha256"] for r in documents.fingerprints(flat, ["k"]).collect()}
    assert got[1] == got[9] and len({got[k] for k in (1, 2, 3, 4, 5)}) == 5 and 6 not in got
    less = {r["k"]: r["sha256"] for r in documents.fingerprints(flat, ["k"], ["a"]).collect()}
    assert less[1] == less[9] != got[1]


def test_differences(spark):
    make = lambda rows: documents.flattened(spark.createDataFrame(rows, "k int, t string"), ["k"], "t")
    left, right = make([(1, '{"a": [1, 2], "b": "x"}'), (2, '{"a": 1}')]), make([(1, '{"a": [1, 3, 4], "b": "x"}'), (3, "7")])
    assert sorted(map(tuple, documents.differences(left, right, ["k"]).collect())) == [(1, "$.a[1]", "2", "3", "changed"), (1, "$.a[2]", None, "4", "absent_left"), (2, "$.a", "1", None, "absent_right"), (3, "$", None, "7", "absent_left")]


def test_empty(spark):
    none = documents.flattened(spark.createDataFrame([], "k int, t string"), ["k"], "t")
    assert none.collect() == [] and documents.fingerprints(none, ["k"]).collect() == []


def test_same_count_runs(spark):
    run = "dataset string, seed int, run_id int, experiment string, policy string, action_space string, synthetic_count int, config string"
    config = lambda name, splits: json.dumps({"name": name, "trainer_config": {"budget_splits": splits}})
    sources = spark.createDataFrame([("d", None, 1, "s", "src", "A", 3, config("s", [])), ("e", 1, 2, "s", "src", "A", 5, config("s", [])), ("f", 1, 3, "s", "src", "A", 5, config("s", [])), ("g", 1, 4, "s", "src", "A", 5, "{}")], run)
    controls = spark.createDataFrame([("d", None, 11, "c", "fixed", "A", 3, config("c", [])), ("e", 1, 12, "other", "else", "", 4, config("c", ["train"])), ("f", 1, 13, "c", "fixed", "A", 5, config("c", [])), ("f", 1, 14, "c", "fixed", "A", 5, config("c", [])), ("z", 9, 15, "c", "fixed", "A", 5, "{}")], run)
    planned = spark.createDataFrame([(d, s, "c", "fixed", n) for d, s, n in (("d", None, 3), ("e", 1, 5), ("f", 1, 5), ("g", 1, 5))], "dataset string, seed int, control_name string, control_policy string, synthetic_record_budget int")
    got = same_count.reconcile_runs(planned, controls, sources, ["dataset", "seed"], ["name"])
    assert sorted((r["dataset"], r["run_id"] or 0, r["problem"]) for r in got.collect()) == [
        ("e", 12, "action_space_mismatch"), ("e", 12, "config_mismatch"), ("e", 12, "count_mismatch"), ("e", 12, "name_mismatch"), ("e", 12, "policy_mismatch"), ("f", 13, "duplicate_control"), ("g", 0, "missing"), ("z", 15, "unplanned"),
    ]
