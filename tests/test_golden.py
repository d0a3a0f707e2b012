"""Golden values of the reference behaviour."""

import json

import pytest
from pyspark.sql import functions as F

from cinderloom.functions import scalars as fn
from cinderloom.operators import comparison, ledger, materialize, policy, predictions, quality_cost, run_summary, selection, text_audit
from cinderloom.sources import artifacts, sinks


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(("horizon", "want"), [(5.0, 0.150), (10.0, 0.175), (0.0, None), (2.0, 0.1)])
def test_quality_cost_auc(spark, horizon, want):
    points = spark.createDataFrame([(1, 0.0, 0.1), (1, 5.0, 0.2)], "run_id int, x double, y double")
    got = one(quality_cost.quality_cost_auc(points, ["run_id"], "x", "y", F.lit(horizon))).auc
    assert got == (None if want is None else pytest.approx(want))


def test_early_stopping_hysteresis(spark):
    rows = spark.createDataFrame([(1, c, m) for c, m in enumerate([0.5, 0.504, 0.509, 0.51, 0.9])], "run_id int, cycle int, metric double")
    r = one(quality_cost.early_stopping(rows, "metric", patience=2, min_delta=0.01))
    assert (r.best_cycle, r.best_metric, r.stopped_cycle) == (0, 0.5, 2)


def test_near_duplicate_rates(spark):
    seeds = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon")], "id int, text string")
    new = spark.createDataFrame([(10, "Alpha, beta gamma!"), (11, "one two three"), (12, "three two one")], "id int, text string")
    assert one(text_audit.near_duplicate_rate(new, seeds, "id", "text")).rate == pytest.approx(2 / 3)
    assert one(text_audit.exact_duplicate_rate(spark.createDataFrame([(1, "a b"), (2, "A b."), (3, "c"), (4, "")], "id int, text string"), "text")).rate == 0.25
    assert text_audit.seed_duplicates(new, seeds, "text").count() == 1


def test_distribution_shift(spark):
    l = spark.createDataFrame([("alpha", 2), ("beta", 1)], "label string, n long")
    r = spark.createDataFrame([("beta", 2), ("gamma", 1)], "label string, n long")
    s = one(text_audit.distribution_shift(l, r))
    assert s.tvd == pytest.approx(2 / 3) and (s.max_count_delta, s.missing_labels, s.extra_labels) == (2, "alpha", "gamma")


def test_certificate_with_four_violations(spark):
    a = spark.createDataFrame([("r", "a1", 0, "success", 6.0, 7.0, 8.0, 6.0, -1.0)], "run_id string, attempt_id string, ord int, status string, predicted double, ledger double, provider double, before double, after double")
    r = one(ledger.budget_certificate(a, spark.createDataFrame([("r", 100.0)], "run_id string, budget double")))
    assert not r.certificate_passed and r.ledger_within_budget
    assert [r.over_preflight_ids, r.over_remaining_ids, r.provider_over_ledger_ids, r.negative_remaining_ids] == ["a1"] * 4 and r.remaining_mismatch_rows == 0
    assert r.failure_reasons == "ledger_exceeds_preflight,ledger_exceeds_remaining_budget,negative_remaining_budget,provider_exceeds_ledger"


def test_sign_test_and_bootstrap(spark):
    rows = spark.createDataFrame([(1, 0), (7, 2), (0, 0), (600, 500)], "w long, l long").select("w", comparison.sign_test_p(F.col("w"), F.col("l")).alias("p"))
    p = {r.w: r.p for r in rows.collect()}
    assert p[1] == pytest.approx(1.0) and p[7] == pytest.approx(0.1796875) and p[0] is None and 0.001 < p[600] < 0.01
    df = spark.createDataFrame([([0.3],), ([1.0, 2.0, 4.0],)], "d array<double>").select(comparison.bootstrap_exact(F.col("d")).alias("c"))
    first, second = df.collect()
    assert first.c.low == first.c.high == 0.3 and second.c.low == pytest.approx(1.0, abs=0.3) and second.c.high <= 4.0


def test_round_robin_and_cover(spark):
    labels = ["alpha"] * 4 + ["beta"] * 2 + ["gamma"] * 2 + ["delta"] * 2
    rows = spark.createDataFrame(list(enumerate(labels)), "id int, label string")
    assert sorted(r.id for r in selection.round_robin(rows, "label", "id", 4).collect()) == [0, 4, 6, 8]
    assert {r.id for r in selection.cover_then_fill(rows, "label", "id", 6).collect()} == {0, 4, 6, 8, 1, 2}
    shards = [{r.id for r in selection.shard(rows, "id", i, 3).collect()} for i in range(3)]
    assert set.union(*shards) == set(range(10)) and sum(map(len, shards)) == 10
    with pytest.raises(ValueError):
        selection.shard(rows, "id", 3, 3)


def test_generation_summary(spark):
    rows = spark.createDataFrame([("a", "a"), ("zzz", "b")], "pred string, true string")
    r = one(predictions.generation_summary(rows, ["a", "b", "c"]))
    assert (r.exact_match, r.invalid_label_rate, r.macro_f1) == (0.5, 0.5, 0.5) and r.macro_f1_full == pytest.approx(1 / 3)


STATE = "state_id int, cycle int, cycles int, budget double, remaining double, error double, entropy double, hard double, confusion double, synthetic_ratio double, remaining_frac double"


def test_policy_choices(spark):
    s = spark.createDataFrame([(1, 1, 4, 1000.0, 250.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (2, 0, 4, 1000.0, None, 0.4, 0.1, 0.9, 0.2, 0.1, 0.5), (3, 0, 4, 1000.0, 1e6, 0.4, 0.1, 0.9, 0.2, 0.1, 0.5)], STATE)
    assert s.select(policy.pace()["pace_ratio"].alias("p")).first().p == pytest.approx(8 / 3)
    pick = {r.state_id: r.action for r in policy.chosen(s, "fixed_boundary").collect()}
    assert pick == {1: "STOP", 2: "boundary:cheap:b16", 3: "boundary:cheap:b16"}
    assert {r.action for r in policy.chosen(s, "student_only").collect()} == {"STOP"}
    assert policy.chosen(s, "active_uncertainty").where("state_id = 3").first().action.startswith("boundary:cheap")
    cheap = F.create_map(F.lit("strong"), F.lit(10.0))
    assert policy.chosen(s, "strong_only", predicted=cheap).where("state_id = 1").first().cost == 10.0
    assert len(policy.action_space()) == 19
    with pytest.raises(ValueError):
        policy.chosen(s, "nobody")


def test_scalars(spark):
    df = spark.createDataFrame([(" Yes.Or,No ", "12 apples, 1,234.5 pears", 'x {"class_label": 3}', "the answer is (b)", [None, 0, 0, 1])], "a string, b string, c string, d string, w array<int>")
    r = df.select(
        fn.canonical_label(F.col("a")).alias("a"), fn.extract_number(F.col("b")).alias("b"), fn.label_from_reply(F.col("c"), 4).alias("c"), fn.label_from_reply(F.col("c"), 3).alias("c3"), fn.extract_choice(F.col("d")).alias("d"), fn.truthy(F.col("a")).alias("t"),
        fn.aligned_labels(F.col("w"), F.array(F.lit(7), F.lit(8))).alias("w"), fn.tokens_floor(F.lit(2)).alias("f"), fn.tokens_ceil(F.lit(4)).alias("e"), fn.lenient_long(F.lit("3.9")).alias("l"), fn.option_values(F.lit("a, ,b")).alias("o"), fn.looked_up(F.lit("q"), {"p": 1}, 0).alias("k"),
    ).first()
    assert (r.a, r.b, r.c, r.c3, r.d, r.t, r.w, r.f, r.e, r.l, r.o, r.k) == ("yes_or_no", "1234.5", 3, None, "B", False, [-100, 7, -100, 8], 1, 2, 3, ["a", "b"], 0)


def test_union_and_records(spark, tmp_path):
    train = spark.createDataFrame([(1, "t", 0.5, True)], "id int, text string, w double, ok boolean")
    both = materialize.union_synthetic(train, spark.createDataFrame([(2, "n", "x")], "id int, text string, other string"))
    assert [tuple(r) for r in both.orderBy("id").collect()] == [(1, "t", 0.5, True), (2, "n", 0.0, False)]
    assert materialize.ensure_origin_columns(train, "train").columns[-3:] == ["source_split", "source_idx", "origin_cycle"]
    with pytest.raises(KeyError):
        materialize.rendered("{missing}")
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "again")], "conv_id long, turn long, role string, text string")
    assert one(materialize.gold_records(turns)).gold_answer == "a"
    sinks.write_csv(train.limit(0), str(tmp_path / "empty"), ["id", "text", "w", "ok", "more"])
    assert next((tmp_path / "empty").glob("*.csv")).read_text().strip() == "id,text,w,ok,more"
    with pytest.raises(ValueError):
        sinks.write_csv(train, str(tmp_path / "x"), ["id"])


def make_run(path, run_id, status="completed", tokens=(0, 5), values=(0.1, 0.2), budget=10, seed=0):
    path.mkdir(parents=True)
    (path / "run_manifest.json").write_text(json.dumps({"run_id": run_id, "status": status, "policy_name": "p", "seed": 1, "token_budget": budget, "paper_mode": True}))
    (path / "experiment_config.yaml").write_text(f"name: e\ntoken_budget: {budget}\ndataset: d\n")
    metrics = {str(i): {"accuracy": v, "_teacher_tokens_at_eval": t} for i, (v, t) in enumerate(zip(values, tokens))}
    (path / "metrics.json").write_text(json.dumps(metrics | {"heldout_test": {"accuracy": 0.3, "_selection_split": "test"}}))
    (path / "token_usage.json").write_text(json.dumps({"per_cycle": [{"cycle": 0, "operations": {}, "cycle_total": {"total_tokens": 5}}], "totals": {"sft_data": {"total_tokens": seed}}, "grand_total": {"total_tokens": tokens[-1]}}))
    (path / "teacher_attempts.jsonl").write_text(json.dumps({"attempt_id": "a", "status": "success", "predicted_cost": {"total_tokens": 6}, "ledger_debit_cost": {"total_tokens": 5}, "provider_reported_cost": {"total_tokens": 5}, "budget_before": {"tokens_remaining": 10}, "budget_after": {"tokens_remaining": 5}}) + "\n\n")


def test_run_summary(spark, tmp_path):
    make_run(tmp_path / "r1", "one")
    make_run(tmp_path / "r1" / "nested", "inner")
    make_run(tmp_path / "r2", "two", tokens=(100, 110), budget=20, seed=100)
    (tmp_path / "r3").mkdir()
    (tmp_path / "r3" / "metrics.json").write_text("{}")
    rows = {r.run_id: r for r in run_summary.summarize(spark, str(tmp_path)).collect()}
    assert set(rows) == {"one", "two"}
    assert rows["one"].cycle_quality_cost_auc == pytest.approx(0.175) and rows["one"].heldout_metric == 0.3 and rows["one"].metric == "accuracy"
    assert rows["two"].online_acquisition_quality_cost_auc == pytest.approx(0.175) and rows["two"].total_teacher_quality_cost_auc == pytest.approx(0.1125)
    found = artifacts.files(spark, str(tmp_path / "r1"), str(tmp_path))
    certificates = ledger.budget_certificate(artifacts.attempts(found), artifacts.contexts(found).select(F.col("dir").alias("run_id"), F.col("token_budget").alias("budget")))
    assert all(r.certificate_passed for r in certificates.collect())
    make_run(tmp_path / "r4", "bad", status="failed")
    with pytest.raises(run_summary.NotCompleted):
        run_summary.summarize(spark, str(tmp_path))
    assert run_summary.summarize(spark, str(tmp_path), strict=False).count() == 2
