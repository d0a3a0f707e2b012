"""Commands: analyze, certificates, provenance, gate, pilot-gate, fixed-scorer-gate, plan-same-count-controls, policy-smoke and query."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    return SparkSession.builder.appName("cinderloom").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def analyze(args) -> int:
    from cinderloom.operators.run_summary import summarize
    from cinderloom.sources.sinks import write_csv

    rows = summarize(session(), *args.paths, metric=args.metric, mode=args.mode)
    if rows.isEmpty():
        print("no runs found", file=sys.stderr)
        return 1
    if args.output:
        write_csv(rows, args.output, rows.columns)
    else:
        rows.show(truncate=False)
    return 0


def certificates(args) -> int:
    from cinderloom.operators.ledger import budget_certificate
    from cinderloom.sources import artifacts

    found = artifacts.files(session(), *args.paths)
    budgets = artifacts.contexts(found).select(F.col("dir").alias("run_id"), F.col("token_budget").alias("budget"))
    rows = budget_certificate(artifacts.attempts(found), budgets)
    rows.show(truncate=False)
    return int(not rows.where("not certificate_passed").isEmpty())


def provenance(args) -> int:
    """The provenance audit and the tokens of seed data; exit 1 if a run fails the audit."""
    from cinderloom.operators import provenance as origin
    from cinderloom.sources import artifacts

    spark = session()
    every = artifacts.files(spark, *args.paths)
    found = every.join(artifacts.run_dirs(every), "dir")
    seeds = origin.seed_files(found, origin.materialized(spark, *(args.data or args.paths)))
    rows = origin.audit(found, seeds)
    rows.join(origin.seed_tokens(found, seeds).drop("manifests"), "dir", "left").show(truncate=False)
    return int(not rows.where("not passed").isEmpty())


def gate(args) -> int:
    """The run-level checks; exit 1 if one fails."""
    from cinderloom.operators import gates
    from cinderloom.operators.ledger import budget_certificate
    from cinderloom.operators.run_summary import summarize
    from cinderloom.sources import artifacts

    spark = session()
    runs = summarize(spark, *args.paths, strict=False)
    found = artifacts.files(spark, *args.paths)
    tries = artifacts.attempts(found)
    certificate = budget_certificate(tries, artifacts.contexts(found).select(F.col("dir").alias("run_id"), F.col("token_budget").alias("budget")))
    report = gates.report({
        "runs_present": gates.empty(runs), "runs_completed": gates.not_completed(artifacts.contexts(found)), "paper_mode_enabled": gates.not_paper_mode(runs), "paper_cycle_bounds": gates.cycles_out_of_bounds(runs),
        "heldout_test_metrics_present": gates.heldout_missing(runs), "provider_reported_usage_present": gates.unreported(tries), "budget_feasibility_certificate": gates.failed_certificates(certificate),
    }).collect()
    print(json.dumps([r.asDict() for r in report], indent=2))
    return int(not all(r.passed for r in report))


def _told(report) -> int:
    """Print a gate's checks; exit 1 if one fails."""
    rows = report.collect()
    print(json.dumps({"passed": all(r.passed for r in rows), "checks": [r.asDict() for r in rows]}, indent=2))
    return int(not all(r.passed for r in rows))


def _list(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def _required(args, *names: str) -> set[str]:
    return {n for n in names if getattr(args, f"require_{n}")}


def pilot_gate(args) -> int:
    """All checks of a pilot's run folders."""
    from cinderloom.plans import gate_inputs

    rate = {m: getattr(args, f"min_{m}_win_rate") for m in ("auc", "heldout", "final")}
    required = _required(args, "teacher_attempts", "frontier", "heldout", "labels", "paper_mode", "provider_usage", "same_count", "plan")
    return _told(gate_inputs.pilot_gate(
        session(), *args.paths, metric=args.metric, mode=args.mode, policies=_list(args.policies), seeds=_list(args.seeds), budgets=_list(args.budgets), required=required, source_policy=args.source_policy, plan_path=args.plan,
        control_policy=args.control_policy, success_policy=args.success_policy, baselines=_list(args.baselines), min_win_rate={m: r for m, r in rate.items() if r is not None},
    ))


def fixed_scorer_gate(args) -> int:
    """All checks of the fixed-scorer control runs."""
    from cinderloom.plans import gate_inputs

    return _told(gate_inputs.fixed_scorer_gate(session(), *args.paths, controls=_list(args.controls), seeds=_list(args.seeds), budgets=_list(args.budgets), metric=args.metric, mode=args.mode, required=_required(args, "heldout", "paper_mode", "provider_usage")))


def plan_controls(args) -> int:
    from cinderloom.plans import gate_inputs

    made = gate_inputs.plan_same_count(session(), *args.paths, output=args.output, source_policy=args.source_policy, control_policies=_list(args.control_policies), metric=args.metric, mode=args.mode, base_output_dir=args.base_output_dir)
    print(f"{len(made)} control configurations in {args.output}")
    return int(not made)


def policy_smoke(args) -> int:
    """One choice of a policy on a fixed state."""
    from cinderloom.operators import policy

    state = session().createDataFrame([(0, 1, 4, 1000.0, 250.0, 0.4, 0.5, 0.2, 0.3, 0.1, 0.25)], "state_id int, cycle int, cycles int, budget double, remaining double, error double, entropy double, hard double, confusion double, synthetic_ratio double, remaining_frac double")
    policy.chosen(state, args.policy).show(truncate=False)
    return 0


def run_query(args) -> int:
    from cinderloom.plans.catalogue import QUERIES

    QUERIES[args.name](session(), args.sf_dir).show(args.rows, truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cinderloom")
    sub = p.add_subparsers(required=True)
    a = sub.add_parser("analyze")
    a.add_argument("paths", nargs="+")
    a.add_argument("--metric")
    a.add_argument("--mode", default="auto", choices=["auto", "min", "max"])
    a.add_argument("--output")
    a.set_defaults(run=analyze)
    for name, f in (("certificates", certificates), ("gate", gate)):
        c = sub.add_parser(name)
        c.add_argument("paths", nargs="+")
        c.set_defaults(run=f)
    def add_gate(name: str, f, on: tuple[str, ...], off: tuple[str, ...]):
        g = sub.add_parser(name)
        g.add_argument("paths", nargs="+")
        g.add_argument("--metric")
        g.add_argument("--mode", default="auto", choices=["auto", "min", "max"])
        for what in ("seeds", "budgets"):
            g.add_argument(f"--{what}", help="expected values, with commas between them")
        for what in (*on, *off):
            g.add_argument(f"--require-{what.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=what in on)
        g.set_defaults(run=f)
        return g

    g = add_gate("pilot-gate", pilot_gate, ("teacher_attempts", "frontier"), ("heldout", "labels", "paper_mode", "provider_usage", "same_count", "plan"))
    for what in ("policies", "plan", "source-policy", "control-policy", "success-policy", "baselines"):
        g.add_argument(f"--{what}")
    for m in ("auc", "heldout", "final"):
        g.add_argument(f"--min-{m}-win-rate", type=float)
    g = add_gate("fixed-scorer-gate", fixed_scorer_gate, ("heldout", "paper_mode", "provider_usage"), ())
    g.add_argument("--controls", required=True)
    c = sub.add_parser("plan-same-count-controls")
    c.add_argument("paths", nargs="+")
    c.add_argument("--metric")
    c.add_argument("--mode", default="auto", choices=["auto", "min", "max"])
    c.add_argument("--output", required=True)
    c.add_argument("--source-policy", required=True)
    c.add_argument("--control-policies", required=True, help="in order of preference where they tie")
    c.add_argument("--base-output-dir")
    c.set_defaults(run=plan_controls)
    o = sub.add_parser("provenance")
    o.add_argument("paths", nargs="+")
    o.add_argument("--data", nargs="*", help="folders of data files and their manifests, if not below the runs")
    o.set_defaults(run=provenance)
    s = sub.add_parser("policy-smoke")
    s.add_argument("--policy", default="linear")
    s.set_defaults(run=policy_smoke)
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("sf_dir")
    q.add_argument("--rows", type=int, default=20)
    q.set_defaults(run=run_query)
    args = p.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
