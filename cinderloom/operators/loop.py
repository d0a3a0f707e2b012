"""The acquisition loop over immutable DataFrames, with students and teachers as plug-ins.

The driver holds decisions and totals only; rows stay distributed. Each cycle's training rows
are written as a snapshot below ``workdir`` (a folder that all executors share), so lineage ends
there and a lost executor costs at most one cycle.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.operators import policy
from cinderloom.operators.config import EarlyStopping, Experiment
from cinderloom.operators.materialize import union_synthetic


class Student(Protocol):
    """A model plug-in: trains on rows and tells predictions (idx, pred, true, conf, entropy) for rows."""

    def train(self, rows: DataFrame) -> Any: ...

    def predict(self, model: Any, rows: DataFrame) -> DataFrame: ...

    def evaluate(self, model: Any, rows: DataFrame) -> dict[str, float]: ...


#: A teacher plug-in: from misclassified or uncertain rows and a number to new rows and the tokens they cost.
Teacher = Callable[[DataFrame, int], tuple[DataFrame, int]]
STUDENTS: dict[str, Callable[[], Student]] = {}


def register_student(name: str):
    def add(factory):
        STUDENTS[name] = factory
        return factory

    return add


def attempt_outcome(budget: Column, predicted: Column, allowed: Column, reply: Column, accepted: Column, reported: Column) -> Column:
    """status, ledger (tokens debited) and source of a teacher attempt, as a function of its row.

    Not sent: masked if the prediction is over the budget, else a budget violation if it was barred.
    Sent: success with accepted records, empty_response without, failed without a reply. The
    ledger takes what the provider reports, or the reserved bound if it reports nothing.
    """
    over = budget.isNotNull() & (predicted > budget)
    status = F.when(over, "masked").when(~F.coalesce(allowed, F.lit(True)), "budget_violation").when(reply.isNull(), "failed").when(F.coalesce(accepted, F.lit(0)) == 0, "empty_response").otherwise("success")
    idle = status.isin("masked", "budget_violation")
    source = F.when(idle, "zero_no_dispatch").when(reported.isNotNull(), "provider_reported").otherwise("reserved_bound")
    return F.struct(status.alias("status"), F.when(idle, 0.0).otherwise(F.coalesce(reported, predicted).cast("double")).alias("ledger"), source.alias("source"))


@dataclass
class Stopper:
    """Early stopping with hysteresis: the best moves only beyond min_delta."""

    config: EarlyStopping
    best: float | None = None
    best_cycle: int | None = None
    waited: int = 0

    def stops(self, metrics: dict[str, float], cycle: int) -> bool:
        if not self.config.enabled or self.config.metric not in metrics:
            return False
        value, sign = metrics[self.config.metric], -1 if self.config.mode == "min" else 1
        if self.best is None or sign * value > sign * self.best + self.config.min_delta:
            self.best, self.best_cycle, self.waited = value, cycle, 0
        else:
            self.waited += 1
        return self.waited >= self.config.patience


@dataclass
class Outcome:
    metrics: dict[int, dict[str, float]] = field(default_factory=dict)
    decisions: list[dict] = field(default_factory=list)
    attempts: list[dict] = field(default_factory=list)
    stop_cause: str = "cycles"
    spent: int = 0

    def rows(self, spark, what: str) -> DataFrame:
        """decisions or attempts as a DataFrame."""
        return spark.read.json(spark.sparkContext.parallelize([json.dumps(x, sort_keys=True) for x in getattr(self, what)], 1))


def run(config: Experiment, train: DataFrame, evaluation: DataFrame, student: Student, teacher: Teacher, workdir: str) -> Outcome:
    """Train, evaluate, decide and acquire until the cycles end, early stopping or the budget stops it, or the policy stops."""
    spark, out, stopper = train.sparkSession, Outcome(), Stopper(config.early_stopping)
    rows = train
    for cycle in range(config.cycles):
        model = student.train(rows)
        metrics = out.metrics[cycle] = student.evaluate(model, evaluation)
        if stopper.stops(metrics, cycle):
            out.stop_cause = "early_stopping"
            break
        if cycle == config.cycles - 1:
            break
        remaining = None if config.token_budget is None else float(config.token_budget - out.spent)
        if config.budget_stop and remaining is not None and remaining <= 0:
            out.stop_cause = "budget"
            break
        error = 1 - metrics.get("accuracy", 1.0)
        state = spark.createDataFrame(
            [(0, cycle, config.cycles, config.token_budget and float(config.token_budget), remaining, error, metrics.get("entropy", 0.0), 0.0, 0.0, 0.0, 0.0)],
            "state_id int, cycle int, cycles int, budget double, remaining double, error double, entropy double, hard double, confusion double, synthetic_ratio double, remaining_frac double",
        )
        choice = policy.chosen(state, config.policy_name or "cost_heuristic").first()
        decision = f"{config.name}:c{cycle}:d{len(out.decisions)}"
        out.decisions.append({"decision_id": decision, "cycle": cycle, "action": choice.action, "cost": choice.cost})
        if choice.action == "STOP":
            out.stop_cause = "policy"
            break
        attempt = {"attempt_id": f"{config.name}:c{cycle}:a{len(out.attempts)}", "decision_id": decision, "cycle": cycle, "predicted": choice.cost, "before": remaining}
        if remaining is not None and choice.cost > remaining:
            # Admission: a call whose bound does not fit is not made, and costs nothing.
            out.attempts.append(attempt | {"status": "masked", "ledger": 0, "after": remaining})
            continue
        wrong = student.predict(model, rows).where("pred <> `true`")
        new, tokens = teacher(wrong, int(choice.action.rsplit("b", 1)[1]))
        status = "budget_violation" if tokens > choice.cost else "empty_response" if new.isEmpty() else "success"
        out.attempts.append(attempt | {"status": status, "ledger": tokens, "after": None if remaining is None else remaining - tokens})
        out.spent += tokens
        if status == "budget_violation":
            # What was spent is charged, but rows of a call that broke its bound are not taken.
            out.stop_cause = "budget_violation"
            break
        snapshot = f"{workdir.rstrip('/')}/{config.name}/dataset_cycle_{cycle + 1}"
        union_synthetic(rows, new).write.mode("overwrite").parquet(snapshot)
        rows = spark.read.parquet(snapshot)
    return out


def sweep(configs: list[Experiment], run_one: Callable[[Experiment], Outcome]) -> list[dict]:
    """Each configuration in turn; an error becomes a row, a budget stop ends the sweep."""
    out = []
    for c in configs:
        try:
            result = run_one(c)
        except Exception as e:  # noqa: BLE001 - a failed configuration is a result
            out.append({"name": c.name, "error": str(e)})
            continue
        out.append({"name": c.name, "stop_cause": result.stop_cause, "metrics": result.metrics, "spent": result.spent})
        if result.stop_cause == "budget":
            break
    return out
