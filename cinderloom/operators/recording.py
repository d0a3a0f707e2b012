"""What a run leaves behind so that its origin can be audited: the reproducibility sections, the run folder, label artifacts.

The sections hold what ``provenance.audit`` asks for. They are small documents of the driver;
training rows and seed records never pass through here (``sources.record_sink`` writes those).
"""

from __future__ import annotations

import json
import os
import platform
import subprocess
from dataclasses import asdict
from datetime import UTC, datetime
from hashlib import sha256
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderloom.functions.scalars import canonical_label
from cinderloom.operators.config import Experiment, data_files
from cinderloom.operators.loop import Outcome
from cinderloom.operators.provenance import SCHEMA_VERSION

#: The files whose digests stand for the environment's exact packages.
LOCKFILES = ("pyproject.toml", "uv.lock")
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def git_state(folder: str | Path) -> dict:
    """Head and cleanness of the source tree that a folder lies in; nulls outside of one."""

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", str(folder), *args], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    changes = git("status", "--porcelain")
    return {"root": git("rev-parse", "--show-toplevel"), "head_sha": git("rev-parse", "HEAD"), "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "is_dirty": None if changes is None else changes != ""}


def _versions() -> dict[str, str]:
    out = {}
    for name in PACKAGES:
        try:
            out[name] = version(name)
        except PackageNotFoundError:
            pass
    return out


def config_digest(text: str) -> str | None:
    """Digest of a YAML document's values as JSON with sorted keys, as the audit computes it from the file."""
    import yaml

    values = yaml.safe_load(text)
    return sha256(json.dumps(values, sort_keys=True).encode()).hexdigest() if values else None


def reproducibility(config: Experiment, config_text: str, package: str | Path, workspace: str | Path | None = None) -> dict:
    """The sections of a manifest: source control, runtime, hardware, configuration, data set and models."""
    locks = {n: sha256((Path(package) / n).read_bytes()).hexdigest() for n in LOCKFILES if (Path(package) / n).is_file()}
    return {
        "created_at": datetime.now(UTC).isoformat(),
        "source_control": {"package": git_state(package), "workspace": git_state(workspace or package)},
        "runtime": {"python": platform.python_version(), "implementation": platform.python_implementation(), "platform": platform.platform(), "packages": _versions(), "lockfiles": locks},
        "hardware": {"cpu_count": os.cpu_count(), "machine": platform.machine()},
        "config_provenance": {"run_copy_sha256": sha256(config_text.encode()).hexdigest(), "config_hash": config_digest(config_text)},
        "dataset_source": {"dataset": config.dataset, "load_kwargs": config.dataset_kwargs, "data_files": data_files(config)},
        "models": {"student": {"name": config.student, "type": config.student_type}, "teacher": {"name": config.teacher}},
    }


def config_text(config: Experiment) -> str:
    """The experiment as the YAML file that its run folder keeps."""
    import yaml

    return yaml.safe_dump(json.loads(json.dumps(asdict(config))), sort_keys=True)


def usage_of(out: Outcome, config: Experiment, seed_tokens: dict[str, int] | None = None) -> dict:
    """The token ledger of an outcome: by cycle, by operation and in total; seed_tokens are input, output and total of bought seed data."""
    kinds = ("input_tokens", "output_tokens", "total_tokens")
    seed = {k: int((seed_tokens or {}).get(k, 0)) for k in kinds}
    cycles: dict[int, int] = {}
    for a in out.attempts:
        cycles[a["cycle"]] = cycles.get(a["cycle"], 0) + int(a["ledger"] or 0)
    online = sum(cycles.values())
    bought = {"sft_data": seed} if seed["total_tokens"] else {}
    return {
        "experiment_name": config.name,
        "per_cycle": [{"cycle": c, "cycle_total": {"total_tokens": n}} for c, n in sorted(cycles.items())],
        "totals": {"augmentation": {"total_tokens": online}} | bought,
        "grand_total": {k: seed[k] + (online if k == "total_tokens" else 0) for k in kinds},
    }


def _replaced(path: Path, text: str) -> None:
    """A file that readers see whole or not at all."""
    part = path.with_name(f".{path.name}.part")
    part.write_text(text, encoding="utf-8")
    part.replace(path)


def record(out: Outcome, config: Experiment, folder: str | Path, package: str | Path, workspace: str | Path | None = None, status: str = "completed", error: str | None = None, seed_tokens: dict[str, int] | None = None) -> Path:
    """Write a run's folder: configuration, metrics, ledger, logs and, last, the manifest that makes it a run."""
    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    if (place / "run_manifest.json").exists():
        raise FileExistsError(f"a run is recorded there already: {place}")
    text = config_text(config)
    _replaced(place / "experiment_config.yaml", text)
    _replaced(place / "metrics.json", json.dumps({str(c): m for c, m in sorted(out.metrics.items())}))
    _replaced(place / "token_usage.json", json.dumps(usage_of(out, config, seed_tokens)))
    run_id = f"{config.name}-{config_digest(text)[:12]}"
    _replaced(place / "policy_decisions.jsonl", "".join(json.dumps({"run_id": run_id, "decision_id": d["decision_id"], "cycle": d["cycle"], "policy_name": config.policy_name, "action_name": d["action"]}) + "\n" for d in out.decisions))
    log = [
        {
            "run_id": run_id, "attempt_id": a["attempt_id"], "decision_id": a["decision_id"], "cycle": a["cycle"], "status": a["status"], "predicted_cost": {"total_tokens": a["predicted"], "allowed": a["status"] != "masked"},
            "ledger_debit_cost": {"total_tokens": a["ledger"]}, "budget_before": {"tokens_remaining": a["before"]}, "budget_after": {"tokens_remaining": a["after"]},
        }
        for a in out.attempts
    ]
    _replaced(place / "teacher_attempts.jsonl", "".join(json.dumps(x) + "\n" for x in log))
    manifest = {
        "schema_version": SCHEMA_VERSION, "run_id": run_id, "experiment": config.name, "status": status, "error": error, "stop_cause": out.stop_cause, "policy_name": config.policy_name, "seed": config.seed, "token_budget": config.token_budget,
        "dataset": config.dataset, "student_model": config.student, "student_type": config.student_type, "cycles_completed": len(out.metrics), "expected_cycles": config.cycles, "config_hash": config_digest(text), "reproducibility": reproducibility(config, text, package, workspace),
    }
    _replaced(place / "run_manifest.json", json.dumps(manifest, sort_keys=True, indent=2))
    return place


def canonical_labels(configured: list[str] | None = None, rows: DataFrame | None = None, field: str | None = None, class_names: list[str] | None = None) -> dict:
    """The label artifact: configured labels in their order, else the distinct values of a field in text order, else the data set's class names.

    A label set is as large as the number of classes; a field is reduced to its distinct values before they come to the driver.
    """
    if configured:
        labels, source = list(dict.fromkeys(configured)), "configured"
    elif rows is not None and field:
        told = rows.select(F.trim(F.col(field).cast("string")).alias("l")).where("l <> ''").distinct().orderBy("l")
        labels, source = [r["l"] for r in told.collect()], f"dataset field {field}"
    elif class_names:
        labels, source = list(class_names), "class names"
    else:
        raise ValueError("labels need a configuration, a field or class names")
    return {"source": source, "canonical_label_count": len(labels), "canonical_labels": labels}


def with_normalised(spark, artifact: dict) -> dict:
    """The artifact with each label in its compared form."""
    rows = spark.createDataFrame(list(enumerate(artifact["canonical_labels"])), "i int, l string")
    return artifact | {"normalized_canonical_labels": [r[0] for r in rows.orderBy("i").select(canonical_label(F.col("l"))).collect()]}
