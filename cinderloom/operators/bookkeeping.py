"""Manifests, ledgers and sweep summaries that a run leaves behind."""

from __future__ import annotations

import json
from hashlib import sha256
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderloom.functions.scalars import stable_json_sha256


def usage_document(usage: DataFrame, experiment: str) -> DataFrame:
    """One row, value: the token ledger as JSON, by cycle, by operation and in total. Ledgers have a row per cycle and operation."""
    sums = F.struct(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])
    per_cycle = usage.groupBy("cycle").agg(sums.alias("cycle_total")).agg(F.array_sort(F.collect_list(F.struct("cycle", "cycle_total"))).alias("per_cycle"))
    totals = usage.groupBy("operation").agg(sums.alias("u")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("operation", "u")))).alias("totals"))
    grand = usage.agg(sums.alias("grand_total"))
    # Three one-row aggregates side by side.
    return per_cycle.crossJoin(totals).crossJoin(grand).select(F.to_json(F.struct(F.lit(experiment).alias("experiment_name"), "per_cycle", "totals", "grand_total")).alias("value"))


def canonical_labels_document(labels: list[str], field: str) -> dict:
    seen = list(dict.fromkeys(x.strip() for x in labels if x and x.strip()))
    return {"field": field, "labels": seen, "sha256": stable_json_sha256(seen)}


def run_manifest(config: dict, status: str, error: str | None = None, artifact_dir: str | None = None, package: str = ".") -> dict:
    """What a run was made with, in the sections that the provenance audit reads, and the digests of the files beside it."""
    import yaml

    from cinderloom.operators import recording
    from cinderloom.operators.config import from_dict

    text = yaml.safe_dump(config, sort_keys=True)
    files = {p.name: sha256(p.read_bytes()).hexdigest() for p in sorted(Path(artifact_dir).iterdir()) if p.is_file()} if artifact_dir else {}
    return {
        "schema_version": recording.SCHEMA_VERSION, "status": status, "error": error, "config": config, "config_hash": recording.config_digest(text), "files": files,
        "reproducibility": recording.reproducibility(from_dict({"name": "run"} | config), text, package),
    }


def sweep_summary(results: list[dict], metric: str, mode: str = "max") -> list[dict]:
    """One flat row per configuration with its best cycle; best marks the first best configuration."""
    sign, rows = -1 if mode == "min" else 1, []
    for r in results:
        cycles = {int(c): m[metric] for c, m in (r.get("metrics") or {}).items() if metric in m}
        at = max(cycles, key=lambda c: (sign * cycles[c], -c)) if cycles else None
        rows.append({"name": r["name"], "error": r.get("error"), "best_cycle": at, metric: cycles.get(at)})
    told = [r for r in rows if r[metric] is not None]
    best = max(told, key=lambda r: sign * r[metric])["name"] if told else None
    return [r | {"best": r["name"] == best} for r in rows]


def write_document(path: str, document: dict) -> None:
    """A small JSON document, by a rename so that readers see all of it or nothing."""
    target = Path(path)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(document, sort_keys=True, indent=2))
    part.replace(target)


def policy_curves(points: DataFrame, most: int = 6) -> DataFrame:
    """Mean cost and quality per policy, budget and cycle, of the first policies by name: what a quality-cost figure shows."""
    first = points.select("policy").distinct().orderBy("policy").limit(most)
    return points.join(first, "policy", "left_semi").groupBy("policy", "budget", "cycle").agg(F.avg("total_tokens").alias("x"), F.avg("value").alias("y"))


def operator_shares(frequencies: DataFrame) -> DataFrame:
    """Summed shares per policy and operator."""
    return frequencies.groupBy("policy", "operator").agg(F.sum("share").alias("share"))
