"""The provenance audit and seed tokens on run folders, with a planted fault for each reason."""

import hashlib
import json

import pytest
import yaml

from cinderloom import cli
from cinderloom.operators import provenance
from cinderloom.sources import artifacts

SECTIONS = {k: {"x": 1} for k in ("hardware", "dataset_source", "models")}


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def run_folder(root, name, change=lambda manifest, seed: None, data_files="seed.jsonl", lines=None, seed_manifest=True):
    run = root / name
    run.mkdir(parents=True)
    config = {"name": name, "dataset_kwargs": {"data_files": data_files}}
    text = yaml.safe_dump(config)
    (run / "experiment_config.yaml").write_text(text)
    rows = lines or [json.dumps({"teacher_input_tokens": 3, "teacher_output_tokens": 2, "teacher_total_tokens": 5}) for _ in range(2)]
    body = "\n".join(rows) + "\n"
    (run / "seed.jsonl").write_text(body)
    repro = SECTIONS | {
        "source_control": {s: {"head_sha": "abc", "is_dirty": False} for s in ("package", "workspace")},
        "runtime": {"lockfiles": {"pyproject.toml": "p", "uv.lock": "u"}},
        "config_provenance": {"run_copy_sha256": sha(text)},
    }
    manifest = {"schema_version": 3, "run_id": name, "config_hash": sha(json.dumps(config, sort_keys=True)), "reproducibility": json.loads(json.dumps(repro))}
    seed = {"artifact_sha256": sha(body), "records": 2, "records_sha256": [sha(r) for r in rows], "teacher_input_tokens": 6, "teacher_output_tokens": 4, "teacher_total_tokens": 10, "accepted_records": 2, "attempted_records": 3, "rejected_records": 1,
            "teacher_gold_agreement_records": 2, "teacher_gold_disagreement_records": 0, "teacher_gold_disagreement_rate": 0.0, "usage_estimated_records": 1, "reproducibility": repro}
    change(manifest, seed)
    (run / "run_manifest.json").write_text(json.dumps(manifest))
    if seed_manifest:
        (run / "seed.jsonl.manifest.json").write_text(json.dumps(seed))
    (run / "metrics.json").write_text("{}")
    (run / "token_usage.json").write_text(json.dumps({"totals": {"sft_data": {"input_tokens": 6, "output_tokens": 4, "total_tokens": 10}}, "grand_total": {"input_tokens": 16, "output_tokens": 9, "total_tokens": 25}}))


def put(*keys, value=None, side=0):
    """A change that sets (or with value None drops) a nested key of the run's or the seed's manifest."""

    def change(*documents):
        doc = documents[side]
        for k in keys[:-1]:
            doc = doc[k]
        if value is None:
            del doc[keys[-1]]
        else:
            doc[keys[-1]] = value

    return change


R = "reproducibility"
FAULTS = {
    "run_manifest_schema_version_lt_3": put("schema_version", value=2), "missing_hardware": put(R, "hardware"), "missing_dataset_source": put(R, "dataset_source"), "missing_models": put(R, "models", value={}),
    "missing_config_run_copy_sha256": put(R, "config_provenance", value={"x": 1}), "missing_config_hash": put("config_hash"), "config_hash_mismatch": put("config_hash", value="other"), "config_run_copy_sha256_mismatch": put(R, "config_provenance", "run_copy_sha256", value="other"),
    "missing_package_head_sha": put(R, "source_control", "package", "head_sha", value=""), "missing_workspace_head_sha": put(R, "source_control", "workspace", "head_sha"), "missing_pyproject_sha256": put(R, "runtime", "lockfiles", "pyproject.toml"), "missing_uv_lock_sha256": put(R, "runtime", "lockfiles", "uv.lock"),
    "dirty_package_git": put(R, "source_control", "package", "is_dirty", value=True), "dirty_workspace_git": put(R, "source_control", "workspace", "is_dirty", value=True), "missing_config_provenance;missing_config_run_copy_sha256": put(R, "config_provenance"),
    "missing_runtime;missing_pyproject_sha256;missing_uv_lock_sha256": put(R, "runtime"), "missing_source_control;missing_package_head_sha;missing_workspace_head_sha": put(R, "source_control"),
    "missing_materialized_manifest_provenance": put(R, "models", side=1), "missing_materialized_manifest_accounting": put("rejected_records", side=1), "materialized_manifest_integrity_mismatch": put("records_sha256", value=["a", "b"], side=1),
    "materialized_manifest_token_accounting_mismatch": put("attempted_records", value=1, side=1),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    for i, change in enumerate(FAULTS.values()):
        run_folder(root, f"fault{i}", lambda m, s, c=change: c(m, s))
    run_folder(root, "good")
    run_folder(root, "listed", data_files={"train": ["seed.jsonl", "seed.jsonl"], "test": "good/seed.jsonl"})
    run_folder(root, "lost", seed_manifest=False)
    run_folder(root, "torn", lines=["{", json.dumps({"teacher_total_tokens": 10})])
    run_folder(root, "bare", put(R))
    found = artifacts.files(spark, str(root))
    return found, provenance.seed_files(found, provenance.materialized(spark, str(root)), "/nowhere")


def test_audit(tables):
    got = {r.dir.rsplit("/", 1)[1]: r for r in provenance.audit(*tables).collect()}
    assert got["good"].passed and got["good"].failure_reasons == "" and got["good"].integrity_ok_files == 1
    for i, reasons in enumerate(FAULTS):
        assert got[f"fault{i}"].failure_reasons == reasons
    assert got["listed"].passed and (got["listed"].data_files, got["listed"].manifests) == (3, 3)
    assert got["lost"].failure_reasons == "missing_materialized_manifests"
    assert got["torn"].failure_reasons == "materialized_manifest_token_accounting_mismatch"
    assert got["bare"].failure_reasons.startswith("missing_run_reproducibility;missing_source_control;missing_runtime;missing_hardware") and not got["bare"].passed


def test_seed_tokens(tables):
    got = {r.dir.rsplit("/", 1)[1]: r for r in provenance.seed_tokens(*tables).collect()}
    assert tuple(got["good"])[1:] == (1, 1, 6, 4, 10, 10, 5, 15, 16, 9, 25)
    assert (got["listed"].manifests, got["listed"].seed_total_tokens, got["listed"].all_total_tokens) == (2, 20, 35)
    assert (got["lost"].manifests, got["lost"].seed_input_tokens, got["lost"].seed_total_tokens) == (0, 6, 10)


def test_calibration_csv_falls_back(spark, tmp_path):
    report = tmp_path / "report"
    for folder in (tmp_path / "audit", report / "audit", report):
        assert folder != tmp_path / "audit" or artifacts.calibration_csv(spark, str(report)) is None
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "teacher_calibration.csv").write_text(f"place\n{folder}\n")
        assert artifacts.calibration_csv(spark, f"{report}/").first().place == str(folder)


def test_command(spark, tmp_path):
    run_folder(tmp_path / "a", "good")
    run_folder(tmp_path / "b", "bad", put("config_hash"))
    assert cli.main(["provenance", str(tmp_path / "a")]) == 0
    assert cli.main(["provenance", str(tmp_path / "a"), str(tmp_path / "b")]) == 1
