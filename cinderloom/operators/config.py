"""Experiment configuration: validation, grids of list parameters, names, shards, data files."""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

#: Fields that may hold a list, each value then an experiment of its own.
LISTED = ("teacher", "student", "dataset", "cycles", "policy_name", "token_budget", "seed", "augmentation_batch_size")


@dataclass(frozen=True)
class EarlyStopping:
    enabled: bool = False
    patience: int = 2
    metric: str = "accuracy"
    mode: str = "max"
    min_delta: float = 0.0
    restore_best: bool = True


@dataclass(frozen=True)
class Sampling:
    enabled: bool = False
    sample_size: int = 1000
    train_ratio: float = 0.8
    stratify_column: str = "label"
    seed: int = 42


@dataclass(frozen=True)
class Experiment:
    name: str
    teacher: Any = "teacher"
    student: Any = "student"
    student_type: str = "transformers"
    dataset: Any = "dataset"
    dataset_kwargs: dict = field(default_factory=dict)
    metrics: tuple[str, ...] = ("accuracy", "f1")
    cycles: Any = 3
    policy_name: Any = None
    token_budget: Any = None
    budget_stop: bool = False
    seed: Any = 42
    augmentation_batch_size: Any = 16
    early_stopping: EarlyStopping = EarlyStopping()
    sampling: Sampling = Sampling()

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9._-]+", self.name):
            raise ValueError("a name has letters, digits, dots, dashes and underscores only")
        if self.early_stopping.enabled and self.early_stopping.metric not in self.metrics:
            raise ValueError("the early-stopping metric must be among the metrics")
        for budget in self.token_budget if isinstance(self.token_budget, (list, tuple)) else [self.token_budget]:
            if budget is not None and budget < 0:
                raise ValueError("a token budget can't be negative")


def from_dict(doc: dict) -> Experiment:
    known = {f.name for f in fields(Experiment)}
    parts = {k: v for k, v in doc.items() if k in known}
    if isinstance(doc.get("early_stopping"), dict):
        parts["early_stopping"] = EarlyStopping(**doc["early_stopping"])
    if isinstance(doc.get("sampling"), dict):
        parts["sampling"] = Sampling(**doc["sampling"])
    if "metrics" in parts:
        parts["metrics"] = tuple(parts["metrics"])
    return Experiment(**parts)


def from_yaml(path: str) -> tuple[Experiment, str]:
    """The experiment and the digest of its file."""
    import yaml

    raw = Path(path).read_bytes()
    return from_dict(yaml.safe_load(raw)), hashlib.sha256(raw).hexdigest()


def list_parameters(config: Experiment) -> list[str]:
    return sorted(k for k in LISTED if isinstance(getattr(config, k), (list, tuple)))


def value_name(value: Any) -> str:
    """A parameter value in a directory name."""
    if isinstance(value, float):
        text = f"{value:.0e}" if 0 < abs(value) < 0.001 else f"{value:g}"
    else:
        text = str(value).rsplit("/", 1)[-1]
    return re.sub(r"[^A-Za-z0-9._-]", "_", text)


def grid(config: Experiment) -> list[Experiment]:
    """Every combination of the listed parameters, in the order of the parameters' names."""
    names = list_parameters(config)
    if not names:
        return [config]
    out = []
    for values in itertools.product(*(getattr(config, n) for n in names)):
        suffix = "".join(f"_{n}-{value_name(v)}" for n, v in zip(names, values))
        out.append(replace(config, name=config.name + suffix, **dict(zip(names, values))))
    return out


def shard(configs: list[Experiment], index: int | None, count: int | None) -> list[Experiment]:
    """Every count-th configuration from the index on; shards are disjoint and complete."""
    if index is None and count is None:
        return configs
    if index is None or count is None or count < 1 or not 0 <= index < count:
        raise ValueError("shard index and count must be given together, 0 <= index < count")
    return configs[index::count]


def data_files(config: Experiment) -> list[str]:
    """All files that data_files names, whether as text, list or mapping of these."""

    def flat(x: Any) -> list[str]:
        if x is None:
            return []
        if isinstance(x, str):
            return [x]
        return [f for part in (x.values() if isinstance(x, dict) else x) for f in flat(part)]

    return flat(config.dataset_kwargs.get("data_files"))


def as_rows(configs: list[Experiment]) -> list[dict]:
    return [{"position": i, "name": c.name} | {k: str(v) for k, v in asdict(c).items() if k in LISTED} for i, c in enumerate(configs)]
