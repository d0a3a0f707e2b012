"""Seed records as a transactional sink: the data source ``seed_records``.

Every task writes one JSON-lines part and that part's manifest (digest of the file and of each
record, counts and token sums) into a staging folder beside the target. The commit message of a
task is its part's name and sums, so the driver holds a few numbers a task and no record. When all
tasks are done, files that no message names (of tasks that were tried twice) are deleted, the
folder's own manifest is written, and one rename makes the folder appear. If the job fails the
staging folder is deleted: readers see a whole artifact or none. An existing target is refused
unless it is to be replaced.

Each part with its manifest is what ``provenance.materialized`` audits.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cinderloom.sources.run_files import opened

TOKENS = ("teacher_input_tokens", "teacher_output_tokens", "teacher_total_tokens")
SUFFIX, MANIFEST = ".manifest.json", "manifest.json"
#: Of a record: whether its teacher agreed with the gold answer, and whether its usage is an estimate.
AGREES, ESTIMATED = "teacher_gold_agreement", "usage_estimated"


@dataclass
class Sums:
    records: int = 0
    agree: int = 0
    disagree: int = 0
    estimated: int = 0
    teacher_input_tokens: int = 0
    teacher_output_tokens: int = 0
    teacher_total_tokens: int = 0

    def add(self, record: dict) -> None:
        self.records += 1
        self.agree += record.get(AGREES) is True
        self.disagree += record.get(AGREES) is False
        self.estimated += record.get(ESTIMATED) is True
        for k in TOKENS:
            setattr(self, k, getattr(self, k) + int(record.get(k) or 0))

    def accounts(self, rejected: int) -> dict:
        return {
            "records": self.records, "accepted_records": self.records, "rejected_records": rejected, "attempted_records": self.records + rejected, "usage_estimated_records": self.estimated,
            "teacher_gold_agreement_records": self.agree, "teacher_gold_disagreement_records": self.disagree, "teacher_gold_disagreement_rate": self.disagree / max(1, self.agree + self.disagree),
        } | {k: getattr(self, k) for k in TOKENS}


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    sha256: str | None
    sums: dict


class RecordWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        import uuid

        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.rejected, self.extra = int(options.get("rejected", 0)), json.loads(options.get("manifest", "{}"))
        self.labels = options.get("canonical_labels")
        parent, _, name = self.path.rpartition("/")
        self.staging = f"{parent}/.{name}.staging-{uuid.uuid4().hex}"
        self._refuse()

    def _there(self, path: str) -> bool:
        from pyarrow import fs

        system, place = opened(path)
        return system.get_file_info(place).type != fs.FileType.NotFound

    def _refuse(self) -> None:
        if not self.overwrite and self._there(self.path):
            raise FileExistsError(f"there is an artifact already: {self.path}")

    def _put(self, name: str, document: dict) -> None:
        system, place = opened(f"{self.staging}/{name}")
        with system.open_output_stream(place) as f:
            f.write((json.dumps(document, sort_keys=True, indent=2) + "\n").encode())

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        rows = iter(iterator)
        first = next(rows, None)
        if first is None:
            return Part(None, None, asdict(Sums()))
        system, place = opened(self.staging)
        system.create_dir(place, recursive=True)
        # Tries of one task write different files; the message of the try that counts names its own.
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.jsonl"
        whole, each, sums = hashlib.sha256(), [], Sums()
        with system.open_output_stream(f"{place}/{name}") as f:
            while first is not None:
                text = first[0]
                record = json.loads(text) if text is not None else None
                if not isinstance(record, dict):
                    raise ValueError(f"a record is no JSON object: {text!r:.80}")
                if any(c in text for c in "\r\n"):  # white space between tokens only: a value has them escaped
                    text = json.dumps(record, ensure_ascii=False)
                line = text.strip().encode()
                sums.add(record)
                each.append(hashlib.sha256(line).hexdigest())
                whole.update(line + b"\n")
                f.write(line + b"\n")
                first = next(rows, None)
        digest = whole.hexdigest()
        self._put(name + SUFFIX, self.extra | sums.accounts(0) | {"artifact_sha256": digest, "records_sha256": each})
        return Part(name, digest, asdict(sums))

    def commit(self, messages: list[Part]) -> None:
        from pyarrow import fs

        parts = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.name)
        system, place = opened(self.staging)
        system.create_dir(place, recursive=True)
        named = {n for p in parts for n in (p.name, p.name + SUFFIX)}
        for info in system.get_file_info(fs.FileSelector(place)):
            if info.base_name not in named:
                system.delete_file(info.path)
        total = Sums(**{k: sum(p.sums[k] for p in parts) for k in asdict(Sums())})
        if self.labels:
            self._put("canonical_labels.json", json.loads(self.labels))
        self._put(MANIFEST, self.extra | total.accounts(self.rejected) | {"parts": [{"name": p.name, "sha256": p.sha256, "records": p.sums["records"]} for p in parts]})
        self._refuse()
        target = opened(self.path)[1]
        old = f"{place}-old"
        if self._there(self.path):
            system.move(target, old)
        system.move(place, target)
        if self._there(old if "://" not in self.path else self.staging + "-old"):
            system.delete_dir(old)

    def abort(self, messages) -> None:
        if self._there(self.staging):
            system, place = opened(self.staging)
            system.delete_dir(place)


class SeedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seed_records"

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        if [f.name for f in schema] != ["record"]:
            raise ValueError("seed records are one column, record, of JSON text")
        return RecordWriter(self.options, overwrite)


def write_records(records: DataFrame, path: str, rejected: int = 0, manifest: dict | None = None, labels: dict | None = None, overwrite: bool = False) -> None:
    """Write the rows as JSON records below path, with manifests that hold ``manifest`` besides; rejected rows are only counted.

    Columns of the rows are the fields of a record; null fields are left out. ``teacher_*_tokens``,
    ``teacher_gold_agreement`` and ``usage_estimated`` are summed where they occur. Rows keep their
    partitions, and a partition its order. An empty table gives an artifact without parts.
    """
    spark = records.sparkSession
    spark.dataSource.register(SeedRecords)
    lines = records.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])).alias("record"))
    out = lines.write.format("seed_records").option("rejected", rejected).option("manifest", json.dumps(manifest or {}))
    if labels:
        out = out.option("canonical_labels", json.dumps(labels))
    out.mode("overwrite" if overwrite else "append").save(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("pathGlobFilter", "part-*.jsonl").json(path)
