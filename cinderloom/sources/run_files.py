"""Run folders and their logs as Python data sources: ``run_files``, ``run_log`` and its stream.

``run_files`` gives dir, name and content of the artifacts, one task a folder; predicates on
``name`` reach the reader, so files of other names are not opened. ``run_log`` gives the lines of
JSON logs as dir, name, ord (the line's byte offset, which orders the log) and line, and cuts a
log of any size into byte ranges: a task reads the lines that begin in its range. As a stream it
remembers the byte offset of each log and gives what was appended since; a last line that has no
line feed yet waits for it.

Files are reached by pyarrow's file systems (local paths and the stores that it knows).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from cinderloom.sources.artifacts import REQUIRED

NAMES = (*REQUIRED, "policy_decisions.jsonl", "teacher_attempts.jsonl")
#: Bytes of a range of a log.
SPLIT = 64 << 20


def opened(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def found_files(roots: list[str], wanted) -> list[tuple[str, str, str, int]]:
    """(root's scheme and path of the folder, file name, whole path, bytes) of every file below the roots whose name is wanted, each once."""
    from pyarrow import fs

    out = {}
    for root in roots:
        system, place = opened(root)
        head = root[: root.index("://") + 3] if "://" in root and not root.startswith("file:") else ""
        for info in system.get_file_info(fs.FileSelector(place, recursive=True)):
            if info.type == fs.FileType.File and wanted(info.base_name):
                out[head + info.path] = (head + info.path.rsplit("/", 1)[0], info.base_name, head + info.path, info.size)
    return [out[k] for k in sorted(out)]


def _roots(options: dict) -> list[str]:
    """The paths of the option ``paths`` (a JSON list) or ``path``."""
    roots = json.loads(options["paths"]) if "paths" in options else [options["path"]]
    if not roots:
        raise ValueError("a run source needs a path")
    return roots


@dataclass
class Folder(InputPartition):
    dir: str
    files: list[tuple[str, str]]  # name, path


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.names = _roots(options), set(json.loads(options.get("names", json.dumps(NAMES))))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.names &= {f.value}
            elif isinstance(f, In) and f.attribute == ("name",):
                self.names &= set(f.value)
            else:
                yield f

    def partitions(self) -> list[Folder]:
        by_dir: dict[str, list[tuple[str, str]]] = {}
        for place, name, path, _ in found_files(self.roots, self.names.__contains__):
            by_dir.setdefault(place, []).append((name, path))
        return [Folder(d, files) for d, files in by_dir.items()]

    def read(self, part: Folder) -> Iterator[tuple]:
        for name, path in part.files:
            system, place = opened(path)
            with system.open_input_stream(place) as f:
                yield part.dir, name, f.read().decode("utf-8")


class RunFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_files"

    def schema(self) -> str:
        return "dir string, name string, content string"

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


@dataclass
class Range(InputPartition):
    dir: str
    name: str
    path: str
    start: int
    end: int


def cut(place: str, name: str, path: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(place, name, path, a, min(a + split, end)) for a in range(start, end, split)]


def line_number(path: str, offset: int) -> int:
    """The number, from 1, of the line at a byte offset."""
    system, place = opened(path)
    n, left = 1, offset
    with system.open_input_stream(place) as f:
        while left > 0 and (some := f.read(min(left, 1 << 20))):
            n, left = n + some.count(b"\n"), left - len(some)
    return n


def lines_of(part: Range, block: int = 1 << 20) -> Iterator[tuple[str, str, int, str]]:
    """The lines that begin in a range, without blank ones; a line that is no JSON raises with its file and number."""
    system, place = opened(part.path)
    with system.open_input_file(place) as f:
        at = part.start
        if at:
            # The line that begins at the range's first byte is its own; any other line there belongs to the range before.
            f.seek(at - 1)
            while some := f.read(block):
                if (i := some.find(b"\n")) >= 0:
                    at = f.tell() - len(some) + i + 1
                    break
            else:
                return
        f.seek(at)
        held = b""
        while at < part.end:
            some = f.read(block)
            held += some
            while at < part.end and ((i := held.find(b"\n")) >= 0 or (not some and held)):
                i = len(held) if i < 0 else i
                line, held = held[:i], held[i + 1 :]
                text = line.decode("utf-8").strip()
                if text:
                    try:
                        json.loads(text)
                    except ValueError as e:
                        raise ValueError(f"{part.path}, line {line_number(part.path, at)}: {e}") from None
                    yield part.dir, part.name, at, text
                at += i + 1
            if not some:
                return


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.pattern, self.split = _roots(options), options.get("log", "*.jsonl"), int(options.get("split", SPLIT))
        self.names: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            some = {f.value} if isinstance(f, EqualTo) and f.attribute == ("name",) else set(f.value) if isinstance(f, In) and f.attribute == ("name",) else None
            if some is None:
                yield f
            else:
                self.names = some if self.names is None else self.names & some

    def wanted(self, name: str) -> bool:
        return fnmatch(name, self.pattern) and (self.names is None or name in self.names)

    def partitions(self) -> list[Range]:
        return [r for place, name, path, size in found_files(self.roots, self.wanted) for r in cut(place, name, path, 0, size, self.split)]

    def read(self, part: Range) -> Iterator[tuple]:
        return lines_of(part)


class LogStreamReader(DataSourceStreamReader):
    """Offsets: path to the bytes up to its last line feed."""

    def __init__(self, options: dict):
        self.roots, self.pattern, self.split = _roots(options), options.get("log", "*.jsonl"), int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: self._whole(path, size) for _, _, path, size in found_files(self.roots, lambda n: fnmatch(n, self.pattern))}

    @staticmethod
    def _whole(path: str, size: int, block: int = 1 << 16) -> int:
        system, place = opened(path)
        with system.open_input_file(place) as f:
            end = size
            while end > 0:
                a = max(0, end - block)
                f.seek(a)
                if (i := f.read(end - a).rfind(b"\n")) >= 0:
                    return a + i + 1
                end = a
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path in sorted(end):
            a, b = start.get(path, 0), end[path]
            if b < a:
                raise ValueError(f"{path} became shorter: a log is appended to only")
            place, name = path.rsplit("/", 1)
            out += cut(place, name, path, a, b, self.split)
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        return lines_of(part)


class RunLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_log"

    def schema(self) -> str:
        return "dir string, name string, ord bigint, line string"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RunFiles)
    spark.dataSource.register(RunLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def files(spark: SparkSession, *roots: str) -> DataFrame:
    """dir, name and content of every artifact below the roots, one task a folder."""
    register(spark)
    return spark.read.format("run_files").option("paths", json.dumps(roots)).load()


def _columns(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select("dir", "ord", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("x")).select("dir", "ord", "x.*")


def log(spark: SparkSession, name: str, schema: str, *roots: str, split: int = SPLIT) -> DataFrame:
    """dir, ord and the columns of every line of the logs of a name."""
    register(spark)
    return _columns(spark.read.format("run_log").option("paths", json.dumps(roots)).option("log", name).option("split", split).load(), schema)


def log_stream(spark: SparkSession, name: str, schema: str, *roots: str, split: int = SPLIT) -> DataFrame:
    """The same as a stream of appended lines."""
    register(spark)
    return _columns(spark.readStream.format("run_log").option("paths", json.dumps(roots)).option("log", name).option("split", split).load(), schema)
