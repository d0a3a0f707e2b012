"""Run folders and logs as data sources: the same rows as by whole files, ranges, pushdown, errors, streams."""

import json

import pytest

from cinderloom.sources import artifacts, run_files

NAMES = ["run_manifest.json", "experiment_config.yaml", "metrics.json", "token_usage.json"]


def text_of(i):
    return json.dumps({"attempt_id": f"a{i}", "cycle": i % 4, "note": "ü𝒳" * (i % 7), "status": None if i % 5 == 0 else "success"}, ensure_ascii=i % 2 == 0)


@pytest.fixture()
def runs(tmp_path):
    for k in range(3):
        d = tmp_path / "deep" / f"run{k}"
        d.mkdir(parents=True)
        for n in NAMES:
            (d / n).write_text(json.dumps({"k": k, "n": n}))
        end = "\r\n" if k == 1 else "\n"
        body = end.join(text_of(i) for i in range(40 * k))
        (d / "teacher_attempts.jsonl").write_text(body + ("" if k == 2 else end) + ("\n  \n" if k == 1 else ""), newline="")
        (d / "model.bin").write_bytes(b"\xff\xfe")
    return str(tmp_path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_files_equal_the_whole_file_scan(spark, runs):
    got = run_files.files(spark, runs, runs + "/deep")
    assert rows(got) == rows(artifacts.files(spark, runs))
    assert got.rdd.getNumPartitions() == 3


def test_names_reach_the_reader(spark, runs):
    some = run_files.files(spark, runs).where("name in ('metrics.json', 'other')")
    assert len(some.collect()) == 3
    reader = run_files.FilesReader({"path": runs})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("name",), "metrics.json"), GreaterThan(("dir",), "a")]))
    assert left == [GreaterThan(("dir",), "a")]
    assert {n for p in reader.partitions() for n, _ in p.files} == {"metrics.json"}


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 1 << 20])
def test_ranges_give_each_line_once(spark, runs, split):
    schema = "attempt_id string, cycle int, note string, status string"
    whole = artifacts.log(artifacts.files(spark, runs), "teacher_attempts.jsonl", schema)
    if split > 50:
        parts = run_files.log(spark, "teacher_attempts.jsonl", schema, runs, split=split)
        assert sorted(map(repr, parts.drop("ord").collect())) == sorted(map(repr, whole.drop("ord").collect()))
        order = [r["attempt_id"] for r in parts.where("dir like '%run2'").orderBy("ord").collect()]
    else:  # thousands of ranges: without Spark
        reader = run_files.LogReader({"path": runs, "log": "teacher_attempts.jsonl", "split": str(split)})
        order = [json.loads(x[3])["attempt_id"] for p in reader.partitions() if p.dir.endswith("run2") for x in reader.read(p)]
    assert order == [f"a{i}" for i in range(80)]


def test_a_long_log_reads_in_several_tasks(spark, tmp_path):
    (tmp_path / "r").mkdir()
    with open(tmp_path / "r" / "teacher_attempts.jsonl", "w") as f:
        f.writelines(text_of(i) + "\n" for i in range(20_000))
    df = run_files.log(spark, "teacher_attempts.jsonl", "attempt_id string", str(tmp_path), split=100_000)
    assert df.rdd.getNumPartitions() > 5 and df.distinct().count() == 20_000


def test_lines_longer_than_blocks_and_ranges(tmp_path):
    path = tmp_path / "x.jsonl"
    bodies = [json.dumps("y" * n) for n in (10, 5000, 3, 70_000, 1)]
    path.write_text("\n".join(bodies))
    for split in (13, 4096):
        parts = run_files.cut("d", "x.jsonl", str(path), 0, path.stat().st_size, split)
        assert [x[3] for p in parts for x in run_files.lines_of(p, block=64)] == bodies


def test_a_malformed_line_names_file_and_line(spark, runs):
    path = f"{runs}/deep/run0/teacher_attempts.jsonl"
    with open(path, "w") as f:
        f.write('{"attempt_id": "a"}\n\n{"attempt_id": "b"}\n{"attempt_id": \n')
    with pytest.raises(Exception, match=r"run0/teacher_attempts\.jsonl, line 4"):
        run_files.log(spark, "teacher_attempts.jsonl", "attempt_id string", runs, split=10_000).collect()


def test_stream_gives_appended_lines_once(spark, tmp_path):
    log, out = tmp_path / "runs" / "r1" / "teacher_attempts.jsonl", str(tmp_path / "out")
    log.parent.mkdir(parents=True)

    def go():
        df = run_files.log_stream(spark, "teacher_attempts.jsonl", "attempt_id string", str(tmp_path / "runs"), split=64)
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["attempt_id"] for r in spark.read.parquet(out).collect())

    log.write_text('{"attempt_id": "a"}\n{"attempt_id": "b"}\n{"attempt_id": "c')
    assert go() == ["a", "b"]
    with log.open("a") as f:
        f.write('"}\n{"attempt_id": "d"}\n')
    other = log.parent.parent / "r2"
    other.mkdir()
    (other / "teacher_attempts.jsonl").write_text('{"attempt_id": "e"}\n')
    assert go() == ["a", "b", "c", "d", "e"]
    assert go() == ["a", "b", "c", "d", "e"]


def test_a_shrunk_log_raises():
    reader = run_files.LogStreamReader({"path": "/x"})
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions({"/x/a.jsonl": 10}, {"/x/a.jsonl": 5})
