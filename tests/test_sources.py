import json

import pytest

from curatrix.sources import scans, sinks
from curatrix.streaming import requests


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_strict_scan_fails_closed(spark, tmp_path):
    put(tmp_path / "a/x.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    assert scans.strict_json_lines(spark, str(tmp_path / "a"), "a int", ("a",)).count() == 2
    for name, bad in (("b", "not json"), ("c", "[1]"), ("d", '{"a": "x"}'), ("e", '{"b": 1}')):
        put(tmp_path / name / "x.jsonl", f'{{"a": 1}}\n\n{bad}\n')
        with pytest.raises(Exception, match=r"x\.jsonl:3 (must be a JSON object|has no a)"):
            scans.strict_json_lines(spark, str(tmp_path / name), "a int", ("a",)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scans.strict_json_lines(spark, str(tmp_path / "none"), "a int")
    assert scans.strict_json_lines(spark, str(tmp_path / "none"), "a int", missing_ok=True).count() == 0


def test_lines_of_files_that_are_split(spark, tmp_path):
    for n, rows in (("one", 3000), ("two", 1), ("none", 0)):
        put(tmp_path / f"d/{n}.txt", "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, rows + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000b")
    try:
        got = scans.numbered_lines(spark, str(tmp_path / "d"))
        assert got.rdd.getNumPartitions() > 1
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 3001 and all(r.value.split()[1] == str(r.row_index) for r in rows)


def test_files_of_a_split(spark, tmp_path):
    for name in ("train/a/x.jsonl", "train/y.jsonl", "train_extra.jsonl", "test/z.jsonl", "other/train.jsonl"):
        put(tmp_path / "root" / name, json.dumps({"n": name}) + "\n")
    got = scans.split_files(spark, str(tmp_path / "root"), "train", "n string")
    assert sorted(r.n for r in got.collect()) == ["train/a/x.jsonl", "train/y.jsonl", "train_extra.jsonl"]
    df = spark.createDataFrame([("/d/train/a.jsonl", "train"), ("/d/test/a.jsonl", "train")], "file string, split string")
    assert scans.checked_split(spark.createDataFrame([('/d/train/a.jsonl', 'train')], df.schema), 'split').first().split == 'train'
    with pytest.raises(Exception, match="holds a row of split train"):
        scans.checked_split(df, "split").collect()


def test_smoke_rows(spark, tmp_path):
    kind = "turns array<struct<`from`:string,value:string>>"
    turns = [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]
    put(tmp_path / "good.jsonl", json.dumps({"turns": turns}) + "\n")
    put(tmp_path / "bad.jsonl", json.dumps({"turns": [{"from": "x", "value": ""}]}) + "\n")
    put(tmp_path / "empty.jsonl", "")
    assert scans.smoke_rows(spark, str(tmp_path / "good.jsonl"), kind, "turns", ()).count() == 1
    for name, said in (("bad", "empty_value, invalid_role"), ("empty", "no rows")):
        with pytest.raises(ValueError, match=said):
            scans.smoke_rows(spark, str(tmp_path / f"{name}.jsonl"), kind, "turns", ())


def test_manifest_of_a_run(spark, tmp_path):
    put(tmp_path / "in/x.jsonl", "{}")
    m = sinks.run_manifest(spark, {"rows": str(tmp_path / "in")}, {"k": 1}, str(tmp_path), "r1", "run it")
    assert m["git"] is None and any(p.startswith("pyspark==") for p in m["packages"]) and len(m["inputs"]["rows"]) == 64
    import subprocess

    for command in (["init", "-q"], ["add", "in"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(tmp_path), *command], check=True)
    put(tmp_path / "new", "")
    state = sinks.git_state(str(tmp_path))
    assert len(state["commit"]) == 40 and state["dirty"] and state["status"] == "?? new"


def test_lenient_scan_counts_physical_lines(spark, tmp_path):
    put(tmp_path / "train/x.jsonl", '{"a": 1}\n\nbroken\n[1]\n')
    got = scans.lenient_json_lines(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [(r.row_index, r.issue) for r in got] == [(1, None), (3, "invalid_json"), (4, "invalid_schema")]
    df = spark.createDataFrame([("/d/train/a.jsonl",), ("/d/test_x.jsonl",), ("/d/other/a",)], "file string")
    assert [r.s for r in df.select(scans.split_from_path().alias("s")).collect()] == ["train", "test", "unknown"]


def test_formats_together(spark, tmp_path):
    put(tmp_path / "a.jsonl", '{"x": "1"}\n')
    put(tmp_path / "b.json", json.dumps([{"x": "2"}, {"x": "3"}]))
    put(tmp_path / "c.json", json.dumps({"data": [{"x": "4"}]}))
    put(tmp_path / "d.csv", "﻿x,y\n5,6\n")
    put(tmp_path / "e.txt", "x")
    assert sorted(r.x for r in scans.tables(spark, str(tmp_path), "x string").collect()) == list("12345")


def test_sidecar_lies_over_rows(spark):
    rows = spark.createDataFrame([("a/x", 1, "own"), ("a/x", 2, "own")], "file string, row_index int, m string")
    side = scans.sidecar(spark.createDataFrame([("a\\x", 2, "side")], "file string, row_index int, m string"))
    assert sorted(r.m for r in scans.with_sidecar(rows, side).collect()) == ["own", "side"]
    with pytest.raises(ValueError):
        scans.sidecar(side.union(side))


def test_access_needs_rights():
    scans.source_allowed({"access": "automatic"}, False)
    with pytest.raises(PermissionError):
        scans.source_allowed({"access": "manual", "source_id": "s"}, False)


def test_sinks_are_deterministic_and_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, None)], "b int, a string")
    for n in ("one", "two"):
        sinks.write_json_lines(df.repartition(3), str(tmp_path / n), "b")
    lines = [sorted(p.read_text() for p in (tmp_path / n).glob("part-*") if p.stat().st_size) for n in ("one", "two")]
    assert lines[0] == lines[1] and json.loads(lines[0][-1].split("\n")[0]) in ({"b": 1}, {"a": "é", "b": 2})
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_json_lines(df, str(tmp_path / "one"), "b")
    assert sinks.directory_fingerprint(spark, str(tmp_path / "one")) != ""


def test_seal_opens_once(spark, tmp_path):
    put(tmp_path / "m.json", "{}")
    sha = sinks.file_fingerprints(spark, str(tmp_path / "m.json")).first().sha256
    with pytest.raises(ValueError):
        sinks.open_sealed(spark, str(tmp_path / "m.json"), "0" * 64, str(tmp_path / "seal"))
    assert sinks.open_sealed(spark, str(tmp_path / "m.json"), sha, str(tmp_path / "seal")).first().value == "{}"
    with pytest.raises(ValueError):
        sinks.open_sealed(spark, str(tmp_path / "m.json"), sha, str(tmp_path / "seal"))


def test_stream_of_requests(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", True), (1, "2024-01-01 00:01:00", True), (2, "2024-01-01 00:02:00", False), (2, "2024-01-01 00:03:00", True)]
    df = spark.createDataFrame(rows, "user long, at string, ok boolean").selectExpr("user", "cast(at as timestamp) at", "ok")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = requests.outcomes(stream, "user", "at", "ok").writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user, r.outcome) for r in spark.table("told").collect()) == [(1, "DUPLICATE_REQUEST"), (1, "OK"), (2, "NOT_ELIGIBLE"), (2, "OK")]
    counts = requests.windowed_counts(stream, "at", "1 hour", "user").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert {r.user: r.n for r in spark.table("counted").collect()} == {1: 2, 2: 2}


def test_stream_forgets_keys_that_are_long_past(spark, tmp_path):
    days = [("a", 1), ("a", 2), ("b", 40), ("c", 41), ("a", 80), ("a", 81)]
    for n, (user, day) in enumerate(days):
        df = spark.sql(f"select '{user}' as user, timestamp'2024-01-01' + interval {day} days as at, true as ok")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = requests.outcomes(stream, "user", "at", "ok", "10 days").writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    told = sorted((r.user, r.at.day + 31 * (r.at.month - 1) - 1, r.outcome) for r in spark.table("kept").collect())
    assert [t[2] for t in told if t[0] == "a"] == ["OK", "DUPLICATE_REQUEST", "OK", "DUPLICATE_REQUEST"]
