"""JSON arrays cut anywhere against the library's reader."""

import json
import random

import pytest

from curatrix.sources import jsonarrays, scans


def made(rng, depth=0):
    """Objects with braces, brackets, quotes and escapes in texts, and nested ones."""
    text = lambda: "".join(rng.choice(['{', '}', '[', ']', '"', "\\", ",", ":", "é", " ", "x", "\n"]) for _ in range(rng.randint(0, 12)))
    value = lambda: rng.choice([None, 1, True, text(), [text()], [made(rng, depth + 1)] if depth < 2 else 0, made(rng, depth + 1) if depth < 2 else {}])
    return {rng.choice("abc") + text(): value() for _ in range(rng.randint(0, 4))}


@pytest.mark.parametrize("split", ["64b", "1m"])
def test_records_of_files_cut_anywhere(spark, tmp_path, split):
    rng = random.Random(5)
    want = {}
    for k in range(6):
        rows = [made(rng) for _ in range([0, 1, 40, 40, 25, 3][k])]
        body = rows if k % 2 else {"data": rows, "more": {"x": [{"y": 1}]}, "z": {}}
        name = f"f{k}.json"
        (tmp_path / name).write_text(json.dumps(body, ensure_ascii=k % 3 == 0, indent=rng.choice([None, 1])))
        want[name] = rows
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert (read.rdd.getNumPartitions() > 20) == (split == "64b")
        got = {}
        for r in jsonarrays.records(spark, str(tmp_path)).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.nth] = json.loads(r.record)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_tables_of_large_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "t": "x}{"}, {"id": 2, "other": [1, {"id": 9}]}]')
    (tmp_path / "b.json").write_text('{"data": [{"id": 3}]}')
    (tmp_path / "c.jsonl").write_text('{"id": 4, "t": "y"}\n')
    (tmp_path / "d.csv").write_text("t\nz\n")
    got = [sorted(map(tuple, scans.tables(spark, str(tmp_path), "id long, t string", large).collect()), key=repr) for large in (False, True)]
    assert got[0] == got[1] and (1, "x}{") in got[0] and len(got[0]) == 5


def test_other_forms_are_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"id": 1}]}')
    with pytest.raises(ValueError, match="no list of objects"):
        jsonarrays.records(spark, str(tmp_path))
