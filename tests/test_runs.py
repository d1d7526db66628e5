import pytest
from pyspark.sql import functions as F

from curatrix.operators import runs


def table(spark, rows):
    return spark.createDataFrame(rows, "run string, case_id long, tier string, passed boolean, auto_resolved boolean, checks struct<ok:boolean>, eligible boolean")


def test_comparison(spark):
    rows = [("a", 1, "t", True, False, (True,), True), ("a", 2, "u", False, False, None, False), ("b", 1, "t", True, True, (False,), True), ("b", 2, "u", True, False, (True,), False)]
    df = table(spark, rows)
    got = runs.compare(df, "run", "case_id", "tier", ("passed", "auto_resolved", "ok"))
    assert {(r.run, r.metric): r.rate for r in got["rates"].collect()} == {("a", "passed"): 0.5, ("a", "auto_resolved"): 0.0, ("a", "ok"): 0.5, ("b", "passed"): 1.0, ("b", "auto_resolved"): 0.5, ("b", "ok"): 0.5}
    assert {r.metric: r.delta for r in got["deltas"].collect()} == {"passed": 0.5, "auto_resolved": 0.5, "ok": 0.0}
    assert got["by_tier"].count() == 12
    assert [r.case_id for r in runs.eligible_cases(df, "run", "case_id", "eligible").collect()] == [1]
    with pytest.raises(ValueError):
        runs.compare(df.where("not (run = 'a' and case_id = 2)"), "run", "case_id", "tier", ("passed",))
    with pytest.raises(ValueError):
        runs.eligible_cases(df.where("case_id = 2"), "run", "case_id", "eligible")


def test_guards(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "id long, s double")
    assert runs.unique(df, "id").count() == 2
    with pytest.raises(ValueError):
        runs.unique(df.union(df), "id")
    assert runs.slice_by_ids(df, df.where("id = 1"), "id").count() == 1
    with pytest.raises(ValueError):
        runs.slice_by_ids(df, spark.range(5), "id")
    assert runs.gated_margin(df.where("id = 1"), "s").first().s == 0.5
    with pytest.raises(Exception, match="missing score"):
        runs.gated_margin(df, "s").collect()


def test_details_and_claims(spark):
    schema = "id long, passed boolean, errors array<string>, calls array<struct<name:string>>"
    before = spark.createDataFrame([(1, True, [], [("f",)]), (2, False, ["x"], [])], schema)
    after = spark.createDataFrame([(1, False, ["y"], [("g",)]), (2, False, ["x"], [])], schema)
    (r,) = runs.failure_details(before, after, "id").collect()
    assert (r.id, r.transition, r.tool_sequence_changed) == (1, "pass_to_fail", True)
    obs = ['{"ok": true, "data": {"a": "1", "b": "2"}}', '{"ok": false}', '{"ok": true, "data": {"a": "3"}}']
    df = spark.createDataFrame([(obs, [1, 2])], "o array<string>, t array<int>")
    r = df.select(runs.allowed_claims("o").alias("c"), runs.with_end("t", 2).alias("a"), runs.with_end("t", 9).alias("b")).first()
    assert r.c == {"a": "3", "b": "2"} and r.a == [1, 2] and r.b == [1, 2, 9]


def test_sealed_sets_and_tokens(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string")
    b = spark.createDataFrame([(7, "y")], "id long, text string")
    keys = {"content": F.col("text"), "id": F.col("id")}
    assert runs.sealed_set_faults({"cases": a, "oracle": a}, "id", {"dev": b}, keys) == ["content shared with dev"]
    assert runs.sealed_set_faults({"cases": a, "oracle": b}, "id", {}, keys) == ["ids differ between the set's tables"]
    t = spark.createDataFrame([(10, 5), (20, None), (5000, 7)], "p int, c int")
    got = {r.field: r for r in runs.token_audit(t, (15,), 4096, "p", "c").collect()}
    assert got["p"].over_15 == 2 and got["p"].implausible and got["p"].p50 == 20 and got["c"].n == 2


def test_rollup(spark):
    a = spark.createDataFrame([("r", 1)], "run string, x int")
    assert runs.run_rollup(a, a.withColumnRenamed("x", "y"), a.withColumnRenamed("x", "z"), "run").columns == ["run", "x", "y", "z"]
