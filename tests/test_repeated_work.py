"""What evaluation and rollouts make once for a row, or not at all where nobody asks for it."""

from __future__ import annotations

import copy

import pytest
from pyspark.sql import functions as F

from curatrix.operators import evaluation, policy

CALLS = "array<struct<name:string,arguments:string>>"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_divergence_orders_turns_once(spark):
    turns = spark.createDataFrame(
        [
            ("a", 1, "tool_calls", [("f", '{"x": 1, "y": 2}')], ""),
            ("a", 2, "tool_calls", [("f", '{"x":3}')], ""),
            ("b", 1, "tool_calls", [("f", "no json")], ""),
            ("c", 1, "tool_calls", [("g", "{}")], ""),
        ],
        f"case_id string, step int, kind string, calls {CALLS}, output string",
    )
    expected = spark.createDataFrame(
        [("a", [("f", '{"y":2,"x":1}'), ("f", '{"x":4}')], "done"), ("b", [("f", "no json")], ""), ("c", [("f", "{}")], ""), ("d", [], "")],
        f"case_id string, calls {CALLS}, answer string",
    )
    out = evaluation.first_divergence(turns, expected)
    got = {r.case_id: (r.step, r.reason, r.primary_error, r.rejected) for r in out.collect()}
    none = (None, "no_actionable_first_divergence", None, None)
    assert got == {
        "a": (2, "selected", "invalid_argument", 'Action: f\nAction Input: {"x": "3"}'),
        "b": none,
        "c": (1, "selected", "wrong_action", "Action: g\nAction Input: {}"),
        "d": none,
    }
    assert plan(out).count("Window [") == 1


def test_same_calls_is_canonical_equality(spark):
    texts = [None, "", "{", "{}", '{"a":1}', '{ "a": 1 }', '{"a":1,"b":2}', '{"b":2,"a":1}', '{"b":2,"a":3}']
    rows = [([("f", x)], [(n, y)]) for x in texts for y in texts for n in ("f", "g", None)] + [(None, []), ([], []), ([], [("f", "{}")])]
    df = spark.createDataFrame(rows, f"a {CALLS}, b {CALLS}")
    a, b = F.col("a"), F.col("b")
    old = evaluation.canonical_calls(a) == evaluation.canonical_calls(b)
    assert df.where(~evaluation.same_calls(a, b).eqNullSafe(old)).count() == 0


def test_state_at_a_path_reads_the_document_once(spark):
    docs = ['{"a":{"b":"F"}}', '{"a":{"b":null}}', '{"a":[{"b":1}]}', '{"a":"{\\"b\\":1}"}', '{"a":null}', '{"c":1}', "[1]", "x", None, '{"a":{"b":{"d":2,"c":1.50}}}']
    df = spark.createDataFrame([(d, p) for d in docs for p in ("a", "a.b", "a.b.c", "x")], "doc string, path string")
    got = df.select(evaluation._at(F.col("doc"), F.col("path")).alias("x"))
    told = {(d, p): r.x for (d, p), r in zip([(d, p) for d in docs for p in ("a", "a.b", "a.b.c", "x")], got.collect(), strict=True)}
    assert {k: v for k, v in told.items() if v is not None} == {
        (docs[0], "a"): '{"b":"F"}', (docs[0], "a.b"): '"F"', (docs[1], "a"): '{"b":null}', (docs[1], "a.b"): "null", (docs[2], "a"): '[{"b":1}]',
        (docs[3], "a"): '"{\\"b\\":1}"', (docs[4], "a"): "null", (docs[9], "a"): '{"b":{"c":1.5,"d":2}}', (docs[9], "a.b"): '{"c":1.5,"d":2}', (docs[9], "a.b.c"): "1.5",
    }
    assert plan(got).count("to_json") <= 1 and "from_json" not in plan(got)


def test_rollouts_write_what_is_asked_for(spark):
    cases = spark.createDataFrame([("c", '{"EC-1":{"order_id":"EC-1"}}')], "case_id string, orders string")
    whole = policy.rollouts(cases, lambda case, messages: "done")
    some = policy.rollouts(cases, lambda case, messages: "done", columns=("final_answer", "case_id"))
    assert whole.columns == [c.split()[0] for c in policy.TRACE.split(", ")]
    assert some.columns == ["case_id", "final_answer"]
    assert some.collect() == whole.select(*some.columns).collect()
    with pytest.raises(ValueError):
        policy.rollouts(cases, lambda case, messages: "done", columns=("none",))


def test_copies_are_deep():
    class Own(dict):
        pass

    x = {"a": [1, {"b": None}], "t": ([1],), "o": Own(k=[2])}
    y = policy.copied(x)
    assert y == x == copy.deepcopy(x) and type(y["o"]) is Own
    y["a"][1]["b"], y["o"]["k"][0] = 5, 6
    y["t"][0].append(2)
    assert x == {"a": [1, {"b": None}], "t": ([1],), "o": {"k": [2]}}
