import json

import pytest
from pyspark.sql import functions as F

from curatrix.functions import templates, toolformats
from curatrix.operators import audit, policy, selection, synthesis
from curatrix.sources import hub, sinks

CALLS = "array<struct<name:string,arguments:string>>"


def test_templates(spark):
    df = spark.createDataFrame([([("a", "b"), ("c", "d")], "be kind")], "p array<struct<user:string,assistant:string>>, s string")
    got = df.select(templates.prompt("p", "vicuna", F.col("s")).alias("v"), templates.prompt("p", "base").alias("b"), templates.dialog("p", "mistral").alias("m")).first()
    assert got.v == "be kind</s>USER: a ASSISTANT:b</s>USER: c ASSISTANT:d" and got.b == "ab</s>cd"
    assert got.m == ["[INST] a [/INST]", "b", "</s>[INST] c [/INST]", "d"]
    assert len(templates.TEMPLATES) == 33
    with pytest.raises(ValueError):
        templates.register("qwen", templates.Template("{query}", ""))


@pytest.mark.parametrize("name", ["default", "qwen", "mistral", "glm4", "llama3"])
def test_calls_are_read_as_written(spark, name):
    calls = [("look", '{"a": "x", "n": 1}')]
    df = spark.createDataFrame([(calls,)], f"c {CALLS}")
    out = df.select(toolformats.calls_text("c", name).alias("t")).select(toolformats.calls_read("t", name).alias("r")).first().r
    assert [(c.name, c.arguments) for c in out] == [("look", '{"a":"x","n":1}')]
    plain = spark.createDataFrame([("no call here",)], "t string")
    assert plain.select(toolformats.calls_read("t", name).alias("r")).first().r is None


def test_parallel_calls(spark):
    df = spark.createDataFrame([([("f", "{}"), ("g", "{}")],)], f"c {CALLS}")
    for name in ("default", "qwen", "mistral"):
        got = df.select(toolformats.calls_text("c", name).alias("t")).select(toolformats.calls_read("t", name).alias("r")).first().r
        assert [c.name for c in got] == ["f", "g"]
    with pytest.raises(Exception, match="parallel"):
        df.select(toolformats.calls_text("c", "glm4")).collect()


def test_tool_lists():
    tool = {"name": "f", "description": "d", "parameters": {"properties": {"a": {"type": "string", "description": "x", "enum": ["p", "q"]}}, "required": ["a"]}}
    assert "  - a (string, required): x, should be one of [p, q]\n" in toolformats.tool_list([tool], "default")
    assert "Today Date: 01 Jan 2024" in toolformats.tool_list([tool], "llama3", "01 Jan 2024")
    assert json.loads(toolformats.tool_list([tool], "mistral")[len("[AVAILABLE_TOOLS] ") : -len("[/AVAILABLE_TOOLS]")])[0]["function"] == tool


def test_messages_labels_and_limits(spark):
    turns = [("system", "s1"), ("human", "hi"), ("function_call", '{"name":"f","arguments":{"a":"1"}}'), ("observation", "ok"), ("gpt", "done")]
    df = spark.createDataFrame([(turns,)], "t array<struct<`from`:string,value:string>>")
    got = df.select(toolformats.chat_messages("t", " tools", "qwen").alias("m")).first().m
    assert [m.role for m in got] == ["system", "user", "assistant", "user", "assistant"] and got[0].content == "s1 tools" and got[2].content.startswith("<tool_call>")
    ids = spark.createDataFrame([([[1, 2], [3, 4, 5, 6]], [[7], [8, 9]])], "s array<array<int>>, t array<array<int>>")
    r = ids.select(toolformats.masked_labels("s", "t", 6).alias("x")).first().x
    assert r.input_ids == [1, 2, 7, 3, 4, 8] and r.labels == [-100, -100, 7, -100, -100, 8]
    flags = ids.select(toolformats.learnable(F.array(F.lit(-100))).alias("a"), toolformats.within_tokens(1, F.col("s")[0]).alias("b"), toolformats.within_tokens(2, F.col("s")[0]).alias("c")).first()
    assert tuple(flags) == (False, False, True)


def test_oracles_pass_their_own_replay(spark):
    assert [r.errors for r in synthesis.replayed(spark).collect() if not r.passed] == []
    o = {r.category: r for r in synthesis.oracles(spark).collect()}
    assert o["create"].codes == ["OK", "ELIGIBLE", "OK"] and o["timeout"].codes == ["UPSTREAM_TIMEOUT"] and o["expired"].codes == ["OK", "RETURN_WINDOW_EXPIRED"]


def test_cases_and_trajectories(spark):
    prompts = {s: (f"{s} one", f"{s} two") for s in synthesis.SCENARIOS}
    got = synthesis.cases(spark, prompts, [("", "please: "), (".", "!")], 60).collect()
    assert [sum(r.tier == t for r in got) for t in ("basic", "complex", "adversarial")] == [30, 15, 15] and all(r.prompt for r in got)
    ev = spark.createDataFrame([(str(i), i % 2, "train", "", "multi_call") for i in range(30)], "record string, variant int, split string, intent string, trajectory string")
    a = synthesis.trajectories(ev).orderBy("parent_id").collect()
    b = synthesis.trajectories(ev.repartition(5)).orderBy("parent_id").collect()
    assert a == b and {r.scenario for r in a} == {"damaged_exchange", "wrong_item_return", "identity_required"}
    for r in a:
        kinds = [t["from"] for t in r.conversations]
        assert kinds[0] == "human" and kinds[-1] == "gpt" and kinds.count("function_call") == kinds.count("observation")


def test_small_selections(spark):
    df = spark.range(40).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    first, rest = selection.head_split(df, 25, "id")
    assert [r.id for r in first.orderBy("id").collect()] == list(range(10)) and rest.count() == 30
    pairs = spark.createDataFrame([(i, i + j) for i in range(5) for j in (1, 2)], "a long, b long")
    some, more = selection.capped_pairs(pairs, "a", "b", 3)
    assert [tuple(r) for r in some.collect()] == [(0, 1), (0, 2), (1, 2)] and more
    levels = df.withColumn("level", F.element_at(F.array(*map(F.lit, ("response", "decision", "parameter"))), (F.col("id") % 3 + 1).cast("int"))).withColumn("kind", F.when(F.col("id") % 2 == 0, "action").otherwise("response"))
    got = selection.balanced_preferences(levels, "level", "kind", 20, F.col("h"), "id").groupBy("level").count().collect()
    assert {r.level: r["count"] for r in got} == {"response": 8, "decision": 5, "parameter": 7}


def test_rule_sets(spark):
    rows = [(1, [("human", "x"), ("function_call", '{"name":"f"}')], "a", "a"), (2, [("human", "x"), ("observation", "o"), ("gpt", "y")], "a", "b")]
    df = spark.createDataFrame(rows, "id long, t array<struct<`from`:string,value:string>>, c string, r string")
    assert {(r.id, r.code) for r in audit.issues(df, ["id"], audit.smoke_rules("t", ("f",))).collect()} == {(1, "call_without_observation")}
    codes = df.select(audit.precheck_codes("t", ("f",), "c", "r").alias("x")).collect()
    assert [r.x for r in codes] == [["identical_pair", "missing_final_answer", "unpaired_tool_turn"], ["unpaired_tool_turn"]]
    assert df.select(audit.names_tools(F.lit("please query_order_status"), tuple(policy.TOOLS)).alias("x")).first().x


def test_pinned_rows_and_manifest(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1/a.jsonl").write_text('{"x": 1, "y": "a"}\n\n{"x": 2}\n')
    spark.dataSource.register(hub.PinnedRows)
    read = spark.read.format("pinned_rows").option("root", str(tmp_path)).schema("y string, x long")
    assert sorted((r.x, r.y) for r in read.option("revision", "r1").load().collect()) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="no such revision"):
        read.option("revision", "r2").load().collect()
    m = sinks.run_manifest(spark, {"in": str(tmp_path / "r1")}, {"seed": 1})
    assert len(m["inputs"]["in"]) == 64
