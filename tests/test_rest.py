"""Joins of runs, ids and strata, training turns, reports, made preferences and cases."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from curatrix.functions import personal, toolformats
from curatrix.operators import audit, casesets, evaluation, guards, policy, runs, selection, synthesis


def test_rows_that_pairs_are_mined_from(spark):
    df = lambda rows, c: spark.createDataFrame(rows, f"case_id long, {c} string")
    cases, oracles, traces, results = df([(1, "a"), (2, "b")], "text"), df([(1, "o"), (2, "p"), (3, "q")], "x"), df([(2, "t"), (1, "u")], "y"), df([(1, "r"), (2, "s")], "z")
    got = runs.mining_rows(cases, oracles, traces, results).orderBy("case_id").collect()
    assert [(r.text, r.oracle.x, r.trace.y, r.result.z) for r in got] == [("a", "o", "u", "r"), ("b", "p", "t", "s")]
    for bad in (traces.limit(1), traces.union(traces)):
        with pytest.raises(ValueError):
            runs.mining_rows(cases, oracles, bad, results)
    items = spark.createDataFrame([(1, ("a", ["old"]))], "case_id long, sft struct<answer:string,observations:array<string>>")
    seen = spark.createDataFrame([(1, ["o"], "final_answer", [])], "case_id long, observations array<string>, termination_reason string, parse_errors array<string>")
    r = runs.with_trace_evidence(items, {"sft": seen}).first()
    assert r.sft.asDict() == {"answer": "a", "observations": ["o"], "termination_reason": "final_answer", "parse_errors": []}
    with pytest.raises(ValueError):
        runs.with_trace_evidence(items, {"sft": seen.limit(0)})


def test_ids_strata_and_levels(spark):
    df = spark.createDataFrame([("sft", "s", "c", "train", None, None, 7), ("dpo", "s", "c", "train", "decision", None, 1234)], "task string, source string, scenario string, split string, level string, error string, n int")
    got = df.select(runs.stratum("task", "source", "scenario", "split", "level", "error").alias("s"), runs.review_id("n").alias("r"), runs.pair_id("1.3", F.lit("c"), "n").alias("p")).collect()
    assert [tuple(r) for r in got] == [("s|c|train", "R007", "dpo-v1.3-rollout-c-step7"), ("s|c|train|decision|unknown", "R1234", "dpo-v1.3-rollout-c-step1234")]
    assert [r.l for r in df.select(runs.level_of("level", F.lit("response")).alias("l")).collect()] == ["response", "decision"]
    with pytest.raises(Exception, match="unsupported preference level"):
        df.select(runs.level_of("level")).collect()


def turns_by_hand(pairs, limit, end, ignore=-100):
    ids, labels = [], []
    for s, t in pairs:
        if not s and not t:
            continue
        n, m = len(s), len(t)
        s, t = s[: int(limit * (n / (n + m)))], (t[: max(0, int(limit * (m / (n + m))) - 1)] if m > int(limit * (m / (n + m))) - 1 else t)
        s, t = s[1:] if s[:1] == [end] else s, t[:-1] if t[-1:] == [end] else t
        if len(ids) + len(s) + len(t) + 1 > limit:
            break
        ids += s + t + [end]
        labels += [ignore] * len(s) + t + [end]
    return ids, labels


def test_trained_turns(spark):
    rng = random.Random(3)
    rows = [([[rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(3)], [[rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(3)]) for _ in range(80)]
    df = spark.createDataFrame(rows, "s array<array<int>>, t array<array<int>>")
    for limit in (5, 16, 60):
        got = df.select(toolformats.trained_turns("s", "t", limit, 2).alias("x")).collect()
        assert [(r.x.input_ids, r.x.labels) for r in got] == [turns_by_hand(zip(s, t, strict=True), limit, 2) for s, t in rows]


def test_reduced_personal_data(spark):
    rows = [("call 13800138000", True), ("id 13800138000x", False), ("a@b.co", True), ("11010119900307771X.", True), (None, False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", personal.in_case("t")).collect())


def test_shuffles_slices_and_merges(spark):
    df = spark.range(200)
    want = sorted(range(200), key=lambda i: hashlib.sha256(f"7:{i}".encode()).hexdigest())
    assert [r.id for r in selection.shuffled(df.repartition(7), "7", "id").collect()] == want and [r.id for r in selection.shuffled(df, "7", "id", 5).collect()] == want[:5]
    held, train = selection.seeded_split(df, 0.2, "7", "id")
    assert 20 < held.count() < 60 and held.union(train).distinct().count() == 200
    keyed = df.withColumn("k", F.col("id") % 3)
    assert selection.numbered_slice(keyed, "k", ["id"], 60, 6, whole=True).count() == 18
    with pytest.raises(ValueError):
        selection.numbered_slice(keyed, "k", ["id"], 60, 7, whole=True)
    cases = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "case string, place int")
    parts = [spark.createDataFrame([(c, c.upper())], "case string, v string") for c in "cab"]
    assert [r.v for r in selection.merged(parts, cases, "case", "place").collect()] == ["B", "A", "C"]


def test_null_groups_have_quotas(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "g", None if i % 2 else "h") for i in range(40)], "id long, a string, b string")
    got = selection.proportional_subset(df, "a", 20, F.col("id"), "id").groupBy("a").count().collect()
    assert {r.a: r["count"] for r in got} == {None: 5, "g": 15}
    assert selection.two_level_subset(df, "a", "b", 20, F.col("id"), "id").count() == 20
    split = selection.greedy_group_split(df, "a", "s")
    assert split.count() == 40 and split.where("a is null").select("split").distinct().count() == 1


def test_audit_gates_and_report(spark):
    kind = "id string, g string, split string, turns array<struct<`from`:string,value:string>>, source_id string"
    turns = [("human", "one two three"), ("gpt", "four five")]
    empty = audit.audit(spark.createDataFrame([], kind), "turns", "id", "g", "split", ())
    assert [(r.code, r.severity, r.message) for r in empty.collect()] == [("empty_dataset", "error", "the dataset has no rows")] and not audit.passes(empty)
    far = [("human", "a quite different question"), ("gpt", "with an answer of its own")]
    df = spark.createDataFrame([("a", "g", "train", turns, ""), ("b", "h", "train", far, "s")], kind)
    for strict, severity in ((True, "error"), (False, "warning")):
        issues = audit.audit(df, "turns", "id", "g", "split", (), required=("source_id",), strict=strict)
        assert [(r.code, r.severity, r.key) for r in issues.collect()] == [("missing_metadata", severity, "a")] and audit.passes(issues) != strict
    near = spark.createDataFrame([(str(i), str(i), "train", [("human", "x y" + " " * i + "z" * 9 + "."), ("gpt", f"{'a b' if i % 2 else 'ab'} c")], "s") for i in range(2)], kind)
    codes = lambda most: sorted(r.code for r in audit.audit(near, "turns", "id", "g", "split", (), most_pairs=most).collect())
    assert codes(5) == ["near_duplicate"] and codes(0) == ["near_duplicates_truncated"]
    issues = audit.audit(df, "turns", "id", "g", "split", (), required=("source_id",))
    r = audit.report(df, issues, "split", F.to_json("turns"), "source_id").first()
    assert r.row_count == 2 and not r.passed and r.split_counts == {"train": 2} and r.source_counts == {"": 1, "s": 1} and r.issue_counts == {"missing_metadata": 1} and r.severity_counts == {"error": 1}


def made(spark, n=240):
    rows = [(f"r{i}", i % 3, ("train", "validation", "test")[i % 3], ("", "damage", "wrong", "missing", "return")[i % 5], ("multi_call", "multi_turn_call", "single_call", "no_call", "x")[i % 4]) for i in range(n)]
    return synthesis.trajectories(spark.createDataFrame(rows, "record string, variant int, split string, intent string, trajectory string"))


def test_made_conversations_replay(spark):
    """Each conversation's calls, made again on a simulator of its own, are answered as it says."""
    rows = made(spark).collect()
    assert {r.scenario for r in rows} == set(synthesis.CASES)
    for r in rows:
        order = synthesis.CASE_SPECS[r.scenario][0]
        own = "EC-GEN-" + hashlib.sha256(r.parent_id.encode()).hexdigest()[:10].upper()
        state = json.loads(json.dumps(synthesis.ORDERS[order]).replace(order, own)) if order else None
        if state and state["after_sales_request"]:
            state["after_sales_request"]["order_id"] = own
        sim = policy.Simulator({own: state} if state else {})
        calls = [json.loads(t.value) for t in r.conversations if t["from"] == "function_call"]
        seen = [json.loads(t.value) for t in r.conversations if t["from"] == "observation"]
        assert [sim.call(c["name"], c["arguments"]) for c in calls] == seen
        assert r.conversations[0]["from"] == "human" and r.conversations[-1].value == r.answer and r.answer != r.rejected
        assert all(x["data"]["request_id"] in r.answer and x["data"]["request_id"] in r.rejected for x in seen if x["ok"] and x["tool"] == "create_after_sales_request")
    assert audit.audit(made(spark).withColumn("split", F.lit("train")), "conversations", "sample_id", "record", "split", tuple(policy.TOOLS)).where("code not like '%duplicate%' and code <> 'group_split_leakage'").count() == 0


def test_preferences_of_conversations(spark):
    rows = {r.sample_id.replace("sft", "dpo"): r for r in made(spark).collect()}
    pairs = synthesis.preferences(made(spark)).collect()
    assert len({p.sample_id for p in pairs}) == len(pairs)
    per = {}
    for p in pairs:
        base = next(k for k in rows if p.sample_id.startswith(k + "-"))
        r = rows[base]
        per.setdefault(base, []).append(p)
        assert p.prompt == r.conversations[: p.target] and p.chosen != p.rejected
        assert p.chosen_kind == ("action" if p.chosen.startswith("Action:") else "response")
        at = r.conversations[p.target]
        if at["from"] == "function_call":
            call = json.loads(at.value)
            assert p.chosen == f"Action: {call['name']}\nAction Input: {json.dumps(call['arguments'], ensure_ascii=False, sort_keys=True)}"
        else:
            assert p.chosen == r.answer
    for base, own in per.items():
        calls = sum(t["from"] == "function_call" for t in rows[base].conversations)
        assert sorted(p.level for p in own) == sorted(["response", "decision"] + ["decision"] * max(0, calls - 1) + ["parameter"] * calls)
        assert {p.primary_error for p in own if p.level == "parameter"} <= {"invalid_argument"} and all(p.rejected for p in own)


def evidence(spark, n):
    rows = [("made", f"r{i}", f"g{i}", "test" if i % 2 == 0 else "train", [("user", "why?"), ("assistant", "so"), ("user", "ok")][: 1 + 2 * (i % 3 == 0)]) for i in range(n)]
    return spark.createDataFrame(rows, "source_id string, record string, parent_id string, split string, turns array<struct<role:string,text:string>>")


def test_cases_of_evidence(spark):
    got = synthesis.candidates(evidence(spark, 120), 40, 10)
    rows = sorted(got.collect(), key=lambda r: r.idx)
    order = sorted((i for i in range(0, 120, 2)), key=lambda i: hashlib.sha256(f"prefreeze-v1:made:r{i}:g{i}".encode()).hexdigest())
    assert [r.record for r in rows] == [f"r{i}" for i in order[10:50]] and [r.tier for r in rows] == ["iid"] * 20 + ["compositional"] * 10 + ["challenge"] * 10
    assert [r.category for r in rows[:5]] == ["status", "policy", "create", "missing_order", "status"] and {len(r.messages) for r in rows} == {1, 3}
    one = rows[0]
    assert one.case_id == "PF1-IID-" + hashlib.sha256(f"1.0.0:iid:status:made:{one.record}".encode()).hexdigest()[:16]
    assert one.messages[-1].content == synthesis.TONES[2] + synthesis.PROMPTS["status"][10 % 4] + "" + ""
    assert synthesis.case_issues(got).count() == 0 and synthesis.with_oracles(got).where("goal is null").count() == 0
    again = got.union(got.limit(1).withColumn("messages", F.expr("array(named_struct('role', 'assistant', 'content', 'query_order_status 13800138000'))")))
    assert {r.code for r in synthesis.case_issues(again).collect()} == {"duplicate_case_id", "duplicate_source_parent", "invalid_messages", "pii_detected", "tool_name_leakage"}
    mined = synthesis.candidates(evidence(spark, 120), 12, purpose="training_mining", strata={("iid", "create"): 7, ("challenge", "timeout"): 5}).collect()
    assert [r.category for r in sorted(mined, key=lambda r: r.idx)] == ["create"] * 7 + ["timeout"] * 5 and all(r.case_id.startswith("RM1-") for r in mined)
    for bad in ({"limit": 11}, {"limit": 61}, {"limit": 12, "offset": -1}, {"limit": 12, "purpose": "x"}, {"limit": 12, "strata": {("iid", "x"): 12}}):
        with pytest.raises(ValueError):
            synthesis.candidates(evidence(spark, 120), **bad)
    leak = evidence(spark, 40).withColumn("parent_id", F.lit("g"))
    with pytest.raises(ValueError, match="several splits"):
        synthesis.candidates(leak, 12)


def test_fixed_case_sets(spark):
    dev = {r.case_id: r for r in casesets.dev_cases(spark).collect()}
    assert len(dev) == 9 and dev["RD1-CREATE"].codes == ["OK", "ELIGIBLE", "OK"] and dev["RD1-TOOL-FAILURE"].codes == ["UPSTREAM_TIMEOUT"]
    frozen = casesets.frozen_cases(spark)
    rows = {r.case_id: r for r in frozen.collect()}
    assert len(rows) == 100 and rows["FZ1-POLICY-002"].codes == ["OK", "ELIGIBLE", "IDENTITY_NOT_VERIFIED"] and rows["FZ1-HALLUCINATION-000"].codes == ["ORDER_NOT_FOUND"]
    assert rows["FZ1-TOOL-000"].allowed_claims["after_sales_status"] == '"submitted"' and rows["FZ1-MISSING-000"].calls == []
    said = frozen.select("case_id", "calls", "codes", "terminal_status", F.col("allowed_claims").alias("claimed_facts"))
    assert evaluation.exact_checks(frozen, said).where("not passed").count() == 0


def test_guards():
    assert (guards.positive("n", 3), guards.fraction("p", 0.5), guards.one_of("k", "a", "ab"), guards.fraction("p", 1, open_high=False)) == (3, 0.5, "a", 1)
    assert guards.shares("s", {"a": 0.1, "b": 0.2, "c": 0.7}) and guards.consistent("m", {"a": 1}, {"a": 1}) is None
    for call in (
        lambda: guards.positive("n", 0),
        lambda: guards.positive("n", True),
        lambda: guards.positive("n", 1.0),
        lambda: guards.fraction("p", 0),
        lambda: guards.fraction("p", 1.5, open_high=False),
        lambda: guards.shares("s", {"a": 0.5}),
        lambda: guards.shares("s", {}),
        lambda: guards.one_of("k", "c", "ab"),
        lambda: guards.consistent("m", {"a": 1, "b": None}, {"a": 1}),
    ):
        with pytest.raises(ValueError):
            call()


def test_trajectories_of_one_partition_are_spread(spark):
    from curatrix.operators import synthesis

    rows = [(str(i), 0, "train", "damage", "single_call") for i in range(50)]
    evidence = spark.createDataFrame(rows, "record string, variant int, split string, intent string, trajectory string").coalesce(1)
    assert synthesis.trajectories(evidence).rdd.getNumPartitions() == 4
