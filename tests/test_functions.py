import json

import pytest
from pyspark.sql import functions as F

from curatrix.functions import actions, dialogue, personal, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [("  A\t B\n", "a b"), ("Ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("", ""), (None, None)])
def test_normalised_text(spark, value, want):
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(text.normalized("t", nfkc=True).alias("x")).first().x == want


def test_cjk_words_are_joined(spark):
    assert one(spark, text.cleaned("t", join_cjk=True), t=" 我 要 退货 ") == "我要退货"
    assert one(spark, text.cleaned("t", join_cjk=True), t=" two words ") == "two words"


def test_canonical_json_and_paths(spark):
    assert one(spark, text.canonical_json("t"), t='{"b": 1, "a": {"d": 2, "c": null}}') == '{"a":{"c":null,"d":2},"b":1}'
    assert one(spark, text.dotted("t", "EC-1.x"), t='{"EC-1": {"x": null}}') == "null"
    assert one(spark, text.dotted("t", "EC-1.y"), t='{"EC-1": {"x": null}}') is None


@pytest.mark.parametrize(
    ("value", "want"),
    [("call 13800138000 now", ["cn_mobile"]), ("a.b@c.org", ["email"]), ("XXX@YYY.com", []), ("x 1234567890123456 y", ["bank_card"]), ("12345678901234567X", ["bank_card", "cn_id"]), ("sk-abcdefghijklmnop1", ["api_token"]), ("-----BEGIN RSA PRIVATE KEY-----", ["private_key"]), ("广东省深圳市南山路", ["cn_address"]), (None, [])],
)
def test_personal_data(spark, value, want):
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(personal.types("t").alias("x")).first().x == want


def test_transcript_parser(spark):
    chat = "USER: hi\n\nASSISTANT: <functioncall> {} <|endoftext|>\n\nFUNCTION RESPONSE: {}\n\nASSISTANT: done USER:  ASSISTANT: bye"
    got = one(spark, dialogue.parsed_chat("t"), t=chat)
    assert [(r.role, r.text) for r in got] == [("user", "hi"), ("assistant", "<functioncall> {}"), ("observation", "{}"), ("assistant", "done"), ("user", "ASSISTANT: bye")]


def turns(spark, *pairs):
    return spark.createDataFrame([([{"role": r, "text": t} for r, t in pairs],)], dialogue.TURNS.join(("turns ", "")))


def test_history_pairs(spark):
    df = turns(spark, ("system", "s"), ("assistant", "lost"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "dropped"), ("user", "open"))
    plain, open_ = df.select(dialogue.history("turns").alias("h"), dialogue.history("turns", keep_open=True).alias("o")).first()
    assert [tuple(p) for p in plain] == [("a\nb", "c")] and [tuple(p) for p in open_] == [("a\nb", "c"), ("open", "")]


def test_skeleton(spark):
    s = turns(spark, ("user", "为什么不行?"), ("assistant", "x"), ("user", "Oh!")).select(dialogue.skeleton("turns").alias("s")).first().s
    assert s.asDict() == {"source_turn_count": 3, "source_user_turn_count": 2, "source_assistant_turn_count": 1, "first_user_length_bucket": "short", "multi_turn": True, "has_question": True, "has_negation": True, "has_emphasis": True}


def test_adapters(spark):
    b = spark.createDataFrame([(" hi ", "yes", "c", "i", "f")], "instruction string, response string, category string, intent string, flags string")
    r = dialogue.ADAPTERS["bitext"](b).first()
    assert [t.text for t in r.turns] == ["hi", "yes"] and r.natural_group == "i:f" and json.loads(r.labels)["trajectory_type"] == "dialogue_pair"
    g = spark.createDataFrame([("sys", "USER: a ASSISTANT: <functioncall> x USER: b")], "system string, chat string")
    assert json.loads(dialogue.ADAPTERS["glaive"](g).first().labels)["trajectory_type"] == "multi_turn_call"
    c = spark.createDataFrame([([("Q", "我 要"), ("A", " ")], [("t2",), ("t1",)], "q", None, "d1")], "Dialogue array<struct<speaker:string,utterance:string>>, QA array<struct<Topic:string>>, QRole string, Session_id string, DialogueID string")
    r = dialogue.ADAPTERS["csds"](c).first()
    assert [tuple(t) for t in r.turns] == [("user", "我要")] and r.natural_group == "d1" and json.loads(r.labels)["topics"] == ["t1", "t2"]
    d = spark.createDataFrame([("7", [("customer", ["a", " b "]), ("helpdesk", [])], [(1,)])], "id string, turns array<struct<sender:string,utterances:array<string>>>, annotations array<struct<quality:int>>")
    r = dialogue.ADAPTERS["dch2"](d).first()
    assert [tuple(t) for t in r.turns] == [("user", "a\nb")] and json.loads(r.labels)["has_quality_scores"]


@pytest.mark.parametrize(
    ("output", "kind", "n"),
    [("Action: f\nAction Input: {\"a\": \"1\"}", "tool_calls", 1), ("Action: f Action Input: {\"a\":\"1\"}\nAction: g\nAction Input: `{}`", "tool_calls", 2), ("action : what", "malformed_action", 0), ("Action: f Action Input: {broken", "invalid_action_json", 1), ("Action: f Action Input: [1]", "action_input_not_object", 1), ("All fine.", "final", 0)],
)
def test_outputs(spark, output, kind, n):
    df = spark.createDataFrame([(output,)], "t string")
    r = df.select(actions.kind("t").alias("k"), F.size(actions.calls("t")).alias("n")).first()
    assert (r.k, r.n) == (kind, n)
    k, v = actions.parse(output)
    assert k == (kind if kind in ("tool_calls", "final") else "parse_error") and (k != "parse_error" or v == kind)


def test_first_action_and_codes(spark):
    assert one(spark, actions.first_action("t"), t='```json\n{"action": "look"}\n```') == "look"
    assert one(spark, actions.first_action("t"), t="hello") is None
    code = lambda t: one(spark, actions.observation_code("t"), t=t)
    assert [code('{"ok": true, "data": {}}'), code('{"ok": true, "data": {"reason_code": "R"}}'), code('{"ok": false, "error": {"code": "E"}}'), code("{}")] == ["OK", "R", "E", "UNKNOWN_ERROR"]
    args = '{"b": "x\\"y", "a": "1"}'
    assert one(spark, actions.formatted(F.lit("f"), "t"), t=args) == "Action: f\nAction Input: " + json.dumps(json.loads(args), sort_keys=True)
