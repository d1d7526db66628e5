import hashlib
import random
import sys
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from curatrix.functions import text
from curatrix.operators import audit, dedup, evaluation, metrics, policy, selection


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_largest_remainders(spark):
    def quotas(total, **shares):
        df = spark.createDataFrame(list(shares.items()), "k string, w double")
        return {r.k: r.quota for r in selection.largest_remainder(df, F.col("w"), total, "k").collect()}

    shares = {"must_continue": 0.36, "must_stop": 0.36, "parameter": 0.0, "response": 0.04, "wrong_action": 0.24}
    assert quotas(720, **shares) == {"must_continue": 259, "must_stop": 259, "parameter": 0, "response": 29, "wrong_action": 173}
    assert quotas(80, **shares) == {"must_continue": 29, "must_stop": 29, "parameter": 0, "response": 3, "wrong_action": 19}


def test_greedy_group_split(spark):
    rng = random.Random(1)
    rows = [(i, f"g{rng.randrange(60)}" if i % 3 else "big") for i in range(400)]
    sizes = Counter(g for _, g in rows)
    names, target, got, want = ("train", "validation", "test"), (320.0, 40.0, 40.0), [0.0] * 3, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], sha(f"salt:{x[0]}"))):
        cost = [sum(abs(got[j] + n * (j == i) - target[j]) for j in range(3)) for i in range(3)]
        i = cost.index(min(cost))
        got[i] += n
        want[g] = names[i]
    df = spark.createDataFrame(rows, "id long, g string")
    out = selection.greedy_group_split(df, "g", "salt").collect()
    assert {r.g: r.split for r in out} == want and len(out) == 400
    single = selection.greedy_group_split(spark.range(100).withColumn("g", F.col("id").cast("string")), "g", "s")
    assert {r.split: r["count"] for r in single.groupBy("split").count().collect()} == {"train": 80, "validation": 10, "test": 10}


def test_capped_selection_against_a_walk(spark):
    rng = random.Random(4)
    for case in range(3):
        rows = [(i, rng.choice("abc"), rng.choice("pqrs") + str(rng.randrange(3)), round(rng.random(), 2)) for i in range(60)]
        targets = {"a": 5, "b": 8, "c": 4}
        have = Counter(r[1] for r in rows)
        used, want = Counter(), []
        for b in sorted(targets, key=lambda b: (have[b] / targets[b], b)):
            n = 0
            for r in sorted((r for r in rows if r[1] == b), key=lambda r: (r[3], r[0])):
                if n < targets[b] and used[r[2]] < 2:
                    used[r[2]] += 1
                    n += 1
                    want.append(r[0])
        df = spark.createDataFrame(rows, "id long, b string, p string, m double").repartition(case + 1)
        got = selection.capped_selection(df, "b", targets, "m", "p", 2, "id")
        assert sorted(r.id for r in got.collect()) == sorted(want)
    with pytest.raises(ValueError):
        selection.capped_selection(df, "b", {"a": 1000}, "m", "p", 2, "id")


def test_shards_and_merge(spark):
    df = spark.range(11).withColumn("x", -F.col("id"))
    out = selection.shards(df, 4, "x")
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [2, 3, 3, 3]
    parts = [out.where(F.col("shard") == i) for i in range(4)]
    assert selection.merged(parts, df, "id").count() == 11
    for bad in ([parts[0]] * 2 + parts[1:], parts[1:]):
        with pytest.raises(ValueError):
            selection.merged(bad, df, "id")


def simhash_brute(t):
    t = "".join(t.split())
    if not t:
        return 0
    grams = [t] if len(t) <= 4 else [t[i : i + 4] for i in range(len(t) - 3)]
    h = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) >= len(h))


def test_simhash_and_greedy_near_dedup(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdef ") for _ in range(200)) for _ in range(6)]
    texts = ["", " ", "abc"] + [b[:k] + rng.choice("xyz") + b[k:] for b in base for k in rng.sample(range(200), 8)] + base
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("fp", dedup.simhash("t"))
    prints = {r.id: r.fp % (1 << 64) for r in df.collect()}
    assert prints == {i: simhash_brute(t) for i, t in enumerate(texts)}
    order = sorted(prints, key=lambda i: (sha(str(i)), i))
    kept = []
    for i in order:
        if all((prints[i] ^ prints[j]).bit_count() > 3 for j in kept):
            kept.append(i)
    got = dedup.near_keep(df, "id", "fp", text.rank("id"))
    assert sorted(r.id for r in got.where("accepted").collect()) == sorted(kept) and got.count() == len(texts)
    pairs = {(min(a, b), max(a, b)) for a in prints for b in prints if prints[a] != prints[b] and (prints[a] ^ prints[b]).bit_count() <= 3}
    assert {(r.left_id, r.right_id) for r in dedup.banded_pairs(df, "id", "fp").collect()} == pairs


def test_null_beside_texts_leaves_their_fingerprints(spark):
    texts = ["some words to hash", None, "other words"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    got = {r.id: r.fp for r in df.select("id", dedup.simhash("t").alias("fp")).collect()}
    assert got[1] is None and all(got[i] % (1 << 64) == simhash_brute(texts[i]) for i in (0, 2))


@pytest.mark.parametrize("slots, piece, pieces", [(1 << 20, 1 << 16, 256), (4, 7, 3), (2, 1, 1)])
def test_fingerprints_of_odd_texts(monkeypatch, slots, piece, pieces):
    """Texts cut in pieces, grams that share a slot, characters of more than 16 bits, zeros, and null."""
    monkeypatch.setattr(dedup, "SLOTS", slots)
    monkeypatch.setattr(dedup, "PIECE", piece)
    monkeypatch.setattr(dedup, "PIECES", pieces)
    rng = random.Random(5)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [some("abc\0 \u00e9\uffff", n) for n in range(30)] + [some("a\0\U0001f600\U0001f601 \U0010ffff", n) for n in range(30)]
    texts += [None, "", " \u3000", "abcd", "\0", "\0" * 4, "\0" * 5, "\uffff" * 6, "\U0001f600", "\U0001f600" * 4, "ab\U0001f600\0\0cd", some("abcdef", 70_000 if piece > 7 else 500)]
    for size in (7, 100):
        batches = [pd.Series(texts[i : i + size], dtype=object) for i in range(0, len(texts), size)] + [pd.Series([], dtype=object)]
        got = [None if pd.isna(v) else v % (1 << 64) for b in dedup.simhash.func(iter(batches)) for v in b.tolist()]
        assert got == [None if t is None else simhash_brute(t) for t in texts]


def test_calls_for_fingerprints_grow_with_texts_and_grams_not_with_characters():
    """50 texts of 4,000 characters have 512 different grams; a look-up in Python for each text's grams took 61,499 calls."""
    rng = random.Random(6)
    texts = pd.Series(["".join(rng.choice("abcdefgh"[k % 2 :: 2] + " ") for _ in range(4000)) for k in range(50)])
    calls = [0]

    def count(*_):
        calls[0] += 1

    sys.setprofile(count)
    try:
        list(dedup.simhash.func(iter([texts[:25], texts[25:]])))
    finally:
        sys.setprofile(None)
    assert calls[0] < 15_000


def test_fingerprints_need_no_normalized_white_space(spark):
    """All that counts as white space there is left out of a fingerprint anyway."""
    every = spark.createDataFrame([(f"x{chr(c)}y",) for c in range(0x10000) if not 0xD800 <= c < 0xE000], "t string")
    blank = [r.t[1] for r in every.where(text.normalized("t") == "x y").collect()]
    assert len(blank) > 20 and all(c.isspace() for c in blank)
    odd = spark.createDataFrame([(f"{c} Some{c}{c}Words \u0130\u03a3{c}to\u03a3 hash{c}",) for c in blank] + [(None,), (" ",)], "t string")
    assert odd.where(~dedup.simhash(F.lower("t")).eqNullSafe(dedup.simhash(text.normalized("t")))).count() == 0


def test_near_pair_of_one_bit(spark):
    df = spark.createDataFrame([(0, 0), (1, 1)], "id long, fp long")
    assert [tuple(r) for r in dedup.banded_pairs(df, "id", "fp").collect()] == [(0, 1, 1)]


def test_near_links_hold_every_pair_of_different_contents(spark):
    rows = [(0, "h0", 5), (1, "h1", 5), (2, "h1", 5), (3, "h2", 7), (4, "h3", 7), (5, "h4", 1 << 40), (6, "h5", 5), (7, "h4", 1 << 40), (8, None, None)]
    df = spark.createDataFrame(rows, "id long, h string, fp long")
    want = {(i, j, (p ^ q).bit_count()) for i, h, p in rows[:-1] for j, k, q in rows[:-1] if i < j and h != k and (p ^ q).bit_count() <= 3}
    assert (0, 1, 0) in want and {tuple(r) for r in dedup.banded_pairs(df, "id", "fp", hash_col="h").collect()} == want
    found = dedup.near_links(df, "id", "h", "fp").collect()
    lead = {k: {r.id: r.near_id for r in found if r.kind == k} for k in ("copy", "fingerprint")}
    content = {i: lead["copy"].get(i, i) for i in range(8)}
    head = {i: lead["fingerprint"].get(c, c) for i, c in content.items()}
    bits = {(r.near_id, r.id): r.bits for r in found if r.kind == "near"}
    got = set()
    for i in range(8):
        for j in range(i + 1, 8):
            d = 0 if head[i] == head[j] else bits.get((min(head[i], head[j]), max(head[i], head[j])))
            if content[i] != content[j] and d is not None:
                got.add((i, j, d))
    assert got == want and len(found) == 7


def test_near_pairs_query_names_documents_of_one_fingerprint(spark, tmp_path):
    from curatrix.plans import catalogue

    spark.createDataFrame([(1, "ab cdefgh"), (2, "abc defgh"), (3, "something else"), (4, "AB  cdefgh"), (5, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in catalogue.QUERIES["simhash_near_pairs"](spark, str(tmp_path)).select("doc_id", "class_id", "n_copies", "n_same").collect()}
    assert got == {(1, 1, 1, 1), (2, 1, 0, 1), (3, 3, 0, 0), (4, 1, 1, 1), (5, 5, None, None)}


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
@pytest.mark.parametrize("pairwise", [1000, 3])
def test_classes_of_near_fingerprints(spark, monkeypatch, distance, pairwise):
    monkeypatch.setattr(dedup, "PAIRWISE", pairwise)
    rng, prints = random.Random(distance), set()
    for base in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(60):
            p = base
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(0, 64, 3)
            prints.add(p)
    prints = sorted(prints) + [0, 1, (1 << 64) - 1]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(i, f"h{i}", dedup._signed(p)) for i, p in enumerate(prints)], "id long, h string, fp long")
    got = {r.id: r.class_id for r in dedup.near_classes(df, "id", "h", "fp", distance).collect()}
    assert got == {i: find(i) for i in range(len(prints))}


def test_audit_names_leakage(spark):
    schema = "id string, g string, split string, turns array<struct<`from`:string,value:string>>"
    ok = [("human", "where is it"), ("gpt", "on its way")]
    bad = [("human", "call 13800138000"), ("function_call", '{"name": "delete_order"}'), ("gpt", "done")]
    rows = [("a", "g1", "train", ok), ("a", "g1", "test", ok), ("c", "g2", "elsewhere", bad), ("d", "g3", "train", [])]
    issues = audit.audit(spark.createDataFrame(rows, schema), "turns", "id", "g", "split", tuple(policy.TOOLS))
    codes = {r.code for r in issues.collect()}
    assert {"duplicate_sample_id", "group_split_leakage", "content_split_leakage", "pii_detected", "unknown_tool", "unpaired_tool_turn", "unknown_split", "empty_conversation"} <= codes
    clean = [("a", "g1", "train", ok), ("b", "g2", "validation", [("human", "another question here"), ("gpt", "a very different answer")])]
    assert audit.audit(spark.createDataFrame(clean, schema), "turns", "id", "g", "split", ()).count() == 0


def test_null_keys_keep_their_rows(spark, tmp_path):
    from curatrix.plans import catalogue

    spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in catalogue.QUERIES["exact_dedup_keep_first"](spark, str(tmp_path)).select("doc_id", "duplicate_of").collect()}
    assert got == {(1, None), (2, None), (3, 1), (4, 2)}
    rows = catalogue.QUERIES["first_match_rejection"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.reason for r in rows} == {1: "incomplete", 2: "accepted", 3: "incomplete", 4: "exact_duplicate"}
    groups = spark.createDataFrame([(i, "g" if i % 2 else None) for i in range(10)], "id long, g string")
    split = selection.greedy_group_split(groups, "g", "salt")
    assert sorted(r.id for r in split.collect()) == list(range(10)) and split.select("g", "split").distinct().count() == 2


def test_audit_names_near_copies_in_and_over_splits(spark):
    rng = random.Random(4)
    rows = [(f"h{rng.randrange(30)}", s) for s in rng.choices(("train", "validation", "test", None), k=80)]
    fp = {f"h{i}": (1 << 20 * (i % 3)) | (i % 5 == 0) << 40 | i // 6 << 50 for i in range(30)}
    want = set()
    for h, s in rows:
        for k, t in rows:
            if h != k and (fp[h] ^ fp[k]).bit_count() <= 3:
                key = "/".join(f"{x:X}" for x in sorted((fp[h], fp[k])))
                want.add(("near_duplicate", "warning", key) if s == t else ("near_duplicate_split_leakage", "error", key))
    got = audit.near_issues(spark.createDataFrame([(h, fp[h], s) for h, s in rows], "hash string, fp long, split string"), 3).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {c for c, _, _ in want} == {"near_duplicate", "near_duplicate_split_leakage"}
    # Blanks are left out of fingerprints: other contents of one fingerprint, in two splits and in one.
    schema = "id string, g string, split string, turns array<struct<`from`:string,value:string>>"
    turns = lambda t: [("human", t), ("gpt", "on its way")]
    for splits, code in ((("train", "validation"), "near_duplicate_split_leakage"), (("train", "train"), "near_duplicate")):
        df = spark.createDataFrame([("a", "g1", splits[0], turns("where is it")), ("b", "g2", splits[1], turns("whe reis it"))], schema)
        issues = audit.audit(df, "turns", "id", "g", "split", ())
        assert [r.code for r in issues.collect()] == [code] and audit.passes(issues) == (code == "near_duplicate")


ORDER = {"order_id": "EC-1", "payment_status": "paid", "fulfillment_status": "delivered", "days_since_delivery": 2, "identity_verified": True, "item_summary": "x"}


@pytest.mark.parametrize(
    ("change", "call", "code"),
    [
        ({}, ("query_order_status", {"order_id": "EC-1"}), "OK"),
        ({}, ("query_order_status", {"order_id": "EC-2"}), "ORDER_NOT_FOUND"),
        ({}, ("query_order_status", {"order_id": "bad"}), "INVALID_ARGUMENTS"),
        ({}, ("steal", {}), "UNKNOWN_TOOL"),
        ({"tool_failures": {"query_order_status": {"code": "TIMEOUT", "retryable": True}}}, ("query_order_status", {"order_id": "EC-1"}), "TIMEOUT"),
        ({"days_since_delivery": 8}, ("check_return_policy", {"order_id": "EC-1", "issue_type": "no_reason"}), "RETURN_WINDOW_EXPIRED"),
        ({"days_since_delivery": None}, ("check_return_policy", {"order_id": "EC-1", "issue_type": "no_reason"}), "RETURN_WINDOW_EXPIRED"),
        ({"fulfillment_status": "shipped"}, ("check_return_policy", {"order_id": "EC-1", "issue_type": "damaged"}), "ORDER_NOT_DELIVERED"),
        ({"payment_status": "unpaid"}, ("check_return_policy", {"order_id": "EC-1", "issue_type": "damaged"}), "ORDER_NOT_PAID"),
        ({"identity_verified": False}, ("create_after_sales_request", {"order_id": "EC-1", "request_type": "exchange", "reason": "damaged"}), "IDENTITY_NOT_VERIFIED"),
        ({}, ("create_after_sales_request", {"order_id": "EC-1", "request_type": "exchange", "reason": "missing_item"}), "REQUEST_TYPE_NOT_ALLOWED"),
    ],
)
def test_simulator(change, call, code):
    assert policy.code_of(policy.Simulator({"EC-1": ORDER | change}).call(*call)) == code


def test_simulator_changes_state_once():
    sim = policy.Simulator({"EC-1": ORDER})
    args = {"order_id": "EC-1", "request_type": "exchange", "reason": "damaged"}
    assert [policy.code_of(sim.call("create_after_sales_request", args)) for _ in range(2)] == ["OK", "DUPLICATE_REQUEST"]
    assert "after_sales_request" not in ORDER


def case(spark, answer, calls, state="F", codes=("OK",)):
    call = ("query", '{"order_id": "EC-1"}')
    c = spark.createDataFrame(
        [(1, "refund", [[call]], ["delete"], ["OK"], [["delivered", "shipped"]], [("o.status", '"F"')], '["EC-1"]'), (2, "identity", [], [], [], [], [], "[]")],
        "case_id long, category string, acceptable array<array<struct<name:string,arguments:string>>>, must_not_call array<string>, codes array<string>, term_groups array<array<string>>, assertions array<struct<path:string,equals:string>>, inputs string",
    )
    t = spark.createDataFrame(
        [(1, calls, list(codes), answer, [], '[{"status": "shipped"}]', f'{{"o": {{"status": "{state}"}}}}', "final_answer")],
        "case_id long, calls array<struct<name:string,arguments:string>>, codes array<string>, answer string, parse_errors array<string>, evidence string, state_after string, termination_reason string",
    )
    return {r.case_id: r for r in evaluation.evaluate(c, t).collect()}


def test_evaluation(spark):
    call = [("query", '{"order_id":"EC-1"}')]
    r = case(spark, "EC-1 is shipped", call)
    assert r[1].passed and r[1].errors == [] and r[1].auto_resolved
    assert not r[2].passed and r[2].errors == ["missing_trace"] and r[2].checks is None and not r[2].auto_resolution_eligible
    assert case(spark, "", call)[1].errors == ["incomplete_resolution", "missing_final_answer"]
    assert case(spark, "shipped", [("delete", "{}")])[1].errors == ["forbidden_tool", "wrong_argument", "wrong_tool"]
    assert case(spark, "shipped EC-9", call, state="P")[1].errors == ["goal_state_not_reached", "hallucinated_state", "unsupported_identifier:EC-9"]
    assert case(spark, "shipped 已退款", call)[1].errors == ["hallucinated_state", "unsupported_state:refunded"]
    assert case(spark, "shipped 尚未显示已退款", call)[1].passed and case(spark, "shipped 运输中", call)[1].passed


def test_traces_must_be_of_known_cases_once(spark):
    c = spark.createDataFrame([(1, "refund", [], [], [], [], [], "[]")], "case_id long, category string, acceptable array<array<struct<name:string,arguments:string>>>, must_not_call array<string>, codes array<string>, term_groups array<array<string>>, assertions array<struct<path:string,equals:string>>, inputs string")
    kind = "case_id long, calls array<struct<name:string,arguments:string>>, codes array<string>, answer string, parse_errors array<string>, evidence string, state_after string, termination_reason string"
    for ids in ([1, 1], [1, 2]):
        t = spark.createDataFrame([(i, [], [], "a", [], "[]", "{}", "final_answer") for i in ids], kind)
        with pytest.raises(Exception, match="repeated or unknown cases"):
            evaluation.evaluate(c, t).collect()


def test_simulator_says_why(spark):
    sim = policy.Simulator({"EC-1": ORDER | {"payment_status": "unpaid"}})
    before, message = sim.snapshot(), lambda *c: sim.call(*c)["error"]["message"]
    args = {"order_id": "EC-1", "request_type": "exchange", "reason": "damaged"}
    assert "delete" in message("delete", {}) and "JSON object" in message("query_order_status", [])
    assert "缺少必填参数：order_id" in message("query_order_status", {}) and "未定义参数：x" in message("query_order_status", {"order_id": "EC-1", "x": 1})
    assert "必须是字符串" in message("query_order_status", {"order_id": 1}) and "不能为空" in message("query_order_status", {"order_id": " "})
    assert "不在允许值中：'lost'" in message("check_return_policy", {"order_id": "EC-1", "issue_type": "lost"}) and "格式不合法：'x'" in message("query_order_status", {"order_id": "x"})
    assert "未找到" in message("query_order_status", {"order_id": "EC-2"}) and "尚未支付" in message("create_after_sales_request", args)
    assert sim.snapshot() == before and sim.call("check_return_policy", {"order_id": "EC-1", "issue_type": "damaged"})["data"]["message"] == "订单尚未支付，不能申请售后。"
    own = policy.Policy.from_config(
        {"tools": [{"name": t, "parameters": {"properties": {a: {"type": "string"} for a, _ in f}, "required": [a for a, _ in f], "additionalProperties": False}} for t, f in policy.TOOLS.items()]},
        {"policy_version": "x", "return_window_days": 30, "eligible_payment_statuses": ["unpaid"], "rules": {"lost": {"allowed_request_types": ["exchange"]}}},
    )
    made = policy.Simulator({"EC-1": ORDER | {"payment_status": "unpaid"}}, own).call("create_after_sales_request", args | {"reason": "lost"})
    assert made["ok"] and made["data"]["reason"] == "lost"
    df = spark.createDataFrame([("unpaid", "shipped", None, "lost"), ("paid", "delivered", 1, "damaged")], "payment_status string, fulfillment_status string, days_since_delivery int, issue_type string")
    assert [r.reason_code for r in policy.decision(df, policy=own).collect()] == ["ELIGIBLE", "UNSUPPORTED_ISSUE_TYPE"]
    for bad in ({"tools": []}, {}):
        with pytest.raises(ValueError):
            policy.Policy.from_config(bad, {"rules": {"a": {}}})
    for orders in ([{}], [{"order_id": "a"}, {"order_id": "a"}], None):
        with pytest.raises(ValueError):
            policy.Simulator.of_scenarios({"orders": orders})


def test_buckets_and_margin(spark):
    df = spark.createDataFrame([("decision", "action", "response"), ("decision", "response", "action"), ("parameter", "action", "action"), ("response", "response", "response"), ("decision", "action", "action")], "l string, c string, r string")
    b = evaluation.bucket(F.col("l"), F.col("c"), F.col("r"))
    assert [x.b for x in df.select(b.alias("b")).collect()] == ["must_continue", "must_stop", "parameter", "response", "wrong_action"]
    with pytest.raises(Exception, match="unsupported preference structure"):
        spark.createDataFrame([("response", "action", "action")], "l string, c string, r string").select(b).collect()


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0.25, 0, 0.25)], "v double")
    assert df.select(metrics.linear("v", 0.5).alias("x")).first().x == 0.125
    five = spark.createDataFrame([(x,) for x in (5, 1, 4, 2, 3)], "v int")
    assert five.select(metrics.nearest("v", 0.4).alias("a"), metrics.nearest("v", 0.5).alias("b"), metrics.nearest("v", 0.99).alias("c")).first() == (2, 3, 5)
    assert five.limit(0).select(metrics.nearest("v", 0.5).alias("a")).first().a == 0
    six = spark.createDataFrame([(x,) for x in range(6)], "v int")
    assert metrics.half_even(six, "v", (0.5,)).first().value == 2


def test_bootstrap(spark):
    values = [float(i % 2) for i in range(50)]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, i int, v double")
    got = metrics.bootstrap_exact(df.repartition(5), "run", "v", "i", 200, 7).first()
    assert got == metrics.bootstrap_exact(df.coalesce(1), "run", "v", "i", 200, 7).first()
    rng = random.Random(7)
    means = sorted(sum(values[rng.randrange(50)] for _ in range(50)) / 50 for _ in range(200))
    assert got.mean == 0.5 and got.low == pytest.approx(metrics._between(means, 0.025)) and got.high == pytest.approx(metrics._between(means, 0.975))
    hashed = metrics.bootstrap_hashed(spark.range(2000).withColumn("v", F.col("id") % 2), "id", "v", 200, "s").first()
    assert 0.45 < hashed.low < 0.5 < hashed.high < 0.55


def test_runs_must_cover_the_same_cases(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "run string, c long")
    with pytest.raises(ValueError):
        metrics.same_cases(df, "run", "c")
