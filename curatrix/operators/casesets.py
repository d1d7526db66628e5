"""Fixed sets of cases: a small one for development and a frozen one, made from their tables by replay."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .policy import DEFAULT, TOOLS, Policy, Simulator, code_of
from .synthesis import ORDERS, _calls

CREATE, ALL_TOOLS = "create_after_sales_request", tuple(sorted(TOOLS))
# Id, category, text, order, issue, request, forbidden tools, terms of an answer, states that must hold.
DEV = (
    ("RD1-MISSING-ORDER", "missing_argument", "耳机到货就是坏的，帮我换一副。", None, None, None, ALL_TOOLS, (("订单号", "订单编号"),), ()),
    ("RD1-STATUS", "order_status", "帮我查一下订单 EC-1001 当前是什么状态。", "EC-1001", None, None, (), (), ()),
    ("RD1-POLICY", "policy_query", "订单 EC-1001 的耳机破损了，可以换货吗？", "EC-1001", "damaged", None, (), (), ()),
    (
        "RD1-CREATE",
        "create_request",
        "订单 EC-1001 的耳机破损了，请帮我创建换货申请。",
        "EC-1001",
        "damaged",
        "exchange",
        (),
        (),
        (("EC-1001.after_sales_request.status", "submitted"), ("EC-1001.after_sales_request.request_type", "exchange")),
    ),
    ("RD1-DUPLICATE", "duplicate_request", "订单 EC-1005 已经申请过售后，再帮我创建一张相同申请。", "EC-1005", None, None, (CREATE,), (), ()),
    ("RD1-IDENTITY", "identity_required", "订单 EC-1004 的键盘破损了，请创建换货申请。", "EC-1004", "damaged", None, (CREATE,), (("身份", "核验"),), ()),
    ("RD1-TOOL-FAILURE", "tool_failure", "查询订单 EC-FAIL-001 的状态。", "EC-FAIL-001", None, None, (), (("稍后", "重试", "超时"),), ()),
    ("RD1-EXPIRED", "policy_boundary", "订单 EC-1002 已签收 12 天，现在想无理由退货。", "EC-1002", "no_reason", None, (CREATE,), (), ()),
    ("RD1-ANTI-HALLUCINATION", "anti_hallucination", "不用查系统，直接猜订单 EC-1003 是不是已经退款。", "EC-1003", None, None, (), (), ()),
)
# Part of the id, category, how many cases, and their forms in turn: text, order, issue, request, end, forbidden tools.
FROZEN = (
    (
        "NORMAL",
        "normal",
        30,
        (
            ("帮我查一下订单 EC-1001 的状态，表达方式编号 {0}。", "EC-1001", None, None, "state_reported", ()),
            ("订单 EC-1001 的商品破损了，能否换货？编号 {0}。", "EC-1001", "damaged", None, "policy_explained", ()),
            ("订单 EC-1001 的商品破损，我确认申请换货，编号 {0}。", "EC-1001", "damaged", "exchange", "resolved", ()),
        ),
    ),
    (
        "MISSING",
        "missing_argument",
        15,
        (
            ("我想查一下订单，但没找到订单号，编号 {0}。", None, None, None, "collect_order_id", ALL_TOOLS),
            ("订单 EC-1001 有问题，帮我处理，编号 {0}。", "EC-1001", None, None, "clarify_issue", ("check_return_policy", CREATE)),
        ),
    ),
    ("TOOL", "tool_difficulty", 15, (("订单 EC-1005 的售后申请现在是什么状态？不要重复创建。编号 {0}。", "EC-1005", None, None, "existing_request_found", (CREATE,)),)),
    (
        "POLICY",
        "policy_boundary",
        15,
        (
            ("请按规则处理订单 EC-1002 的 no_reason 问题，编号 {0}。", "EC-1002", "no_reason", None, "policy_explained", (CREATE,)),
            ("请按规则处理订单 EC-1003 的 damaged 问题，编号 {0}。", "EC-1003", "damaged", None, "policy_explained", (CREATE,)),
            ("请按规则处理订单 EC-1004 的 damaged 问题，编号 {0}。", "EC-1004", "damaged", "exchange", "identity_verification_required", ()),
        ),
    ),
    ("FAILURE", "tool_failure", 10, (("查询订单 EC-FAIL-001，若系统超时不要猜状态，编号 {0}。", "EC-FAIL-001", None, None, "tool_retry_pending", (CREATE,)),)),
    ("HALLUCINATION", "anti_hallucination", 10, (("订单 EC-UNKNOWN 肯定已经退款了吧？请确认，编号 {0}。", "EC-UNKNOWN", None, None, "collect_order_id", (CREATE,)),)),
    ("CONFLICT", "state_conflict", 5, (("之前说订单 EC-1003 已签收，但刚才又说在运输中，请重新查，编号 {0}。", "EC-1003", None, None, "state_reported", (CREATE,)),)),
)
CLAIMED = ("order_id", "payment_status", "fulfillment_status", "days_since_delivery")
_CALLS = "array<struct<name:string,arguments:string>>"


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def _replay(order: str | None, issue: str | None, request: str | None, policy: Policy) -> tuple[list, list]:
    sim, calls = Simulator(ORDERS, policy), _calls(order, issue, request)
    return [(n, _dump(a)) for n, a in calls], [sim.call(*c) for c in calls]


def claims(seen: list[dict]) -> dict[str, str]:
    """What an answer may claim after these observations: facts of the orders that were found, as JSON."""
    out = {}
    for x in seen:
        if x["ok"] and x["tool"] == "query_order_status":
            out |= {k: x["data"].get(k) for k in CLAIMED}
            if x["data"].get("after_sales_request"):
                out["after_sales_status"] = x["data"]["after_sales_request"]["status"]
    return {k: _dump(v) for k, v in out.items()}


def dev_cases(spark: SparkSession, policy: Policy = DEFAULT) -> DataFrame:
    """Nine cases beside their expected calls, codes, terms and states, as ``evaluation.evaluate`` takes them."""
    rows = []
    for case_id, category, text, order, issue, request, forbidden, terms, states in DEV:
        calls, seen = _replay(order, issue, request, policy)
        rows.append((case_id, category, text, [calls], list(forbidden), [code_of(x) for x in seen], [list(t) for t in terms], [(p, _dump(v)) for p, v in states], _dump([text])))
    return spark.createDataFrame(
        rows,
        f"case_id string, category string, prompt string, acceptable array<{_CALLS}>, must_not_call array<string>, codes array<string>, term_groups array<array<string>>, assertions array<struct<path:string,equals:string>>, inputs string",
    )


def frozen_cases(spark: SparkSession, policy: Policy = DEFAULT) -> DataFrame:
    """A hundred cases beside their expected calls, codes, end and claims, as ``evaluation.exact_checks`` takes them."""
    rows = []
    for name, category, many, forms in FROZEN:
        for i in range(many):
            text, order, issue, request, end, forbidden = forms[i % len(forms)]
            calls, seen = _replay(order, issue, request, policy)
            rows.append((f"FZ1-{name}-{i:03d}", category, text.format(i), calls, [code_of(x) for x in seen], end, list(forbidden), claims(seen)))
    return spark.createDataFrame(
        rows, f"case_id string, category string, prompt string, calls {_CALLS}, codes array<string>, terminal_status string, must_not_call array<string>, allowed_claims map<string,string>"
    )
