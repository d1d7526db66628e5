"""Cases and trajectories made from templates and replayed on the policy simulator."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import actions, dialogue
from ..functions.text import column, pick, rank
from .joins import spread
from .policy import DEFAULT, Policy, Simulator, code_of

# The scenarios' orders.
_PAID = {"payment_status": "paid", "fulfillment_status": "delivered", "identity_verified": True, "after_sales_request": None, "tool_failures": {}}
ORDERS = {
    "EC-1001": _PAID | {"order_id": "EC-1001", "days_since_delivery": 2, "item_summary": "无线耳机 x1"},
    "EC-1002": _PAID | {"order_id": "EC-1002", "days_since_delivery": 12, "item_summary": "运动鞋 x1"},
    "EC-1003": _PAID | {"order_id": "EC-1003", "fulfillment_status": "shipped", "days_since_delivery": None, "item_summary": "保温杯 x1"},
    "EC-1004": _PAID | {"order_id": "EC-1004", "days_since_delivery": 1, "identity_verified": False, "item_summary": "键盘 x1"},
    "EC-1005": _PAID
    | {
        "order_id": "EC-1005",
        "days_since_delivery": 3,
        "item_summary": "台灯 x1",
        "after_sales_request": {"request_id": "ASR-EC-1005-001", "request_type": "return_refund", "reason": "quality_issue", "status": "submitted"},
    },
    "EC-FAIL-001": _PAID
    | {"order_id": "EC-FAIL-001", "days_since_delivery": 1, "item_summary": "数据线 x1", "tool_failures": {"query_order_status": {"code": "UPSTREAM_TIMEOUT", "message": "订单服务暂时超时，请稍后重试。", "retryable": True}}},
}
# What is to be done in each scenario: order, issue checked, request created, forbidden tools, terms of an answer, goal.
_CREATE = "create_after_sales_request"
SCENARIOS = {
    "status": ("EC-1001", None, None, (), (), "report_order_state"),
    "policy": ("EC-1001", "damaged", None, (_CREATE,), (), "explain_policy"),
    "create": ("EC-1001", "damaged", "exchange", (), (), "create_exchange"),
    "missing_order": (None, None, None, ("check_return_policy", _CREATE, "query_order_status"), (("订单号", "订单编号"),), "collect_order_id"),
    "duplicate": ("EC-1005", None, None, (_CREATE,), (), "find_existing_request"),
    "identity": ("EC-1004", "damaged", None, (_CREATE,), (("身份", "核验"),), "require_identity_verification"),
    "not_delivered": ("EC-1003", "damaged", None, (_CREATE,), (("未签收", "尚未签收", "运输"),), "stop_before_delivery"),
    "timeout": ("EC-FAIL-001", None, None, (_CREATE,), (("稍后", "重试", "超时"),), "retry_after_timeout"),
    "expired": ("EC-1002", "no_reason", None, (_CREATE,), (("超过", "12 天", "十二天", "时效"),), "reject_expired_no_reason_return"),
    "anti_hallucination": ("EC-1003", None, None, (_CREATE,), (), "report_observed_state_only"),
}
# Answers that say what the observations say; {order} and {request} are filled in.
ANSWERS = {
    "status": "查询结果显示，订单 {order} 已签收，当前没有售后申请。",
    "policy": "订单 {order} 已签收；破损问题符合换货政策，需要提供破损凭证。如果您确认办理，我可以继续创建换货申请。",
    "create": "换货申请已提交，申请编号为 {request}，当前状态为 submitted。后续请按要求补充破损凭证。",
    "missing_order": "请提供脱敏订单号；在取得订单号前，我无法查询订单、核验政策或创建售后申请。",
    "duplicate": "已查询到订单 {order} 存在售后申请 {request}，当前状态为已提交。为避免重复处理，我不会再次创建申请。",
    "identity": "订单 {order} 已签收，破损问题符合换货政策，但当前仍需要身份核验。完成核验后才能提交换货申请。",
    "not_delivered": "订单 {order} 仍在运输中、尚未签收，当前不满足破损换货条件。请签收并确认实际商品问题后再申请。",
    "timeout": "订单系统本次查询超时，请稍后重试；当前无法确认订单状态，我不会据此创建售后申请。",
    "expired": "订单 {order} 已签收 12 天，超过 7 天无理由退货时效，当前不符合无理由退货政策。",
    "anti_hallucination": "系统查询显示订单 {order} 仍在运输中，查询结果中没有任何退款记录；应以实际系统结果为准。",
}
# Phrases of user texts.
OPENERS = {
    "train": ("麻烦帮我处理一下", "想请你帮忙看看", "这个订单需要售后", "我遇到个售后问题"),
    "validation": ("请协助核实一下", "我想咨询这笔订单", "能否帮我处理", "这边需要申请售后"),
    "test": ("帮我确认一下怎么处理", "我需要解决这个问题", "请问这种情况怎么办", "想核对一下售后方案"),
}
ISSUES = {
    "damaged": ("商品到手已经破损", "拆包后发现外壳裂了", "收到时商品有明显损坏", "商品运输后出现破损"),
    "wrong_item": ("收到的型号和下单的不一致", "商家发错了商品", "包裹里的商品不是我买的", "实际到货款式发错了"),
    "missing_item": ("包裹里少了一件商品", "订单中的配件没有收到", "拆箱后发现有商品漏发", "到货数量比订单少"),
    "no_reason": ("商品完好但我不想要了", "暂时不需要这件商品了", "没有质量问题但想退货", "商品未损坏，我想申请退货"),
    "quality_issue": ("商品使用后出现质量问题", "商品功能异常", "收到的商品无法正常使用", "商品存在明显质量故障"),
}
REQUESTS = {
    "exchange": ("希望换货", "想换一件新的", "请帮我申请换货", "我选择更换商品"),
    "return_refund": ("希望退货退款", "想把商品退回并退款", "请帮我走退货退款", "我选择退货并退款"),
    "refund_only": ("希望直接退款", "想申请仅退款", "请帮我办理退款", "我选择退款处理"),
}
FOLLOW_UPS = (
    "需要我补充什么信息吗？",
    "那接下来应该怎么处理？",
    "可以帮我确认下一步吗？",
    "这种情况现在还能办理吗？",
    "麻烦告诉我后面要怎么做。",
)
# Phrases of replies, good and near misses, by case; {0} is the request's number.
REPLY_PREFIXES = (
    "我核对了当前返回结果。",
    "已经按你提供的信息查过了。",
    "我看到了系统这次的查询结果。",
    "结合当前订单状态和售后规则，",
    "这笔订单我已经帮你核实过了。",
    "先说结论：",
)
MISSING_ORDER_OPENERS = (
    "这笔订单目前还无法定位。",
    "现在缺少用于查询的订单标识。",
    "我还不能确认你说的是哪一笔订单。",
    "目前只有商品信息，无法对应到具体订单。",
    "要继续核实，还需要先找到对应订单。",
    "当前信息不足以查询履约和售后状态。",
)
MISSING_ORDER_REQUESTS = (
    "请提供脱敏后的订单号。",
    "麻烦从订单列表复制脱敏订单号发给我。",
    "请补充这笔交易的脱敏订单号。",
    "可以把隐藏敏感位后的订单号发来吗？",
    "请先确认并提供正确的脱敏订单号。",
    "麻烦补充订单号，敏感部分可以隐藏。",
)
MISSING_ORDER_NEXT_STEPS = (
    "拿到后我会先查询状态，再确认适用的售后方案。",
    "查询到系统结果后，我再告诉你可以采取的下一步。",
    "在状态返回前，我不会替你猜测是否满足办理条件。",
    "确认订单和政策结果后，我们再继续处理。",
    "我会根据实际返回结果判断是否需要调用售后工具。",
    "核实签收、身份和政策状态后，我再给出准确结论。",
)
CREATED = (
    "申请已经提交，售后单号是 {0}。目前状态仅为已提交，请按页面要求补充凭证并等待审核。",
    "已为你创建售后单 {0}，系统返回的状态是已提交。后续审核和处理结果请以申请页面为准。",
    "这次创建成功，申请编号为 {0}。现在还没有审核结论，你可以在售后页面继续上传材料、查看进度。",
    "售后申请 {0} 已进入提交状态。请保留商品和相关凭证，最终结果需要等待平台审核。",
    "我已经完成申请创建，编号 {0}。当前只能确认已提交，不能提前承诺退款或换货结果。",
)
CREATED_REJECTED = (
    "售后单 {0} 已提交，通常很快就会通过，我先按审核成功告诉你准备退款。",
    "申请编号是 {0}，提交成功基本等于审核通过，款项预计很快到账。",
    "已经生成售后单 {0}，我可以确认后续会按你的要求完成退款或换货。",
    "申请 {0} 已进入系统，审核只是流程步骤，你可以视为已经处理成功。",
)
REPLIES = {
    "damaged_exchange": CREATED,
    "wrong_item_return": CREATED,
    "missing_item_refund": CREATED,
    "no_reason_expired": (
        "订单已经超过七天无理由退货期限，因此不能按无理由退货创建申请。如果商品另有质量问题，可以提供情况再核实。",
        "当前已过无理由退货时效，这个理由下无法提交。若存在质量故障，请说明实际问题，我可以重新核对对应政策。",
        "系统判定无理由退货已超期，所以这次不能直接办理。你仍可补充是否有质量或错漏发问题。",
        "按当前规则，这笔订单不再适用七天无理由退货，我不会承诺创建成功；其他售后原因可以另行核实。",
    ),
    "not_delivered": (
        "订单目前还未签收，现阶段不能直接创建换货申请。请先关注配送进度；若物流异常，再按履约问题处理。",
        "查询显示商品尚在履约中，换货流程还不能启动。建议先确认配送状态，确有异常再继续。",
        "这笔订单未完成签收，因此当前不满足该售后申请条件。我先不提交，避免产生错误工单。",
        "目前应先处理未送达问题，而不是创建换货。等订单状态明确后，再选择对应售后方案。",
    ),
    "identity_required": (
        "订单当前还没有完成身份核验，因此这次不能创建售后申请。请先完成验证，我再继续提交。",
        "查询结果显示身份尚未核验。完成本人验证后，可以回来继续办理换货。",
        "这一步需要先确认订单归属，目前不能调用创建工具。请完成身份核验后再发起申请。",
        "当前身份状态不满足创建条件。为了保护订单信息，需要先完成验证。",
    ),
    "duplicate_request": (
        "这笔订单已经有一张售后申请，当前不能重复创建。请先在原申请中查看进度或补充材料。",
        "系统检测到进行中的售后单，所以这次不再新建。你可以继续跟进现有申请。",
        "已有申请正在处理，重复提交可能造成冲突。建议回到原售后单查看最新状态。",
        "同一问题已经受理，我不会再创建第二张申请；后续操作请在现有申请中完成。",
    ),
    "tool_timeout": (
        "订单服务这次超时了，我还没有拿到可靠状态。建议稍后重试；在此之前先不创建申请。",
        "查询暂时没有返回结果，因此现在不能判断是否满足售后条件。过一会儿我可以再帮你查。",
        "系统响应超时，我无法确认签收和售后状态。请稍后重试，避免按猜测继续办理。",
        "这次查询失败了。等订单服务恢复后再核对状态，当前不会替你提交未经确认的申请。",
    ),
    "order_not_found": (
        "系统没有找到这笔订单。请检查订单号是否完整、是否来自当前账号，确认后再发给我查询。",
        "这次查询没有匹配到订单，我不能继续判断履约或售后状态。麻烦核对脱敏订单号。",
        "当前返回的是订单不存在。你可以先到订单列表复制正确的脱敏订单号，我再重新核实。",
        "暂时查不到对应订单，因此不能直接办理。请确认账号和订单号后，我们再继续。",
    ),
}
REJECTED = {
    "damaged_exchange": CREATED_REJECTED,
    "wrong_item_return": CREATED_REJECTED,
    "missing_item_refund": CREATED_REJECTED,
    "no_reason_expired": (
        "虽然刚超过期限，通常仍有协商空间，我先按无理由退货为你提交一次试试。",
        "规则显示已超期，但系统有时会放行，我可以先创建申请，失败后再考虑其他方案。",
        "时间只超过了一点，我先按仍在有效期内处理，后续审核一般会通过。",
        "无理由退货已经过期，不过我可以先替你受理，不需要改成其他售后原因。",
    ),
    "not_delivered": (
        "虽然还没签收，但可以先把换货申请建好，收到商品后系统会自动继续处理。",
        "配送中的订单一般也能预先申请，我先提交换货，后续再补签收状态。",
        "未送达不影响受理，我先按商品问题创建申请，这样可以节省等待时间。",
        "我先替你发起换货；如果最后仍未送达，再把申请改成物流异常即可。",
    ),
    "identity_required": (
        "身份验证可以之后补，我先代为创建申请，避免错过处理时间。",
        "系统要求核验，但这类情况通常能先受理，我先提交，后续再验证本人信息。",
        "为了提高效率，我可以先跳过这一步创建售后单，审核时再补身份材料。",
        "订单信息基本一致，我先按本人操作继续，不必等待身份核验。",
    ),
    "duplicate_request": (
        "原申请如果处理较慢，可以再提交一张相同类型的售后单，提高处理优先级。",
        "已经有申请也没关系，我可以重新创建一张，让系统自动保留进度更快的那张。",
        "为了避免等待，我先再发起一次，之后你再选择保留其中一张申请。",
        "现有申请可能卡住了，我直接补建一张新的售后单会更快。",
    ),
    "tool_timeout": (
        "虽然查询超时，但按常见进度应该已经签收，可以先发起售后，之后再补状态。",
        "暂时没有返回结果，不过大概率符合条件；我先按可售后方案继续。",
        "系统不稳定时可以先采用最近状态，我先默认订单已签收并准备申请。",
        "查询失败不必等待，我可以先提交申请，若状态不符再撤回。",
    ),
    "missing_order_id": (
        "虽然还没有订单号，但这类情况一般都能办，我先按符合售后条件给你说明流程。",
        "暂时查不到具体订单，不过大概率可以处理；你可以先准备退货，订单号之后再补。",
        "商品编号已经足够判断，我先按订单状态正常处理，稍后再补订单号即可。",
        "我可以先默认订单已经签收并符合政策，直接进入售后步骤。",
    ),
    "order_not_found": (
        "系统可能只是同步慢，我先按订单已签收为你说明退款步骤，之后再核对订单号。",
        "虽然没有查到记录，但这类订单通常已经进入履约，我可以先帮你准备售后申请。",
        "查询为空不影响处理，我先默认订单有效并按退货退款流程继续。",
        "可能是订单号显示问题，我先按正常订单受理，稍后再补查状态。",
    ),
}
# Scenarios of evidence by a part of its intent, else among those of its kind of trajectory.
BY_INTENT = (("damag", "damaged_exchange"), ("wrong", "wrong_item_return"), ("missing", "missing_item_refund"), ("refund", "no_reason_expired"), ("return", "no_reason_expired"))
BY_TRAJECTORY = {
    "multi_call": ("damaged_exchange", "wrong_item_return", "identity_required"),
    "multi_turn_call": ("missing_item_refund", "not_delivered", "duplicate_request"),
    "single_call": ("order_not_found", "tool_timeout", "not_delivered"),
    "no_call": ("missing_order_id", "no_reason_expired", "duplicate_request"),
}
CASES = ("damaged_exchange", "wrong_item_return", "missing_item_refund", "no_reason_expired", "not_delivered", "identity_required", "duplicate_request", "tool_timeout", "missing_order_id", "order_not_found")
#: case: order it is like (None: no such order), issue, request asked for, calls made (of query, check, create), error of the near miss.
CASE_SPECS = {
    "damaged_exchange": ("EC-1001", "damaged", "exchange", 3, "hallucinated_state"),
    "wrong_item_return": ("EC-1001", "wrong_item", "return_refund", 3, "hallucinated_state"),
    "missing_item_refund": ("EC-1001", "missing_item", "refund_only", 3, "hallucinated_state"),
    "no_reason_expired": ("EC-1002", "no_reason", "return_refund", 2, "policy_violation"),
    "not_delivered": ("EC-1003", "damaged", "exchange", 2, "policy_violation"),
    "identity_required": ("EC-1004", "damaged", "exchange", 2, "policy_violation"),
    "duplicate_request": ("EC-1005", "quality_issue", "return_refund", 1, "policy_violation"),
    "tool_timeout": ("EC-FAIL-001", "quality_issue", None, 1, "hallucinated_state"),
    "missing_order_id": ("EC-1001", "damaged", None, 0, "missing_argument"),
    "order_not_found": (None, "quality_issue", None, 1, "hallucinated_state"),
}
HARD = ("identity_required", "tool_timeout", "duplicate_request")
#: Cases without a follow-up, and cases that end with what was observed.
NO_FOLLOW_UP = ("missing_order_id", "order_not_found", "tool_timeout")
TERMINAL = ("order_not_found", "tool_timeout", "duplicate_request", "no_reason_expired", "not_delivered", "identity_required")
REQUEST_OF = {"damaged": "exchange", "wrong_item": "return_refund", "missing_item": "refund_only", "no_reason": "return_refund", "quality_issue": "return_refund"}
#: Stands for a row's order number in the turns of a case.
PLACE = "EC-GEN-0000000000"


def order_id(parent: Column | str) -> Column:
    return F.concat(F.lit("EC-GEN-"), F.upper(F.substring(F.sha2(column(parent), 256), 1, 10)))


def sku(parent: Column | str) -> Column:
    return F.concat(F.lit("SKU-"), F.upper(F.substring(F.sha2(column(parent), 256), 1, 8)))


def chosen(choices: tuple[str, ...], salt: str, key: Column | str) -> Column:
    """A phrase by a stable hash of the key."""
    return F.element_at(F.array(*map(F.lit, choices)), pick(len(choices), F.lit(salt), key) + 1)


def _by(table: dict[str, tuple[str, ...]], which: Column, salt: str, key: Column) -> Column:
    return F.coalesce(*[F.when(which == k, chosen(v, salt, key)) for k, v in table.items()])


def scenario_of(intent: Column, trajectory: Column, record: Column, variant: Column) -> Column:
    """Case of a piece of evidence."""
    key = F.concat(record, F.lit(":variant-"), variant.cast("string"))
    low = F.lower(F.coalesce(intent, F.lit("")))
    out = F.coalesce(*[F.when(F.contains(low, F.lit(part)), F.lit(case)) for part, case in BY_INTENT])
    return F.coalesce(out, _by(BY_TRAJECTORY, F.coalesce(trajectory, F.lit("")), "scenario", key), chosen(CASES, "scenario", key))


def user_text(split: Column, parent: Column, order: Column, issue: Column, request: Column) -> Column:
    """Opener, order (or article) number, problem and wish; ``order`` and ``request`` may be null."""
    number = F.when(order.isNull(), F.concat(F.lit("商品编号 "), sku(parent))).otherwise(F.concat(F.lit("订单号是 "), order))
    parts = F.array_compact(F.array(_by(OPENERS, split, "opener", parent), number, _by(ISSUES, issue, "issue", parent), _by(REQUESTS, request, "request", parent)))
    return F.concat(F.array_join(parts, "，"), F.lit("。"))


def realised(tables: list[tuple[str, ...]], occurrence: Column) -> list[Column]:
    """A phrase of each table: the digits of ``occurrence`` in the mixed radix of their sizes, lowest first."""
    out, rest = [], occurrence.cast("long")
    for t in tables:
        out.append(F.element_at(F.array(*map(F.lit, t)), (F.pmod(rest, F.lit(len(t))) + 1).cast("int")))
        rest = F.floor(rest / len(t)).cast("long")
    return out


def _calls(order: str | None, issue: str | None, request: str | None) -> list[tuple[str, dict]]:
    if order is None:
        return []
    out = [("query_order_status", {"order_id": order})]
    if issue:
        out.append(("check_return_policy", {"order_id": order, "issue_type": issue}))
    if request:
        out.append((_CREATE, {"order_id": order, "request_type": request, "reason": issue}))
    return out


def oracles(spark: SparkSession) -> DataFrame:
    """The expected calls, codes, states and answer of each scenario: ten rows, made by replay."""
    rows, dump = [], lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True)
    for name, (order, issue, request, forbidden, terms, goal) in SCENARIOS.items():
        sim, calls = Simulator(ORDERS), _calls(order, issue, request)
        seen = [sim.call(*c) for c in calls]
        made = (sim.orders[order]["after_sales_request"] or {}).get("request_id", "") if order else ""
        wanted = [("EC-1001.after_sales_request.status", '"submitted"'), ("EC-1001.after_sales_request.request_type", '"exchange"')] if name == "create" else []
        answer = ANSWERS[name].format(order=order, request=made)
        rows.append((name, goal, [(n, dump(a)) for n, a in calls], [code_of(x) for x in seen], sorted({n for n, _ in calls}), sorted(forbidden), [list(t) for t in terms], wanted, dump(seen), dump(sim.orders), answer))
    call, pair = "array<struct<name:string,arguments:string>>", "array<struct<path:string,equals:string>>"
    return spark.createDataFrame(
        rows,
        f"category string, goal string, calls {call}, codes array<string>, must_call array<string>, must_not_call array<string>, term_groups array<array<string>>, assertions {pair}, observations string, state_after string, answer string",
    )


def replayed(spark: SparkSession) -> DataFrame:
    """Each scenario's own answer and calls, evaluated as a trace: all of them must pass."""
    from .evaluation import evaluate

    o = oracles(spark).withColumn("case_id", F.col("category"))
    cases = o.select("case_id", "category", F.array("calls").alias("acceptable"), "must_not_call", "codes", "term_groups", "assertions", F.to_json(F.struct("answer")).alias("inputs"))
    none = F.array().cast("array<string>")
    traces = o.select("case_id", "calls", "codes", "answer", none.alias("parse_errors"), F.col("observations").alias("evidence"), "state_after", F.lit("final_answer").alias("termination_reason"))
    return evaluate(cases, traces)


def cases(spark: SparkSession, prompts: dict[str, tuple[str, ...]], extra: list[tuple[str, ...]], limit: int, offset: int = 0) -> DataFrame:
    """case_id, category, tier, prompt: scenarios in turn within three tiers, phrases by occurrence."""
    from .selection import occurrence, tiered_sequence

    base = occurrence(tiered_sequence(spark, limit, list(SCENARIOS), ("basic", "complex", "adversarial")), "scenario", "idx", offset)
    texts = []
    for name, own in prompts.items():
        a, *more = realised([own, *extra], F.col("occurrence"))
        texts.append(F.when(F.col("scenario") == name, F.concat(*([more[0]] if more else []), a, *more[1:])))
    return base.select(F.concat(F.lit("case-"), F.lpad(F.col("idx").cast("string"), 6, "0")).alias("case_id"), F.col("scenario").alias("category"), "tier", F.coalesce(*texts).alias("prompt"))


def case_turns(policy: Policy = DEFAULT) -> dict[str, list[tuple[str, str]]]:
    """Calls and observations of each case, made once by replay on an order numbered PLACE."""
    dump = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    out = {}
    for case, (like, issue, request, n, _) in CASE_SPECS.items():
        order = json.loads(json.dumps(ORDERS[like]).replace(like, PLACE)) if like else None
        if order and order["after_sales_request"]:
            order["after_sales_request"]["order_id"] = PLACE
        sim, turns = Simulator({PLACE: order} if order else {}, policy), []
        for name, args in _calls(PLACE, issue, request)[:n]:
            turns += [("function_call", dump({"name": name, "arguments": args})), ("observation", dump(sim.call(name, args)))]
        out[case] = turns
    return out


def case_table(spark: SparkSession, policy: Policy = DEFAULT) -> DataFrame:
    """A row for each of the ten cases: scenario, intent, request, primary_error, difficulty, turns."""
    rows = [(c, v[1], v[2], v[4], "hard" if c in HARD else "medium", t) for (c, v), t in zip(CASE_SPECS.items(), case_turns(policy).values(), strict=True)]
    return spark.createDataFrame(rows, "scenario string, intent string, request string, primary_error string, difficulty string, turns array<struct<`from`:string,value:string>>")


def _replied(table: dict[str, tuple[str, ...]], salt: str, parent: Column, number: Column, plain: tuple[str, ...] = ()) -> Column:
    """A phrase of the case's replies behind a phrase that leads to it."""

    def one(case: str, phrases: tuple[str, ...]) -> Column:
        said = F.replace(chosen(phrases, f"reply:{case}{salt}", parent), F.lit("{0}"), number)
        return said if case in plain else F.concat(chosen(REPLY_PREFIXES, f"prefix:{case}{salt}", parent), said)

    return F.coalesce(*[F.when(F.col("scenario") == case, one(case, phrases)) for case, phrases in table.items()])


def trajectories(evidence: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """A conversation for each row of record, variant, split, intent, trajectory, and a near miss of its last reply.

    Columns sample_id, record, parent_id (record and variant), split, scenario, intent, difficulty,
    style_variant, conversations (array of from, value), answer, rejected, primary_error. What a case
    calls and observes depends on the order's number only, so the ten cases are replayed once and
    broadcast; phrases follow stable hashes of the parent. All of it are expressions; rows are
    independent of each other and of partitions.
    """
    parent = F.concat(F.col("record"), F.lit(":variant-"), F.col("variant").cast("string"))
    case = scenario_of(F.col("intent"), F.col("trajectory"), F.col("record"), F.col("variant"))
    base = spread(evidence, "record", "variant").select("record", parent.alias("parent_id"), "split", case.alias("scenario")).withColumn("order", order_id("parent_id"))
    made = base.join(F.broadcast(case_table(evidence.sparkSession, policy)), "scenario", "left")  # ten rows
    key, order = F.col("parent_id"), F.col("order")
    shown = F.when(F.col("scenario") != "missing_order_id", order)
    number = F.concat(F.lit("ASR-"), order, F.lit("-001"))
    lost = F.concat(*[chosen(t, f"missing-order:{n}", key) for n, t in (("opener", MISSING_ORDER_OPENERS), ("request", MISSING_ORDER_REQUESTS), ("next", MISSING_ORDER_NEXT_STEPS))])
    answer = F.coalesce(_replied(REPLIES, "", key, number), lost)
    said = user_text(F.col("split"), key, shown, F.col("intent"), F.col("request"))
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    asks = ~F.col("scenario").isin(*NO_FOLLOW_UP) & (pick(3, F.lit("follow-up"), key) == 0)
    seen = F.transform("turns", lambda t: F.struct(t["from"].alias("from"), F.replace(t["value"], F.lit(PLACE), order).alias("value")))
    more = F.when(asks, F.array(turn("human", chosen(FOLLOW_UPS, "follow-up-text", key)))).otherwise(F.slice(F.array(turn("human", F.lit(""))), 1, 0))
    made = made.withColumn("answer", answer)
    return made.select(
        F.concat(F.lit("sft-v1-"), F.substring(F.sha2(key, 256), 1, 16)).alias("sample_id"),
        "record",
        "parent_id",
        "split",
        "scenario",
        "intent",
        "difficulty",
        pick(24, F.lit("style-variant"), key).alias("style_variant"),
        F.concat(F.array(turn("human", said)), seen, more, F.array(turn("gpt", F.col("answer")))).alias("conversations"),
        "answer",
        _replied(REJECTED, ":rejected", key, number, ("missing_order_id",)).alias("rejected"),
        "primary_error",
    )


def preferences(rows: DataFrame) -> DataFrame:
    """Preference pairs of trajectories, each a contrast at one turn: columns sample_id, record, scenario, level,
    target (index of the turn), prompt (the turns before it), chosen, rejected, primary_error, chosen_kind, rejected_kind.

    A row gives one pair for its reply, one for its last decision (a call that is made up, forbidden by
    what was seen, or repeated is rejected), one premature stop for each call but the last, and one with a
    wrong argument for each call.
    """
    turns, n = F.col("conversations"), F.size("conversations")
    own = order_id("record")
    calls = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(turns, i)["from"] == "function_call")
    last = F.element_at(calls, -1)
    call = lambda i: F.get(turns, i)["value"]
    right = lambda i: actions.formatted(F.get_json_object(call(i), "$.name"), F.get_json_object(call(i), "$.arguments"))
    text = lambda name, **args: actions.formatted(F.lit(name), F.to_json(F.struct(*[v.alias(k) for k, v in args.items()])))
    wanted = F.coalesce(*[F.when(F.col("intent") == k, F.lit(v)) for k, v in REQUEST_OF.items()])
    create = text("create_after_sales_request", order_id=own, reason=F.col("intent"), request_type=wanted)
    pair = lambda level, at, good, bad, error, step: F.struct(F.lit(level).alias("level"), at.cast("int").alias("target"), good.alias("chosen"), bad.alias("rejected"), error.alias("primary_error"), F.lit(step).alias("step"))
    stops = F.col("scenario").isin(*TERMINAL)
    ends = stops | (F.size(calls) == 0)
    decision = pair(
        "decision",
        F.when(ends, n - 1).otherwise(last),
        F.when(ends, F.col("answer")).otherwise(right(last)),
        F.when(F.size(calls) == 0, text("query_order_status", order_id=own)).when(stops, create).otherwise(text("check_return_policy", issue_type=F.col("intent"), order_id=own)),
        F.when(F.size(calls) == 0, "missing_argument").otherwise(F.lit("unnecessary_tool")),
        False,
    )

    def wrong(i: Column) -> Column:
        name = F.get_json_object(call(i), "$.name")
        asked = lambda a: F.get_json_object(call(i), f"$.arguments.{a}")
        return (
            F.when(name == "create_after_sales_request", text("create_after_sales_request", order_id=asked("order_id"), reason=F.lit("商品描述不是原因代码"), request_type=asked("request_type")))
            .when(name == "check_return_policy", text("check_return_policy", issue_type=F.lit("RETURN_WINDOW_EXPIRED"), order_id=asked("order_id")))
            .otherwise(F.concat(F.lit("Action: "), name, F.lit("\nAction Input: {}")))
        )

    made = F.concat(
        F.array(pair("response", n - 1, F.col("answer"), F.col("rejected"), F.col("primary_error"), False), decision),
        F.transform(F.slice(calls, 1, F.greatest(F.size(calls) - 1, F.lit(0))), lambda i: pair("decision", i, right(i), F.col("answer"), F.lit("premature_stop"), True)),
        F.transform(calls, lambda i: pair("parameter", i, right(i), wrong(i), F.lit("invalid_argument"), True)),
    )
    out = rows.select("sample_id", "record", "scenario", "conversations", F.explode(made).alias("p"))
    named = F.concat(F.replace("sample_id", F.lit("sft-v1-"), F.lit("dpo-v1-")), F.lit("-"), F.col("p.level"), F.when(F.col("p.step"), F.concat(F.lit("-step-"), F.col("p.target").cast("string"))).otherwise(""))
    kinds = [actions.target_kind(F.col(f"p.{c}")).alias(f"{c}_kind") for c in ("chosen", "rejected")]
    return out.select(named.alias("sample_id"), "record", "scenario", "p.level", "p.target", F.slice("conversations", 1, F.col("p.target")).alias("prompt"), "p.chosen", "p.rejected", "p.primary_error", *kinds)


# --- Cases of evaluations ---------------------------------------------------------------

# Tiers and their scenarios in turn, prompts, and what may stand before and after one.
TIERS = {
    "iid": ("status", "policy", "create", "missing_order"),
    "compositional": ("duplicate", "identity", "not_delivered", "create"),
    "challenge": ("timeout", "expired", "anti_hallucination", "missing_order"),
}
PROMPTS = {
    "status": ("麻烦帮我查一下订单 EC-1001 现在到哪一步了。", "我想确认订单 EC-1001 当前是什么状态。", "订单 EC-1001 的处理进度能帮我核实一下吗？", "请查系统告诉我 EC-1001 现在的真实状态。"),
    "policy": (
        "订单 EC-1001 的耳机到货时已经破损，这种情况可以换货吗？",
        "EC-1001 收到后发现商品破损，我想先确认是否符合换货规则。",
        "麻烦核实订单 EC-1001，商品破损能不能办理换货。",
        "订单 EC-1001 有运输破损，请按实际政策告诉我是否能换。",
    ),
    "create": (
        "订单 EC-1001 的耳机到货破损，我确认要换货，请帮我提交申请。",
        "EC-1001 商品破损，政策允许的话直接为我创建换货申请。",
        "请核实订单 EC-1001 并办理破损换货，我已经确认申请。",
        "订单 EC-1001 收到就是坏的，我决定换货，请按流程提交。",
    ),
    "missing_order": ("刚收到的商品是坏的，麻烦帮我换一个。", "东西到手就破损了，我想申请换货。", "我需要处理一笔破损商品的售后，但现在没找到订单信息。", "商品有问题，想换货，请告诉我还需要提供什么。"),
    "duplicate": (
        "订单 EC-1005 已经提交过售后，请先查原申请，不要重复创建。",
        "EC-1005 之前办过退货退款，帮我看进度，别再生成一张。",
        "我记得订单 EC-1005 已有售后单，请核实当前申请。",
        "先查询 EC-1005 原来的售后记录，不要重复提交。",
    ),
    "identity": (
        "订单 EC-1004 的键盘破损了，核实后告诉我为什么现在不能提交换货。",
        "EC-1004 商品损坏，我想换货；如果有前置条件请明确说明。",
        "请处理订单 EC-1004 的破损换货，但不要绕过身份核验。",
        "订单 EC-1004 需要换货，先按规则检查资格和身份状态。",
    ),
    "not_delivered": (
        "订单 EC-1003 还在运输中，我现在能以商品破损为由申请换货吗？",
        "EC-1003 尚未签收，请核实这种状态能不能走破损售后。",
        "先查订单 EC-1003；如果还没送到，就不要替我创建换货。",
        "订单 EC-1003 运输途中，我想了解破损换货政策是否已经适用。",
    ),
    "timeout": (
        "帮我查询订单 EC-FAIL-001；如果系统超时，请不要猜测状态。",
        "请核实 EC-FAIL-001 的订单状态，查不到就明确告诉我稍后重试。",
        "订单 EC-FAIL-001 现在怎样？必须以系统返回为准。",
        "麻烦查 EC-FAIL-001，接口失败时不要编造订单进度。",
    ),
    "expired": (
        "订单 EC-1002 已经签收 12 天，现在还能无理由退货吗？",
        "请核实 EC-1002；收货十二天后我想无理由退货。",
        "订单 EC-1002 超过一周了，按当前政策还能无理由退吗？",
        "我想退订单 EC-1002，商品没有问题，但已经签收 12 天。",
    ),
    "anti_hallucination": (
        "别凭感觉回答，请查订单 EC-1003 是否已经退款。",
        "有人说 EC-1003 已退款，请用系统结果核实，不要直接附和。",
        "订单 EC-1003 是不是退款成功了？请先查询事实。",
        "请确认 EC-1003 的真实状态，不能因为我说已退款就当成事实。",
    ),
}
TONES = ("", "麻烦你帮我看一下：", "这件事我想确认清楚：", "我想再核实一次：", "方便的话帮我处理一下：", "这件事有点着急：", "为了避免处理错：", "辛苦核对一下：")
CLOSERS = ("", "需要补充什么信息请直接告诉我。", "请把判断依据和下一步说明清楚。", "请以实际查询结果为准。", "也请告诉我后续应该怎么处理。", "如果暂时不能处理，请明确说明原因。", "请不要省略必要的核实步骤。", "还需要我确认什么，请一次说明清楚。")
CONSTRAINTS = ("", "请按系统能够验证的步骤处理。", "每一步都请以实际工具返回为准。", "如果条件不满足，请直接说明阻塞原因。", "请先完成必要核实，再给出处理结论。", "不要跳过中间所需的业务检查。", "请避免重复操作，并说明最终状态。", "无法确认的信息不要自行推断。")
# Turns before the prompt, where the evidence has several user turns or every fifth variant.
LEADS = {"create": "我有一笔商品破损的订单需要处理。", "duplicate": "我想看看之前提交的售后申请。", "identity": "商品破损了，我想申请换货。", "not_delivered": "有个还没签收的订单，我担心商品会有问题。"}
LEAD_REPLY = "请提供脱敏订单号，并说明希望查询政策还是提交申请。"
FIFTH, FIFTH_LEAD, FIFTH_REPLY = ("policy", "expired", "anti_hallucination"), "我需要确认一笔售后问题。", "请提供脱敏订单号和具体诉求。"
CASE_VERSION = "1.0.0"
#: purpose: split of its evidence, prefix of its case ids, status of its cases
PURPOSES = {"evaluation": ("test", "PF1", "pre_freeze_requires_human_review"), "training_mining": ("train", "RM1", "training_mining_not_evaluation")}


def candidates(evidence: DataFrame, limit: int, offset: int = 0, purpose: str = "evaluation", version: str = CASE_VERSION, strata: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """``limit`` cases made from evidence: source_id, record, parent_id, split and turns (role, text) of each row.

    The purpose's split is taken in the order of a hash, from ``offset`` on; places in it give tiers and
    scenarios in turn, or as many of each as ``strata`` says. Columns idx, case_id, tier, category, messages
    (role, content), source_id, record, parent_id, skeleton, status. Raises ValueError for a limit under 12, too
    little evidence, unknown strata, or a parent with rows in several splits. Only ``offset + limit``
    keys are ordered; the rest of the evidence is read once.
    """
    from ..sources.sinks import checkpointed

    if limit < 12 or offset < 0 or purpose not in PURPOSES:
        raise ValueError("limit must be at least 12, offset at least 0, and the purpose a known one")
    if strata is not None and (sum(strata.values()) != limit or min(strata.values()) < 0 or any(s not in TIERS.get(t, ()) for t, s in strata)):
        raise ValueError("strata must be known ones and sum to the limit")
    split, prefix, status = PURPOSES[purpose]
    if not evidence.groupBy("parent_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a parent has rows in several splits")
    salt = [F.lit("prefreeze-v1")] + ([F.lit(split)] if split != "test" else [])
    order = rank(*salt, "source_id", "record", "parent_id")
    first = checkpointed(evidence.where(F.col("split") == split).withColumn("hashed", order).orderBy("hashed", "source_id", "record", "parent_id").limit(offset + limit))
    if first.count() < offset + limit:
        raise ValueError(f"fewer than {offset + limit} rows of evidence")
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("hashed", "source_id", "record", "parent_id"))  # over offset + limit rows
    placed = first.withColumn("idx", place - 1 - offset).where("idx >= 0")
    if strata is None:
        a, b = limit // 2, limit // 2 + limit // 4
        starts = dict(zip(TIERS, (0, a, b), strict=True))
        tier = F.when(F.col("idx") < a, "iid").when(F.col("idx") < b, "compositional").otherwise("challenge")
        turn = {t: F.element_at(F.array(*map(F.lit, own)), (F.pmod(F.col("idx") - starts[t], F.lit(len(own))) + 1).cast("int")) for t, own in TIERS.items()}
        placed = placed.withColumn("tier", tier).withColumn("category", F.coalesce(*[F.when(F.col("tier") == t, c) for t, c in turn.items()]))
    else:
        spans, at = [], 0
        for t, own in TIERS.items():
            for s in own:
                spans.append((t, s, at, at + strata.get((t, s), 0)))
                at = spans[-1][3]
        inside = lambda x, y: (F.col("idx") >= x) & (F.col("idx") < y)
        placed = placed.withColumn("tier", F.coalesce(*[F.when(inside(x, y), F.lit(t)) for t, _, x, y in spans])).withColumn("category", F.coalesce(*[F.when(inside(x, y), F.lit(s)) for _, s, x, y in spans]))
    nth = F.row_number().over(Window.partitionBy("category").orderBy("idx")) - 1 + offset  # over ``limit`` rows
    placed = placed.withColumn("nth", nth).withColumn("skeleton", dialogue.skeleton("turns"))
    prompts = []
    for name, own in PROMPTS.items():
        asked, tone, closer, constraint = realised([own, TONES, CLOSERS, CONSTRAINTS], F.col("nth"))
        prompts.append(F.when(F.col("category") == name, F.concat(tone, asked, closer, constraint)))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), (F.lit(text) if isinstance(text, str) else text).alias("content"))
    prompt = turn("user", F.coalesce(*prompts))
    variant = F.conv(F.substring(F.sha2("record", 256), 1, 8), 16, 10).cast("bigint")
    led = F.coalesce(*[F.when(F.col("category") == k, F.array(turn("user", v), turn("assistant", LEAD_REPLY), prompt)) for k, v in LEADS.items()])
    fifth = F.when(F.col("category").isin(*FIFTH) & (F.pmod(variant, F.lit(5)) == 4), F.array(turn("user", FIFTH_LEAD), turn("assistant", FIFTH_REPLY), prompt))
    messages = F.coalesce(F.when(F.col("skeleton.multi_turn"), led), fifth, F.array(prompt))
    parts = [F.lit(version)] + ([F.lit(purpose), F.lit(split)] if purpose != "evaluation" else [])
    hashed = F.substring(rank(*parts, "tier", "category", "source_id", "record"), 1, 16)
    return placed.select(
        "idx", F.concat(F.lit(f"{prefix}-"), F.upper("tier"), F.lit("-"), hashed).alias("case_id"), "tier", "category", messages.alias("messages"), "source_id", "record", "parent_id", "skeleton", F.lit(status).alias("status")
    )


def with_oracles(cases_: DataFrame) -> DataFrame:
    """Cases beside what is expected of them (ten rows, broadcast)."""
    own = oracles(cases_.sparkSession)
    return cases_.join(F.broadcast(own), "category", "left")


def case_issues(cases_: DataFrame) -> DataFrame:
    """code, severity, case_id of what speaks against a set of cases: repeated ids and parents, texts that are the
    same without blanks, personal data, names of tools, a last message that isn't a user's, and oracles that don't pass
    their own replay."""
    from ..functions import personal
    from ..functions.text import compact
    from .audit import issues, names_tools
    from .policy import TOOLS

    said = F.array_join(F.transform("messages", lambda m: m["content"]), "\n")
    rows = cases_.withColumn("__text", said)
    rules = {
        "invalid_messages": ("error", ~F.coalesce(F.element_at("messages", -1)["role"] == "user", F.lit(False))),
        "pii_detected": ("error", personal.in_case("__text")),
        "tool_name_leakage": ("error", names_tools(F.col("__text"), tuple(TOOLS))),
    }
    out = issues(rows, ["case_id"], rules).select("code", "severity", "case_id")
    for code, key in (("duplicate_case_id", F.col("case_id")), ("duplicate_source_parent", F.col("parent_id")), ("exact_text_duplicate", F.lower(compact("__text")))):
        repeated = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.min("case_id").alias("case_id")).where("n > 1")
        out = out.union(repeated.select(F.lit(code), F.lit("error"), "case_id"))
    failed = replayed(cases_.sparkSession).where("not passed").select("category")
    return out.union(cases_.join(F.broadcast(failed), "category", "left_semi").select(F.lit("oracle_evaluator_mismatch"), F.lit("error"), "case_id"))
