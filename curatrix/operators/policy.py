"""The after-sales policy: tool schemas, argument checks, decisions, and a replay of call sequences."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The policy's version, window, payment states and rules.
POLICY_VERSION, RETURN_WINDOW_DAYS, PAYMENT_STATUSES = "2026-08-v1", 7, ("paid",)
#: issue_type: allowed request types, requires delivery, enforces the window, needs evidence.
RULES = {
    "no_reason": (("return_refund",), True, True, False),
    "damaged": (("refund_only", "return_refund", "exchange"), True, False, True),
    "wrong_item": (("return_refund", "exchange"), True, False, True),
    "missing_item": (("refund_only",), True, False, True),
    "quality_issue": (("return_refund", "exchange"), True, False, True),
}
ORDER_PATTERN = "EC-[A-Z0-9-]+"
REQUEST_TYPES = ("refund_only", "return_refund", "exchange")
#: tool: (argument, enum or None for an order id) of its arguments, all required, none else allowed.
TOOLS = {
    "query_order_status": (("order_id", None),),
    "check_return_policy": (("order_id", None), ("issue_type", tuple(RULES))),
    "create_after_sales_request": (("order_id", None), ("request_type", REQUEST_TYPES), ("reason", tuple(RULES))),
}
# What an answer says beside its code.
MESSAGES = {
    "UNKNOWN_TOOL": "未定义工具：{0}",
    "not_object": "arguments 必须是 JSON object。",
    "missing": "缺少必填参数：{0}。",
    "unexpected": "包含未定义参数：{0}。",
    "type": "参数 {0} 必须是字符串。",
    "blank": "参数 {0} 不能为空。",
    "enum": "参数 {0} 不在允许值中：{1!r}。",
    "pattern": "参数 {0} 格式不合法：{1!r}。",
    "ORDER_NOT_FOUND": "未找到该订单。",
    "IDENTITY_NOT_VERIFIED": "用户身份尚未核验，不能创建售后申请。",
    "DUPLICATE_REQUEST": "该订单已有售后申请，不能重复创建。",
    "REQUEST_TYPE_NOT_ALLOWED": "当前问题不支持所选售后类型。",
    "UNSUPPORTED_ISSUE_TYPE": "未配置该问题类型的售后政策。",
    "ORDER_NOT_PAID": "订单尚未支付，不能申请售后。",
    "ORDER_NOT_DELIVERED": "订单尚未签收。",
    "RETURN_WINDOW_EXPIRED": "已超过 {0} 天无理由退货时效。",
    "ELIGIBLE": "符合当前售后政策。",
}


@dataclass(frozen=True)
class Policy:
    """Rules and tool schemas that decisions and simulators follow; the defaults are the versioned ones above."""

    version: str = POLICY_VERSION
    window: int = RETURN_WINDOW_DAYS
    payment_statuses: tuple[str, ...] = PAYMENT_STATUSES
    rules: dict[str, tuple] = field(default_factory=lambda: dict(RULES))
    #: tool: argument: the keys of its JSON schema that are checked (type, enum, pattern)
    tools: dict[str, dict[str, dict]] = field(default_factory=lambda: {t: {a: {"type": "string", "enum": e} if e else {"type": "string", "pattern": ORDER_PATTERN} for a, e in f} for t, f in TOOLS.items()})
    optional: frozenset[tuple[str, str]] = frozenset()
    #: tools that also take arguments without a schema
    free: frozenset[str] = frozenset()

    @classmethod
    def from_config(cls, tools: dict, policies: dict) -> Policy:
        """From the JSON objects of a tool list and of a policy; raises ValueError unless the tools are the known ones."""
        listed = tools.get("tools") if isinstance(tools, dict) else None
        schemas = {t.get("name"): t.get("parameters", {}) for t in listed or () if isinstance(t, dict)}
        if set(schemas) != set(TOOLS):
            raise ValueError(f"the tools must be {', '.join(sorted(TOOLS))}")
        if not isinstance(policies.get("rules"), dict) or not policies["rules"]:
            raise ValueError("a policy needs rules")
        known = {t: x.get("properties", {}) for t, x in schemas.items()}
        return cls(
            policies["policy_version"],
            policies["return_window_days"],
            tuple(policies["eligible_payment_statuses"]),
            {k: (tuple(r["allowed_request_types"]), bool(r.get("requires_delivery")), bool(r.get("enforce_return_window")), bool(r.get("evidence_required"))) for k, r in policies["rules"].items()},
            known,
            frozenset((t, a) for t, x in schemas.items() for a in known[t] if a not in x.get("required", [])),
            frozenset(t for t, x in schemas.items() if x.get("additionalProperties") is not False),
        )


DEFAULT = Policy()


def rules(spark: SparkSession, policy: Policy = DEFAULT) -> DataFrame:
    """The rules as a table of a row each."""
    rows = [(k, list(a), d, w, e) for k, (a, d, w, e) in policy.rules.items()]
    return spark.createDataFrame(rows, "issue_type string, allowed_request_types array<string>, requires_delivery boolean, enforce_return_window boolean, evidence_required boolean")


DECISIONS = ("UNSUPPORTED_ISSUE_TYPE", "ORDER_NOT_PAID", "ORDER_NOT_DELIVERED", "RETURN_WINDOW_EXPIRED", "ELIGIBLE")


def decision(orders: DataFrame, issue: str = "issue_type", policy: Policy = DEFAULT) -> DataFrame:
    """``orders`` with eligible, reason_code, allowed_request_types, evidence_required and message.

    orders: payment_status, fulfillment_status, days_since_delivery, and the issue's type.
    The first reason that applies counts: unsupported issue, not paid, not delivered,
    window over (an unknown number of days too).
    """
    r = rules(orders.sparkSession, policy).withColumnRenamed("issue_type", "__issue").withColumn("__known", F.lit(True))
    joined = orders.join(F.broadcast(r), F.col(issue) == F.col("__issue"), "left")  # a row for each rule
    late = F.col("enforce_return_window") & (F.col("days_since_delivery").isNull() | (F.col("days_since_delivery") > policy.window))
    code = (
        F.when(F.col("__known").isNull(), "UNSUPPORTED_ISSUE_TYPE")
        .when(~F.coalesce(F.col("payment_status").isin(*policy.payment_statuses), F.lit(False)), "ORDER_NOT_PAID")
        .when(F.col("requires_delivery") & ~F.col("fulfillment_status").eqNullSafe(F.lit("delivered")), "ORDER_NOT_DELIVERED")
        .when(late, "RETURN_WINDOW_EXPIRED")
        .otherwise("ELIGIBLE")
    )
    ok = code == "ELIGIBLE"
    return joined.select(
        *[F.col(c) for c in orders.columns],
        code.alias("reason_code"),
        ok.alias("eligible"),
        F.when(ok, F.col("allowed_request_types")).otherwise(F.array().cast("array<string>")).alias("allowed_request_types"),
        (ok & F.coalesce("evidence_required", F.lit(False))).alias("evidence_required"),
        F.coalesce(*[F.when(code == c, F.lit(MESSAGES[c].format(policy.window))) for c in DECISIONS]).alias("message"),
    )


def argument_error(tool: Column, arguments: Column) -> Column:
    """Null, or the first fault of a call: unknown_tool, not_object, missing:a,b, unexpected:a,b,
    type:a, blank:a, enum:a, pattern:a. ``arguments`` is JSON text."""
    parsed = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    keys = F.array_sort(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")))
    out = F.when(~F.coalesce(tool.isin(*TOOLS), F.lit(False)), "unknown_tool").when(~F.coalesce(is_object, F.lit(False)), "not_object")
    for name, fields in TOOLS.items():
        known = F.array(*[F.lit(a) for a in sorted(a for a, _ in fields)])
        missing, unexpected = F.array_except(known, keys), F.array_except(keys, known)
        faults = [
            F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))),
            F.when(F.size(unexpected) > 0, F.concat(F.lit("unexpected:"), F.array_join(unexpected, ","))),
        ]
        for a, enum in fields:
            raw = F.try_variant_get(parsed, f"$.{a}", "variant")
            value = F.try_variant_get(parsed, f"$.{a}", "string")
            faults += [F.when(F.schema_of_variant(raw) != "STRING", f"type:{a}"), F.when(F.trim(value) == "", f"blank:{a}")]
            faults.append(F.when(~value.isin(*enum), f"enum:{a}") if enum else F.when(~value.rlike(f"^(?:{ORDER_PATTERN})$"), f"pattern:{a}"))
        out = out.when(tool == name, F.coalesce(*faults))
    return out


def copied(x):
    """A deep copy of what JSON texts give; what isn't a plain dict or list goes to copy.deepcopy."""
    kind = type(x)
    if kind is dict:
        return {k: copied(v) for k, v in x.items()}
    if kind is list:
        return [copied(v) for v in x]
    return x if kind in _PLAIN else copy.deepcopy(x)


_PLAIN = frozenset((str, int, float, bool, type(None)))


class Simulator:
    """Orders of one case; calls are answered and may add a request to an order."""

    def __init__(self, orders: dict[str, dict], policy: Policy = DEFAULT):
        self.orders, self.policy = copied(orders), policy

    @classmethod
    def of_scenarios(cls, scenarios: dict, policy: Policy = DEFAULT) -> Simulator:
        """From a JSON object with a list of orders; raises ValueError for an order without an id or with another's."""
        listed = scenarios.get("orders")
        ids = [o.get("order_id") if isinstance(o, dict) else None for o in listed] if isinstance(listed, list) else [None]
        if not all(isinstance(i, str) for i in ids) or len(set(ids)) < len(ids):
            raise ValueError("each order needs an order_id of its own")
        return cls(dict(zip(ids, listed, strict=True)), policy)

    def snapshot(self) -> dict[str, dict]:
        """The state as it is now; later calls don't change it."""
        return copied(self.orders)

    def call(self, tool: str, args) -> dict:
        if tool not in self.policy.tools:
            return self._no(tool, "UNKNOWN_TOOL", MESSAGES["UNKNOWN_TOOL"].format(tool))
        fault = self._fault(tool, args)
        if fault:
            return self._no(tool, "INVALID_ARGUMENTS", fault)
        order = self.orders.get(args["order_id"])
        if order is None:
            return self._no(tool, "ORDER_NOT_FOUND", MESSAGES["ORDER_NOT_FOUND"])
        failure = (order.get("tool_failures") or {}).get(tool)
        if isinstance(failure, dict):
            return self._no(tool, failure["code"], failure.get("message", ""), bool(failure.get("retryable")))
        made = getattr(self, f"_{tool}")(order, args)
        return {"ok": True, "tool": tool, "data": copied(made)} if isinstance(made, dict) else self._no(tool, made, MESSAGES[made].format(self.policy.window))

    @staticmethod
    def _no(tool: str, code: str, message: str, retryable: bool = False) -> dict:
        return {"ok": False, "tool": tool, "error": {"code": code, "message": message, "retryable": retryable}}

    def _fault(self, tool: str, args) -> str | None:
        """What is wrong with a call's arguments: absent ones, then unknown ones, then their values in turn."""
        if not isinstance(args, dict):
            return MESSAGES["not_object"]
        known = self.policy.tools[tool]
        absent = sorted(a for a in known if a not in args and (tool, a) not in self.policy.optional)
        strange = sorted(set(args) - set(known)) if tool not in self.policy.free else []
        for kind, names in (("missing", absent), ("unexpected", strange)):
            if names:
                return MESSAGES[kind].format(", ".join(names))
        for a, value in args.items():
            kind = self._bad_value(known.get(a, {}), value)
            if kind:
                return MESSAGES[kind].format(a, value)
        return None

    @staticmethod
    def _bad_value(schema: dict, value) -> str | None:
        is_text = isinstance(value, str)
        bad = {
            "type": schema.get("type") == "string" and not is_text,
            "blank": is_text and not value.strip(),
            "enum": schema.get("enum") is not None and value not in schema["enum"],
            "pattern": is_text and "pattern" in schema and not re.fullmatch(schema["pattern"], value),
        }
        return next((kind for kind, holds in bad.items() if holds), None)

    def _query_order_status(self, order: dict, args: dict) -> dict:
        shown = ("order_id", "payment_status", "fulfillment_status", "days_since_delivery", "item_summary", "after_sales_request")
        return {k: order.get(k) for k in shown} | {"identity_verification_status": "verified" if order.get("identity_verified") else "required"}

    def _check_return_policy(self, order: dict, args: dict) -> dict:
        return self._decided(order, args["issue_type"])

    def _decided(self, order: dict, issue: str) -> dict:
        p = self.policy
        allowed, delivery, window, evidence = p.rules.get(issue, ((), False, False, False))
        days = order.get("days_since_delivery")
        holds = (
            issue not in p.rules,
            order.get("payment_status") not in p.payment_statuses,
            delivery and order.get("fulfillment_status") != "delivered",
            window and (not isinstance(days, int) or days > p.window),
            True,
        )
        code = DECISIONS[holds.index(True)]
        ok = code == "ELIGIBLE"
        base = {"order_id": order["order_id"], "issue_type": issue, "policy_version": p.version, "eligible": ok, "reason_code": code}
        return base | {"allowed_request_types": list(allowed) if ok else [], "evidence_required": ok and evidence, "message": MESSAGES[code].format(p.window)}

    def _create_after_sales_request(self, order: dict, args: dict) -> dict | str:
        if not order.get("identity_verified"):
            return "IDENTITY_NOT_VERIFIED"
        if order.get("after_sales_request") is not None:
            return "DUPLICATE_REQUEST"
        d = self._decided(order, args["reason"])
        if not d["eligible"]:
            return d["reason_code"]
        if args["request_type"] not in d["allowed_request_types"]:
            return "REQUEST_TYPE_NOT_ALLOWED"
        made = {"request_id": f"ASR-{order['order_id']}-001", "order_id": order["order_id"], "request_type": args["request_type"], "reason": args["reason"], "status": "submitted", "evidence_required": d["evidence_required"]}
        order["after_sales_request"] = copied(made)
        return made


def code_of(observation: dict) -> str:
    if not observation.get("ok"):
        return (observation.get("error") or {}).get("code", "UNKNOWN_ERROR")
    return (observation.get("data") or {}).get("reason_code", "OK")


TRACE = "case_id string, codes array<string>, final_answer string, termination_reason string, parse_error string, calls string, observations string, state_before string, state_after string"


def rollouts(cases: DataFrame, generate: Callable[[dict, list[dict]], str], max_steps: int = 6, policy: Policy = DEFAULT, spread: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """One trace for each case: case_id, orders (JSON: id to order), and whatever ``generate`` needs.

    ``generate(case, messages)`` gives the next output; calls are executed in the case's
    own simulator until a final answer, an output that can't be parsed, or ``max_steps``.
    Cases are independent. They are dealt out anew, as a case costs far more than its move and a
    small table may come in one partition; without ``spread`` they stay as the input is. The state
    is kept as it is before the first and after the last call. ``columns`` names those of TRACE that are
    wanted, all by default; JSON of others isn't written.
    """
    import json

    names = cases.columns
    wanted = [c for c in TRACE.split(", ") if not columns or c.split()[0] in columns]
    if columns and len(wanted) != len(set(columns)):
        raise ValueError("columns are those of TRACE")
    told = [c.split()[0] for c in wanted]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions.actions import parse

        dump = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode
        shown = {c: dump if c in told else lambda x: None for c in ("calls", "observations", "state_before", "state_after")}
        for pdf in batches:
            out = []
            for case in pdf.to_dict("records"):
                sim, messages, codes, calls, seen = Simulator(json.loads(case["orders"] or "{}"), policy), [], [], [], []
                before = shown["state_before"](sim.orders)
                final, reason, error = None, "max_steps", None
                for _ in range(max_steps):
                    text = generate(case, messages)
                    kind, value = parse(text)
                    messages.append({"role": "assistant", "content": text})
                    if kind == "final":
                        final, reason = value, "final_answer"
                        break
                    if kind == "parse_error":
                        error, reason = value, "parse_error"
                        break
                    for name, args in value:
                        got = sim.call(name, args)
                        calls.append({"name": name, "arguments": args})
                        seen.append(got)
                        codes.append(code_of(got))
                        messages.append({"role": "observation", "content": dump(got)})
                out.append((case["case_id"], codes, final, reason, error, shown["calls"](calls), shown["observations"](seen), before, shown["state_after"](sim.orders)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACE.split(", ")])[told]

    if spread:
        cases = cases.repartition(int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_id")
    return cases.select(*names).mapInPandas(run, ", ".join(wanted))


def replay_requests(df: DataFrame, order_id: str, at: str, eligible: Column, kind: Column) -> DataFrame:
    """``outcome`` of each request to create an after-sales request, in order of ``at``.

    State is one fact for each order: whether a request succeeded before. It is the least
    ``at`` of the order's eligible requests, so a partial aggregation replaces the replay.
    """
    asked = df.withColumn("__ok", eligible).withColumn("kind", kind)
    first = asked.where("__ok").groupBy(order_id).agg(F.min(at).alias("__first"))
    joined = asked.join(first, order_id, "left")
    outcome = F.when(F.col(at) > F.col("__first"), "DUPLICATE_REQUEST").when(F.col("__ok"), "OK").otherwise("NOT_ELIGIBLE")
    return joined.withColumn("outcome", outcome).drop("__ok", "__first")
