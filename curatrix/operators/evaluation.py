"""Evaluation of traces against what was expected, and preference pairs from where they part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import actions
from ..functions.text import canonical_json, column, dotted

CALLS = "array<struct<name:string,arguments:string>>"
#: Categories whose cases a policy never resolves by itself.
NOT_AUTOMATIC = ("identity", "timeout")
#: Identifiers, and claims about states with the state each stands for.
IDENTIFIER = r"\b(?:EC|ASR)-[A-Z0-9-]+\b"
CLAIMS = {
    "(?:已退款|已经退款|退款成功)": "refunded",
    "(?<!未)已提交": "submitted",
    "(?<!未)已审核": "approved",
    "(?:已签收|完成交付|已完成交付)": "delivered",
    "(?:已发货|运输中)": "shipped",
    "(?:已支付|完成支付|已完成支付)": "paid",
}
NEGATED = "(?<!(?:尚未|并未|没有|并没有|不是|并非|不代表|无法确认|不能确认|尚无法确认|未能确认)[^，。；！？\\n]{0,6})"
_STATUS = r'"(?:status|payment_status|fulfillment_status)":\s*"([^"]+)"'
_STATED = "[\"'](?:status|payment_status|fulfillment_status)[\"']\\s*:\\s*[\"']([^\"']+)[\"']"
#: Checks in the order in which they are reported, with the error that names a failure.
CHECKS = {
    "parse_success": "parse_error",
    "tool_selection_valid": "wrong_tool",
    "arguments_valid": "wrong_argument",
    "forbidden_tool_absent": "forbidden_tool",
    "observation_outcomes_valid": "unexpected_tool_outcome",
    "final_answer_present": "missing_final_answer",
    "answer_requirements_met": "incomplete_resolution",
    "state_assertions_met": "goal_state_not_reached",
    "facts_faithful": "hallucinated_state",
    "within_step_limit": "max_steps",
}


def canonical_calls(calls: Column) -> Column:
    """name and canonical arguments of each call, so that equal calls are equal values."""
    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), canonical_json(c["arguments"]).alias("arguments")))


def _plain(calls: Column) -> Column:
    """name and arguments of each call as they are."""
    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")))


def _names(calls: Column) -> Column:
    return F.transform(calls, lambda c: c["name"])


def same_calls(a: Column, b: Column) -> Column:
    """Are two lists of calls equal in canonical form? Equal texts are, other names aren't; JSON is read for the rest only."""
    canonical = F.when(_names(a) == _names(b), canonical_calls(a) == canonical_calls(b)).otherwise(_names(a) == _names(b))
    return F.when(a == b, True).otherwise(canonical)


def fact_issues(answer: Column, inputs: Column, evidence: Column) -> Column:
    """Identifiers and states that an answer claims without support, sorted.

    ``inputs`` and ``evidence`` are JSON texts; evidence names states in status fields.
    """
    found = lambda c: F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0))
    ids = F.array_except(found(answer), F.concat(found(inputs), found(evidence)))
    known = F.regexp_extract_all(evidence, F.lit(_STATUS), F.lit(1))
    claimed = F.array_compact(F.array(*[F.when(answer.rlike(p) & answer.rlike(NEGATED + p), F.lit(s)) for p, s in CLAIMS.items()]))
    states = F.array_except(F.concat(F.regexp_extract_all(answer, F.lit(_STATED), F.lit(1)), claimed), known)
    return F.array_sort(F.concat(F.transform(ids, lambda i: F.concat(F.lit("unsupported_identifier:"), i)), F.transform(states, lambda s: F.concat(F.lit("unsupported_state:"), s))))


def evaluate(cases: DataFrame, traces: DataFrame) -> DataFrame:
    """case_id, category, passed, auto_resolution_eligible, auto_resolved, checks, errors for each case.

    cases: case_id, category, acceptable (array of call arrays), must_not_call, codes,
    term_groups (array of arrays), assertions (array of path, equals as JSON), inputs (JSON).
    traces: case_id, calls, codes, answer, parse_errors, evidence (JSON), state_after
    (JSON), termination_reason. A case without a trace fails with missing_trace and null
    checks. Repeated or unknown case ids in traces raise an error when the result is read.
    """
    t = traces.select("case_id", *[F.col(c).alias(f"t_{c}") for c in traces.columns if c != "case_id"], F.lit(True).alias("traced"))
    # One join tells cases without a trace and traces without a case; the guard costs no pass of its own.
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("t_calls"))
    own = cases.withColumn("__case", F.lit(True))
    j = own.join(t.withColumn("__nth", nth), "case_id", "full_outer")
    bad = F.col("__case").isNull() | (F.coalesce("__nth", F.lit(1)) > 1)
    j = j.withColumn("case_id", F.when(bad, F.raise_error(F.lit("traces have repeated or unknown cases")).cast(cases.schema["case_id"].dataType)).otherwise(F.col("case_id")))
    acceptable = F.when(F.size("acceptable") > 0, F.col("acceptable")).otherwise(F.array(F.array().cast(CALLS)))
    answer = F.trim(F.coalesce("t_answer", F.lit("")))
    issues = fact_issues(answer, F.coalesce("inputs", F.lit("[]")), F.coalesce("t_evidence", F.lit("[]")))
    # Columns of their own, so that each is made once for a row and not wherever it is read.
    j = j.withColumns({"__acceptable": F.transform(acceptable, _plain), "__calls": _plain(F.col("t_calls")), "__names": _names(F.col("t_calls")), "__facts": issues})
    names, calls = F.col("__names"), F.col("__calls")
    state = lambda a: F.coalesce(_at(F.col("t_state_after"), a["path"]) == canonical_json(a["equals"]), F.lit(False))
    checks = {
        "parse_success": F.coalesce(F.size("t_parse_errors"), F.lit(0)) <= 0,
        "tool_selection_valid": F.exists("__acceptable", lambda s: _names(s) == names),
        "arguments_valid": F.exists("__acceptable", lambda s: same_calls(s, calls)),
        "forbidden_tool_absent": ~F.arrays_overlap(names, F.coalesce("must_not_call", F.array().cast("array<string>"))),
        "observation_outcomes_valid": F.coalesce("t_codes", F.array().cast("array<string>")) == F.coalesce("codes", F.array().cast("array<string>")),
        "final_answer_present": answer != "",
        "answer_requirements_met": F.forall(F.coalesce("term_groups", F.array().cast("array<array<string>>")), lambda g: F.exists(g, lambda x: F.contains(answer, x))),
        "state_assertions_met": F.forall(F.coalesce("assertions", F.array().cast("array<struct<path:string,equals:string>>")), state),
        "facts_faithful": F.size("__facts") == 0,
        "within_step_limit": ~F.coalesce(F.col("t_termination_reason") == "max_steps", F.lit(False)),
    }
    j = j.withColumn("checks", F.when(F.col("traced"), F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])))
    passed = F.coalesce(_all([F.col(f"checks.{n}") for n in CHECKS]), F.lit(False))
    named = F.array_compact(F.array(*[F.when(~F.col(f"checks.{n}"), F.lit(e)) for n, e in CHECKS.items()]))
    errors = F.when(F.col("traced"), F.array_sort(F.array_distinct(F.concat(named, "__facts")))).otherwise(F.array(F.lit("missing_trace")))
    own = F.col("auto_resolution_eligible") if "auto_resolution_eligible" in cases.columns else F.lit(None).cast("boolean")
    eligible = F.coalesce(own, ~F.coalesce(F.col("category").isin(*NOT_AUTOMATIC), F.lit(False)))
    return j.select("case_id", "category", passed.alias("passed"), eligible.alias("auto_resolution_eligible"), (eligible & passed).alias("auto_resolved"), "checks", errors.alias("errors"))


def _all(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out & f
    return out


def _at(document: Column, path: Column) -> Column:
    """Canonical JSON at a dotted path that varies by row; null where a part is missing."""
    inner = lambda v, part: F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), part)
    return F.to_json(F.aggregate(F.split(path, r"\."), F.try_parse_json(document), inner))


def exact_checks(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """The stricter set: calls, codes, terminal state, forbidden tools and claimed facts must all match.

    expected: case_id, calls, codes, terminal_status, must_not_call, allowed_claims (map);
    predictions: case_id, calls, codes, terminal_status, claimed_facts (map).
    """
    p = predictions.select("case_id", *[F.col(c).alias(f"p_{c}") for c in predictions.columns if c != "case_id"])
    j = expected.join(p, "case_id", "left")
    a, b = canonical_calls(F.col("p_calls")), canonical_calls(F.col("calls"))
    names = lambda c: F.transform(c, lambda x: x["name"])
    claims = F.forall(F.map_entries("p_claimed_facts"), lambda e: F.element_at("allowed_claims", e["key"]).eqNullSafe(e["value"]))
    flags = {
        "tool_selection_exact": names(a) == names(b),
        "arguments_exact": a == b,
        "observation_codes_exact": F.col("p_codes") == F.col("codes"),
        "terminal_status_exact": F.col("p_terminal_status") == F.col("terminal_status"),
        "forbidden_tool_absent": ~F.arrays_overlap(names(a), F.col("must_not_call")),
        "claims_allowed": claims,
        "prediction_present": F.col("p_calls").isNotNull(),
    }
    checks = [F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()]
    out = j.select("case_id", *checks)
    return out.withColumn("passed", _all([F.col(n) for n in flags])).withColumn("errors", F.array_sort(F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in flags]))))


def first_divergence(turns: DataFrame, expected: DataFrame) -> DataFrame:
    """Where each trace first leaves the expected calls: case_id, step, reason, level, primary_error, chosen_call, rejected.

    turns: case_id, step, kind (tool_calls, final, parse_error), calls, output. expected:
    case_id, calls, answer, one row for each case. ``reason`` is selected, or why there is no pair. The calls
    before a turn are counted by a window over the case; a case's turns are few. Arguments
    are brought into canonical form where texts differ, and for the pair that is returned.
    """
    w = Window.partitionBy("case_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    n = F.when(F.col("kind") == "tool_calls", F.greatest(F.size("calls"), F.lit(0))).otherwise(0)
    e = expected.select("case_id", _plain(F.col("calls")).alias("wanted"), "answer")
    t = turns.withColumn("calls", _plain(F.col("calls")))
    t = t.withColumn("done", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("int")).join(e, "case_id")
    size = F.size("calls")
    next_ = F.get("wanted", F.col("done"))
    t = t.withColumn("due", F.slice("wanted", F.col("done") + 1, F.greatest(size, F.lit(0))))
    same = (F.col("kind") == "tool_calls") & (size > 0) & same_calls(F.col("due"), F.col("calls"))
    parted = t.where(~F.coalesce(same, F.lit(False)))
    one = F.struct("step", "kind", F.col("calls").alias("actual"), "output", "answer", next_.alias("next"))
    first = parted.groupBy("case_id").agg(F.min_by(one, "step").alias("d"))
    d = lambda c: F.col(f"d.{c}")
    over = d("next").isNull()
    final, call = d("kind") == "final", d("kind") == "tool_calls"
    # Cases without a divergence come by the same join, so that the work above is done once.
    first = expected.select("case_id").join(first, "case_id", "left")
    reason = (
        F.when(F.col("d").isNull(), "no_actionable_first_divergence")
        .when(d("kind") == "parse_error", "parse_error_not_near_miss")
        .when(~(final | call), "unsupported_turn_kind")
        .when(call & (F.size(d("actual")) <= 0), "empty_tool_call")
        .when(call & (F.size(d("actual")) > 1), "multi_call_divergence_requires_alignment")
        .otherwise("selected")
    )
    level = F.when(final & over, "response").when(call & ~over & (F.get(d("actual"), F.lit(0))["name"] == d("next")["name"]), "parameter").otherwise("decision")
    error = F.when(final & over, "incomplete_resolution").when(final, "premature_stop").when(over, "unnecessary_tool").when(level == "parameter", "invalid_argument").otherwise("wrong_action")
    text = lambda c: actions.formatted(c["name"], c["arguments"])
    chosen = F.when(over, d("answer")).otherwise(text(d("next")))
    rejected = F.when(final, F.trim(d("output"))).otherwise(text(F.get(d("actual"), F.lit(0))))
    picked = reason == "selected"
    return first.select("case_id", d("step").alias("step"), reason.alias("reason"), *[F.when(picked, c).alias(n_) for n_, c in (("level", level), ("primary_error", error), ("chosen", chosen), ("rejected", rejected))])


def bucket(level: Column, chosen_kind: Column, rejected_kind: Column) -> Column:
    """Behaviour that a pair teaches; a pair of another structure raises an error."""
    a, r = lambda c: c == "action", lambda c: c == "response"
    return (
        F.when((level == "parameter") & a(chosen_kind) & a(rejected_kind), "parameter")
        .when((level == "response") & r(chosen_kind) & r(rejected_kind), "response")
        .when((level == "decision") & a(chosen_kind) & r(rejected_kind), "must_continue")
        .when((level == "decision") & r(chosen_kind) & a(rejected_kind), "must_stop")
        .when((level == "decision") & a(chosen_kind) & a(rejected_kind), "wrong_action")
        .otherwise(F.raise_error(F.concat_ws("/", F.lit("unsupported preference structure"), level, chosen_kind, rejected_kind)))
    )


def margin(chosen_sum: Column, chosen_n: Column, rejected_sum: Column, rejected_n: Column) -> Column:
    """Difference of mean log probabilities; null for a completion without tokens."""
    return F.try_divide(chosen_sum, chosen_n) - F.try_divide(rejected_sum, rejected_n)


def state_at(document: Column | str, path: str) -> Column:
    return dotted(column(document), path)
