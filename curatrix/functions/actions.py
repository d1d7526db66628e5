"""Tool calls in model outputs: parsing, formatting, observation codes, tool formats."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_json, column

#: Fixed value: a call and its JSON input, up to the next call or the end.
ACTION = r"(?s)Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)"
_ACTION = re.compile(ACTION)


def calls(text: Column | str) -> Column:
    """array<struct<name, arguments>> of an output; ``arguments`` is what stands there, quotes and ticks off."""
    c = column(text)
    strip = lambda a: F.trim(F.regexp_replace(F.regexp_replace(F.trim(a), '^"+|"+$', ""), "^`+|`+$", ""))
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(c, F.lit(ACTION), F.lit(1)).alias("name"), F.regexp_extract_all(c, F.lit(ACTION), F.lit(2)).alias("raw")),
        lambda x: F.struct(x["name"].alias("name"), strip(x["raw"]).alias("arguments")),
    )


def kind(text: Column | str) -> Column:
    """tool_calls, final, malformed_action, invalid_action_json or action_input_not_object."""
    c = column(text)
    found = calls(c)
    parsed = F.transform(found, lambda x: F.try_parse_json(x["arguments"]))
    return (
        F.when((F.size(found) == 0) & c.rlike(r"(?i)\bAction\s*:"), "malformed_action")
        .when(F.size(found) == 0, "final")
        .when(F.exists(parsed, lambda v: v.isNull()), "invalid_action_json")
        .when(F.exists(parsed, lambda v: ~F.schema_of_variant(v).startswith("OBJECT")), "action_input_not_object")
        .otherwise("tool_calls")
    )


def parse(text: str) -> tuple[str, object]:
    """(tool_calls, [(name, arguments)]), (final, text) or (parse_error, what) of one output."""
    text = text.strip()
    found = _ACTION.findall(text)
    if not found:
        return ("parse_error", "malformed_action") if re.search(r"\bAction\s*:", text, re.I) else ("final", text)
    out = []
    for name, raw in found:
        try:
            args = json.loads(raw.strip().strip('"').strip("`").strip())
        except json.JSONDecodeError:
            return "parse_error", "invalid_action_json"
        if not isinstance(args, dict):
            return "parse_error", "action_input_not_object"
        out.append((name, args))
    return "tool_calls", out


def first_action(text: Column | str) -> Column:
    """Name of the first call, or the action field of an output that is (fenced) JSON."""
    c = column(text)
    named = F.regexp_extract(c, ACTION, 1)
    bare = F.regexp_replace(F.trim(c), r"^```json\s*|\s*```$", "")
    return F.coalesce(F.when(named != "", named), F.get_json_object(F.when(F.try_parse_json(bare).isNotNull(), bare), "$.action"))


def spaced_json(c: Column | str) -> Column:
    """Canonical JSON of an object of strings with a blank after each comma and colon."""
    entries = F.from_json(canonical_json(c), "map<string,string>")
    quoted = lambda s: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    items = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))


def formatted(name: Column | str, arguments: Column | str) -> Column:
    """A call as text, its arguments' keys sorted."""
    return F.concat(F.lit("Action: "), column(name), F.lit("\nAction Input: "), spaced_json(arguments))


def target_kind(text: Column | str) -> Column:
    return F.when(column(text).startswith("Action:"), "action").otherwise("response")


def observation_code(observation: Column | str) -> Column:
    """OK or a reason of a success, the error's code of a failure."""
    v = F.try_parse_json(column(observation))
    get = lambda p: F.try_variant_get(v, p, "string")
    ok = F.coalesce(F.try_variant_get(v, "$.ok", "boolean"), F.lit(False))
    return F.when(ok, F.coalesce(get("$.data.reason_code"), F.lit("OK"))).otherwise(F.coalesce(get("$.error.code"), F.lit("UNKNOWN_ERROR")))


#: How calls are put by tool format: before, between name and arguments, after.
CALL_FORMS = {
    "default": ("Action: ", "\nAction Input: ", ""),
    "qwen": ('<tool_call>\n{"name": "', '", "arguments": ', "}\n</tool_call>"),
    "glm4": ("", "\n", ""),
    "mistral": ('[TOOL_CALLS] [{"name": "', '", "arguments": ', "}]"),
    "llama3": ('{"name": "', '", "parameters": ', "}"),
}


def call_text(name: Column | str, arguments: Column | str, form: str = "default") -> Column:
    a, b, c = CALL_FORMS[form]
    return F.concat(F.lit(a), column(name), F.lit(b), spaced_json(arguments), F.lit(c))


def tools_prompt(tools: list[dict], form: str = "default", date: str | None = None) -> str:
    """System text that lists the tools; ``date`` is part of it where a format asks for one."""
    lines = [f"> Tool Name: {t['name']}\nTool Description: {t.get('description', '')}\nTool Args: {json.dumps(t.get('parameters', {}), ensure_ascii=False, sort_keys=True)}" for t in tools]
    head = f"Today is {date}.\n" if form == "llama3" and date else ""
    return head + "You have access to the following tools:\n" + "\n".join(lines)
