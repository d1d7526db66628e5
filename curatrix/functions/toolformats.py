"""How model families write tool lists and calls, and how calls are read back."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .actions import ACTION
from .text import canonical_json, column

FAMILIES = {"default": "default", "glm4": "glm4", "llama3": "llama3", "mistral": "mistral", "qwen": "qwen", "qwen3": "qwen", "qwen3.5": "qwen"}
CALLS = "array<struct<name:string,arguments:string>>"

#: The texts in which tool lists stand.
_DEFAULT = (
    "You have access to the following tools:\n{tools}Use the following format if using a tool:\n```\nAction: tool name (one of [{names}])\n"
    'Action Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{{"input": "hello world", "num_beams": 5}}```)\n```\n'
)
_GLM4 = "你是一个名为 ChatGLM 的人工智能助手。你是基于智谱AI训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。# 可用工具{tools}"
_GLM4_TOOL = "\n\n## {name}\n\n{body}\n在调用上述函数时，请使用 Json 格式表示调用的参数。"
_LLAMA3 = (
    "Cutting Knowledge Date: December 2023\nToday Date: {date}\n\nYou have access to the following functions. To call a function, please respond with JSON for a function call. "
    'Respond in the format {{"name": function name, "parameters": dictionary of argument name and its value}}. Do not use variables.\n\n{tools}'
)
_QWEN = (
    "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>{tools}"
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n"
    '<tool_call>\n{{"name": <function-name>, "arguments": <args-json-object>}}\n</tool_call>'
)


def family(name: str) -> str:
    if name not in FAMILIES:
        raise ValueError(f"no tool format {name}")
    return FAMILIES[name]


def tool_list(tools: list[dict], name: str, date: str = "") -> str:
    """System text for a list of tool schemas. ``date`` is a parameter, so that results don't depend on the day."""
    kind, dump = family(name), lambda x, **k: json.dumps(x, ensure_ascii=False, **k)
    wrapped = [{"type": "function", "function": t} for t in tools]
    if kind == "glm4":
        return _GLM4.format(tools="".join(_GLM4_TOOL.format(name=t["name"], body=dump(t, indent=4)) for t in tools))
    if kind == "llama3":
        return _LLAMA3.format(date=date, tools="".join(dump(w, indent=4) + "\n\n" for w in wrapped))
    if kind == "mistral":
        return f"[AVAILABLE_TOOLS] {dump(wrapped)}[/AVAILABLE_TOOLS]"
    if kind == "qwen":
        return _QWEN.format(tools="".join("\n" + dump(w) for w in wrapped))
    texts = [f"> Tool Name: {t['name']}\nTool Description: {t.get('description', '')}\nTool Args:\n{''.join(map(_argument, _schema(t)))}\n" for t in tools]
    return _DEFAULT.format(tools="".join(texts), names=", ".join(t["name"] for t in tools))


def _schema(tool: dict):
    needed = tool["parameters"].get("required", [])
    return [(n, p, n in needed) for n, p in tool["parameters"]["properties"].items()]


def _argument(entry) -> str:
    name, p, needed = entry
    out = f"  - {name} ({p.get('type', '')}{', required' if needed else ''}): {p.get('description', '')}"
    if p.get("enum"):
        out += f", should be one of [{', '.join(p['enum'])}]"
    if p.get("items"):
        out += f", where each item should be {p['items'].get('type', '')}"
    return out + "\n"


def calls_text(calls: Column | str, name: str) -> Column:
    """An array of (name, arguments as JSON text) as the family writes it; an error for several calls where it can't."""
    kind, c = family(name), column(calls)
    obj = lambda x, key: F.concat(F.lit('{"name": "'), x["name"], F.lit(f'", "{key}": '), x["arguments"], F.lit("}"))
    if kind == "default":
        return F.array_join(F.transform(c, lambda x: F.concat(F.lit("Action: "), x["name"], F.lit("\nAction Input: "), x["arguments"], F.lit("\n"))), "")
    if kind == "mistral":
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: obj(x, "arguments")), ", "), F.lit("]"))
    if kind == "qwen":
        return F.array_join(F.transform(c, lambda x: F.concat(F.lit("<tool_call>\n"), obj(x, "arguments"), F.lit("\n</tool_call>"))), "\n")
    first = F.get(c, F.lit(0))
    one = F.concat(first["name"], F.lit("\n"), first["arguments"]) if kind == "glm4" else obj(first, "parameters")
    return F.when(F.size(c) > 1, F.raise_error(F.lit(f"{kind} has no parallel calls"))).otherwise(one)


def calls_read(content: Column | str, name: str) -> Column:
    """The calls in an output with canonical arguments; null where it is an answer or can't be read."""
    kind, c = family(name), column(content)
    call = lambda n, a: F.struct(n.alias("name"), canonical_json(a).alias("arguments"))
    member = lambda v, key: F.to_json(F.try_variant_get(v, f"$.{key}", "variant"))
    named = lambda v: F.try_variant_get(v, "$.name", "string")
    from_object = lambda v, key: F.struct(named(v).alias("name"), member(v, key).alias("arguments"))
    if kind == "default":
        found = F.arrays_zip(F.regexp_extract_all(c, F.lit(ACTION), F.lit(1)).alias("n"), F.regexp_extract_all(c, F.lit(ACTION), F.lit(2)).alias("a"))
        bare = lambda a: F.regexp_replace(F.regexp_replace(F.trim(a), '^"+|"+$', ""), "^`+|`+$", "")
        out = F.transform(found, lambda x: call(F.trim(x["n"]), bare(x["a"])))
    elif kind == "glm4":
        at = F.instr(c, "\n")
        out = F.when(at > 0, F.array(call(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.char_length(c)))))
    elif kind == "llama3":
        out = F.array(from_object(F.try_parse_json(c), "parameters"))
    else:
        if kind == "qwen":
            texts = F.regexp_extract_all(c, F.lit(r"(?s)<tool_call>(.+?)</tool_call>(?=\s*<tool_call>|\s*$)"), F.lit(1))
        else:
            texts = F.transform(F.coalesce(F.from_json(F.when(F.trim(c).startswith("["), c), "array<variant>"), F.array(F.try_parse_json(c))), lambda v: F.to_json(v))
        out = F.transform(texts, lambda x: from_object(F.try_parse_json(x), "arguments"))
    whole = (F.size(out) > 0) & F.forall(out, lambda x: x["name"].isNotNull() & x["arguments"].isNotNull())
    return F.when(whole, out)


def chat_messages(turns: Column | str, tools: str = "", form: str = "default") -> Column:
    """(role, content) messages of (from, value) turns: calls are written by the family and said by the
    assistant, observations by the user; system text is the last system turn's with the tools after it."""
    t = column(turns)
    said = F.filter(t, lambda x: x["from"] != "system")
    call = lambda v: calls_text(F.array(F.struct(F.get_json_object(v, "$.name").alias("name"), F.get_json_object(v, "$.arguments").alias("arguments"))), form)
    from .dialogue import observation

    body = F.transform(
        said,
        lambda x: F.struct(
            F.when(x["from"].isin("gpt", "function_call"), "assistant").otherwise("user").alias("role"),
            F.when(x["from"] == "function_call", call(x["value"])).when(x["from"] == "observation", observation(x["value"], form)).otherwise(x["value"]).alias("content"),
        ),
    )
    systems = F.filter(t, lambda x: x["from"] == "system")
    text = F.concat(F.coalesce(F.get(systems, F.size(systems) - 1)["value"], F.lit("")), F.lit(tools))
    head = F.when(text != "", F.array(F.struct(F.lit("system").alias("role"), text.alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return F.concat(head, body)


def masked_labels(sources: Column | str, targets: Column | str, limit: int, ignore: int = -100) -> Column:
    """(input_ids, labels) of turn pairs of token ids: sources are masked, pairs cut in proportion to
    their sizes, and no pair is begun beyond ``limit``."""
    pairs = F.arrays_zip(column(sources).alias("s"), column(targets).alias("t"))
    empty = F.struct(F.array().cast("array<int>").alias("input_ids"), F.array().cast("array<int>").alias("labels"))

    def fold(done: Column, p: Column) -> Column:
        n, m = F.size(p["s"]), F.size(p["t"])
        room = F.lit(limit) - F.size(done["input_ids"])
        over = n + m > room
        keep_s = F.when(over, F.floor(room * n / (n + m))).otherwise(n).cast("int")
        keep_t = F.when(over, room - keep_s).otherwise(m).cast("int")
        s, t = F.slice(p["s"], 1, F.greatest(keep_s, F.lit(0))), F.slice(p["t"], 1, F.greatest(keep_t, F.lit(0)))
        more = F.struct(F.concat(done["input_ids"], s, t).alias("input_ids"), F.concat(done["labels"], F.array_repeat(F.lit(ignore), F.size(s)), t).alias("labels"))
        return F.when(room <= 0, done).otherwise(more)

    return F.aggregate(pairs, empty, fold)


def trained_turns(sources: Column | str, targets: Column | str, limit: int, end: int, ignore: int = -100, on_sources: bool = False) -> Column:
    """(input_ids, labels) of turn pairs of token ids, each pair closed by an end token.

    A pair's source and target may take the shares of ``limit`` that they have of the pair, the
    target one less for the end token; an end token that opens a source or closes a target goes. The first
    pair that doesn't fit ends the dialogue. Sources are masked unless ``on_sources``; a pair without
    tokens is left out.
    """
    pairs = F.filter(F.arrays_zip(column(sources).alias("s"), column(targets).alias("t")), lambda p: F.size(p["s"]) + F.size(p["t"]) > 0)
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("input_ids"), none.alias("labels"), F.lit(False).alias("full"))

    def fold(done: Column, p: Column) -> Column:
        n, m = F.size(p["s"]), F.size(p["t"])
        share = lambda x: F.floor(F.lit(limit) * (x / (n + m))).cast("int")
        s, t = F.slice(p["s"], 1, F.least(n, share(n))), F.slice(p["t"], 1, F.greatest(F.least(m, share(m) - 1), F.lit(0)))
        s = F.when(F.get(s, F.lit(0)) == end, F.slice(s, 2, F.size(s))).otherwise(s)
        t = F.when(F.get(t, F.size(t) - 1) == end, F.slice(t, 1, F.size(t) - 1)).otherwise(t)
        full = done["full"] | (F.size(done["input_ids"]) + F.size(s) + F.size(t) + 1 > limit)
        close = F.array(F.lit(end))
        said = s if on_sources else F.array_repeat(F.lit(ignore), F.size(s))
        more = F.struct(F.concat(done["input_ids"], s, t, close).alias("input_ids"), F.concat(done["labels"], said, t, close).alias("labels"), F.lit(False).alias("full"))
        return F.when(full, F.struct(done["input_ids"].alias("input_ids"), done["labels"].alias("labels"), F.lit(True).alias("full"))).otherwise(more)

    return F.aggregate(pairs, start, fold, lambda done: F.struct(done["input_ids"].alias("input_ids"), done["labels"].alias("labels")))


def learnable(labels: Column | str, ignore: int = -100) -> Column:
    """Is any label not masked?"""
    return F.exists(column(labels), lambda x: x != ignore)


def within_tokens(limit: int, *tokens: Column | str) -> Column:
    """Are all token arrays there, not empty, and within the limit?"""
    out = F.lit(True)
    for t in tokens:
        out = out & F.coalesce(F.size(column(t)).between(1, limit), F.lit(False))
    return out
