"""Conversation templates by name, and rendering of turn pairs with them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column


class Template(NamedTuple):
    prompt: str  # holds {query}
    separator: str
    system: str = ""


_CHATML = "<|im_start|>user\n{query}<|im_end|>\n<|im_start|>assistant\n"
_ASSISTANT = "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n"
#: Published prompt formats: how a query is put, what separates turns, default system text.
TEMPLATES = {
    "vicuna": Template("USER: {query} ASSISTANT:", "</s>", "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."),
    "base": Template("{query}", "</s>"),
    "alpaca": Template("### Instruction:\n{query}\n\n### Response:\n", "\n\n", "Below is an instruction that describes a task. Write a response that appropriately completes the request."),
    "baichuan": Template("<reserved_102>{query}<reserved_103>", "</s>"),
    "baichuan2": Template("<reserved_106>{query}<reserved_107>", "</s>"),
    "ziya": Template("<human>:{query}\n<bot>:", "\n"),
    "linly": Template("User: {query}\nBot: ", "\n"),
    "chatglm": Template("问：{query}\n答：", "\n"),
    "chatglm2": Template("问：{query}\n\n答：", "\n\n"),
    "chatglm3": Template("<|user|>\n{query}<|assistant|>", "\n"),
    "phoenix": Template("Human: <s>{query}</s>Assistant: ", "</s>", "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions.\n\n"),
    "belle": Template("Human: {query}\n\nBelle: ", "\n\n"),
    "aquila": Template("Human: {query}###Assistant:", "###", "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."),
    "intern": Template("<|User|>:{query}<eoh>\n<|Bot|>:", "<eoa>\n"),
    "intern2": Template(_CHATML, "<|im_end|>\n", "<|im_start|>system\nYou are an AI assistant whose name is InternLM (书生·浦语).\n<|im_end|>\n"),
    "starchat": Template("<|user|>\n{query}<|end|>\n<|assistant|>\n", "<|end|>\n", "<system>\n"),
    "llama2": Template(
        "[INST] {query} [/INST]",
        "</s>",
        "<<SYS>>\nYou are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe. Your answers should not include any harmful, unethical, racist, sexist, "
        "toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, "
        "explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information.\n<</SYS>>\n\n",
    ),
    "llama3": Template("<|start_header_id|>user<|end_header_id|>\n\n{query}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>system<|end_header_id|>\n\nYou are a helpful, excellent and smart assistant."),
    "llama2-zh": Template("[INST] {query} [/INST]", "</s>", "[INST] <<SYS>>\nYou are a helpful assistant. 你是一个乐于助人的助手。\n<</SYS>>\n\n [/INST]"),
    "mistral": Template("[INST] {query} [/INST]", "</s>"),
    "xverse": Template("Human: {query}\n\nAssistant: ", "</s>"),
    "chatml": Template(_CHATML, "<|im_end|>\n", "You are a helpful assistant."),
    "deepseek": Template("User: {query}\n\nAssistant:", "</s>"),
    "deepseek3": Template("<｜User｜>{query}<｜Assistant｜>", "</s>"),
    "deepseekcoder": Template(
        "### Instruction:\n{{content}}\n### Response:\n",
        "\n",
        "You are an AI programming assistant, utilizing the Deepseek Coder model, developed by Deepseek Company, and you only answer questions related to computer science. "
        "For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer\n",
    ),
    "yi": Template(_CHATML, "\n"),
    "orion": Template("Human: {query}\n\nAssistant: </s>", "</s>"),
    "cohere": Template("<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{query}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>", "</s>", "<BOS_TOKEN>"),
    "qwen": Template(_CHATML, "\n", _ASSISTANT),
    "qwen3": Template(_CHATML, "\n", _ASSISTANT),
    "qwen3_nothink": Template(_CHATML, "\n", _ASSISTANT),
    "qwen3_5": Template(_CHATML, "\n", _ASSISTANT),
    "qwen3_5_nothink": Template(_CHATML, "\n", _ASSISTANT),
}


def register(name: str, template: Template) -> None:
    if name in TEMPLATES:
        raise ValueError(f"template {name} is there already")
    TEMPLATES[name] = template


def dialog(pairs: Column | str, name: str, system: Column | None = None) -> Column:
    """Prompt and answer of each (user, assistant) pair in turn, as an array of 2 n strings.

    The system text (given, or else the template's own) and a separator stand before the
    first prompt if it isn't empty; a separator stands before each later prompt.
    """
    if name not in TEMPLATES:
        raise ValueError(f"no template {name}")
    t = TEMPLATES[name]
    own = F.lit(t.system)
    text = own if system is None else F.when(F.coalesce(system, F.lit("")) == "", own).otherwise(system)
    head = F.when(text == "", F.lit("")).otherwise(F.concat(text, F.lit(t.separator)))
    before, mark, after = t.prompt.replace("{{", "{").replace("}}", "}").partition("{query}")
    query = lambda p: p["user"] if mark else F.lit("")  # noqa: E731  a format without a place for it leaves the query out
    return F.flatten(
        F.transform(
            column(pairs),
            lambda p, i: F.array(F.concat(F.when(i == 0, head).otherwise(F.lit(t.separator)), F.lit(before), query(p), F.lit(after)), p["assistant"]),
        )
    )


def prompt(pairs: Column | str, name: str, system: Column | None = None) -> Column:
    return F.array_join(dialog(pairs, name, system), "")
