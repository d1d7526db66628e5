"""Expressions over dialogues: arrays of turns with a role and a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import cleaned, column, content_hash

TURNS = "array<struct<role:string,text:string>>"


def gathered(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation, its turns in order as an array of (turn, role, text)."""
    turn = F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def of_role(turns: Column | str, role: str) -> Column:
    return F.filter(column(turns), lambda t: t["role"] == role)


def complete(turns: Column | str) -> Column:
    """Is there a user turn and an assistant turn?"""
    return (F.size(of_role(turns, "user")) > 0) & (F.size(of_role(turns, "assistant")) > 0)


def trajectory(calls: Column, user_turns: Column) -> Column:
    """no_call, multi_call, multi_turn_call or single_call."""
    return F.when(calls == 0, "no_call").when(calls > 1, "multi_call").when(user_turns > 1, "multi_turn_call").otherwise("single_call")


#: Marks by which a user's wording is classed.
QUESTIONS = ("?", "？", "吗", "怎么", "why", "how")
NEGATIONS = ("不", "没", "no", "not", "don't")
EMPHASES = ("!", "！")


def skeleton(turns: Column | str) -> Column:
    """Counts of turns, length class of the first user text, and marks of its wording."""
    users = F.transform(of_role(turns, "user"), lambda t: F.coalesce(t["text"], F.lit("")))
    text, first = F.array_join(users, ""), F.char_length(F.coalesce(F.get(users, F.lit(0)), F.lit("")))
    has = lambda s, marks: F.greatest(*[F.contains(s, F.lit(m)) for m in marks])
    return F.struct(
        F.size(column(turns)).alias("source_turn_count"),
        F.size(users).alias("source_user_turn_count"),
        F.size(of_role(turns, "assistant")).alias("source_assistant_turn_count"),
        F.when(first <= 20, "short").when(first <= 60, "medium").otherwise("long").alias("first_user_length_bucket"),
        (F.size(users) > 1).alias("multi_turn"),
        has(text, QUESTIONS).alias("has_question"),
        has(F.lower(text), NEGATIONS).alias("has_negation"),
        has(text, EMPHASES).alias("has_emphasis"),
    )


def history(turns: Column | str, keep_open: bool = False) -> Column:
    """(user, assistant) pairs: neighbouring user texts are joined by a line end, assistant
    texts without a user text before them are dropped; ``keep_open`` keeps a last user
    text with an empty answer."""
    pair = "struct<done:array<struct<user:string,assistant:string>>,open:string>"
    start = F.from_json(F.lit('{"done":[]}'), pair)
    step = lambda done, open_: F.struct(done.alias("done"), open_.cast("string").alias("open"))

    def fold(state: Column, turn: Column) -> Column:
        joined = F.when(state["open"].isNull(), turn["text"]).otherwise(F.concat(state["open"], F.lit("\n"), turn["text"]))
        answered = F.concat(state["done"], F.array(F.struct(state["open"].alias("user"), turn["text"].alias("assistant"))))
        return (
            F.when(turn["role"] == "user", step(state["done"], joined))
            .when((turn["role"] == "assistant") & state["open"].isNotNull(), step(answered, F.lit(None)))
            .otherwise(state)
        )

    def last(state: Column) -> Column:
        if not keep_open:
            return state["done"]
        rest = F.array(F.struct(state["open"].alias("user"), F.lit("").alias("assistant")))
        return F.when(state["open"].isNotNull(), F.concat(state["done"], rest)).otherwise(state["done"])

    return F.aggregate(F.filter(column(turns), lambda t: t["role"].isin("user", "assistant")), start, fold, last)


def system_text(turns: Column | str) -> Column:
    """Text of the last system turn, '' without one."""
    return F.coalesce(F.element_at(F.transform(F.concat(F.array(F.struct(F.lit("").alias("text"))), F.transform(of_role(turns, "system"), lambda t: F.struct(t["text"].alias("text")))), lambda t: t["text"]), -1), F.lit(""))


#: How an observation is put before the model, by tool format.
OBSERVATION_FORMS = {
    "qwen": ("<tool_response>\n", "\n</tool_response>"),
    "glm4": ("<|observation|>\n", ""),
    "mistral": ("[TOOL_RESULTS] {\"content\": ", "}[/TOOL_RESULTS]"),
    "default": ("", ""),
}


def observation(text: Column | str, form: str) -> Column:
    before, after = OBSERVATION_FORMS.get(form, OBSERVATION_FORMS["default"])
    return F.concat(F.lit(before), column(text), F.lit(after))


def prompted(pairs: Column | str, system: Column, prompt: str, separator: str, system_form: str = "{system}") -> Column:
    """(source, target) of each pair by a template: ``prompt`` holds {query}; the first source opens with the system
    text, each later one with ``separator``."""
    before, after = prompt.split("{query}")
    s_before, s_after = system_form.split("{system}")
    head = F.when(F.coalesce(system, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(s_before), system, F.lit(s_after)))
    return F.transform(
        column(pairs),
        lambda p, i: F.struct(F.concat(F.when(i == 0, head).otherwise(F.lit(separator)), F.lit(before), p["user"], F.lit(after)).alias("source"), p["assistant"].alias("target")),
    )


def rendered(pairs: Column | str, system: Column, prompt: str, separator: str, system_form: str = "{system}") -> Column:
    """A conversation by a template, as one text; see ``prompted``."""
    return F.array_join(F.transform(prompted(pairs, system, prompt, separator, system_form), lambda p: F.concat(p["source"], p["target"])), "")


def parsed_chat(chat: Column | str) -> Column:
    """Turns of a transcript with USER:, ASSISTANT: and FUNCTION RESPONSE: marks."""
    marked = F.regexp_replace(column(chat), r"(?U)(?:^|\s)(USER|ASSISTANT|FUNCTION RESPONSE):\s*", "\u0001$1\u0002")
    pieces = F.filter(F.split(marked, "\u0001"), lambda x: F.contains(x, F.lit("\u0002")))
    name = lambda x: F.substring_index(x, "\u0002", 1)
    role = lambda x: F.when(name(x) == "USER", "user").when(name(x) == "ASSISTANT", "assistant").otherwise("observation")
    text = lambda x: cleaned(F.replace(F.substring_index(x, "\u0002", -1), F.lit("<|endoftext|>"), F.lit("")))
    return F.filter(F.transform(pieces, lambda x: F.struct(role(x).alias("role"), text(x).alias("text"))), lambda t: t["text"] != "")


# --- Adapters of public sources: columns turns, labels (JSON), natural_group ---------


def from_pairs(df: DataFrame) -> DataFrame:
    """instruction, response, category, intent, flags."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), cleaned(c).alias("text"))
    labels = F.struct(*[cleaned(c).alias(c) for c in ("category", "intent", "flags")], F.lit("dialogue_pair").alias("trajectory_type"))
    group = F.array_join(F.filter(F.array(cleaned("intent"), cleaned("flags")), lambda x: x != ""), ":")
    return df.select("*", F.array(turn("user", "instruction"), turn("assistant", "response")).alias("turns"), F.to_json(labels).alias("labels"), F.when(group == "", "unknown").otherwise(group).alias("natural_group"))


def from_tool_chats(df: DataFrame) -> DataFrame:
    """system, chat: a transcript with tool calls."""
    chat, system = cleaned("chat"), cleaned("system")
    turns = parsed_chat(chat)
    calls = F.size(F.split(chat, "<functioncall>")) - 1
    labels = F.struct(trajectory(calls, F.size(of_role(turns, "user"))).alias("trajectory_type"), content_hash(system).alias("source_system_sha256"), system.alias("source_system"))
    return df.select("*", turns.alias("turns"), F.to_json(labels).alias("labels"), F.substring(content_hash(system), 1, 16).alias("natural_group"))


def from_summaries(df: DataFrame) -> DataFrame:
    """Dialogue[{speaker, utterance}], QA[{Topic}], QRole, Session_id, DialogueID."""
    turns = F.filter(
        F.transform("Dialogue", lambda u: F.struct(F.when(F.upper(u["speaker"]) == "Q", "user").otherwise("assistant").alias("role"), cleaned(u["utterance"], join_cjk=True).alias("text"))),
        lambda t: t["text"] != "",
    )
    topics = F.array_sort(F.array_distinct(F.filter(F.transform("QA", lambda q: q["Topic"]), lambda t: t.isNotNull() & (t != ""))))
    labels = F.struct(F.lit("multi_turn_dialogue").alias("trajectory_type"), F.coalesce(topics, F.array().cast("array<string>")).alias("topics"), F.col("QRole").alias("q_role"))
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    return df.select("*", F.coalesce(turns, F.array().cast(TURNS)).alias("turns"), F.to_json(labels).alias("labels"), F.coalesce(filled("Session_id"), filled("DialogueID"), F.lit("unknown")).alias("natural_group"))


def from_helpdesk(df: DataFrame) -> DataFrame:
    """id, turns[{sender, utterances[]}], annotations[{quality}]."""
    said = lambda t: F.array_join(F.filter(F.transform(t["utterances"], lambda u: cleaned(u)), lambda x: x != ""), "\n")
    turns = F.filter(F.transform("turns", lambda t: F.struct(F.when(F.lower(t["sender"]) == "customer", "user").otherwise("assistant").alias("role"), F.coalesce(said(t), F.lit("")).alias("text"))), lambda t: t["text"] != "")
    rated = F.coalesce(F.exists("annotations", lambda a: a["quality"].isNotNull()), F.lit(False))
    labels = F.struct(F.lit("multi_turn_helpdesk").alias("trajectory_type"), F.greatest(F.size("annotations"), F.lit(0)).alias("annotation_count"), rated.alias("has_quality_scores"))
    group = F.coalesce(F.when(F.col("id").cast("string") != "", F.col("id").cast("string")), F.lit("unknown"))
    return df.withColumn("labels", F.to_json(labels)).withColumn("natural_group", group).withColumn("turns", F.coalesce(turns, F.array().cast(TURNS)))


ADAPTERS = {"bitext": from_pairs, "glaive": from_tool_chats, "csds": from_summaries, "dch2": from_helpdesk}
