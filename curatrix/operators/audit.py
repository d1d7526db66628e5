"""Audits: rules that name issues, duplicate keys, leakage between splits, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import personal
from ..functions.text import canonical_json, content_hash, normalized, transcript


def issues(df: DataFrame, keep: list[str], rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """keep, code, severity of every rule (code: severity, condition) that holds for a row.

    One pass over the rows, whatever the number of rules.
    """
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, (sev, c) in rules.items()]))
    return df.select(*keep, F.explode(found).alias("x")).select(*keep, "x.code", "x.severity")


def duplicate_keys(df: DataFrame, key: Column, code: str) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("key is not null and n > 1").select(F.lit(code).alias("code"), F.lit("error").alias("severity"), "key", "n")


def group_leakage(df: DataFrame, group: Column, split: str) -> DataFrame:
    """Groups with rows in more than one split."""
    return df.groupBy(group.alias("key")).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count("*").alias("n")).where("key is not null and size(splits) > 1")


def content_leakage(df: DataFrame, hashed: Column, split: str) -> DataFrame:
    """Repeated content: an error where it is in several splits, else a warning."""
    g = df.groupBy(hashed.alias("key")).agg(F.count("*").alias("n"), F.count_distinct(split).alias("n_splits")).where("n > 1")
    across = F.col("n_splits") > 1
    return g.select(F.when(across, "content_split_leakage").otherwise("exact_duplicate").alias("code"), F.when(across, "error").otherwise("warning").alias("severity"), "key", "n")


ROLES = ("human", "gpt", "function_call", "observation", "system")


def dialogue_rules(turns: str, tools: tuple[str, ...], roles: tuple[str, ...] = ROLES, role: str = "from", value: str = "value") -> dict[str, tuple[str, Column]]:
    """Rules over an array of turns: roles, empty values, tool calls and their observations."""
    t = F.col(turns)
    of = lambda r: F.filter(t, lambda x: x[role] == r)
    calls = F.transform(of("function_call"), lambda x: F.try_parse_json(x[value]))
    name = lambda v: F.try_variant_get(v, "$.name", "string")
    return {
        "empty_conversation": ("error", F.coalesce(F.size(t), F.lit(0)) <= 0),
        "invalid_role": ("error", F.exists(t, lambda x: x[role].isNull() | ~x[role].isin(*roles))),
        "empty_value": ("error", F.exists(t, lambda x: F.trim(F.coalesce(x[value], F.lit(""))) == "")),
        "invalid_tool_call": ("error", F.exists(calls, lambda v: v.isNull() | name(v).isNull())),
        "unknown_tool": ("error", F.exists(calls, lambda v: ~name(v).isin(*tools))),
        "unpaired_tool_turn": ("error", F.size(of("function_call")) != F.size(of("observation"))),
        "missing_final_answer": ("error", F.coalesce(F.get(t, F.size(t) - 1)[role] != "gpt", F.lit(False))),
    }


def preference_rules(chosen: str, rejected: str, level: str, chosen_kind: str, rejected_kind: str) -> dict[str, tuple[str, Column]]:
    c, r = F.col(chosen), F.col(rejected)
    kind = lambda x: F.when(x.startswith("Action:"), "action").otherwise("response")
    return {
        "unpaired_preference": ("error", c.isNull() != r.isNull()),
        "identical_preference": ("error", c == r),
        "invalid_preference_level": ("error", ~F.col(level).isin("response", "decision", "parameter")),
        "inconsistent_target_kind": ("error", (F.col(chosen_kind) != kind(c)) | (F.col(rejected_kind) != kind(r))),
    }


def required_metadata(fields: tuple[str, ...], strict: bool = True) -> dict[str, tuple[str, Column]]:
    return {f"missing_metadata_{f}": ("error" if strict else "warning", F.coalesce(F.col(f).cast("string"), F.lit("")) == "") for f in fields}


#: What a code means to people who read a report.
SAID = {
    "empty_dataset": "the dataset has no rows",
    "empty_conversation": "a conversation has no turns",
    "invalid_role": "a turn's role isn't a known one",
    "empty_value": "a turn says nothing",
    "invalid_tool_call": "a call isn't a JSON object with a name",
    "unknown_tool": "a call names a tool that isn't offered",
    "unpaired_tool_turn": "calls and observations differ in number",
    "missing_final_answer": "the last turn isn't an answer",
    "unknown_split": "the split is none of train, validation and test",
    "empty_text": "there is no text",
    "pii_detected": "the text holds personal data",
    "missing_metadata": "required metadata are missing",
    "duplicate_sample_id": "an id is used more than once",
    "group_split_leakage": "a group has rows in several splits",
    "content_split_leakage": "a content is in several splits",
    "exact_duplicate": "a content occurs more than once",
    "near_duplicate_split_leakage": "near copies are in different splits",
    "near_duplicate": "near copies are in one split",
}


def audit(
    df: DataFrame, turns: str, id_col: str, group_col: str, split: str, tools: tuple[str, ...], max_distance: int = 3, required: tuple[str, ...] = (), strict: bool = True, most_pairs: int | None = None, near: bool = True
) -> DataFrame:
    """code, severity, key, message of everything that speaks against a dataset: no rows at all, rules for rows,
    metadata that are ``required`` (an error if ``strict``, else a warning), repeated ids, groups and contents over
    splits, near copies in and over splits, personal data.

    ``turns`` is an array of (from, value). The dataset passes if no row is an error. A near copy is named by the id of its
    content's first row (key), with the nearest row of another content and a smaller id in the same split or another
    (other, bits) and the number of contents near to it there (near): issues grow with the rows, not with pairs. With
    ``most_pairs`` only so many of them are named, errors first, and ``near_duplicates_truncated`` (a
    warning) says so; without ``near`` near copies aren't looked for, and these three columns aren't there.
    """
    from ..sources.sinks import checkpointed
    from .dedup import simhash

    text = normalized(transcript(turns, "from", "value"))
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.col(split).alias("split"), F.col(turns).alias("turns"), text.alias("norm"), lacking.alias("lacking"))
    # Every branch below reads this; texts are normalised once.
    rows = checkpointed(rows.withColumn("hash", content_hash("norm")))
    rules = dialogue_rules("turns", tools) | {
        "unknown_split": ("error", ~F.coalesce("split", F.lit("")).isin("train", "validation", "test")),
        "empty_text": ("error", F.coalesce("norm", F.lit("")) == ""),
        "pii_detected": ("error", F.size(personal.types("norm")) > 0),
        "missing_metadata": ("error" if strict else "warning", F.size("lacking") > 0),
    }
    out = issues(rows, ["id"], rules).select("code", "severity", F.col("id").cast("string").alias("key"))
    out = out.unionByName(duplicate_keys(rows, F.col("id"), "duplicate_sample_id").select("code", "severity", F.col("key").cast("string").alias("key")))
    out = out.unionByName(group_leakage(rows, F.col("grp"), "split").select(F.lit("group_split_leakage").alias("code"), F.lit("error").alias("severity"), F.col("key").cast("string").alias("key")))
    out = out.unionByName(content_leakage(rows, F.col("hash"), "split").select("code", "severity", "key"))
    empty = df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty_dataset").alias("code"), F.lit("error").alias("severity"), F.lit("").alias("key"))
    out = out.unionByName(empty)
    if near:
        prints = rows.where("norm <> ''").select("id", "hash", simhash("norm").alias("fp"), "split")
        out = out.unionByName(_named(near_findings(prints, max_distance), most_pairs), allowMissingColumns=True)
    said = F.element_at(F.create_map(*[F.lit(x) for kv in SAID.items() for x in kv]), F.col("code"))
    return out.withColumn("message", F.coalesce(said, F.col("code")))


def _named(near: DataFrame, most_pairs: int | None) -> DataFrame:
    """The first ``most_pairs`` issues, and one more that says if there are others."""
    if most_pairs is not None:
        some = near.orderBy(F.col("severity"), "key", "code").limit(most_pairs + 1)
        more = some.agg(F.count("*").alias("n")).where(F.col("n") > most_pairs).select(F.lit("near_duplicates_truncated").alias("code"), F.lit("warning").alias("severity"), F.lit("").alias("key"))
        near = some.orderBy(F.col("severity"), "key", "code").limit(most_pairs).unionByName(more, allowMissingColumns=True)
    return near


def report(df: DataFrame, issues_: DataFrame, split: str, text: Column, source: str | None = None, scenario: str | None = None) -> DataFrame:
    """One row: row_count, passed, content_set_sha256, maps of counts by split, source, scenario, code and severity, and
    the lengths' least, median, 95th percentile and largest."""
    from ..sources.sinks import content_set_hash
    from .metrics import percentiles

    def counted(t: DataFrame, key: Column, name: str) -> DataFrame:
        per = t.groupBy(F.coalesce(key.cast("string"), F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"))
        return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))  # an entry for each value

    sizes = df.select(F.char_length(text).alias("n_chars"))
    lengths = sizes.agg(F.count("*").alias("row_count"), F.min("n_chars").alias("least_chars"), F.max("n_chars").alias("most_chars"))
    ranks = percentiles(sizes, [], "n_chars", {"median_chars": ("linear", 0.5), "p95_chars": ("linear", 0.95)})
    lengths = lengths.crossJoin(ranks).select("row_count", "least_chars", "median_chars", "p95_chars", "most_chars")  # a row each
    out = lengths.crossJoin(counted(df, F.col(split), "split_counts"))  # tables of one row each
    out = out.crossJoin(content_set_hash(df, content_hash(normalized(text))).select("content_set_sha256"))
    for c, name in ((source, "source_counts"), (scenario, "scenario_counts")):
        if c:
            out = out.crossJoin(counted(df, F.col(c), name))
    out = out.crossJoin(counted(issues_, F.col("code"), "issue_counts")).crossJoin(counted(issues_, F.col("severity"), "severity_counts"))
    return out.withColumn("passed", ~F.map_contains_key("severity_counts", F.lit("error")))


def near_findings(rows: DataFrame, max_distance: int) -> DataFrame:
    """code, severity, key, other, bits, near of rows (id, hash, fp, split) that are near to an earlier one of another content.

    Each content of each split stands under its least id and is named once for its own split (a warning) and once for the
    nearest of the other splits (an error).
    """
    from .near import near_rows

    found = near_rows(rows, "id", "hash", "fp", "split", max_distance)
    across = F.col("split") != F.col("other_split")
    # ``near_id`` is null where all of a split's are later, and those name this row.
    parts = found.groupBy("id", "hash", "split", across.alias("across")).agg(F.sum("near").alias("near"), F.min(F.when(F.col("near_id").isNotNull(), F.struct("bits", "near_id"))).alias("first"))
    code = F.when(F.col("across"), "near_duplicate_split_leakage").otherwise("near_duplicate").alias("code")
    severity = F.when(F.col("across"), "error").otherwise("warning").alias("severity")
    return parts.where("first is not null").select(code, severity, F.col("id").cast("string").alias("key"), F.col("first.near_id").cast("string").alias("other"), F.col("first.bits").alias("bits"), "near")


def near_issues(rows: DataFrame, max_distance: int) -> DataFrame:
    """code, severity, key (two fingerprints) of near copies: rows (hash, fp, split) of different
    content whose fingerprints are one or differ in up to ``max_distance`` bits.

    An error if such rows are in different splits, a warning if they are in one; two
    fingerprints may have both.
    """
    from ..sources.sinks import checkpointed
    from .dedup import fingerprint_links

    held = rows.groupBy("fp", F.coalesce("split", F.lit("")).alias("split")).agg(F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    prints = held.groupBy("fp").agg(F.collect_set("split").alias("splits"), F.max(F.col("lo") < F.col("hi")).alias("within"), (F.min("lo") < F.max("hi")).alias("differ"))
    prints = checkpointed(prints)
    # Several contents in several splits: two rows differ in both, whichever way they are dealt.
    one = prints.where("differ").select(F.col("fp").alias("a"), F.col("fp").alias("b"), "within", (F.size("splits") > 1).alias("across"))
    sides = [prints.select(F.col("fp").alias(x), F.col("splits").alias(f"s{x}")) for x in ("a", "b")]
    two = fingerprint_links(prints.select("fp"), max_distance).join(sides[0], "a").join(sides[1], "b")
    two = two.select("a", "b", F.arrays_overlap("sa", "sb").alias("within"), (F.size(F.array_union("sa", "sb")) > 1).alias("across"))
    kinds = (("across", "near_duplicate_split_leakage", "error"), ("within", "near_duplicate", "warning"))
    found = F.array_compact(F.array(*[F.when(F.col(x), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for x, code, severity in kinds]))
    key = F.concat_ws("/", F.hex("a"), F.hex("b")).alias("key")
    return one.union(two).select(F.explode(found).alias("x"), key).select("x.code", "x.severity", "key")


def same_identities(parts: list[DataFrame], key: str) -> bool:
    """Do all tables have the same set of keys, each once?"""
    tagged = parts[0].select(F.col(key).alias("k"), F.lit(0).alias("i"))
    for i, p in enumerate(parts[1:], 1):
        tagged = tagged.union(p.select(F.col(key), F.lit(i)))
    return tagged.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("i").alias("d")).where((F.col("n") != len(parts)) | (F.col("d") != len(parts))).isEmpty()


def policy_drift(df: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """Largest absolute difference of two log probabilities, and whether it is within tolerance."""
    worst = F.max(F.abs(F.col(a) - F.col(b)))
    return df.agg(worst.alias("max_difference"), (worst <= tolerance).alias("passed"))


def row_identity(df: DataFrame, *candidates: str) -> Column:
    """The first id that is there, else the hash of the row as canonical JSON."""
    row = content_hash(canonical_json(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))))
    return F.coalesce(*[F.col(c).cast("string") for c in candidates if c in df.columns], row)


def smoke_rules(turns: str, tools: tuple[str, ...]) -> dict[str, tuple[str, Column]]:
    """A laxer set: a call needs an observation, but an observation needs no call."""
    strict = dialogue_rules(turns, tools)
    t = F.col(turns)
    calls, seen = F.size(F.filter(t, lambda x: x["from"] == "function_call")), F.size(F.filter(t, lambda x: x["from"] == "observation"))
    return {k: v for k, v in strict.items() if k not in ("unpaired_tool_turn", "missing_final_answer")} | {"call_without_observation": ("error", (calls > 0) & (seen == 0))}


def precheck_codes(turns: str, tools: tuple[str, ...], chosen: str | None = None, rejected: str | None = None) -> Column:
    """Sorted codes that a machine gives a row before people see it."""
    rules = dialogue_rules(turns, tools)
    if chosen and rejected:
        rules |= {"identical_pair": ("error", F.col(chosen) == F.col(rejected)), "missing_preference": ("error", F.col(chosen).isNull() | F.col(rejected).isNull())}
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, (_, c) in rules.items()])))


def names_tools(text: Column, tools: tuple[str, ...]) -> Column:
    """Does a user's text name a tool?"""
    return F.greatest(*[F.contains(F.coalesce(text, F.lit("")), F.lit(t)) for t in tools], F.lit(False))


def passes(issues_: DataFrame) -> bool:
    return issues_.where("severity = 'error'").isEmpty()
