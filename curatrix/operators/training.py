"""Rows for training from tables of turns: pairs of a dialogue, token ids and labels, windows of tokens.

A dialogue may have any number of turns. Its pairs are found and numbered over ranges of (dialogue, turn), so the turns
of a long one are in many tasks; only the pairs that can be in a training row are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialogue import prompted
from ..functions.text import column
from ..functions.tokens import token_id, tokens
from ..functions.toolformats import trained_turns
from ..sources.sinks import checkpointed
from .selection import carried, positions


def dialogue_pairs(turns: DataFrame, most: int, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key``, pairs: the first ``most`` (user, assistant) pairs of each dialogue, as ``dialogue.history`` makes them.

    Neighbouring user texts are joined by a line end, an answer is the assistant's first text after them, other roles are
    left out. A null text is empty; turns of one number come by role and text. A dialogue without a pair has no
    row; null is a key.
    """
    said = turns.where(F.col(role).isin("user", "assistant")).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(role).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    placed = positions(said, "k", "o", "r", "t", part="part")
    before = placed.select((F.col("position") + 1).alias("p"), F.col("k").alias("pk"), F.col("r").alias("pr"))
    joined = placed.join(before, F.col("position") == F.col("p"), "left")
    after_user = F.coalesce(F.col("k").eqNullSafe(F.col("pk")) & (F.col("pr") == "user"), F.lit(False))
    user = F.col("r") == "user"
    marked = joined.select("k", "part", "position", "t", user.alias("user"), (user & ~after_user).alias("opens"), after_user.alias("after")).where("user or after")
    # A pair's number is the place of its first turn: the last opening one up to here, maybe in an earlier range.
    named = carried(checkpointed(marked), F.when(F.col("opens"), F.col("position")), "max", "pair", "part", "position")
    users = F.array_sort(F.collect_list(F.when(F.col("user"), F.struct("position", "t"))))
    pairs = named.groupBy("k", "pair").agg(F.array_join(F.transform(users, lambda x: x["t"]), "\n").alias("user"), F.max(F.when(~F.col("user"), F.col("t"))).alias("assistant"), F.min("part").alias("part"))
    pairs = checkpointed(pairs.where("assistant is not null"))
    # Places within a dialogue from the numbers of pairs that its earlier ranges have.
    sizes = pairs.groupBy("k", "part").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("k").alias("sk"), F.col("part").alias("sp"), earlier.alias("earlier"))  # a row for each range of a dialogue
    local = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("k", "part").orderBy("pair")))
    numbered = local.join(sizes, F.col("k").eqNullSafe(F.col("sk")) & (F.col("part") == F.col("sp"))).withColumn("nth", F.col("nth") + F.col("earlier"))
    gathered = numbered.where(F.col("nth") <= most).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("nth", "user", "assistant"))).alias("x"))
    return gathered.select(F.col("k").alias(key), F.transform("x", lambda p: F.struct(p["user"].alias("user"), p["assistant"].alias("assistant"))).alias("pairs"))


def last_system(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key``, system: the text of each dialogue's last system turn."""
    return turns.where(F.col(role) == "system").groupBy(key).agg(F.max(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))).alias("x")).select(key, F.col("x.t").alias("system"))


def training_rows(
    turns: DataFrame, vocabulary: str, template, limit: int, end: str, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", on_sources: bool = False
) -> DataFrame:
    """``key``, input_ids, labels of each dialogue of a table of turns, by a template and a vocabulary.

    Each pair is a prompt, whose labels are masked unless ``on_sources``, and an answer closed by the token ``end``. A
    pair that doesn't fit into ``limit`` tokens ends the dialogue; as each takes one token at least, no more than ``limit`` pairs are
    looked at. The last system turn, or the template's own text, opens the first prompt. Null is a key.
    """
    spark = turns.sparkSession
    pairs = dialogue_pairs(turns, limit, key, order, role, text)
    system = last_system(turns, key, order, role, text).withColumnRenamed(key, "__key")
    held = pairs.join(system, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, "pairs", F.when(F.coalesce("system", F.lit("")) != "", F.col("system")).otherwise(F.lit(template.system)).alias("system"))
    said = held.select(key, prompted("pairs", F.col("system"), template.prompt, template.separator).alias("x"))
    sources, targets = tokens(spark, vocabulary, special_first=True, places=False), tokens(spark, vocabulary, places=False)
    ids = lambda c: F.transform(c, lambda x: x["ids"])
    made = said.select(key, ids(sources(F.transform("x", lambda p: p["source"]))).alias("s"), ids(targets(F.transform("x", lambda p: p["target"]))).alias("t"))
    row = trained_turns("s", "t", limit, token_id(vocabulary, end), on_sources=on_sources)
    return made.select(key, row.alias("row")).select(key, "row.input_ids", "row.labels")


def packed(rows: DataFrame, window: int, *order: str, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """window, input_ids, labels: the tokens of all rows, one row's after the other's in an order, cut into windows.

    A row's first token has a place among all tokens, from sums over ranges of the order; its pieces go to the windows
    they lie in. Every window but the last is full, so a task holds ``window`` tokens of each. Rows without tokens have no part.
    """
    sized = rows.withColumn("__n", F.size(ids).cast("long")).where("__n > 0")
    placed = positions(sized, *order, part="__part")
    summed = carried(placed, F.col("__n"), "sum", "__upto", "__part", "position")
    start = F.col("__upto") - F.col("__n")
    spans = summed.select(ids, labels, start.alias("start"), F.explode(F.sequence(F.expr(f"(__upto - __n) div {window}"), F.expr(f"(__upto - 1) div {window}"))).alias("window"))
    low = F.greatest(F.col("window") * window - F.col("start"), F.lit(0))
    piece = lambda c: F.slice(c, (low + 1).cast("int"), ((F.col("window") + 1) * window - F.col("start") - low).cast("int"))
    pieces = spans.select("window", F.struct("start", piece(ids).alias("ids"), piece(labels).alias("labels")).alias("x"))
    whole = pieces.groupBy("window").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select("window", F.flatten(F.transform("x", lambda p: p["ids"])).alias("input_ids"), F.flatten(F.transform("x", lambda p: p["labels"])).alias("labels"))


def token_lengths(df: DataFrame, vocabulary: str, **texts: Column | str) -> DataFrame:
    """``df`` with the number of tokens of each named text; null texts have none."""
    run = tokens(df.sparkSession, vocabulary, places=False)
    sizes = F.transform(run(F.array(*[column(t).cast("string") for t in texts.values()])), lambda x: F.size(x["ids"]))
    out = df.withColumn("__tokens", sizes)
    for i, name in enumerate(texts):
        out = out.withColumn(name, F.col("__tokens")[i])
    return out.drop("__tokens")
