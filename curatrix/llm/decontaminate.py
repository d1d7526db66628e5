"""Benchmark decontamination by winnowed word grams, in DataFrame functions only.

A window of ``window`` item words that occurs in a document has, among its grams of
``k`` words, a least hash. Documents keep the position of the least gram of every run
of ``window - k + 1`` grams, items all positions of it, so a shared window is met by
one pair of kept positions on its own diagonal. Each such hit is then extended word
by word to both sides; a run of ``window`` equal words or more is contamination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: The items' kept grams, and lists of items, are broadcast up to so many rows and bytes; else joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what lies between words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Letters-and-digits words, A-Z in lower case, of a text; a null text has none."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, SEPARATORS), ""), F.array().cast("array<string>"))


def _shifted(a: str, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _with_grams(df: DataFrame, sizes: list[int], n: str) -> DataFrame:
    """Columns g<size>: the hashes of all grams of that many words, from the words' hashes g1.

    Each column is used by more than one other, so the steps stay apart in the plan and
    nothing is worked out twice.
    """
    top = 1
    while 2 * top <= max(sizes):
        df = df.withColumn(f"g{2 * top}", F.zip_with(f"g{top}", _shifted(f"g{top}", top), lambda a, b: F.xxhash64(a, b)))
        top *= 2
    for size in sizes:
        part, done = top, 0
        while part > size:
            part //= 2
        name, done, rest = f"g{part}", part, size - part
        while rest:
            while part > rest:
                part //= 2
            df = df.withColumn(f"s{size}", F.zip_with(name, _shifted(f"g{part}", done), lambda a, b: F.xxhash64(a, b)))
            name, done, rest = f"s{size}", done + part, rest - part
        df = df.withColumn(f"k{size}", F.slice(name, 1, F.greatest(F.col(n) - (size - 1), F.lit(0))))
    return df


def _packed(span: int) -> int:
    """Low bits that tell the positions of two neighbouring runs apart."""
    return 1 << (2 * span - 1).bit_length()


def _with_least(df: DataFrame, grams: str, span: int) -> DataFrame:
    """Column ``least``: of each run of ``span`` grams the least, its position in the low bits."""
    low = _packed(span)
    df = df.withColumn("m1", F.transform(grams, lambda g, i: g.bitwiseAND(F.lit(-low)).bitwiseOR(i.bitwiseAND(F.lit(low - 1)).cast("long"))))
    top = 1
    while 2 * top <= span:
        df = df.withColumn(f"m{2 * top}", F.zip_with(f"m{top}", _shifted(f"m{top}", top), lambda a, b: F.least(a, b)))
        top *= 2
    runs = F.greatest(F.size(grams) - (span - 1), F.lit(0))
    both = F.zip_with(f"m{top}", _shifted(f"m{top}", span - top), lambda a, b: F.least(a, b)) if span > top else F.col(f"m{top}")
    return df.withColumn("least", F.slice(both, 1, runs))


def _place(least: Column, i: Column, low: int) -> Column:
    """Position of a run's least gram from its low bits and the run's own."""
    return i + (least.bitwiseAND(F.lit(low - 1)).cast("int") - i).bitwiseAND(F.lit(low - 1))


def _sizes(window: int) -> tuple[int, int]:
    k = max(1, window // 2)
    return k, window - k + 1


def _item_prints(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """m, fp, item, and the words before (nearest first), in and after each kept gram.

    ``m`` is the gram's length, negative if the gram is a whole short item; ``fp`` tells
    grams of different lengths apart.
    """
    k, span = _sizes(window)
    low = _packed(span)
    base = (
        items.select(common.column(items, item_col).cast("string").alias("item"), words(common.column(items, text_col).cast("string")).alias("w"))
        .withColumn("n", F.size("w"))
        .where("n > 0")
    )
    hashed = base.withColumn("g1", F.transform("w", lambda x: F.xxhash64(x)))
    kept = _with_least(_with_grams(hashed.where(F.col("n") >= window), [k], "n"), f"k{k}", span)
    ties = F.array_distinct(
        F.flatten(
            F.transform(
                "least",
                lambda m, i: F.filter(F.sequence(i, i + (span - 1)), lambda p: F.get(F.col(f"k{k}"), p).bitwiseAND(F.lit(-low)) == m.bitwiseAND(F.lit(-low))),
            )
        )
    )
    long_ = (
        kept.select("item", "w", "n", F.col(f"k{k}").alias("g"), F.explode_outer(ties).alias("q"))
        .select(
            F.lit(k).alias("m"),
            F.get("g", F.col("q")).bitwiseAND(F.lit(-low)).alias("fp"),
            "item",
            F.reverse(F.slice("w", F.greatest(F.col("q") - (window - k), F.lit(0)) + 1, F.least(F.col("q"), F.lit(window - k)))).alias("i_left"),
            F.slice("w", F.col("q") + 1, k).alias("i_gram"),
            F.slice("w", F.col("q") + 1 + k, window - k).alias("i_right"),
        )
    )
    none = F.array().cast("array<string>")
    short = hashed.where(F.col("n") < window).select(
        (-F.col("n")).alias("m"), _marked(_whole("g1", "n", window), F.col("n")).alias("fp"), "item", none.alias("i_left"), F.col("w").alias("i_gram"), none.alias("i_right")
    )
    return long_.union(short)


def _whole(grams: str, n: str, window: int) -> Column:
    """The hash that _with_grams gives to a gram of all words of a short item."""

    def built(size: int) -> Column:
        powers = {1: [F.get(grams, F.lit(i)) for i in range(size)]}
        p = 1
        while 2 * p <= size:
            powers[2 * p] = [F.xxhash64(powers[p][i], powers[p][i + p]) for i in range(size - 2 * p + 1)]
            p *= 2
        out, at, rest = powers[p][0], p, size - p
        while rest:
            while p > rest:
                p //= 2
            out, at, rest = F.xxhash64(out, powers[p][at]), at + p, rest - p
        return out

    made = F.when(F.col(n) == 1, built(1))
    for size in range(2, window):
        made = made.when(F.col(n) == size, built(size))
    return made


def _marked(gram: Column, size: Column) -> Column:
    return F.xxhash64(gram, size.cast("int"))


def _documents(df: DataFrame, window: int, short: list[int], id_col: str, text_col: str) -> DataFrame:
    """doc, digest, w, n and ``picks``: (p, fp) of each kept gram, and one of p = -1."""
    k, span = _sizes(window)
    low = _packed(span)
    text = common.column(df, text_col).cast("string")
    base = df.select(common.column(df, id_col).alias("doc"), F.md5(text).alias("digest"), words(text).alias("w"))
    base = base.withColumn("n", F.size("w")).withColumn("g1", F.transform("w", lambda x: F.xxhash64(x)))
    base = _with_least(_with_grams(base, sorted({k, *short}), "n"), f"k{k}", span)
    pick = lambda p, fp: F.struct(p.cast("int").alias("p"), fp.alias("fp"))
    changed = F.filter(
        F.transform(F.zip_with("least", F.concat(F.array(F.lit(None).cast("long")), "least"), lambda a, b: F.when(~a.eqNullSafe(b), a)), lambda m, i: F.when(m.isNotNull(), pick(_place(m, i, low), m.bitwiseAND(F.lit(-low))))),
        lambda x: x.isNotNull(),
    )
    picks = [F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("long").alias("fp"))), changed]
    every = lambda m: lambda g, i: pick(i, _marked(g, F.lit(m)))
    picks += [F.transform(f"k{m}", every(m)) for m in short]
    return base.select("doc", "digest", "w", "n", F.concat(*picks).alias("picks"))


def contaminated(
    df: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """What each document shares with the items.

    Returns one row for each row: ``id_col``, ``n_words``, ``n_hit`` (words inside an
    occurrence of a window), ``spans`` (array of first and last word of each hit run, in
    order), ``items`` (sorted item ids with windows that occur).

    A null or empty text has no words and no hits; an item without words has no window;
    an item of fewer than ``window`` words is one window. Repeated documents are judged
    each; a null document id is kept; windows of an item without an id count as hits but
    name no item, ids that repeat are named once. Extra columns are left aside. Empty
    documents give no rows, empty items no hits. Counts are exact: hashes only find
    candidates, whose words are compared.
    """
    spark = df.sparkSession
    root = common.scratch(spark)
    # Items that share a gram with the words around it are one group; who they are is looked up once hits are known.
    # No word holds a blank or a bar, so the group's name has one reading.
    parts = [F.col("m").cast("string"), *[F.array_join(c, " ") for c in ("i_left", "i_gram", "i_right")]]
    named = _item_prints(items, window, item_col, item_text_col).withColumn("group", F.md5(F.concat_ws("|", *parts)))
    members = common.written(named.where("item is not null").select("group", "item").distinct(), f"{root}/members")
    prints = common.written(named.drop("item").dropDuplicates(["group"]), f"{root}/prints")
    sent = F.octet_length(F.concat_ws(" ", "group", "i_left", "i_gram", "i_right")) + 12
    size = prints.agg(F.count("*").alias("n"), F.sum(sent).alias("bytes")).first()
    short = sorted(-r.m for r in prints.where("m < 0").select("m").distinct().collect())  # fewer than ``window`` numbers
    docs = _documents(df, window, short, id_col, text_col)
    k, _ = _sizes(window)
    if size.n <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES:
        # Outer forms: no array is empty, and the filter that inner ones bring along would repeat all steps.
        held = docs.select("doc", "digest", "w", "n", F.inline_outer("picks"))
        met = held.join(F.broadcast(prints), "fp", "left").where(F.col("i_gram").isNotNull() | (F.col("p") < 0))
    else:
        # Texts stay where they are until hits are known; then hits go to their document. A hit has the same word next to the
        # gram on the right or on the left, so a frequent gram is met by its neighbours; short items have none.
        lean = docs.select("doc", "digest", F.inline_outer(_neighboured("picks", k))).where("p >= 0")
        grams = prints.withColumn("i_r", F.coalesce(F.get("i_right", F.lit(0)), F.lit(""))).withColumn("i_l", F.coalesce(F.get("i_left", F.lit(0)), F.lit("")))
        long_, alone = grams.where("m > 0"), grams.where("m < 0 or size(i_left) + size(i_right) = 0")
        columns = ["doc", "digest", "p", "group", "i_left", "i_gram", "i_right"]
        by_right = lean.where("r <> ''").join(long_.where("i_r <> ''").withColumnRenamed("i_r", "r"), ["fp", "r"]).select(*columns)
        by_left = lean.where("l <> ''").join(long_.where("i_l <> ''").withColumnRenamed("i_l", "l"), ["fp", "l"]).where("r = '' or i_r <> r").select(*columns)
        met = by_right.unionByName(by_left).unionByName(lean.join(alone, "fp").select(*columns))
        hits = met.groupBy("doc", "digest").agg(F.collect_list(F.struct("p", "group", "i_left", "i_gram", "i_right")).alias("hits"))
        mark = F.array(F.struct(F.lit(-1).alias("p"), *[F.lit(None).cast(t).alias(c) for c, t in (("group", "string"), ("i_left", "array<string>"), ("i_gram", "array<string>"), ("i_right", "array<string>"))]))
        one = docs.groupBy("doc", "digest").agg(F.first("w").alias("w"), F.first("n").alias("n"), F.count("*").alias("copies"))
        held = one.alias("d").join(hits.alias("h"), F.col("d.doc").eqNullSafe(F.col("h.doc")) & F.col("d.digest").eqNullSafe(F.col("h.digest")), "left")
        held = held.select("d.doc", "d.digest", "w", "n", "copies", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"))
        held = held.withColumn("all", F.concat(F.flatten(F.array_repeat(mark, F.col("copies").cast("int"))), "hits"))
        met = held.select("doc", "digest", "w", "n", F.inline_outer("all"))
    p, reach = F.col("p"), window - k
    runs = met.select(
        "doc",
        "digest",
        "n",
        "p",
        "group",
        "i_gram",
        F.size("i_gram").alias("m"),
        "i_left",
        "i_right",
        F.when(p >= 0, F.reverse(F.slice("w", F.greatest(p - reach, F.lit(0)) + 1, F.least(F.greatest(p, F.lit(0)), F.lit(reach))))).alias("d_left"),
        F.when(p >= 0, F.slice("w", F.greatest(p, F.lit(0)) + 1, F.size("i_gram"))).alias("d_gram"),
        F.when(p >= 0, F.slice("w", F.greatest(p, F.lit(0)) + 1 + F.size("i_gram"), F.size("i_right"))).alias("d_right"),
    )
    runs = runs.withColumn("left", _agree("d_left", "i_left")).withColumn("right", _agree("d_right", "i_right"))
    # A short item is its own window; else left + gram + right must reach a window's length.
    whole = (F.col("d_gram") == F.col("i_gram")) & ((F.col("left") + F.col("m") + F.col("right") >= window) | (F.col("m") != k) | (F.size("i_left") + F.size("i_right") == 0))
    hit = F.when((p >= 0) & whole, F.struct((p - F.col("left")).alias("a"), (p + F.col("m") + F.col("right") - 1).alias("b")))
    marked = runs.select("doc", "digest", "n", (p < 0).cast("int").alias("row"), hit.alias("hit"), "group")
    # No filter on ``hit``: pushed below, it would make every kept gram carry its text along.
    told = marked.groupBy("doc", "digest", "n").agg(
        F.sum("row").alias("copies"), F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.collect_set(F.when(F.col("hit").isNotNull(), F.col("group")))).alias("groups")
    )
    told = told.withColumn("set", F.when(F.size("groups") > 0, F.md5(F.array_join("groups", ""))))
    told = common.written(told.select("doc", "n", "copies", "set", "groups", _merged("hits").alias("spans")), f"{root}/told")
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"] + 1))
    out = _with_items(told, members, root).select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_words"), length.alias("n_hit"), "spans", "items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy"))
    return out.drop("__copy")


def _neighboured(picks: str, k: int) -> Column:
    """The picks with the words right and left of their gram of ``k`` words; '' where the text ends."""
    word = lambda at: F.coalesce(F.get("w", at), F.lit(""))
    return F.transform(picks, lambda x: F.struct(x["p"].alias("p"), x["fp"].alias("fp"), word(x["p"] + k).alias("r"), F.when(x["p"] > 0, word(F.greatest(x["p"] - 1, F.lit(0)))).otherwise(F.lit("")).alias("l")))


def _with_items(told: DataFrame, members: DataFrame, root: str) -> DataFrame:
    """``told`` with ``items``: the sorted ids of all items of a document's groups.

    Documents with the same groups, as copies have, share one list: it is made once for each different set of groups.
    """
    sets = told.where("set is not null").select("set", "groups").dropDuplicates(["set"])
    lists = sets.select("set", F.explode("groups").alias("group")).join(members, "group").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = common.written(lists, f"{root}/lists")
    size = lists.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("items", " ")) + 48).alias("bytes")).first()
    if size.n <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES:
        lists = F.broadcast(lists)
    return told.join(lists, "set", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def _agree(a: str, b: str) -> Column:
    """How many words at the start of both arrays are the same."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.coalesce(F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int"), F.lit(0))


def _merged(hits: str) -> Column:
    """Overlapping or touching runs, sorted by their first word, put together."""
    return F.aggregate(
        hits,
        F.filter(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))), lambda x: F.lit(False)),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["a"] <= F.element_at(done, -1)["b"] + 1),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.get(done, F.size(done) - 1)["a"].alias("a"), F.greatest(F.get(done, F.size(done) - 1)["b"], x["b"]).alias("b"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """``contaminated`` where hits are 1 in ``share`` of the words or more."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def clean(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that aren't contaminated, all columns kept.

    Rows of one id and one text are judged alike. A null id or text is never contaminated
    by itself: a null text has no words.
    """
    digest = F.md5(common.column(df, text_col).cast("string"))
    id_ = common.column(df, id_col)
    a, b = common.unused(df, "id"), common.unused(df, "digest")
    found = contaminated(df.select(F.struct(id_.alias("id"), digest.alias("digest")).alias("row"), common.column(df, text_col).alias("text")), items, id_col="row", text_col="text", **options)
    keys = judged(found).where("contaminated").select(F.col("row.id").alias(a), F.col("row.digest").alias(b)).distinct()
    keys = common.written(keys, f"{common.scratch(df.sparkSession)}/contaminated")
    size = keys.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.concat_ws(" ", F.col(a).cast("string"), b))).alias("bytes")).first()
    if size.n <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    return df.join(keys, id_.eqNullSafe(F.col(a)) & (digest == F.col(b)), "left_anti")
