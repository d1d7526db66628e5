"""Named queries over the driver's tables, and their SQL where SQL can express them.

Each query applies one operator to a whole table. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import actions, dialogue, personal, templates, text, tokens, toolformats
from ..operators import audit, casesets, dedup, evaluation, metrics, policy, runs, selection, synthesis, training
from ..sources import scans, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents")


def _labelled(spark, sf_dir):
    return _documents(spark, sf_dir).join(_table(spark, sf_dir, "labels"), "doc_id")


_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"

# --- Text and content hashes -----------------------------------------------------


@query(f"SELECT doc_id, sha256({_NORM}) AS norm_sha256, length({_NORM}) AS norm_chars FROM documents")
def norm_text_hash(spark, sf_dir):
    norm = text.normalized("text")
    return _documents(spark, sf_dir).select("doc_id", text.content_hash(norm).alias("norm_sha256"), F.char_length(norm).cast("long").alias("norm_chars"))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT source) AS n_splits FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return dedup.exact_groups(_documents(spark, sf_dir), text.content_hash("text"), "doc_id", "source")


@query("SELECT doc_id, CASE WHEN doc_id <> f THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents)")
def exact_dedup_keep_first(spark, sf_dir):
    return selection.first_occurrence(_documents(spark, sf_dir), text.content_hash("text"), "doc_id").select("doc_id", "duplicate_of")


@query(
    "WITH h AS (SELECT sha256(text) AS h, count(*) AS m FROM documents GROUP BY 1), six AS (SELECT left(h, 6) AS p, sha256(string_agg(h || ':' || m || ';', '' ORDER BY h)) AS d, sum(m) AS n FROM h GROUP BY 1), "
    "four AS (SELECT left(p, 4) AS q, sha256(string_agg(p || d, '' ORDER BY p)) AS d, sum(n) AS n FROM six GROUP BY 1), "
    "two AS (SELECT left(q, 2) AS r, sha256(string_agg(q || d, '' ORDER BY q)) AS d, sum(n) AS n FROM four GROUP BY 1) "
    "SELECT sha256(string_agg(r || d, '' ORDER BY r)) AS content_set_sha256, sum(n)::BIGINT AS n_rows FROM two"
)
def content_set_hash(spark, sf_dir):
    return sinks.content_set_hash(_documents(spark, sf_dir), text.content_hash("text"))


@query("SELECT item_id, ('{\"item_id\":' || item_id || ',\"words\":' || len(string_split(text, ' ')) || '}') AS line FROM benchmark")
def canonical_json_lines(spark, sf_dir):
    df = _table(spark, sf_dir, "benchmark").select(F.size(F.split("text", " ")).alias("words"), "item_id")
    return df.select("item_id", sinks.json_line(df).alias("line"))


@query("SELECT c_custkey, ('0x' || left(sha256('variant:' || c_custkey), 8))::BIGINT % 7 AS variant FROM customer")
def stable_pick_variant(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", text.pick(7, F.lit("variant"), "c_custkey").cast("long").alias("variant"))


@query(
    "SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN NULL ELSE json_extract(props, '$.k')::VARCHAR END AS k, "
    "json_extract(props, '$.missing.k')::VARCHAR AS missing FROM events"
)
def dotted_lookup(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", text.dotted("props", "k").alias("k"), text.dotted("props", "missing.k").alias("missing"))


# --- Personal data and rejection ---------------------------------------------------

_PII = """list_filter([
  CASE WHEN regexp_matches(t, '(^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{16,}') THEN 'api_token' END,
  CASE WHEN regexp_matches(t, '(^|[^0-9])[0-9]{16,19}($|[^0-9])') THEN 'bank_card' END,
  CASE WHEN regexp_matches(t, '(北京市|上海市|天津市|重庆市|[一-鿿]{2,8}省)[一-鿿]{2,12}(市|区|县).{0,30}(路|街|道|巷|号)') THEN 'cn_address' END,
  CASE WHEN regexp_matches(t, '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])') THEN 'cn_id' END,
  CASE WHEN regexp_matches(t, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])') THEN 'cn_mobile' END,
  CASE WHEN regexp_matches(t, '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+(\\.[\\pL\\pN_-]+)+') THEN 'email' END,
  CASE WHEN regexp_matches(t, '-----BEGIN (RSA |OPENSSH |EC )?PRIVATE KEY-----') THEN 'private_key' END
], lambda x: x IS NOT NULL)"""
_MASKED = "replace(replace(text, 'XXX@YYY.com', ''), 'xxx@yyy.com', '') AS t"


@query(f"SELECT doc_id, array_to_string({_PII}, ',') AS pii_types FROM (SELECT doc_id, {_MASKED} FROM documents)")
def pii_flags(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(personal.types("text"), ",").alias("pii_types"))


@query(f"SELECT source, p AS pii_type, count(*) AS n FROM (SELECT source, unnest({_PII}) AS p FROM (SELECT source, {_MASKED} FROM documents)) GROUP BY ALL")
def pii_counts_by_source(spark, sf_dir):
    hits = _documents(spark, sf_dir).select("source", F.explode(personal.types("text")).alias("pii_type"))
    return hits.groupBy("source", "pii_type").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, array_to_string({_PII}, ',') AS pii_types FROM (SELECT conv_id, turn, {_MASKED} FROM conversations)")
def pii_in_turns(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(personal.types("text"), ",").alias("pii_types"))


@query(
    f"SELECT doc_id, CASE WHEN length(trim(text)) < 50 THEN 'incomplete' WHEN len({_PII}) > 0 THEN 'pii_detected' WHEN doc_id <> f THEN 'exact_duplicate' ELSE 'accepted' END AS reason "
    f"FROM (SELECT doc_id, text, {_MASKED}, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents)"
)
def first_match_rejection(spark, sf_dir):
    # What is told from the text alone is told before the join, which then moves hashes and flags only.
    flagged = _documents(spark, sf_dir).select("doc_id", text.content_hash("text").alias("hash"), (F.char_length(F.trim("text")) < 50).alias("short"), (F.size(personal.types("text")) > 0).alias("personal"))
    docs = selection.first_occurrence(flagged, "hash", "doc_id")
    reason = F.when(F.col("short"), "incomplete").when(F.col("personal"), "pii_detected").when(F.col("duplicate_of").isNotNull(), "exact_duplicate").otherwise("accepted")
    return docs.select("doc_id", reason.alias("reason"))


# --- Samples, quotas and splits ---------------------------------------------------


@query("SELECT doc_id, sha256('20260809:documents:' || sha256(text)) AS rank_hex FROM documents ORDER BY rank_hex, doc_id LIMIT 100")
def bottom_k_hash_sample(spark, sf_dir):
    return selection.bottom_k(_documents(spark, sf_dir), 100, F.lit("20260809"), F.lit("documents"), text.content_hash("text"), tie="doc_id").select("doc_id", "rank_hex")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY sha256('domain-v1:' || o_orderkey), o_orderkey LIMIT 50")
def hash_order_select(spark, sf_dir):
    return selection.bottom_k(_table(spark, sf_dir, "orders"), 50, F.lit("domain-v1"), "o_orderkey", tie="o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT doc_id, CASE WHEN ('0x' || left(sha256(source), 15))::BIGINT < (0.1 * 1152921504606846976)::BIGINT THEN 'validation' ELSE 'train' END AS split FROM documents")
def hash_threshold_split(spark, sf_dir):
    return selection.threshold_split(_documents(spark, sf_dir), 0.1, "source").select("doc_id", "split")


@query(
    "SELECT doc_id, lang, source, nth FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS nth FROM documents) "
    "ORDER BY nth, lang, source LIMIT 200"
)
def round_robin_strata(spark, sf_dir):
    return selection.round_robin(_documents(spark, sf_dir), ["lang", "source"], text.rank("doc_id"), "doc_id", 200).select("doc_id", "lang", "source", F.col("nth").cast("long").alias("nth"))


@query(
    "WITH s AS (SELECT doc_id, lang, CASE WHEN ('0x' || left(sha256(doc_id::VARCHAR), 15))::BIGINT < (0.2 * 1152921504606846976)::BIGINT THEN 'validation' ELSE 'train' END AS split FROM documents), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY split, lang ORDER BY sha256('t:' || doc_id), doc_id) AS nth FROM s), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY nth, lang) AS place FROM r) "
    "SELECT doc_id, split, place FROM p WHERE place <= CASE split WHEN 'train' THEN 80 ELSE 20 END"
)
def stratified_split_targets(spark, sf_dir):
    docs = selection.threshold_split(_documents(spark, sf_dir), 0.2, "doc_id")
    out = selection.split_targets(docs, ["lang"], {"train": 80, "validation": 20}, "split", text.rank(F.lit("t"), "doc_id"), "doc_id")
    return out.select("doc_id", "split", F.col("place").cast("long").alias("place"))



@query(
    "WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT lang, n, n * 100 / sum(n) OVER () AS exact FROM g), "
    "l AS (SELECT *, 100 - sum(floor(exact)::BIGINT) OVER () AS left_ FROM e) "
    "SELECT lang, n, floor(exact)::BIGINT + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, lang) <= left_ THEN 1 ELSE 0 END AS quota FROM l"
)
def largest_remainder_quota(spark, sf_dir):
    sizes = _documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    return selection.largest_remainder(sizes, F.col("n"), 100, "lang")


@query(
    "WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), e AS (SELECT event_type, n * 300 / sum(n) OVER () AS exact FROM g), "
    "l AS (SELECT *, 300 - sum(floor(exact)::BIGINT) OVER () AS left_ FROM e), "
    "q AS (SELECT event_type, floor(exact)::BIGINT + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, event_type) <= left_ THEN 1 ELSE 0 END AS quota FROM l), "
    "r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('m:' || event_id), event_id) AS nth FROM events) "
    "SELECT event_id, event_type, nth FROM r JOIN q USING (event_type) WHERE nth <= quota"
)
def matched_subset_by_level(spark, sf_dir):
    out = selection.proportional_subset(_table(spark, sf_dir, "events"), "event_type", 300, text.rank(F.lit("m"), "event_id"), "event_id")
    return out.select("event_id", "event_type", F.col("nth").cast("long").alias("nth"))


@query(
    "WITH g AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL), o AS (SELECT a, sum(n) AS na FROM g GROUP BY 1), "
    "oe AS (SELECT a, na, na * 500 / sum(na) OVER () AS exact FROM o), ol AS (SELECT *, 500 - sum(floor(exact)::BIGINT) OVER () AS left_ FROM oe), "
    "oq AS (SELECT a, na, floor(exact)::BIGINT + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, a) <= left_ THEN 1 ELSE 0 END AS q FROM ol), "
    "ie AS (SELECT g.a, b, q, n * q / na AS exact FROM g JOIN oq ON g.a = oq.a), il AS (SELECT *, q - sum(floor(exact)::BIGINT) OVER (PARTITION BY a) AS left_ FROM ie), "
    "iq AS (SELECT a, b, floor(exact)::BIGINT + CASE WHEN row_number() OVER (PARTITION BY a ORDER BY round(exact - floor(exact), 9) DESC, b) <= left_ THEN 1 ELSE 0 END AS quota FROM il), "
    "r AS (SELECT o_orderkey, o_orderpriority AS a, o_orderstatus AS b, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY sha256('s:' || o_orderkey), o_orderkey) AS nth FROM orders) "
    "SELECT o_orderkey, nth FROM r JOIN iq USING (a, b) WHERE nth <= quota"
)
def proportional_two_level_split(spark, sf_dir):
    out = selection.two_level_subset(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", 500, text.rank(F.lit("s"), "o_orderkey"), "o_orderkey")
    return out.select("o_orderkey", F.col("nth").cast("long").alias("nth"))


@query(
    "WITH RECURSIVE z AS (SELECT o_custkey AS k, count(*) AS size FROM orders GROUP BY 1), g AS (SELECT k, size::DOUBLE AS size, row_number() OVER (ORDER BY size DESC, sha256('orders:' || k), k) AS pos FROM z), "
    "t AS (SELECT sum(size) * 0.8::DOUBLE AS ta, sum(size) * 0.1::DOUBLE AS tb FROM g), "
    "w AS (SELECT 0::BIGINT AS pos, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, NULL::BIGINT AS k, '' AS split UNION ALL "
    "SELECT pos, a + CASE split WHEN 'train' THEN size ELSE 0 END, b + CASE split WHEN 'validation' THEN size ELSE 0 END, c + CASE split WHEN 'test' THEN size ELSE 0 END, k, split FROM ("
    "SELECT pos, a, b, c, k, size, CASE WHEN da <= db AND da <= dc THEN 'train' WHEN db <= dc THEN 'validation' ELSE 'test' END AS split FROM ("
    "SELECT g.pos, g.k, size, a, b, c, abs(a + size - ta) - abs(a - ta) AS da, abs(b + size - tb) - abs(b - tb) AS db, abs(c + size - tb) - abs(c - tb) AS dc FROM w JOIN g ON g.pos = w.pos + 1, t))) "
    "SELECT o_orderkey, o_custkey, split FROM orders JOIN w ON o_custkey = k"
)
def group_greedy_split(spark, sf_dir):
    return selection.greedy_group_split(_table(spark, sf_dir, "orders"), "o_custkey", "orders").select("o_orderkey", "o_custkey", "split")


_MARGIN = "((doc_id * 7919) % 1000) / 1000.0 - 0.5"
_BUCKET_TARGETS = {"en": 10, "fr": 12, "de": 6, "es": 3}


def _capped_sql() -> str:
    """Buckets in scarcity order fr, de, es, en, each with the parents' counts so far."""
    base = f"t AS (SELECT doc_id, lang, source, round({_MARGIN}, 6) AS margin FROM documents JOIN labels USING (doc_id))"
    parts, seen = [base], []
    for b in ("fr", "de", "es", "en"):
        used = " UNION ALL ".join(f"SELECT source FROM {x}_" for x in seen) or "SELECT source FROM t WHERE false"
        parts.append(
            f"{b}_ AS (WITH u AS (SELECT source, count(*) AS used FROM ({used}) GROUP BY 1), "
            f"f AS (SELECT t.*, row_number() OVER (PARTITION BY t.source ORDER BY margin, doc_id) AS nth, coalesce(used, 0) AS used FROM t LEFT JOIN u USING (source) WHERE lang = '{b}') "
            f"SELECT doc_id, lang, source, margin FROM f WHERE nth <= 3 - used ORDER BY margin, doc_id LIMIT {_BUCKET_TARGETS[b]})"
        )
        seen.append(b)
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT doc_id, lang, source, margin::DOUBLE AS margin FROM {b}_" for b in seen)


@query(_capped_sql())
def quality_select_margin(spark, sf_dir):
    margin_ = F.round(F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000 - 0.5, 6)
    rows = _labelled(spark, sf_dir).select("doc_id", "lang", "source", margin_.alias("margin"))
    return selection.capped_selection(rows, "lang", _BUCKET_TARGETS, "margin", "source", 3, "doc_id")


@query(
    "WITH s AS (SELECT doc_id, lang, 3 * toxic + 2 * (1 - quality) + CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END AS risk_score FROM documents JOIN labels USING (doc_id)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('risk:' || doc_id), doc_id) AS nth FROM s WHERE risk_score >= 3), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('risk:' || doc_id), doc_id) AS nth FROM s WHERE risk_score < 3), "
    "x AS (SELECT doc_id, risk_score, 'risk' AS selection_type FROM r ORDER BY nth, lang LIMIT 24) "
    "SELECT * FROM x UNION ALL (SELECT doc_id, risk_score, 'control' AS selection_type FROM c ORDER BY nth, lang LIMIT 40 - (SELECT count(*) FROM x))"
)
def risk_review_sample(spark, sf_dir):
    score = 3 * F.col("toxic") + 2 * (1 - F.col("quality")) + (F.col("n_chars") > 5000).cast("int")
    out = selection.risk_sample(_labelled(spark, sf_dir), score, 40, ["lang"], text.rank(F.lit("risk"), "doc_id"), "doc_id")
    return out.select("doc_id", "risk_score", "selection_type")


@query(
    "WITH r AS (SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'regression' WHEN toxic = 1 THEN 'recovery' WHEN quality = 0 THEN 'stable' ELSE 'fill' END AS reason FROM labels), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY sha256('q:' || doc_id), doc_id) AS nth FROM r), "
    "p AS (SELECT *, CASE reason WHEN 'regression' THEN 0 WHEN 'recovery' THEN 1 WHEN 'stable' THEN 2 ELSE 3 END AS priority, nth <= CASE reason WHEN 'regression' THEN 20 WHEN 'recovery' THEN 10 WHEN 'stable' THEN 5 ELSE 0 END AS within FROM n) "
    "SELECT doc_id, reason FROM p ORDER BY within DESC, CASE WHEN within THEN priority END, sha256('q:' || doc_id), doc_id LIMIT 50"
)
def reason_priority_queue(spark, sf_dir):
    t, q = F.col("toxic"), F.col("quality")
    reason = F.when((t == 1) & (q == 0), "regression").when(t == 1, "recovery").when(q == 0, "stable").otherwise("fill")
    out = selection.priority_queue(_table(spark, sf_dir, "labels"), reason, [("regression", 20), ("recovery", 10), ("stable", 5)], text.rank(F.lit("q"), "doc_id"), "doc_id", 50)
    return out.select("doc_id", "reason")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) % 4)::INTEGER AS shard FROM orders")
def shard_round_robin(spark, sf_dir):
    return selection.shards(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 4, "o_totalprice", "o_orderkey").select("o_orderkey", "shard")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def merge_coverage(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    parts = [orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    return selection.merged(parts, orders, "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + 800 AS occurrence FROM orders")
def occurrence_counter(spark, sf_dir):
    return selection.occurrence(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 800).select("o_orderkey", F.col("occurrence").cast("long").alias("occurrence"))


@query("SELECT o_orderkey, nth FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS nth FROM orders) WHERE nth BETWEEN 11 AND 30")
def numbered_slice(spark, sf_dir):
    out = selection.numbered_slice(_table(spark, sf_dir, "orders"), "o_orderpriority", ["o_totalprice", "o_orderkey"], 10, 20)
    return out.select("o_orderkey", F.col("nth").cast("long").alias("nth"))


@query("SELECT n_nationkey, unnest(range(3))::INTEGER AS variant FROM nation")
def variant_expansion(spark, sf_dir):
    return selection.variants(_table(spark, sf_dir, "nation"), 3).select("n_nationkey", "variant")


@query(
    "SELECT i AS idx, CASE WHEN i < 50 THEN 'easy' WHEN i < 75 THEN 'medium' ELSE 'hard' END AS tier, "
    "(['refund','exchange','status'])[((i - CASE WHEN i < 50 THEN 0 WHEN i < 75 THEN 50 ELSE 75 END) % 3) + 1] AS scenario FROM range(100) t(i)"
)
def tiered_sequence(spark, sf_dir):
    return selection.tiered_sequence(spark, 100, ["refund", "exchange", "status"], ("easy", "medium", "hard"))


# --- Duplicates, leakage and audits ------------------------------------------------


@query()
def simhash_near_pairs(spark, sf_dir):
    """Each document's class of near copies; pairs grow with the square of a class and are left to ``dedup.near_links``."""
    norm = text.normalized("text")
    prints = _documents(spark, sf_dir).select("doc_id", text.content_hash(norm).alias("hash"), dedup.simhash(F.lower("text")).alias("fp"))  # leaves white space out, as of the normalized text
    return dedup.near_classes(prints, "doc_id", "hash", "fp").withColumnRenamed("id", "doc_id")


@query()
def near_dedup_greedy(spark, sf_dir):
    prints = _documents(spark, sf_dir).select("doc_id", "lang", dedup.simhash(F.lower("text")).alias("fp"))  # leaves white space out, as of the normalized text
    return dedup.near_keep(prints, "doc_id", "fp", text.rank("doc_id")).select("doc_id", "accepted")


_SPLIT = "CASE WHEN ('0x' || left(sha256(doc_id::VARCHAR), 15))::BIGINT < (0.1 * 1152921504606846976)::BIGINT THEN 'validation' ELSE 'train' END"


@query(
    f"WITH d AS (SELECT *, {_SPLIT} AS split FROM documents), k AS (SELECT split, 'content' AS key_type, sha256(text) AS value FROM d UNION ALL SELECT split, 'source', source FROM d) "
    "SELECT DISTINCT key_type, value FROM k WHERE split = 'train' AND (key_type, value) IN (SELECT (key_type, value) FROM k WHERE split = 'validation')"
)
def leakage_semi_join(spark, sf_dir):
    docs = selection.threshold_split(_documents(spark, sf_dir), 0.1, "doc_id")
    keys = {"content": text.content_hash("text"), "source": F.col("source")}
    return dedup.leakage(docs.where("split = 'train'"), docs.where("split = 'validation'"), keys)


@query(f"WITH d AS (SELECT source, {_SPLIT} AS split FROM documents) SELECT source AS key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(*) AS n FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1")
def group_split_leakage(spark, sf_dir):
    docs = selection.threshold_split(_documents(spark, sf_dir), 0.1, "doc_id")
    return audit.group_leakage(docs, F.col("source"), "split").withColumn("splits", F.array_join("splits", ","))


@query(
    f"WITH d AS (SELECT sha256(text) AS key, {_SPLIT} AS split FROM documents) SELECT CASE WHEN count(DISTINCT split) > 1 THEN 'content_split_leakage' ELSE 'exact_duplicate' END AS code, "
    "CASE WHEN count(DISTINCT split) > 1 THEN 'error' ELSE 'warning' END AS severity, key, count(*) AS n FROM d GROUP BY key HAVING count(*) > 1"
)
def content_split_leakage(spark, sf_dir):
    docs = selection.threshold_split(_documents(spark, sf_dir), 0.1, "doc_id")
    return audit.content_leakage(docs, text.content_hash("text"), "split")


@query("SELECT 'duplicate_parent' AS code, 'error' AS severity, o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def parent_uniqueness(spark, sf_dir):
    return audit.duplicate_keys(_table(spark, sf_dir, "orders"), F.col("o_custkey"), "duplicate_parent")


@query(
    "WITH r AS (SELECT doc_id, unnest(list_filter([CASE WHEN coalesce(lang, '') = '' THEN 'missing_metadata_lang' END, CASE WHEN coalesce(source, '') = '' THEN 'missing_metadata_source' END, "
    "CASE WHEN length(text) <> n_chars THEN 'wrong_length' END, CASE WHEN length(text) < 20 THEN 'short_text' END], lambda x: x IS NOT NULL)) AS code FROM documents) "
    "SELECT doc_id, code, CASE code WHEN 'short_text' THEN 'warning' ELSE 'error' END AS severity FROM r"
)
def metadata_issues(spark, sf_dir):
    rules = audit.required_metadata(("lang", "source")) | {"wrong_length": ("error", F.char_length("text") != F.col("n_chars")), "short_text": ("warning", F.char_length("text") < 20)}
    return audit.issues(_documents(spark, sf_dir), ["doc_id"], rules)


def _conversations(spark, sf_dir):
    return dialogue.gathered(_table(spark, sf_dir, "conversations"))


def _audited(spark, sf_dir, **options):
    turns = F.transform("turns", lambda t: F.struct(F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"), t["text"].alias("value")))
    convs = selection.threshold_split(_conversations(spark, sf_dir).withColumn("turns", turns), 0.1, "conv_id")
    return audit.audit(convs.withColumn("grp", text.pick(50, F.lit("g"), "conv_id")), "turns", "conv_id", "grp", "split", tuple(policy.TOOLS), **options).drop("message")


@query()
def dataset_audit(spark, sf_dir):
    return _audited(spark, sf_dir)


_AUDITED = (
    "WITH c AS (SELECT conv_id, list({'f': CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, 'v': text} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY 1), "
    "n AS (SELECT conv_id, turns, trim(regexp_replace(lower(array_to_string(list_transform(turns, lambda t: t.f || ':' || t.v), chr(10))), '\\s+', ' ', 'g')) AS norm, "
    "CASE WHEN ('0x' || left(sha256(conv_id::VARCHAR), 15))::BIGINT < (0.1 * 1152921504606846976)::BIGINT THEN 'validation' ELSE 'train' END AS split, "
    "('0x' || left(sha256('g:' || conv_id), 8))::BIGINT % 50 AS grp FROM c), "
    "m AS (SELECT *, replace(norm, 'xxx@yyy.com', '') AS t FROM n) "
)


@query(
    _AUDITED + "SELECT unnest(list_filter(["
    "CASE WHEN len(list_filter(turns, lambda x: x.f NOT IN ('human', 'gpt', 'function_call', 'observation', 'system'))) > 0 THEN 'invalid_role' END, "
    "CASE WHEN len(list_filter(turns, lambda x: trim(coalesce(x.v, '')) = '')) > 0 THEN 'empty_value' END, CASE WHEN turns[-1].f <> 'gpt' THEN 'missing_final_answer' END, "
    f"CASE WHEN norm = '' THEN 'empty_text' END, CASE WHEN len({_PII}) > 0 THEN 'pii_detected' END], lambda x: x IS NOT NULL)) AS code, 'error' AS severity, conv_id::VARCHAR AS key FROM m "
    "UNION ALL SELECT 'group_split_leakage', 'error', grp::VARCHAR FROM m GROUP BY grp HAVING count(DISTINCT split) > 1 "
    "UNION ALL SELECT CASE WHEN count(DISTINCT split) > 1 THEN 'content_split_leakage' ELSE 'exact_duplicate' END, CASE WHEN count(DISTINCT split) > 1 THEN 'error' ELSE 'warning' END, sha256(norm) FROM m GROUP BY norm HAVING count(*) > 1"
)
def dataset_rules(spark, sf_dir):
    """The audit without its search for near copies."""
    return _audited(spark, sf_dir, near=False)


# --- Dialogues -----------------------------------------------------------------------

_TURNS = "(SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY 1)"


@query(f"SELECT conv_id, len(turns) AS n_turns, len(list_filter(turns, lambda t: t.role = 'user')) > 0 AND len(list_filter(turns, lambda t: t.role = 'assistant')) > 0 AS complete FROM {_TURNS}")
def conv_completeness(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", F.size("turns").cast("long").alias("n_turns"), dialogue.complete("turns").alias("complete"))


@query(
    "WITH c AS (SELECT conv_id, len(turns) AS n, list_filter(turns, lambda t: t.role = 'user') AS u, len(list_filter(turns, lambda t: t.role = 'assistant')) AS a "
    f"FROM {_TURNS}), s AS (SELECT *, array_to_string(list_transform(u, lambda t: t.text), '') AS joined, coalesce(length(u[1].text), 0) AS f FROM c) "
    "SELECT conv_id, n::INTEGER AS source_turn_count, len(u)::INTEGER AS source_user_turn_count, a::INTEGER AS source_assistant_turn_count, "
    "CASE WHEN f <= 20 THEN 'short' WHEN f <= 60 THEN 'medium' ELSE 'long' END AS first_user_length_bucket, len(u) > 1 AS multi_turn, "
    "contains(joined, '?') OR contains(joined, '？') OR contains(joined, '吗') OR contains(joined, '怎么') OR contains(joined, 'why') OR contains(joined, 'how') AS has_question, "
    "contains(lower(joined), '不') OR contains(lower(joined), '没') OR contains(lower(joined), 'no') OR contains(lower(joined), 'not') OR contains(lower(joined), 'don''t') AS has_negation, "
    "contains(joined, '!') OR contains(joined, '！') AS has_emphasis FROM s"
)
def conv_skeleton(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", dialogue.skeleton("turns").alias("s")).select("conv_id", "s.*")


@query(f"SELECT conv_id, sha256(array_to_string(list_transform(turns, lambda t: t.role || ':' || t.text), chr(10))) AS transcript_sha256 FROM {_TURNS}")
def conv_transcript(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", text.content_hash(text.transcript("turns")).alias("transcript_sha256"))


_PAIRED = (
    # An answer counts if the user spoke since the last answer; its question is what the user said since.
    "WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations WHERE role IN ('user', 'assistant')), "
    "g AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM t), "
    "p AS (SELECT conv_id, coalesce(grp, 0) AS grp, string_agg(text, chr(10) ORDER BY i) FILTER (role = 'user') AS u, max(text) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'assistant') AS n FROM g GROUP BY ALL) "
)


@query(_PAIRED + "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY grp) - 1)::INTEGER AS pair, sha256(u) AS user_sha256, sha256(a) AS assistant_sha256 FROM p WHERE u IS NOT NULL AND n > 0")
def conv_turn_pairs(spark, sf_dir):
    pairs = _conversations(spark, sf_dir).select("conv_id", F.posexplode(dialogue.history("turns")).alias("pair", "p"))
    return pairs.select("conv_id", "pair", text.content_hash("p.user").alias("user_sha256"), text.content_hash("p.assistant").alias("assistant_sha256"))


@query(
    _PAIRED + ", s AS (SELECT conv_id, arg_max(text, i) AS sys FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations WHERE role = 'system') GROUP BY 1), "
    "k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY grp) AS nth, u, a FROM p WHERE u IS NOT NULL AND n > 0), "
    "c AS (SELECT conv_id FROM conversations GROUP BY 1) "
    "SELECT c.conv_id, sha256(coalesce(string_agg(CASE WHEN nth = 1 THEN CASE WHEN coalesce(sys, '') = '' THEN '' ELSE sys || chr(10) END ELSE '</s>' END || 'USER: ' || u || ' ASSISTANT: ' || a, '' ORDER BY nth), '')) AS prompt_sha256 "
    "FROM c LEFT JOIN k USING (conv_id) LEFT JOIN s USING (conv_id) GROUP BY c.conv_id"
)
def chat_template_render(spark, sf_dir):
    prompt = dialogue.rendered(dialogue.history("turns"), dialogue.system_text("turns"), "USER: {query} ASSISTANT: ", "</s>", "{system}\n")
    return _conversations(spark, sf_dir).select("conv_id", text.content_hash(prompt).alias("prompt_sha256"))


@query(
    f"SELECT conv_id, CASE WHEN c = 0 THEN 'no_call' WHEN c > 1 THEN 'multi_call' WHEN u > 1 THEN 'multi_turn_call' ELSE 'single_call' END AS trajectory FROM "
    f"(SELECT conv_id, len(list_filter(turns, lambda t: t.role = 'system')) AS c, len(list_filter(turns, lambda t: t.role = 'user')) AS u FROM {_TURNS})"
)
def trajectory_class(spark, sf_dir):
    calls, users = F.size(dialogue.of_role("turns", "system")), F.size(dialogue.of_role("turns", "user"))
    return _conversations(spark, sf_dir).select("conv_id", dialogue.trajectory(calls, users).alias("trajectory"))


@query(
    f"WITH i AS (SELECT conv_id, unnest(list_filter([CASE WHEN len(list_filter(turns, lambda t: t.role NOT IN ('user', 'assistant'))) > 0 THEN 'invalid_role' END, "
    f"CASE WHEN len(list_filter(turns, lambda t: trim(coalesce(t.text, '')) = '')) > 0 THEN 'empty_value' END, CASE WHEN turns[-1].role <> 'assistant' THEN 'missing_final_answer' END], lambda x: x IS NOT NULL)) AS code FROM {_TURNS}) "
    "SELECT conv_id, code, 'error' AS severity FROM i"
)
def role_validation_issues(spark, sf_dir):
    t = F.col("turns")
    rules = {
        "invalid_role": ("error", F.exists(t, lambda x: ~x["role"].isin("user", "assistant"))),
        "empty_value": ("error", F.exists(t, lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) == "")),
        "missing_final_answer": ("error", F.element_at(t, -1)["role"] != "assistant"),
    }
    return audit.issues(_conversations(spark, sf_dir), ["conv_id"], rules)


# --- Tools, policy and evaluation --------------------------------------------------


def _outputs(spark, sf_dir) -> DataFrame:
    """An output of each kind for each order."""
    call = F.concat(F.lit('Action: query_order_status\nAction Input: {"order_id": "EC-'), F.col("o_orderkey"), F.lit('"}'))
    out = (
        F.when(F.col("o_orderkey") % 5 == 0, call)
        .when(F.col("o_orderkey") % 5 == 1, F.lit("Action: no input"))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("Action: x Action Input: {broken "), F.col("o_orderkey")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(call, F.lit("\n"), call))
        .otherwise(F.concat(F.lit("Your order is "), F.col("o_orderstatus")))
    )
    return _table(spark, sf_dir, "orders").select("o_orderkey", out.alias("output"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'tool_calls' WHEN 1 THEN 'malformed_action' WHEN 2 THEN 'invalid_action_json' WHEN 3 THEN 'tool_calls' ELSE 'final' END AS kind, "
    "(CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END)::INTEGER AS n_calls, "
    "CASE o_orderkey % 5 WHEN 0 THEN 'query_order_status' WHEN 2 THEN 'x' WHEN 3 THEN 'query_order_status' END AS first_action FROM orders"
)
def action_parse(spark, sf_dir):
    return _outputs(spark, sf_dir).select("o_orderkey", actions.kind("output").alias("kind"), F.size(actions.calls("output")).alias("n_calls"), actions.first_action("output").alias("first_action"))


_ISSUE = ("no_reason", "damaged", "wrong_item", "missing_item", "quality_issue", "other")


def _order_states(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(k % 7 == 0, "unpaid").otherwise("paid").alias("payment_status"),
        F.when(F.col("o_orderstatus") == "F", "delivered").otherwise("shipped").alias("fulfillment_status"),
        F.when(k % 11 != 0, (k % 15).cast("int")).alias("days_since_delivery"),
        F.element_at(F.array(*map(F.lit, _ISSUE)), (k % 6 + 1).cast("int")).alias("issue_type"),
    )


@query(
    "WITH s AS (SELECT o_orderkey, o_orderkey % 7 = 0 AS unpaid, o_orderstatus = 'F' AS delivered, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 15 END AS days, o_orderkey % 6 AS i FROM orders), "
    "c AS (SELECT o_orderkey, i, CASE WHEN i = 5 THEN 'UNSUPPORTED_ISSUE_TYPE' WHEN unpaid THEN 'ORDER_NOT_PAID' WHEN NOT delivered THEN 'ORDER_NOT_DELIVERED' WHEN i = 0 AND (days IS NULL OR days > 7) THEN 'RETURN_WINDOW_EXPIRED' ELSE 'ELIGIBLE' END AS reason_code FROM s) "
    "SELECT o_orderkey, reason_code, reason_code = 'ELIGIBLE' AS eligible, reason_code = 'ELIGIBLE' AND i <> 0 AS evidence_required, "
    "CASE WHEN reason_code <> 'ELIGIBLE' THEN '' ELSE (['return_refund', 'refund_only,return_refund,exchange', 'return_refund,exchange', 'refund_only', 'return_refund,exchange'])[i + 1] END AS allowed FROM c"
)
def policy_decision_matrix(spark, sf_dir):
    out = policy.decision(_order_states(spark, sf_dir))
    return out.select("o_orderkey", "reason_code", "eligible", "evidence_required", F.array_join("allowed_request_types", ",").alias("allowed"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'missing:issue_type' WHEN 2 THEN 'unexpected:note' WHEN 3 THEN 'enum:issue_type' WHEN 4 THEN 'pattern:order_id' ELSE 'unknown_tool' END AS fault FROM orders"
)
def tool_call_validate(spark, sf_dir):
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 6
    obj = lambda order, issue, more="": F.concat(F.lit('{"order_id":"'), order, F.lit('"'), F.lit(issue), F.lit(more), F.lit("}"))
    good, issue = F.concat(F.lit("EC-"), k), ',"issue_type":"damaged"'
    args = (
        F.when(n == 1, obj(good, ""))
        .when(n == 2, obj(good, issue, ',"note":"x"'))
        .when(n == 3, obj(good, ',"issue_type":"bored"'))
        .when(n == 4, obj(F.concat(F.lit("ec "), k), issue))
        .otherwise(obj(good, issue))
    )
    tool = F.when(n == 5, "cancel_order").otherwise("check_return_policy")
    return _table(spark, sf_dir, "orders").select("o_orderkey", policy.argument_error(tool, args).alias("fault"))


@query(
    "WITH e AS (SELECT event_id, user_id, event_type = 'purchase' AS ok FROM events), f AS (SELECT *, min(CASE WHEN ok THEN event_id END) OVER (PARTITION BY user_id) AS first FROM e) "
    "SELECT event_id, CASE WHEN event_id > first THEN 'DUPLICATE_REQUEST' WHEN ok THEN 'OK' ELSE 'NOT_ELIGIBLE' END AS outcome FROM f"
)
def replay_requests(spark, sf_dir):
    out = policy.replay_requests(_table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "purchase", F.col("event_type"))
    return out.select("event_id", "outcome")


def _scripted(case: dict, messages: list) -> str:
    done = sum(m["role"] == "assistant" for m in messages)
    return case["script"][done] if done < len(case["script"]) else "done"


@query(
    "WITH s AS (SELECT 'EC-' || o_orderkey AS case_id, o_orderkey % 7 = 0 AS unpaid, o_orderstatus = 'F' AS delivered, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 15 END AS days, o_orderkey % 6 AS i FROM orders), "
    "c AS (SELECT case_id, CASE WHEN unpaid THEN 'ORDER_NOT_PAID' WHEN NOT delivered THEN 'ORDER_NOT_DELIVERED' WHEN i = 0 AND (days IS NULL OR days > 7) THEN 'RETURN_WINDOW_EXPIRED' WHEN i = 3 THEN 'REQUEST_TYPE_NOT_ALLOWED' ELSE 'OK' END AS made FROM s) "
    "SELECT case_id, 'OK,' || made || ',' || CASE made WHEN 'OK' THEN 'DUPLICATE_REQUEST' ELSE made END AS codes, 'All done.' AS final_answer, 'final_answer' AS termination_reason FROM c"
)
def rollout_scripted(spark, sf_dir):
    k = F.concat(F.lit("EC-"), F.col("o_orderkey"))
    order = F.struct(k.alias("order_id"), "payment_status", "fulfillment_status", "days_since_delivery", F.lit(True).alias("identity_verified"), F.lit("item").alias("item_summary"))
    ask = lambda tool, more: F.concat(F.lit(f'Action: {tool}\nAction Input: {{"order_id": "'), k, F.lit('"'), more, F.lit("}"))
    issue = F.when(F.col("issue_type") == "other", "damaged").otherwise(F.col("issue_type"))
    create = ask("create_after_sales_request", F.concat(F.lit(', "request_type": "return_refund", "reason": "'), issue, F.lit('"')))
    cases = _order_states(spark, sf_dir).select(
        k.alias("case_id"),
        F.to_json(F.map_from_arrays(F.array(k), F.array(order))).alias("orders"),
        F.array(ask("query_order_status", F.lit("")), create, create, F.lit("All done.")).alias("script"),
    )
    traces = policy.rollouts(cases, _scripted, columns=("case_id", "codes", "final_answer", "termination_reason"))
    return traces.select("case_id", F.array_join("codes", ",").alias("codes"), "final_answer", "termination_reason")


@query(
    "WITH l AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL), d AS (SELECT l_orderkey, min(l_linenumber) FILTER (flag = 'R') AS step, min(l_linenumber) FILTER (flag = 'N') AS early FROM l GROUP BY 1) "
    "SELECT l_orderkey::VARCHAR AS case_id, CASE WHEN early IS NULL AND step IS NULL THEN NULL ELSE least(coalesce(step, early), coalesce(early, step)) END AS step, "
    "CASE WHEN early IS NULL AND step IS NULL THEN 'no_actionable_first_divergence' ELSE 'selected' END AS reason, "
    "CASE WHEN early IS NULL AND step IS NULL THEN NULL WHEN step IS NULL OR early < step THEN 'premature_stop' ELSE 'wrong_action' END AS primary_error FROM d"
)
def first_divergence(spark, sf_dir):
    # Dealt out by case once; all that follows is by case.
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("case_id"), "l_linenumber", "l_returnflag").repartition("case_id")
    lines = rows.groupBy("case_id", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    args = F.concat(F.lit('{"line":"'), F.col("l_linenumber"), F.lit('"}'))
    call = lambda name: F.struct(name.alias("name"), args.alias("arguments"))
    turns = lines.select(
        "case_id",
        F.col("l_linenumber").alias("step"),
        F.when(F.col("flag") == "N", "final").otherwise("tool_calls").alias("kind"),
        F.when(F.col("flag") != "N", F.array(call(F.when(F.col("flag") == "R", "return").otherwise("ship")))).alias("calls"),
        F.lit("stop here").alias("output"),
    )
    wanted = lines.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", call(F.lit("ship")).alias("c")))).alias("x"))
    expected = wanted.select("case_id", F.transform("x", lambda x: x["c"]).alias("calls"), F.lit("answer").alias("answer"))
    return evaluation.first_divergence(turns, expected).select("case_id", "step", "reason", "primary_error")


@query(
    "SELECT o_orderkey AS case_id, o_orderpriority AS category, ok AS passed, ok AS auto_resolved, CASE WHEN o_orderkey % 10 = 0 THEN 'missing_trace' WHEN ok THEN '' ELSE 'goal_state_not_reached,incomplete_resolution' END AS errors "
    "FROM (SELECT *, o_orderkey % 10 <> 0 AND o_orderstatus = 'F' AS ok FROM orders)"
)
def evaluate_traces(spark, sf_dir):
    """Every order a case: its status is to be told, and told by some."""
    k = F.concat(F.lit("EC-"), F.col("o_orderkey"))
    call = F.array(F.struct(F.lit("query_order_status").alias("name"), F.concat(F.lit('{"order_id":"'), k, F.lit('"}')).alias("arguments")))
    none = F.array().cast("array<string>")
    orders = _table(spark, sf_dir, "orders")
    cases = orders.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("category"), F.array(call).alias("acceptable"), F.array(F.lit("create_after_sales_request")).alias("must_not_call"),
        F.array(F.lit("OK")).alias("codes"), F.array(F.array(F.lit("delivered"), F.lit("shipped"))).alias("term_groups"),
        F.array(F.struct(F.lit("order.status").alias("path"), F.lit('"F"').alias("equals"))).alias("assertions"), F.concat(F.lit("[\""), k, F.lit("\"]")).alias("inputs"),
    )
    traces = orders.where("o_orderkey % 10 <> 0").select(
        F.col("o_orderkey").alias("case_id"), call.alias("calls"), F.array(F.lit("OK")).alias("codes"), F.concat(k, F.when(F.col("o_orderstatus") == "F", " delivered").otherwise(" pending")).alias("answer"),
        none.alias("parse_errors"), F.lit("[]").alias("evidence"), F.concat(F.lit('{"order":{"status":"'), F.col("o_orderstatus"), F.lit('"}}')).alias("state_after"), F.lit("final_answer").alias("termination_reason"),
    )
    return evaluation.evaluate(cases, traces).select("case_id", "category", "passed", "auto_resolved", F.array_join("errors", ",").alias("errors"))


# --- Metrics -------------------------------------------------------------------------


@query("SELECT lang, count(*) FILTER (quality = 1) AS passed, count(*) AS total, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def category_metrics(spark, sf_dir):
    return metrics.grouped_rates(_labelled(spark, sf_dir), "lang", F.col("quality") == 1).withColumn("rate", F.round("rate", 6))


@query("SELECT round(avg(quality), 6) AS quality_rate, round(coalesce(count(*) FILTER (toxic = 1 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 0), 6) AS toxic_rate FROM labels")
def evaluate_rates(spark, sf_dir):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return _table(spark, sf_dir, "labels").agg(F.round(metrics.rate(q), 6).alias("quality_rate"), F.round(metrics.rate_where(t, q), 6).alias("toxic_rate"))


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def counts_report(spark, sf_dir):
    return metrics.counts(_documents(spark, sf_dir), "lang", "source")


@query("SELECT e AS error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END], lambda x: x IS NOT NULL)) AS e FROM labels) GROUP BY 1")
def error_counts(spark, sf_dir):
    errors = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low_quality")))
    return metrics.error_counts(_table(spark, sf_dir, "labels").select(errors.alias("errors")), "errors")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def most_common_sources(spark, sf_dir):
    return metrics.most_common(_documents(spark, sf_dir), "source", 5)


@query("SELECT CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END || '_to_' || CASE WHEN toxic = 0 THEN 'pass' ELSE 'fail' END AS transition, count(*) AS n FROM labels GROUP BY 1")
def transition_matrix(spark, sf_dir):
    return metrics.transitions(_table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


@query(
    "WITH r AS (SELECT 'a' AS run, doc_id, quality::DOUBLE AS v FROM labels UNION ALL SELECT 'b', doc_id, 1.0 - toxic FROM labels UNION ALL SELECT 'c', doc_id, quality * (1.0 - toxic) FROM labels) "
    "SELECT l.run AS left_run, r.run AS right_run, count(*) AS n, round(avg(r.v - l.v), 6) AS delta FROM r l JOIN r r ON l.doc_id = r.doc_id AND l.run < r.run GROUP BY ALL"
)
def paired_delta(spark, sf_dir):
    l = _table(spark, sf_dir, "labels")
    runs = {"a": F.col("quality").cast("double"), "b": 1.0 - F.col("toxic"), "c": F.col("quality") * (1.0 - F.col("toxic"))}
    rows = l.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("run"), v.alias("v")) for k, v in runs.items()])).alias("x")).select("doc_id", "x.*")
    return metrics.paired_deltas(rows, "run", "doc_id", "v").withColumn("delta", F.round("delta", 6))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def percentile_linear(spark, sf_dir):
    out = metrics.percentiles(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": ("linear", 0.5), "p95": ("linear", 0.95)})
    return out.select("l_returnflag", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def percentile_nearest_rank(spark, sf_dir):
    return metrics.percentiles(_table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": ("nearest", 0.5), "p99": ("nearest", 0.99)})


@query(
    "WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () - 1 AS m FROM documents) "
    "SELECT p, (SELECT n_chars FROM s WHERE i = CASE WHEN m * p - floor(m * p) = 0.5 THEN 2 * round(m * p / 2) ELSE round(m * p) END LIMIT 1) AS value FROM (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS p)"
)
def percentile_half_even(spark, sf_dir):
    return metrics.half_even(_documents(spark, sf_dir), "n_chars", (0.5, 0.9, 0.95))


@query(
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS largest, round(avg(o_totalprice), 4) AS mean FROM orders "
    "GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))"
)
def hardness_rollup(spark, sf_dir):
    out = metrics.rollup_summary(_table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", *metrics.summary("o_totalprice"))
    return out.withColumn("mean", F.round("mean", 4))


@query(
    "SELECT lang, count(n_chars) AS n, min(n_chars) AS least, max(n_chars) AS largest, round(avg(n_chars), 4) AS mean, count(*) FILTER (n_chars > 1000) AS over_1000, "
    "round(count(*) FILTER (n_chars > 1000) / count(n_chars), 6) AS share_over_1000 FROM documents GROUP BY 1"
)
def length_exceedance(spark, sf_dir):
    out = _documents(spark, sf_dir).groupBy("lang").agg(*metrics.summary("n_chars", (1000,)))
    return out.withColumn("mean", F.round("mean", 4)).withColumn("share_over_1000", F.round("share_over_1000", 6))


@query("SELECT user_id AS device, round(coalesce(avg(CASE WHEN value > 0 THEN value END), avg(value)), 6) AS mean_use, count(*) AS samples, max(value) AS peak_value FROM events GROUP BY 1")
def telemetry_active_mean(spark, sf_dir):
    return metrics.active_telemetry(_table(spark, sf_dir, "events"), F.col("user_id"), "value", "value").withColumn("mean_use", F.round("mean_use", 6))


@query(
    "WITH s AS (SELECT event_type, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events) "
    "SELECT event_type, count(*) AS calls, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value) FILTER (nth > 1), 6) AS steady_mean, "
    "round(sum(event_id) FILTER (nth > 1) / sum(value) FILTER (nth > 1), 4) AS steady_tokens_per_second FROM s GROUP BY 1"
)
def latency_steady_state(spark, sf_dir):
    out = metrics.steady_latency(_table(spark, sf_dir, "events"), "event_type", "event_id", "value", "event_id")
    return out.select("event_type", "calls", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.round("steady_mean", 6).alias("steady_mean"), F.round("steady_tokens_per_second", 4).alias("steady_tokens_per_second"))


@query(
    "WITH p AS (SELECT 2305843009213693951::HUGEINT AS p), r AS (SELECT quality::DOUBLE AS v, ('0x' || left(sha256('20260809:' || doc_id), 15))::BIGINT::HUGEINT AS r FROM labels), "
    "b AS (SELECT b, 1 + ('0x' || left(sha256('20260809:a:' || b), 15))::BIGINT::HUGEINT AS a, ('0x' || left(sha256('20260809:c:' || b), 15))::BIGINT::HUGEINT AS c FROM range(500) t(b)), "
    "k AS (SELECT k::HUGEINT * p // 100000000000 AS k FROM p, (SELECT unnest([36787944117, 73575888234, 91969860293, 98101184312, 99634015317, 99940581518, 99991675885, 99998975081]) AS k)), "
    "u AS (SELECT b, v, (a * r + c) % p AS x FROM r, b, p), "
    "t AS (SELECT b, v, (SELECT count(*) FROM k WHERE k <= x) AS t FROM u), "
    "m AS (SELECT b, sum(t * v) / sum(t) AS m FROM t GROUP BY b) "
    "SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, count(*) AS resamples FROM m"
)
def bootstrap_ci(spark, sf_dir):
    out = metrics.bootstrap_hashed(_table(spark, sf_dir, "labels"), "doc_id", "quality", 500, "20260809")
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "resamples")


# --- Gates and preferences -----------------------------------------------------------


@query(
    "WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'response' WHEN 'P' THEN 'decision' ELSE 'parameter' END AS level, CASE WHEN o_orderpriority < '3' THEN 'action' ELSE 'response' END AS kind, "
    "sha256('pref:' || o_orderkey) AS h FROM orders), g AS (SELECT *, CASE WHEN level = 'decision' THEN 'decision:' || kind ELSE level END AS grp FROM r), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY h, o_orderkey) AS nth FROM g), "
    "w AS (SELECT *, nth <= CASE grp WHEN 'response' THEN 160 WHEN 'decision:action' THEN 50 WHEN 'decision:response' THEN 50 ELSE 140 END AS within FROM n) "
    "SELECT o_orderkey, level, kind FROM w ORDER BY within DESC, h, o_orderkey LIMIT 400"
)
def balanced_preferences(spark, sf_dir):
    status = F.col("o_orderstatus")
    level = F.when(status == "F", "response").when(status == "P", "decision").otherwise("parameter")
    kind = F.when(F.col("o_orderpriority") < "3", "action").otherwise("response")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", level.alias("level"), kind.alias("kind"))
    return selection.balanced_preferences(rows, "level", "kind", 400, text.rank(F.lit("pref"), "o_orderkey"), "o_orderkey").drop("within")


@query(
    "SELECT CASE WHEN l_returnflag = 'A' THEN 'parameter' WHEN l_returnflag = 'N' THEN 'response' WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'wrong_action' WHEN l_linestatus = 'F' THEN 'must_continue' ELSE 'must_stop' END AS bucket, "
    "count(*) AS n FROM lineitem GROUP BY 1"
)
def behaviour_buckets(spark, sf_dir):
    flag, open_, first = F.col("l_returnflag"), F.col("l_linestatus") != "F", F.col("l_linenumber") == 1
    level = F.when(flag == "A", "parameter").when(flag == "N", "response").otherwise("decision")
    chosen = F.when(flag == "A", "action").when((flag == "N") | open_, "response").otherwise("action")
    rejected = F.when(flag == "A", "action").when(flag == "N", "response").when(open_ | first, "action").otherwise("response")
    return _table(spark, sf_dir, "lineitem").groupBy(evaluation.bucket(level, chosen, rejected).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(100 * ((-l_extendedprice) / l_quantity - (-l_tax) / l_linenumber))::BIGINT AS margin_percent FROM lineitem"
)
def hardness_margins(spark, sf_dir):
    """Margins of mean log probabilities, none of which may be missing."""
    margin = evaluation.margin(-F.col("l_extendedprice"), F.col("l_quantity"), -F.col("l_tax"), F.col("l_linenumber"))
    rows = runs.gated_margin(_table(spark, sf_dir, "lineitem").withColumn("margin", margin), "margin")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(100 * F.col("margin")).alias("margin_percent"))


@query(
    "WITH t AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderstatus = 'F' AS b, o_totalprice > 200000 AS a FROM orders) "
    "SELECT o_orderkey AS case_id, CASE WHEN b THEN 'pass_to_fail' ELSE 'fail_to_pass' END AS transition, CASE WHEN b THEN '' ELSE o_orderpriority END AS before_errors, CASE WHEN a THEN '' ELSE 'price' END AS after_errors, "
    "o_orderstatus <> 'O' AS tool_sequence_changed FROM t WHERE a <> b"
)
def failure_transitions(spark, sf_dir):
    """Cases whose result changed between two runs, with the errors of both."""
    orders = _table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "case_id")
    listed = lambda ok, word: F.when(ok, F.array().cast("array<string>")).otherwise(F.array(word))
    was, is_ = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000
    before = orders.select("case_id", was.alias("passed"), listed(was, F.col("o_orderpriority")).alias("errors"), F.array("o_orderstatus").alias("calls"))
    after = orders.select("case_id", is_.alias("passed"), listed(is_, F.lit("price")).alias("errors"), F.array(F.lit("O")).alias("calls"))
    out = runs.failure_details(before, after, "case_id")
    return out.withColumn("before_errors", F.array_join("before_errors", ",")).withColumn("after_errors", F.array_join("after_errors", ","))


@query("SELECT max(abs(l_discount - l_tax)) AS max_difference, max(abs(l_discount - l_tax)) <= 0.2 AS passed FROM lineitem")
def policy_preflight(spark, sf_dir):
    return audit.policy_drift(_table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", 0.2)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN sha256('{\"c_custkey\":' || c_custkey || ',\"c_nationkey\":' || c_nationkey || '}') ELSE c_name END AS identity FROM customer")
def row_identity(spark, sf_dir):
    """The first id that is there, else the hash of the row as canonical JSON."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("sample_id"))
    return rows.select("c_custkey", audit.row_identity(rows, "record_id", "sample_id").alias("identity"))


@query(
    "WITH o AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1), e AS (SELECT user_id, count(*) AS events FROM events GROUP BY 1) "
    "SELECT c_custkey AS run, c_mktsegment, orders, events FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey"
)
def run_rollup(spark, sf_dir):
    """One row for each run with what three tables say of it."""
    training_ = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), "c_mktsegment")
    hardware = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("orders"))
    results = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("events"))
    return runs.run_rollup(training_, hardware, results, "run")


@query(
    "WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT l_suppkey, l_partkey, (SELECT count(*) > 300 FROM p) AS truncated FROM p ORDER BY l_partkey, l_suppkey LIMIT 300"
)
def capped_pairs(spark, sf_dir):
    """The first pairs of a report, and whether there were more."""
    pairs, more = selection.capped_pairs(_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct(), "l_suppkey", "l_partkey", 300)
    return pairs.select("l_suppkey", "l_partkey", F.lit(more).alias("truncated"))


@query(
    "WITH t AS (SELECT *, o_orderkey % 5 <> 0 AS here, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS tool, o_orderkey % 4 <> 0 AS args, o_orderkey % 7 <> 0 AS final, o_orderkey % 11 <> 0 AS claim FROM orders), "
    "f AS (SELECT o_orderkey, here AND tool = o_orderstatus AS tools, here AND tool = o_orderstatus AND args AS arguments, here AND final AS terminal, here AND tool <> 'P' AS forbidden, here AND claim AS claims, here FROM t) "
    "SELECT o_orderkey AS case_id, tools AND arguments AND terminal AND forbidden AND claims AND here AS passed, array_to_string(list_filter([CASE WHEN NOT arguments THEN 'arguments_exact' END, CASE WHEN NOT claims THEN 'claims_allowed' END, "
    "CASE WHEN NOT forbidden THEN 'forbidden_tool_absent' END, CASE WHEN NOT here THEN 'observation_codes_exact' END, CASE WHEN NOT here THEN 'prediction_present' END, CASE WHEN NOT terminal THEN 'terminal_status_exact' END, "
    "CASE WHEN NOT tools THEN 'tool_selection_exact' END], lambda x: x IS NOT NULL), ',') AS errors FROM f"
)
def exact_evaluator(spark, sf_dir):
    """The stricter evaluator: every call, code, state and claim must match."""
    orders = _table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "case_id")
    call = lambda name, value: F.array(F.struct(name.alias("name"), F.to_json(F.struct(value.alias("p"))).alias("arguments")))
    key, status = F.col("case_id"), F.col("o_orderstatus")
    expected = orders.select(
        "case_id", call(status, F.col("o_orderpriority")).alias("calls"), F.array(status).alias("codes"), F.col("o_orderpriority").alias("terminal_status"),
        F.array(F.lit("P")).alias("must_not_call"), F.create_map(F.lit("status"), status).alias("allowed_claims"),
    )
    unless = lambda n, good, bad: F.when(key % n != 0, good).otherwise(F.lit(bad))
    told = orders.where(key % 5 != 0).select(
        "case_id", call(unless(3, status, "P"), unless(4, F.col("o_orderpriority"), "x")).alias("calls"), F.array(status).alias("codes"), unless(7, F.col("o_orderpriority"), "x").alias("terminal_status"),
        F.create_map(F.lit("status"), unless(11, status, "x")).alias("claimed_facts"),
    )
    return evaluation.exact_checks(expected, told).select("case_id", "passed", F.array_join("errors", ",").alias("errors"))


# --- Tokens ----------------------------------------------------------------------------

#: Tokens of a training row and of a window, the template, and the token that closes an answer.
ROW_TOKENS, WINDOW_TOKENS, TEMPLATE, END = 512, 2048, "vicuna", "<|endoftext|>"


def _vocabulary(spark) -> str:
    import public_tokenizers

    return tokens.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))


def _training_rows(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return training.training_rows(turns, _vocabulary(spark), templates.TEMPLATES[TEMPLATE], ROW_TOKENS, END)


def _ids_hash(c: str):
    return F.sha2(F.array_join(c, ","), 256)


@query()
def sft_token_rows(spark, sf_dir):
    """Token ids and labels of each conversation, and whether any label is learned from."""
    rows = _training_rows(spark, sf_dir)
    return rows.select("conv_id", F.size("input_ids").alias("n_tokens"), _ids_hash("input_ids").alias("ids_sha256"), _ids_hash("labels").alias("labels_sha256"), toolformats.learnable("labels").alias("learnable"))


@query()
def packed_token_windows(spark, sf_dir):
    """All training rows one after the other in hash order, cut into windows."""
    rows = _training_rows(spark, sf_dir).withColumn("place", text.rank(F.lit("pack"), "conv_id"))
    windows = training.packed(rows.where(toolformats.learnable("labels")), WINDOW_TOKENS, "place", "conv_id")
    return windows.select("window", F.size("input_ids").alias("n_tokens"), _ids_hash("input_ids").alias("ids_sha256"), _ids_hash("labels").alias("labels_sha256"))


@query()
def token_length_audit(spark, sf_dir):
    """Tokens of each conversation's turns by role and together: summary, percentiles, and how many exceed the limits."""
    turns = training.token_lengths(_table(spark, sf_dir, "conversations"), _vocabulary(spark), turn_tokens="text")
    of = lambda role: F.sum(F.when(F.col("role") == role, F.col("turn_tokens")))
    sums = turns.groupBy("conv_id").agg(of("user").alias("user"), of("assistant").alias("assistant"), F.sum("turn_tokens").alias("dialogue"))
    return runs.token_audit(sums, (512, 1024), 1 << 20, "user", "assistant", "dialogue")


# --- Sets and unions -------------------------------------------------------------------


@query("SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier")
def schema_align_union(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    return scans.aligned([c, s])


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def key_intersection(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(_table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def key_difference(spark, sf_dir):
    return _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority, o_orderstatus, o_orderkey LIMIT 100")
def multi_key_sort(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").orderBy("o_orderpriority", "o_orderstatus", "o_orderkey").limit(100)


@query("SELECT doc_id, coalesce(quality, -1) AS quality, toxic IS NULL AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)")
def left_join_with_default(spark, sf_dir):
    out = _documents(spark, sf_dir).join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("toxic").isNull().alias("unlabelled"))


# --- Templates, tool formats and made cases ---------------------------------------------


@query(
    _PAIRED + ", k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY grp) AS nth, u, a FROM p WHERE u IS NOT NULL AND n > 0), c AS (SELECT conv_id FROM conversations GROUP BY 1), "
    "m AS (SELECT conv_id, coalesce(string_agg(CASE WHEN nth = 1 THEN '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || chr(10) ELSE chr(10) END "
    "|| '<|im_start|>user' || chr(10) || u || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || a, '' ORDER BY nth), '') AS t FROM c LEFT JOIN k USING (conv_id) GROUP BY conv_id) "
    "SELECT conv_id, sha256(t) AS prompt_sha256, length(t) AS n_chars FROM m"
)
def named_template_render(spark, sf_dir):
    out = _conversations(spark, sf_dir).select("conv_id", templates.prompt(dialogue.history("turns"), "qwen").alias("t"))
    return out.select("conv_id", text.content_hash("t").alias("prompt_sha256"), F.char_length("t").cast("long").alias("n_chars"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE 'query_order_status' END AS name, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE '{\"order_id\":\"EC-' || o_orderkey || '\"}' END AS arguments FROM orders"
)
def tool_format_round_trip(spark, sf_dir):
    """Calls written and read by the format of each order's family; every fourth output is an answer."""
    k = F.col("o_orderkey")
    call = F.array(F.struct(F.lit("query_order_status").alias("name"), F.concat(F.lit('{"order_id": "EC-'), k, F.lit('"}')).alias("arguments")))
    families = ("default", "qwen", "mistral")
    written = F.coalesce(*[F.when(k % 4 == i, toolformats.calls_text(call, f)) for i, f in enumerate(families)], F.lit("It is on its way"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", written.alias("output"))
    read = F.coalesce(*[F.when(k % 4 == i, toolformats.calls_read("output", f)) for i, f in enumerate(families)])
    return rows.select("o_orderkey", F.get(read, F.lit(0)).alias("c")).select("o_orderkey", "c.name", "c.arguments")


@query(
    "SELECT o_orderkey, CASE WHEN p = 'damage' THEN 'damaged_exchange' WHEN p = 'return' THEN 'no_reason_expired' ELSE (['order_not_found', 'tool_timeout', 'not_delivered'])"
    "[('0x' || left(sha256('scenario:' || o_orderkey || ':variant-1'), 8))::BIGINT % 3 + 1] END AS scenario, 'EC-GEN-' || upper(left(sha256(o_orderkey::VARCHAR), 10)) AS order_id "
    "FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'damage' WHEN 1 THEN 'return' ELSE '' END AS p FROM orders)"
)
def scenario_classifier(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    intent = F.when(F.col("o_orderkey") % 3 == 0, "Damage").when(F.col("o_orderkey") % 3 == 1, "return").otherwise("")
    return _table(spark, sf_dir, "orders").select("o_orderkey", synthesis.scenario_of(intent, F.lit("single_call"), k, F.lit(1)).alias("scenario"), synthesis.order_id(k).alias("order_id"))


@query("SELECT unnest(['status', 'policy', 'create', 'missing_order', 'duplicate', 'identity', 'not_delivered', 'timeout', 'expired', 'anti_hallucination']) AS case_id, true AS passed, '' AS errors")
def oracle_replay(spark, sf_dir):
    return synthesis.replayed(spark).select("case_id", "passed", F.array_join("errors", ",").alias("errors"))


# SQL for made conversations: a table of the cases' turns, and stable picks from the same phrases.


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _picked(choices, salt: str, key: str) -> str:
    return f"({_list(choices)})[('0x' || left(sha256({_text(salt + ':')} || {key}), 8))::BIGINT % {len(choices)} + 1]"


def _by_case(table: dict, column: str, made: Callable[[str], str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_text(k)} THEN {made(k)}" for k in table) + " END"


def _replies(table: dict, salt: str, plain: tuple = ()) -> str:
    said = lambda k: f"replace({_picked(table[k], f'reply:{k}{salt}', 'parent_id')}, '{{0}}', 'ASR-' || ord || '-001')"
    return _by_case(table, "scenario", lambda k: said(k) if k in plain else f"{_picked(synthesis.REPLY_PREFIXES, f'prefix:{k}{salt}', 'parent_id')} || {said(k)}")


def _trajectory_sql(evidence: str) -> str:
    """Common table expressions up to ``made``: record, parent_id, scenario, turns (strings of kind:value), answer, rejected."""
    spec = synthesis.CASE_SPECS
    turns = ", ".join(f"({_text(c)}, {_list([f'{k}:{v}' for k, v in t]) if t else '[]::VARCHAR[]'}, {_text(spec[c][1])}, {_text(spec[c][2]) if spec[c][2] else 'NULL'}, {_text(spec[c][4])})" for c, t in synthesis.case_turns().items())
    lost = " || ".join(_picked(t, f"missing-order:{n}", "parent_id") for n, t in (("opener", synthesis.MISSING_ORDER_OPENERS), ("request", synthesis.MISSING_ORDER_REQUESTS), ("next", synthesis.MISSING_ORDER_NEXT_STEPS)))
    kinds = " ".join(f"WHEN contains(lower(intent), {_text(part)}) THEN {_text(case)}" for part, case in synthesis.BY_INTENT)
    paths = " ".join(f"WHEN trajectory = {_text(k)} THEN {_picked(v, 'scenario', 'parent_id')}" for k, v in synthesis.BY_TRAJECTORY.items())
    opener = _by_case(synthesis.OPENERS, "split", lambda k: _picked(synthesis.OPENERS[k], "opener", "parent_id"))
    issue = _by_case(synthesis.ISSUES, "issue", lambda k: _picked(synthesis.ISSUES[k], "issue", "parent_id"))
    wish = _by_case(synthesis.REQUESTS, "request", lambda k: _picked(synthesis.REQUESTS[k], "request", "parent_id"))
    asks = f"scenario NOT IN ({', '.join(map(_text, synthesis.NO_FOLLOW_UP))}) AND ('0x' || left(sha256('follow-up:' || parent_id), 8))::BIGINT % 3 = 0"
    follow = _picked(synthesis.FOLLOW_UPS, "follow-up-text", "parent_id")
    return (
        f"WITH e AS ({evidence}), c(scenario, seen, issue, request, error) AS (VALUES {turns}), "
        "k AS (SELECT record, record || ':variant-' || variant AS parent_id, split, intent, trajectory FROM e), "
        f"s AS (SELECT record, parent_id, split, CASE {kinds} {paths} ELSE {_picked(synthesis.CASES, 'scenario', 'parent_id')} END AS scenario, 'EC-GEN-' || upper(left(sha256(parent_id), 10)) AS ord FROM k), "
        f"r AS (SELECT record, parent_id, split, scenario, ord, seen, issue, request, error, coalesce({_replies(synthesis.REPLIES, '')}, {lost}) AS answer, {_replies(synthesis.REJECTED, ':rejected', ('missing_order_id',))} AS rejected FROM s JOIN c USING (scenario)), "
        f"made AS (SELECT *, ['human:' || array_to_string(list_filter([{opener}, CASE WHEN scenario = 'missing_order_id' THEN '商品编号 SKU-' || upper(left(sha256(parent_id), 8)) ELSE '订单号是 ' || ord END, {issue}, {wish}], lambda x: x IS NOT NULL), '，') || '。'] "
        f"|| list_transform(seen, lambda t: replace(t, '{synthesis.PLACE}', ord)) || CASE WHEN {asks} THEN ['human:' || {follow}] ELSE []::VARCHAR[] END || ['gpt:' || answer] AS turns FROM r) "
    )


def _conversation(c: str):
    return F.array_join(F.transform(c, lambda t: F.concat(t["from"], F.lit(":"), t["value"])), "\n")


@query(
    _trajectory_sql("SELECT o_orderkey::VARCHAR AS record, 0 AS variant, CASE WHEN o_orderkey % 10 = 0 THEN 'validation' ELSE 'train' END AS split, '' AS intent, 'other' AS trajectory FROM orders")
    + "SELECT 'sft-v1-' || left(sha256(parent_id), 16) AS sample_id, parent_id, split, scenario, len(turns)::INTEGER AS n_turns, sha256(array_to_string(turns, chr(10))) AS conversation_sha256, sha256(rejected) AS rejected_sha256 FROM made"
)
def synthesised_trajectories(spark, sf_dir):
    split = F.when(F.col("o_orderkey") % 10 == 0, "validation").otherwise("train")
    evidence = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record"), F.lit(0).alias("variant"), split.alias("split"), F.lit("").alias("intent"), F.lit("other").alias("trajectory"))
    made = synthesis.trajectories(evidence)
    return made.select("sample_id", "parent_id", "split", "scenario", F.size("conversations").alias("n_turns"), F.sha2(_conversation("conversations"), 256).alias("conversation_sha256"), F.sha2("rejected", 256).alias("rejected_sha256"))


_EVIDENCE = "SELECT c_custkey::VARCHAR AS record, (c_custkey % 2)::INTEGER AS variant, 'train' AS split, (['damage', 'wrong item', '', 'return'])[c_custkey % 4 + 1] AS intent, (['multi_call', 'multi_turn_call', 'single_call', 'no_call', 'x'])[c_custkey % 5 + 1] AS trajectory FROM customer"
_SPACED = "'{' || array_to_string(list_transform(list_sort(json_keys(args)), lambda k: '\"' || k || '\": ' || json_extract(args, '$.' || k)::VARCHAR), ', ') || '}'"


def _pairs_sql() -> str:
    wanted = _by_case(synthesis.REQUEST_OF, "issue", lambda k: _text(synthesis.REQUEST_OF[k]))
    terminal = ", ".join(map(_text, synthesis.TERMINAL))
    action = lambda name, *args: f"'Action: {name}' || chr(10) || 'Action Input: {{' || " + " || ', ' || ".join(f"'\"{k}\": \"' || {v} || '\"'" for k, v in args) + " || '}'"
    create = action("create_after_sales_request", ("order_id", "own"), ("reason", "issue"), ("request_type", wanted))
    return (
        _trajectory_sql(_EVIDENCE)
        + ", t AS (SELECT 'dpo-v1-' || left(sha256(parent_id), 16) AS base, record, scenario, issue, error, answer, rejected, turns, 'EC-GEN-' || upper(left(sha256(record), 10)) AS own, "
        "list_filter(range(len(turns)), lambda i: starts_with(turns[i + 1], 'function_call:')) AS calls FROM made), "
        "x AS (SELECT *, unnest(calls) AS i FROM t), "
        "y AS (SELECT *, substr(turns[i + 1], 15)::JSON AS j FROM x), "
        "z AS (SELECT *, j->>'$.name' AS name, j->'$.arguments' AS args FROM y), "
        f"w AS (SELECT *, 'Action: ' || name || chr(10) || 'Action Input: ' || {_SPACED} AS right_, "
        "'Action: ' || name || chr(10) || 'Action Input: ' || CASE name WHEN 'create_after_sales_request' THEN '{\"order_id\": \"' || (args->>'$.order_id') || '\", \"reason\": \"商品描述不是原因代码\", \"request_type\": \"' || (args->>'$.request_type') || '\"}' "
        "WHEN 'check_return_policy' THEN '{\"issue_type\": \"RETURN_WINDOW_EXPIRED\", \"order_id\": \"' || (args->>'$.order_id') || '\"}' ELSE '{}' END AS wrong_ FROM z), "
        "p AS (SELECT base || '-response' AS sample_id, record, 'response' AS level, len(turns) - 1 AS target, answer AS chosen, rejected, error AS primary_error FROM t "
        f"UNION ALL SELECT base || '-decision', record, 'decision', len(turns) - 1, answer, {create}, 'unnecessary_tool' FROM t WHERE scenario IN ({terminal}) AND len(calls) > 0 "
        f"UNION ALL SELECT base || '-decision', record, 'decision', len(turns) - 1, answer, {action('query_order_status', ('order_id', 'own'))}, 'missing_argument' FROM t WHERE len(calls) = 0 "
        f"UNION ALL SELECT base || '-decision', record, 'decision', i, right_, {action('check_return_policy', ('issue_type', 'issue'), ('order_id', 'own'))}, 'unnecessary_tool' FROM w WHERE scenario NOT IN ({terminal}) AND i = calls[-1] "
        "UNION ALL SELECT base || '-decision-step-' || i, record, 'decision', i, right_, answer, 'premature_stop' FROM w WHERE i < calls[-1] "
        "UNION ALL SELECT base || '-parameter-step-' || i, record, 'parameter', i, right_, wrong_, 'invalid_argument' FROM w) "
        "SELECT sample_id, record, level, target::INTEGER AS target, primary_error, sha256(chosen || '|' || rejected) AS pair_sha256 FROM p"
    )


@query(_pairs_sql())
def counterfactual_pairs(spark, sf_dir):
    k = F.col("c_custkey")
    turn = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    evidence = _table(spark, sf_dir, "customer").select(
        k.cast("string").alias("record"), (k % 2).cast("int").alias("variant"), F.lit("train").alias("split"),
        turn(4, "damage", "wrong item", "", "return").alias("intent"), turn(5, "multi_call", "multi_turn_call", "single_call", "no_call", "x").alias("trajectory"),
    )
    pairs = synthesis.preferences(synthesis.trajectories(evidence))
    return pairs.select("sample_id", "record", "level", "target", "primary_error", F.sha2(F.concat_ws("|", "chosen", "rejected"), 256).alias("pair_sha256"))


def _candidates_sql(limit: int) -> str:
    a, b = limit // 2, limit // 2 + limit // 4
    names = {t: _list(own) for t, own in synthesis.TIERS.items()}
    word = lambda table, size: f"({_list(table)})[(nth // {size}) % {len(table)} + 1]"
    prompt = _by_case(synthesis.PROMPTS, "category", lambda k: f"{word(synthesis.TONES, 4)} || {word(synthesis.PROMPTS[k], 1)} || {word(synthesis.CLOSERS, 32)} || {word(synthesis.CONSTRAINTS, 256)}")
    lead = _by_case(synthesis.LEADS, "category", lambda k: _text(synthesis.LEADS[k]))
    fifth = ", ".join(map(_text, synthesis.FIFTH))
    return (
        "WITH c AS (SELECT c_custkey::VARCHAR AS record, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS users FROM customer), "
        f"o AS (SELECT *, row_number() OVER (ORDER BY sha256('prefreeze-v1:made:' || record || ':g' || record), record) - 1 AS idx FROM c QUALIFY idx < {limit}), "
        f"t AS (SELECT *, CASE WHEN idx < {a} THEN 'iid' WHEN idx < {b} THEN 'compositional' ELSE 'challenge' END AS tier, "
        f"CASE WHEN idx < {a} THEN ({names['iid']})[idx % 4 + 1] WHEN idx < {b} THEN ({names['compositional']})[(idx - {a}) % 4 + 1] ELSE ({names['challenge']})[(idx - {b}) % 4 + 1] END AS category FROM o), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY idx) - 1 AS nth FROM t), "
        f"p AS (SELECT *, {prompt} AS prompt, {lead} AS lead FROM n) "
        "SELECT idx::INTEGER AS idx, 'PF1-' || upper(tier) || '-' || left(sha256('1.0.0:' || tier || ':' || category || ':made:' || record), 16) AS case_id, category, record, "
        f"sha256(CASE WHEN users > 1 AND lead IS NOT NULL THEN lead || chr(10) || {_text(synthesis.LEAD_REPLY)} || chr(10) "
        f"WHEN category IN ({fifth}) AND ('0x' || left(sha256(record), 8))::BIGINT % 5 = 4 THEN {_text(synthesis.FIFTH_LEAD)} || chr(10) || {_text(synthesis.FIFTH_REPLY)} || chr(10) ELSE '' END || prompt) AS messages_sha256 FROM p"
    )


@query(_candidates_sql(80))
def case_candidates(spark, sf_dir):
    k, said = F.col("c_custkey").cast("string"), F.struct(F.lit("user").alias("role"), F.col("c_name").alias("text"))
    turns = F.when(F.col("c_custkey") % 3 == 0, F.array(said, said)).otherwise(F.array(said))
    evidence = _table(spark, sf_dir, "customer").select(F.lit("made").alias("source_id"), k.alias("record"), F.concat(F.lit("g"), k).alias("parent_id"), F.lit("test").alias("split"), turns.alias("turns"))
    made = synthesis.candidates(evidence, 80)
    return made.select("idx", "case_id", "category", "record", F.sha2(F.array_join(F.transform("messages", lambda m: m["content"]), "\n"), 256).alias("messages_sha256"))


def _frozen_sql() -> str:
    parts = []
    for name, category, many, forms in casesets.FROZEN:
        texts, ends = _list(f[0] for f in forms), _list(f[4] for f in forms)
        pick_ = f"[i % {len(forms)} + 1]"
        parts.append(f"SELECT 'FZ1-{name}-' || lpad(i::VARCHAR, 3, '0') AS case_id, '{category}' AS category, sha256(replace(({texts}){pick_}, '{{0}}', i::VARCHAR)) AS prompt_sha256, ({ends}){pick_} AS terminal_status FROM range({many}) t(i)")
    return " UNION ALL ".join(parts)


@query(_frozen_sql())
def frozen_cases(spark, sf_dir):
    return casesets.frozen_cases(spark).select("case_id", "category", F.sha2("prompt", 256).alias("prompt_sha256"), "terminal_status")
