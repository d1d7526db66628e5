"""The thin queries over the operators of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classify, codes, common, decontaminate, flac, htmltext, language, periodic, pii, simhash, substrings
from .common import table

#: Token limit of the count query.
TOKEN_LIMIT = 512
#: What the quality classifier may know of a document beside its text.
METADATA = ("n_chars",)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP1_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT m FROM item_window
), doc_window AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)
), hit AS (
  SELECT DISTINCT doc_id, m, i, item_id FROM doc_window JOIN item_window USING (m, g)
), hit_word AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, m, i FROM hit)
), counted AS (
  SELECT doc_id, count(*) AS n_hit FROM hit_word GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary())
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.count_tokens(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return out.select("doc_id", simhash.hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


def _same(value: str):
    return lambda x: x == value


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are those of the base spans; ``spans`` also has the disguised ones."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.col("base.kind"), _same(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flac.read_back(flac.store(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = classify.fit_toxicity(docs, labels, classify.fold(F.col("id"), 5) != 0)
    held = classify.fold(F.col("doc_id"), 5) == 0
    out = classify.scored(docs, model, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(held, F.lit(False))})
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = classify.fit_quality(docs, labels, classify.fold(F.col("id"), 3) != 1, metadata=METADATA)
    held = classify.fold(F.col("doc_id"), 3) == 1
    out = classify.scored(docs, model, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(held, F.lit(False))}, metadata=METADATA)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, classify.fold(F.col("id"), 4) != 2)
    held = classify.fold(F.col("doc_id"), 4) == 2
    return language.predicted(docs, model, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(held, F.lit(False))})


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.compressed(table(spark, sf_dir, "embeddings"), beside=("label",))
    found = common.written(found, f"{common.scratch(spark)}/codes")
    out = codes.label_sums(found, "label", "error", "label_error")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """Every round written out: distances of all parts to all entries, then means of equal names."""
    steps = []
    for r in range(codes.ROUNDS + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
  SELECT vec_id, p, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, z) + list_inner_product(z, z), e := e)) AS best
  FROM point JOIN book{r} USING (p) GROUP BY vec_id, p
)"""
        )
        if r < codes.ROUNDS:
            steps.append(
                f"""mean{r} AS (
  SELECT p, e, list(floor(s / c) ORDER BY i) AS z FROM (
    SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS c FROM near{r} JOIN point USING (vec_id, p), (SELECT unnest(range(1, (SELECT max(len(x)) FROM point) + 1)) AS i) GROUP BY 1, 2, 3
  ) GROUP BY p, e
), book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(mean{r}.z, book{r}.z) AS z FROM book{r} LEFT JOIN mean{r} USING (p, e)
)"""
            )
    last = codes.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), point AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS p)
), book0 AS MATERIALIZED (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x AS z FROM point WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
), {", ".join(steps)}, coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{last} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(z[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM book{last}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM point) + 1)) AS i)
), by_label AS (
  SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label
)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) JOIN by_label ON kept.label IS NOT DISTINCT FROM by_label.label, books
"""


def repeated_order(h: int, n: int) -> np.ndarray | None:
    """For a tenth of the documents: word i from word a on is word a + (i - a) % p."""
    g, rest = divmod(h, 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic.collapsed(docs, order=repeated_order, beside=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    best = periodic.strongest(F.col("runs"))
    line = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END), 4294967295) AS h
  FROM documents
), a AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS dealt, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM d
), word AS MATERIALIZED (
  SELECT doc_id, n, i, CASE WHEN dealt AND i >= a THEN w[a + (i - a) % (1 + (n - a) // parts) + 1] ELSE w[i + 1] END AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM a)
), lag AS (
  SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM a WHERE n >= 6
), mark AS (
  SELECT doc_id, n, q, unnest(range(0, n - q, q)) AS i FROM lag
), same AS (
  SELECT mark.doc_id, mark.n, q, mark.i // q AS k FROM mark JOIN word u ON u.doc_id = mark.doc_id AND u.i = mark.i JOIN word v ON v.doc_id = mark.doc_id AND v.i = mark.i + q WHERE u.x = v.x
), maybe AS MATERIALIZED (
  SELECT DISTINCT doc_id, n, q FROM (SELECT *, lag(k, 2) OVER (PARTITION BY doc_id, q ORDER BY k) AS before FROM same) WHERE before = k - 2
), hit AS (
  SELECT m.doc_id, q, u.i, u.i - row_number() OVER (PARTITION BY m.doc_id, q ORDER BY u.i) AS island
  FROM maybe m JOIN word u ON u.doc_id = m.doc_id JOIN word v ON v.doc_id = m.doc_id AND v.i = u.i + q WHERE u.x = v.x
), run AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM (
    SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM hit GROUP BY doc_id, q, island HAVING count(*) >= greatest(6 - q, 3 * q)
  ) GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
         first(struct_pack(s := start, l := length, p := period) ORDER BY length::DOUBLE / period DESC, start, period) AS best
  FROM run GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_benchmark_decontamination, op2_bpe_encoding, op3_substring_dedup, op4_token_counts, op5_html_extraction, op6_simhash_near_dedup, op7_pii, op8_media_columns, op9_toxicity, op10_quality_classifier, op11_language_id, op12_vector_codes, op13_periodic_runs)
}
ORACLE_SQL: dict[str, str] = {"op1_benchmark_decontamination": OP1_SQL, "op12_vector_codes": _op12_sql(), "op13_periodic_runs": OP13_SQL}
