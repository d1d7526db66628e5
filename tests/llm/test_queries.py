"""Every column of the first ten queries against a plain version of its contract, over awkward tables."""

import binascii
import hashlib
import importlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import plain_flac
from awkward_rows import AWKWARD
from curatrix.llm import classify, common, queries
from test_decontaminate import brute as contaminated
from test_htmltext import LAYOUTS, site
from test_pii import brute as personal
from test_simhash import brute_components, brute_print
from test_substrings import brute as substrings

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
text = lambda t: t or ""


def made_documents():
    rng = random.Random(11)
    words = [f"word{i}" for i in range(60)] + ["É", "日本", "İx", "a-b", "x.y"]
    long_ = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, passage = [long_(40), long_(20), "short one", None, "...", long_(13)], long_(70)
    docs = [*[(i, t) for i, t in AWKWARD if t is None or len(t) < 20_000]]
    docs += [(100 + i, long_(rng.randint(0, 90))) for i in range(25)]
    docs += [(200 + i, f"{long_(rng.randint(0, 20))} {passage} {long_(rng.randint(0, 200))}") for i in range(6)]
    docs += [(300 + i, f"{long_(rng.randint(0, 60))}, {item[i % 3]}; {long_(rng.randint(0, 900))}") for i in range(9)]
    near = long_(400)
    docs += [(400 + i, near + f" end{i}" * (i % 3)) for i in range(5)]
    docs += [(500, "mail a@b.co, 10.0.0.1 and 4111 1111 1111 1111 or +1 (555) 123-4567; 999.1.1.1"), (501, "jоhn [at] exаmple [dot] com"), (502, "<|endoftext|> and <|endoftext|>x")]
    return docs, list(enumerate(item))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("contract"))
    docs, items = made_documents()
    rng = random.Random(2)
    save = lambda rows, ddl, name: spark.createDataFrame(rows, ddl).repartition(3).write.parquet(f"{root}/{name}.parquet")
    save([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save(items, "item_id long, text string", "benchmark")
    save([(i, int(300 <= i < 310) or len(text(t)) % 2, int(i % 7 == 0)) for i, t in docs if i is not None], "doc_id long, quality int, toxic int", "labels")
    pages = [(100 * k + i, f"http://site{k}.example/{i}", h, t) for k, layout in enumerate(LAYOUTS) for i, (h, t) in enumerate(site(rng, layout, 6))]
    pages += [(901, None, None, ""), (902, "http://x.example/", "", ""), (None, "http://y.example/", "<p>&Eacute;t&eacute; \U0001f600\n<p>two", "Été \U0001f600\ntwo")]
    save([p[:3] for p in pages], "page_id long, url string, html string", "pages")
    return root, docs, items, pages


def rows(spark, root, name, *columns):
    out = getattr(queries, name)(spark, root)
    assert set(columns) <= set(out.columns)
    kinds = dict(out.dtypes)
    return sorted((tuple(-1 if r[c] is None else r[c] for c in columns) for r in out.collect()), key=str), [kinds[c] for c in columns]


def plain(found):
    return sorted((tuple(-1 if x is None else x for x in r) for r in found), key=str)


def test_op1(spark, tables):
    root, docs, items, _ = tables
    want = []
    for (i, _), (j, n, hit, names) in zip(sorted(docs, key=lambda d: d[0] or 0), contaminated(docs, items), strict=True):
        assert (i or 0) == j
    for i, t in docs:
        (_, n, hit, names), *_ = contaminated([(i, t)], items)
        want.append((i, n, hit, len(names), sha(",".join(names)), hit > 0 and 20 * hit >= n))
    got, kinds = rows(spark, root, "op1_benchmark_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == plain(want) and kinds == ["bigint", "bigint", "bigint", "bigint", "string", "boolean"]
    assert any(r[-1] for r in want)


def test_op2_and_op4(spark, tables):
    root, docs, _, _ = tables
    two, four = [], []
    for i, t in docs:
        ids = LIBRARY.encode(text(t), add_special_tokens=False).ids
        two.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
        four.append((i, len(text(t).encode()), len(ids), len(ids) > 512))
    got, kinds = rows(spark, root, "op2_bpe_encoding", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == plain(two) and kinds == ["bigint", "bigint", "string", "string"]
    got, kinds = rows(spark, root, "op4_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == plain(four) and kinds == ["bigint", "bigint", "bigint", "boolean"]


def test_op3(spark, tables):
    root, docs, _, _ = tables
    want = [(i or -1, n, gone, sha(kept)) for i, n, gone, kept in substrings(docs)]
    got, kinds = rows(spark, root, "op3_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == plain(want) and kinds == ["bigint", "bigint", "bigint", "string"] and any(r[2] for r in want)


def test_op5(spark, tables):
    root, _, _, pages = tables
    got, kinds = rows(spark, root, "op5_html_extraction", "page_id", "url", "text", "n_chars")
    assert got == plain([(i, u, t, len(t)) for i, u, _, t in pages]) and kinds == ["bigint", "string", "string", "bigint"]


def test_op6(spark, tables):
    root, docs, _, _ = tables
    prints = [(i, brute_print(t)) for i, t in docs]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints), strict=True)]
    got, kinds = rows(spark, root, "op6_simhash_near_dedup", "doc_id", "fingerprint", "component_id")
    assert got == plain(want) and kinds == ["bigint", "string", "bigint"] and any(c not in (i, None) for i, _, c in want)


def test_op7(spark, tables):
    root, docs, _, _ = tables
    kinds_ = ("email", "ip", "card", "phone")
    want = []
    for i, t in docs:
        spans = personal(text(t))
        listed = ",".join(f"{kinds_[k]}:{a}:{b}" for a, k, b in spans)
        more = "email:0:27" if i == 501 else listed
        want.append((i, *[sum(k == x for _, x, _ in spans) for k in range(4)], sha(listed), more))
    got, kinds = rows(spark, root, "op7_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert got == plain(want) and kinds == ["bigint"] * 5 + ["string"] * 2


def test_op8(spark, tables):
    root, docs, _, _ = tables
    out = {(r.doc_id, r.n_bytes, r.payload_sha256): r for r in queries.op8_media_columns(spark, root).collect()}
    files = {(r.id, bytes(r.media)) for r in importlib.import_module("curatrix.llm.flac").store(common.table(spark, root, "documents")).select(F.col("doc_id").alias("id"), "media").collect()}
    media = {sha(f): f for _, f in files}
    features = {}
    for i, t in docs:
        raw = text(t).encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = out[i, len(raw), sha(payload)]
        assert (r.payload_bytes, r.tail_crc32) == (len(payload), binascii.crc32(payload[-16:]))
        file = media[r.media_sha256]
        assert r.media_bytes == len(file)
        channels, depth, (samples,), seek, frames = plain_flac.decode(file)
        assert (channels, depth) == (1, 8) and bytes(s + 128 for s in samples) == payload
        starts = {offset: (sample, size) for _, offset, sample, size in frames}
        assert seek and all(starts[o] == (s, n) for s, o, n in seek)
        assert features.setdefault(t or "", r.feature) == r.feature
    kinds = dict(queries.op8_media_columns(spark, root).dtypes)
    assert [kinds[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")] == ["bigint", "bigint", "string", "bigint", "bigint", "string", "string"]


def by_hand(model, t):
    """The network's output for one text, window by window."""
    w = classify.Words(pa.array([t]))
    row = np.zeros((2, max(1, w.n[0]) + model.PAD), np.int64)
    row[0, : w.n[0]], row[1, : w.n[0]] = model.rows[w.bucket], model.stems[w.stems()]
    hidden, at = [], 0
    for b, width in zip(model.b, model.WIDTHS, strict=True):
        columns = [slice(at + j * model.FILTERS, at + (j + 1) * model.FILTERS) for j in range(width)]
        windows = [sum(model.table[row[k, i + j], c] for j, c in enumerate(columns) for k in range(2)) for i in range(max(1, w.n[0]))]
        hidden.append(np.maximum(np.max(windows, axis=0) + b, 0))
        at += width * model.FILTERS
    z = np.concatenate(hidden) @ model.o + model.c[0]
    low = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)
    hits = [sum(x in some for x in words) for some in classify.LANGUAGE_WORDS.values()]
    return classify.sigmoid(z - model.shift[1 + int(np.argmax(hits)) if max(hits) else 0])


def all_pairs(model, t, metadata):
    """A factorisation machine's score with every pair of features written out."""
    words = classify.Words(pa.array([t]))
    weight = 1 / np.sqrt(max(len(words.bucket), 1))
    features = [(int(model.rows[b]), weight) for b in words.bucket]
    features += [(int(b), 1.0) for b in model._bins(np.column_stack([classify.structure(words), metadata]))[0]]
    at, x = np.array([f for f, _ in features]), np.array([v for _, v in features])
    v = model.v[at].astype(np.float64) * x[:, None]
    pairs = sum(float(v[i] @ v[i + 1 :].sum(0)) for i in range(len(v)))
    return 1 / (1 + np.exp(-(float(model.bias[0]) + float(model.w[at].astype(np.float64) @ x) + pairs)))


@pytest.mark.parametrize(("name", "n", "out", "fit", "label"), [("op9_toxicity", 5, 0, classify.fit_toxicity, "toxic"), ("op10_quality_classifier", 3, 1, classify.fit_quality, "quality")])
def test_op9_and_op10(spark, tables, name, n, out, fit, label):
    root, docs, _, _ = tables
    got = getattr(queries, name)(spark, root)
    assert [dict(got.dtypes)[c] for c in ("doc_id", "held_out", "score", "predicted")] == ["bigint", "boolean", "double", "int"]
    found = got.collect()
    assert sorted(r.doc_id or 0 for r in found) == sorted(i or 0 for i, _ in docs)
    d, l = (common.table(spark, root, t) for t in ("documents", "labels"))
    more = {"metadata": queries.METADATA} if name.startswith("op10") else {}
    beside = lambda some: (np.array([[np.nan if t is None else float(len(t))] for t in some]),) if more else ()
    model = fit(d, l, classify.fold(F.col("id"), n) != out, **more)
    scores = {}
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and binascii.crc32(str(r.doc_id).encode()) % n == out)
        scores.setdefault(r.doc_id, []).append(r.score)
    for i, t in docs:
        want = by_hand(model, text(t)) if name == "op9_toxicity" else all_pairs(model, text(t), *beside([t]))
        assert min(abs(want - s) for s in scores[i]) < 1e-5
    # Labels of held-out rows teach nothing.
    flipped = l.withColumn(label, F.when(classify.fold(F.col("doc_id"), n) == out, 1 - F.col(label)).otherwise(F.col(label)))
    again = fit(d, flipped, classify.fold(F.col("id"), n) != out, **more)
    some = [t for _, t in docs]
    assert np.array_equal(*[m.score(pa.array([text(t) for t in some]), *beside(some)) for m in (model, again)])


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_periodic_runs"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out = getattr(queries, name)(spark, sf)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert list(rel.columns) == out.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(rel.fetchall(), key=repr)
