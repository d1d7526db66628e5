import hashlib
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curatrix.llm import classify, common, pii
from test_decontaminate import brute as contaminated
from test_queries import LIBRARY, sha, tables, text  # noqa: F401  tables is a fixture
from test_simhash import brute_similar

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_in_order_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    assert [name.split()[0] for name, _ in pipeline.STAGES] == ["quality", "SimHash", "benchmark", "PII", "BPE"]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[-1] > 0.5 * n[0]
    last = pipeline.run(spark, SF)
    assert last.count() == n[-1] and last.where("decoded_sha256 is null").count() == 0


def near(rows):
    """One of each group: that of the smallest id; rows without an id stay, one of each id does."""
    named = [r for r in rows if r[0] is not None]
    least = brute_similar(named)
    return [r for r in rows if r[0] is None] + list({i: (i, t) for (i, t), c in zip(named, least, strict=True) if c == i}.values())


def test_run_against_a_plain_version(spark, tables):  # noqa: F811
    root, rows, items, _ = tables
    docs, labels = (common.table(spark, root, t) for t in ("documents", "labels"))
    model = classify.fit_quality(docs, labels, classify.fold(F.col("id"), 3) != 1, metadata=("n_chars",))
    sizes = [len(rows)]
    steps = (
        lambda rows: [r for r, s in zip(rows, model.score(pa.array([text(t) for _, t in rows]), np.array([[np.nan if t is None else len(t)] for _, t in rows], float)), strict=True) if s >= 0.5],
        near,
        lambda rows: [r for r in rows if not (lambda n, hit: hit and 20 * hit >= n)(*contaminated([r], items)[0][1:3])],
        lambda rows: [(i, None if t is None else pii.masked(t)) for i, t in rows],
    )
    for step in steps:
        rows = step(rows)
        sizes.append(len(rows))
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(text(t), add_special_tokens=False).ids
        want.append((i if i is not None else -1, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text(t))))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, root).collect()]
    assert sorted(got) == sorted(want) and sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0
    assert all(hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256 for r in pipeline.run(spark, root).collect())


def test_columns_of_any_name_pass_through(spark, tables):  # noqa: F811
    root, _, _, _ = tables
    names = ("__id", "__nth", "__digest", "c0", "missing", "masked", "score", "fingerprint", "row", "t", "k0")
    docs = common.table(spark, root, "documents").select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in names])
    plain = common.table(spark, root, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert all(r[c] == f"{c}:{'' if r.doc_id is None else r.doc_id}" for r in rows for c in names), name
        assert len(rows) == stage(spark, plain, root).count(), name
        assert stage(spark, docs.limit(0), root).count() == 0, name
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), root).count() == 0
