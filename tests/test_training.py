"""Training rows from dialogues against a plain loop over the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curatrix.functions import dialogue, templates, tokens
from curatrix.operators import selection, training
from curatrix.plans import catalogue

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
END = LIBRARY.token_to_id("<|endoftext|>")


def made_turns():
    rng = random.Random(9)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(0, 14)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None])
            rows.append((conv, turn, role, rng.choice([None, "", "plain words", "Été 日本 <|endoftext|>", " ".join(rng.choices(["hello", "world", "one"], k=rng.randint(1, 60)))])))
    rows += [(99, t, "assistant" if t % 2 else "user", f"word {t} of a long talk") for t in range(900)]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "answer"), (100, 1, "user", "b"), (100, 1, "user", "a"), (100, 2, "assistant", "x")]
    return rows


def plain_pairs(turns):
    done, open_ = [], None
    for _, role, text in sorted(((o, r, t or "") for _, o, r, t in turns if r in ("user", "assistant"))):
        if role == "user":
            open_ = text if open_ is None else f"{open_}\n{text}"
        elif open_ is not None:
            done.append((open_, text))
            open_ = None
    return done


def plain_row(turns, template, limit):
    pairs = plain_pairs(turns)
    systems = sorted((o, t or "") for _, o, r, t in turns if r == "system")
    system = (systems[-1][1] if systems else "") or template.system
    ids, labels = [], []
    before, after = template.prompt.split("{query}")
    for i, (user, answer) in enumerate(pairs):
        s = LIBRARY.encode((system if i == 0 else template.separator) + before + user + after, add_special_tokens=i == 0).ids
        t = LIBRARY.encode(answer, add_special_tokens=False).ids
        if not s and not t:
            continue
        n, m = int(limit * (len(s) / (len(s) + len(t)))), int(limit * (len(t) / (len(s) + len(t))))
        s, t = s[:n], t[: max(m - 1, 0)] if len(t) > m - 1 else t
        s = s[1:] if s and s[0] == END else s
        t = t[:-1] if t and t[-1] == END else t
        if len(ids) + len(s) + len(t) + 1 > limit:
            break
        ids += [*s, *t, END]
        labels += [*[-100] * len(s), *t, END]
    return ids, labels


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: v for k, v in out.items() if plain_pairs(v)}


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(made_turns(), "conv_id int, turn int, role string, text string").repartition(5)


def test_pairs_of_dialogues_of_any_length(turns):
    got = {r.conv_id: [tuple(p) for p in r.pairs] for r in training.dialogue_pairs(turns, 10_000).collect()}
    assert got == {k: plain_pairs(v) for k, v in grouped(made_turns()).items()}
    first = {r.conv_id: [tuple(p) for p in r.pairs] for r in training.dialogue_pairs(turns, 3).collect()}
    assert first == {k: v[:3] for k, v in got.items()}


def test_pairs_are_those_of_the_expression_over_arrays(turns):
    some = turns.where("conv_id < 40 and role is not null").fillna("", ["text"])
    want = dialogue.gathered(some).select("conv_id", dialogue.history("turns").alias("p")).where("size(p) > 0")
    got = training.dialogue_pairs(some, 1000)
    assert {(r.conv_id, tuple(map(tuple, r.pairs))) for r in got.collect()} == {(r.conv_id, tuple(map(tuple, r.p))) for r in want.collect()}


@pytest.mark.parametrize(("name", "limit"), [("vicuna", 128), ("chatml", 48), ("base", 600)])
def test_training_rows_against_the_library(spark, turns, name, limit):
    template = templates.TEMPLATES[name]
    out = training.training_rows(turns, tokens.vocabulary(spark, PATH), template, limit, "<|endoftext|>")
    got = {r.conv_id: (r.input_ids, r.labels) for r in out.collect()}
    assert got == {k: plain_row(v, template, limit) for k, v in grouped(made_turns()).items()}


def test_tokens_carry_their_places(spark):
    texts = [["Été 日本", None], None, [], ["x" * 3000, "", "<|endoftext|>a"]]
    run = tokens.tokens(spark, tokens.vocabulary(spark, PATH))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>").select("i", run(F.col("t")).alias("x")).collect()
    for r in got:
        want = [LIBRARY.encode(t or "", add_special_tokens=False) for t in texts[r.i] or []]
        assert [(x.ids, list(zip(x.starts, x.ends, strict=True))) for x in r.x] == [(e.ids, e.offsets) for e in want]


def test_windows_hold_all_tokens_in_order(spark):
    rng = random.Random(4)
    rows = [(i, list(range(1000 * i, 1000 * i + rng.choice([0, 1, 3, 70, 200])))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, input_ids array<int>").withColumn("labels", F.transform("input_ids", lambda x: -x)).repartition(4)
    got = sorted(training.packed(df, 64, "i").collect())
    flat = [x for _, ids in rows for x in ids]
    assert [r.window for r in got] == list(range(-(-len(flat) // 64)))
    assert [r.input_ids for r in got] == [flat[a : a + 64] for a in range(0, len(flat), 64)]
    assert all(r.labels == [-x for x in r.input_ids] for r in got)
    assert training.packed(df.limit(0), 64, "i").count() == 0


def test_sums_and_maxima_carried_over_ranges(spark):
    rows = [(i, (i * 37) % 11 if i % 3 else None) for i in range(200)]
    placed = selection.positions(spark.createDataFrame(rows, "i int, v int").repartition(6), "i", part="part")
    got = selection.carried(selection.carried(placed, F.col("v"), "sum", "s", "part", "position"), F.col("v"), "max", "m", "part", "position").orderBy("i").collect()
    total, most = 0, None
    for r, (i, v) in zip(got, rows, strict=True):
        total += v or 0
        most = v if most is None else max(most, v or 0)
        assert (r.i, r.s, r.m) == (i, total, most)


def test_queries_over_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = grouped(rows)
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    want = {k: plain_row(v, templates.TEMPLATES[catalogue.TEMPLATE], catalogue.ROW_TOKENS) for k, v in by.items()}
    got = catalogue.QUERIES["sft_token_rows"](spark, SF).collect()
    assert {(r.conv_id, r.n_tokens, r.ids_sha256, r.labels_sha256, r.learnable) for r in got} == {(k, len(i), sha(i), sha(l), any(x != -100 for x in l)) for k, (i, l) in want.items()}
    order = sorted(((hashlib.sha256(f"pack:{k}".encode()).hexdigest(), k) for k, (_, l) in want.items() if any(x != -100 for x in l)))
    flat = [x for _, k in order for x in want[k][0]]
    packed = sorted(catalogue.QUERIES["packed_token_windows"](spark, SF).collect())
    w = catalogue.WINDOW_TOKENS
    assert [(r.window, r.n_tokens, r.ids_sha256) for r in packed] == [(i, len(flat[i * w : (i + 1) * w]), sha(flat[i * w : (i + 1) * w])) for i in range(-(-len(flat) // w))]
    tokens_of = lambda t: len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
    sums = {}
    for conv, _, _, t in rows:
        sums[conv] = sums.get(conv, 0) + tokens_of(t)
    audit = {r.field: r for r in catalogue.QUERIES["token_length_audit"](spark, SF).collect()}
    assert (audit["dialogue"].n, audit["dialogue"].largest, audit["dialogue"].over_512) == (len(sums), max(sums.values()), sum(x > 512 for x in sums.values()))
    assert audit["dialogue"].p50 == sorted(sums.values())[-(-len(sums) // 2) - 1]


def test_token_batches_are_bounded(spark):
    """A batch is cut by its bytes, texts are encoded in slices, and rows that need no places get none."""
    session = spark.newSession()
    run = tokens.tokens(session, tokens.vocabulary(session, PATH), special_first=True, places=False)
    assert int(session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    texts = [["a b " * 50_000, "c d " * 40_000, None], None, ["e"], ["f " * 200_000]]
    out = session.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>").select("i", run(F.col("t")).alias("x"))
    assert out.schema["x"].dataType.elementType.names == ["ids"]
    for r in out.collect():
        assert [x.ids for x in r.x] == [LIBRARY.encode(t or "", add_special_tokens=j == 0).ids for j, t in enumerate(texts[r.i] or [])]


def test_texts_are_sent_to_the_library_in_slices(monkeypatch):
    import numpy as np

    sent = []

    class Noted:
        def encode_batch(self, part, **more):
            sent.append(sum(map(len, part)))
            return LIBRARY.encode_batch(part, **more)

    texts = ["word " * 20_000] * 12
    made = tokens.encoded(Noted(), texts, np.zeros(12, bool))
    assert max(sent) <= 1 << 18 and made.field("ids").to_pylist() == [LIBRARY.encode(texts[0]).ids] * 12
