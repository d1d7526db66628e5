import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from curatrix.llm import simhash
from curatrix.operators.dedup import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=2):
    ids = [i for i, _ in prints]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= distance:
                root[find(a)] = find(b)
    out = {}
    for i in range(len(ids)):
        members = [ids[j] for j in range(len(ids)) if find(j) == find(i) and ids[j] is not None]
        out.setdefault(i, min(members) if members else None)
    return [out[i] for i in range(len(ids))]


def test_rows_against_brute_force(awkward, empty):
    rows = [(r.doc_id, brute_print(r.text)) for r in awkward.collect()]
    want = sorted((i or 0, p, c or 0) for (i, p), c in zip(rows, brute_components(rows), strict=True))
    got = sorted((r.doc_id or 0, r.fingerprint % (1 << 64), r.component_id or 0) for r in simhash.near_groups(awkward).collect())
    assert got == want and simhash.near_groups(empty).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["Word", "b", "É", " ", "\n", "\t  "]) for _ in range(n)) for n in (0, 1, 2, 3, 5, 40, 900)]
    for size in (1, 2, 7, 50, 1 << 18):
        monkeypatch.setattr(simhash, "PIECE_BYTES", size)
        for k in (1, 3, 5):
            assert [simhash.fingerprint(t.encode(), k) for t in texts] == [brute_print(t, k) for t in texts]


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_links_with_crowded_buckets(spark, distance):
    rng = random.Random(3)
    base, prints = rng.getrandbits(64), set()
    for _ in range(400):  # many in one bucket: bits of two blocks only
        p = base
        for _ in range(rng.randint(0, 5)):
            p ^= 1 << rng.randrange(24)
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1, 1 << 63}
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(rows, "fp long")
    parts = {r.node: r.root for r in components(simhash.links(df, distance)).collect()}
    nodes = [(x, x % (1 << 64)) for (x,) in rows]
    want = brute_components(nodes, distance)
    for (x, _), c in zip(nodes, want, strict=True):
        assert parts.get(x, x) == c


def test_chain_component(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_one_of_each_group_stays(awkward):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids == [0, 0, 1, 2, 7, 8, 10]  # 9 is within two bits of 8; rows without an id stay


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_columns_of_any_name_stay(awkward, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", most)
    named = awkward.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(("__id", "__NTH", "__fp", "fingerprint", "component_id", "n", "root"))])
    kept = simhash.keep_one(named)
    assert kept.columns == named.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 7, 8, 10]
    assert {tuple(r)[2:] for r in kept.collect()} == {(0, 1, 2, 3, 4, 5, 6)}


def shingles(text, size=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_similar(rows, similarity=0.8):
    """The smallest id of each row's group under links of all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(rows))]


def changed(rng, words, n):
    out = words[:]
    for at in rng.sample(range(len(out)), n):
        out[at] = f"other{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("crowd", [32, 4])
def test_groups_of_similar_texts(spark, monkeypatch, crowd):
    """Copies with some changed words; in crowded blocks, too."""
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", crowd)
    rng = random.Random(crowd)
    rows = []
    for base in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 300, 900]))]
        rows += [(len(rows) + i, " ".join(changed(rng, words, rng.randint(0, len(words) // 60)))) for i in range(12)]
        rows.append((len(rows), " ".join(changed(rng, words, len(words) // 5))))  # a far one
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "one two", "ONE  two", "one three", "a b c d e f", "a b c d e"])]
    rows.append((3, "another text of an id that is there"))
    got = sorted((r.doc_id, r.component_id) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    want = sorted((i, c) for (i, _), c in zip(rows, brute_similar(rows), strict=True))
    assert got == want


def test_minima_tell_what_two_sets_share():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        both = rng.integers(0, 1 << 62, int(2000 * share)).astype(np.uint64)
        rest = rng.integers(0, 1 << 62, (2, (2000 - len(both)) // 2)).astype(np.uint64)
        a, b = (simhash.minima(np.unique(np.concatenate([both, r]))) for r in rest)
        assert abs((a == b).mean() - share) < 0.16
    assert len(set(simhash.minima(np.array([5], np.uint64)).tolist())) == simhash.MINIMA and (simhash.minima(np.zeros(0, np.uint64)) == -1).all()


def test_similar_texts_of_the_given_table_are_found(spark):
    """Recall over all pairs of sf0.01 that share 0.8 of their five-word shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    least = dict(zip([i for i, _ in rows], brute_similar(rows), strict=True))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    missed = [i for i in least if got[i] != least[i]]
    assert len(missed) <= 0.1 * sum(least[i] != i for i in least)


def test_crowded_blocks_lose_no_link(spark, monkeypatch):
    """Two groups in the same blocks with one link between them, that neither the first text of a block nor a part of it need have."""
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", 1)
    monkeypatch.setattr(simhash, "PART", 1)
    monkeypatch.setattr(simhash, "ROWS", 7)
    rng, rows = random.Random(5), []
    put = lambda words, spots: [f"x{rng.randrange(10**6)}" if i in spots else w for i, w in enumerate(words)]
    for _ in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for side in (put(words, {20, 60, 100}), put(words, {140, 180, 220})):
            rows += [(len(rows) + i, " ".join(put(side, {10 + 10 * x for x in rng.sample((0, 2, 4, 6, 10, 12, 14, 24, 26, 28), 2)} if i else ()))) for i in range(30)]
    rng.shuffle(rows)
    want = {i: c for (i, _), c in zip(rows, brute_similar(rows), strict=True)}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(set(want.values())) == 4 and got == want


def test_groups_of_a_crowded_block_meet_without_rows_of_candidates(spark, monkeypatch):
    """Dealt into small parts; what the join gives are the similar pairs and no others."""
    monkeypatch.setattr(simhash, "ROWS", 7)
    monkeypatch.setattr(simhash, "HASHES", 150)
    rng = random.Random(3)
    sets = {i: sorted(set(rng.sample(range(30), 24)) | ({100 + i} if i % 3 else set())) for i in range(90)}
    group = {i: 0 if i < 30 else i for i in sets}
    rest = spark.createDataFrame([(1, 5, i, group[i], 0) for i in sets], "c int, k long, node long, root long, top long")
    held = spark.createDataFrame(list(sets.items()), "node long, hashes array<long>")
    got = sorted((r.a, r.b) for r in simhash._met_apart(rest, held, 0.8).collect())
    alike = lambda a, b: len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})
    want = [(a, b) for a in sets for b in sets if a < b and group[a] != group[b] and alike(a, b)]
    assert want and got == want
