"""Product codes against plain rounds over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from curatrix.llm import codes, queries


def plain_rounds(points, books, rounds):
    """Rounds of one part in Python's whole numbers: entries, assignments, distances."""
    far = lambda x, z: sum((a - b) ** 2 for a, b in zip(x, z, strict=True))
    nearest = lambda x: min(range(len(books)), key=lambda e: (far(x, books[e]), e))
    for _ in range(rounds):
        own = [nearest(x) for x in points]
        for e in sorted(set(own)):
            mine = [x for x, o in zip(points, own, strict=True) if o == e]
            books[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = [nearest(x) for x in points]
    return books, own, [far(x, books[e]) for x, e in zip(points, own, strict=True)]


def contract(rows, entries=256):
    sound = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if sound(v) and len(v) and len(v) % 4 == 0]
    if not kept:
        return []
    width = len(min(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[1]) // 4
    kept = [r for r in kept if len(r[1]) == 4 * width]
    seeds = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    code, error, flat = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        cut = lambda r, p=p: list(r[1][p * width : (p + 1) * width])
        books, own, far = plain_rounds([cut(r) for r in kept], [cut(r) for r in seeds], 4)
        flat += [str(x) for z in books for x in z]
        code = [c + f"{o:02x}" for c, o in zip(code, own, strict=True)]
        error = [a + b for a, b in zip(error, far, strict=True)]
    by_label = {}
    for (_, _, label), x in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + x
    sha = hashlib.sha256(",".join(flat).encode()).hexdigest()
    return [(i, c, x, by_label[label], sha) for (i, _, label), c, x in zip(kept, code, error, strict=True)]


def made(rng, n, width, kind):
    if kind == "ties":
        value = lambda: rng.randint(-2, 2) / 1024
    elif kind == "clusters":
        value = lambda: rng.choice([-0.5, 0.25, 0.5]) + rng.gauss(0, 0.001)
    else:
        value = lambda: rng.gauss(0, 0.3)
    return [(i, [value() for _ in range(4 * width)], rng.choice([None, 1, 2, 3])) for i in range(n)]


def query(spark, root, rows, partitions=3):
    frame = spark.createDataFrame([tuple(r) for r in rows], "vec_id long, embedding array<double>, label int")
    frame.repartition(partitions).write.mode("overwrite").parquet(f"{root}/embeddings.parquet")
    out = queries.op12_vector_codes(spark, str(root))
    assert out.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("kind", ["ties", "clusters", "spread"])
def test_query_against_plain_rounds(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(codes, "LEAF", 4)
    rng = random.Random(kind)
    rows = made(rng, 330, 3, kind)
    rows += [(500, None, 1), (501, [0.1] * 11 + [None], 1), (502, [0.1] * 11 + [float("nan")], 1), (503, [float("inf")] + [0.1] * 11, None)]
    rows += [(504, [], 1), (505, [0.1] * 10, 1), (506, [0.1] * 16, 1), (None, [0.1] * 12, None), *rows[:3], (0, [0.2] * 12, 2)]
    rng.shuffle(rows)
    assert query(spark, tmp_path, rows) == sorted(contract(rows), key=repr)


def test_fewer_vectors_than_entries_and_none(spark, tmp_path):
    rows = made(random.Random(1), 7, 2, "ties")
    assert query(spark, f"{tmp_path}/a", rows) == sorted(contract(rows), key=repr)
    assert query(spark, f"{tmp_path}/b", [(1, None, 1), (2, [float("nan")] * 8, 1)]) == []
    assert query(spark, f"{tmp_path}/c", [(None, [0.5] * 8, 1)]) == []


@pytest.mark.parametrize(("scale", "exact"), [(3, True), (1000, True), (1 << 26, False)])
def test_filtered_tree_assigns_as_a_full_scan(scale, exact):
    rng = np.random.default_rng(2)
    for n, dims, k in ((1, 1, 1), (700, 2, 9), (1500, 5, 40), (900, 16, 256)):
        points, entries = rng.integers(-scale, scale + 1, (n, dims)), rng.integers(-scale, scale + 1, (k, dims))
        assert codes.exact_floats(points, entries) is exact or (n, exact) == (1, False)
        tree = codes.Tree(points)
        found, count, total, _ = codes.Tree.unpacked(tree.packed(), dims).nearest(entries)
        want = ((points[:, None, :] - entries[None]) ** 2).sum(2).argmin(1)
        assert (found == want[tree.order]).all()
        assert (count == np.bincount(want, minlength=k)).all()
        assert all((total[e] == points[want == e].sum(0)).all() for e in range(k))


def test_boxes_assign_whole_nodes():
    """Tight clusters are assigned without looking at their points."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-1000, 1000, (8, 4))
    points = np.repeat(centres, 2000, axis=0) + rng.integers(-2, 3, (16_000, 4))
    *_, by_node = codes.Tree(points).nearest(centres)
    assert by_node > 12_000


def test_rare_labels_meet_their_sums_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(codes, "HEAVY_SHARE", 0.2)
    rows = [(i, None if i % 3 == 0 else i, i) for i in range(30)]
    got = {(r.i, r.s) for r in codes.label_sums(spark.createDataFrame(rows, "i int, label int, v long"), "label", "v", "s").collect()}
    assert got == {(i, sum(range(0, 30, 3)) if i % 3 == 0 else i) for i in range(30)}


def test_components_beyond_exact_distances_are_an_error():
    with pytest.raises(ValueError):
        codes.whole_numbers(np.array([[1e9, 0.0]]), 2)


def test_columns_of_other_names(spark):
    rows = [(f"v{i}", [0.1 * i, 0.2, 0.3, 0.4], i, "x") for i in range(5)]
    out, books = codes.compressed(spark.createDataFrame(rows, "`a b` string, `x.y` array<float>, k0 int, trees string"), "a b", "x.y", ("trees",))
    assert out.columns == ["a b", "trees", "code", "error"] and out.count() == 5 and books.shape == (4, 5, 1)
    assert {r[1] for r in out.collect()} == {"x"}
