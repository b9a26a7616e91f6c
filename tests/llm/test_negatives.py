"""Hard negatives against all pairs."""

import numpy as np
import pytest

from pageloom.llm import negatives

SHAPE = "vec_id bigint, label int, vec array<bigint>, score string"


def by_all_pairs(rows, anchors, positives=5, n=3, least=50, most=95):
    """rows: (id, label, list) without nulls and repeats."""
    out = []
    dim = max([0, *(len(v) for _, _, v in rows)])
    wide = np.array([[*v, *[0] * (dim - len(v))] for _, _, v in rows], dtype=object).reshape(len(rows), dim)
    for i, (a, label, _) in enumerate(rows):
        if not anchors(a):
            continue
        scores = wide @ wide[i] if dim else np.zeros(len(rows), dtype=object)
        scored = sorted((-int(s), id_, lab) for s, (id_, lab, _) in zip(scores, rows, strict=True) if id_ != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            found = [x for x in scored if x[2] != label and least * -s <= 100 * -x[0] <= most * -s][:n]
            out += [(a, p, k + 1, q, -s, -t) for k, (t, q, _) in enumerate(found)]
    return sorted(out)


def check(spark, rows, every=5, whole=None, **how):
    df = spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows], SHAPE)
    got = sorted(tuple(r) for r in negatives.mined(df, f"id % {every} = 0", **how).collect())
    assert got == by_all_pairs(rows if whole is None else whole, lambda a: a % every == 0)
    return got


def vectors(g, n, dim, spread=100):
    return [[int(x) for x in v] for v in g.normal(0, spread, (n, dim))]


@pytest.mark.parametrize("chunk", [7, 2048])
def test_random_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    g = np.random.default_rng(chunk)
    assert check(spark, [(i, int(g.integers(0, 4)), v) for i, v in enumerate(vectors(g, 400, 12))])
    # clusters, many ties, repeated vectors, one of them in a third of the rows
    centres = vectors(g, 8, 6, 60)
    rows = []
    for i in range(600):
        v = [c + int(g.integers(-2, 3)) for c in centres[int(g.integers(0, 8))]]
        rows.append((i, int(g.integers(0, 3)), centres[0] if i % 3 == 0 else v))
    assert check(spark, rows)


def test_rounds_scan_few_segments_of_clustered_vectors(spark, monkeypatch):
    """What the radius leaves out isn't read, and the result is that of all pairs."""
    monkeypatch.setattr(negatives, "CHUNK", 16)
    g = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        c = i % 25
        v = [int(900 * np.cos(2 * np.pi * c / 25) + g.normal(0, 4)), int(900 * np.sin(2 * np.pi * c / 25) + g.normal(0, 4)), int(g.normal(0, 4))]
        rows.append((i, i // 25 % 2, v))
    df = spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows], SHAPE)
    index = negatives.Index(negatives.usable(df, "vec_id", "label", "vec"), 6)
    space = index.space
    x = np.array([v for _, _, v in rows[:50]])
    sixth = np.sort(x @ np.array([v for _, _, v in rows]).T, axis=1)[:, -12]
    scanned = (space.bounds(x)[0] <= space.radius(x, sixth)[:, None]).mean()
    assert len(space.segment) > 60 and scanned < 0.35
    assert check(spark, rows, 50)


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [3, 3]), (2, 2, [2, 3]), (3, 2, [2, 2]), (4, 2, [0, 0]), (5, 1, [-1, -1]), (6, 1, [1]), (7, 2, []), (10, 3, [5, 5, 5]), (11, 9, [0, 0, 0])]
    odd = [(12, None, [9, 9]), (None, 1, [9, 9]), (13, 1, None), (14, 2, [9, None]), (0, 1, [3, 5]), (1, 1, [3, 3])]
    check(spark, rows + odd, 5, rows)
    check(spark, [(0, 1, [1, 1])])
    check(spark, [(i, 1, [1, 2]) for i in range(20)])
    check(spark, [(i, i % 2, []) for i in range(12)])
    check(spark, [(i, i % 2, [0, 0]) for i in range(12)])
    check(spark, [])


def test_large_numbers_stay_exact(spark):
    g = np.random.default_rng(4)
    for top in (1 << 26, 1 << 29):
        rows = [(i, int(g.integers(0, 3)), [int(x) for x in g.integers(0, top, 5)]) for i in range(120)]
        assert check(spark, rows)
    far = [(0, 1, [1 << 60, 5]), (1, 1, [1 << 60, 4]), (2, 2, [1 << 59, 3]), (3, 2, [3, 3])]
    negatives.mined(spark.createDataFrame([(*r, "x") for r in far], SHAPE), "id % 5 = 0").collect()
