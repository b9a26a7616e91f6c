"""One-permutation MinHash and its groups against all pairs."""

import collections
import itertools
import random

import numpy as np

from pageloom.llm import minhash
from pageloom.llm.simhash import shingle_hashes

DOC = "doc_id bigint, text string, component string"


def by_all_pairs(rows):
    """(id, size, component) of rows (id, text): components over links, names by the smallest id."""
    sets = [frozenset(shingle_hashes(t or "", 5)) for _, t in rows]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = collections.Counter(p for ids in holders.values() for p in itertools.combinations(ids, 2))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 85 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[find(i)] = min(least.get(find(i), id_), id_)
    return sorted(((id_, len(sets[i]), id_ if id_ is None else least[find(i)]) for i, (id_, _) in enumerate(rows)), key=str)


def check(spark, rows):
    found = minhash.near_groups(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert got == by_all_pairs(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return found


def prose(r, n, words=3000):
    return [f"w{r.randrange(words)}" for _ in range(n)]


def test_signatures_agree_as_often_as_sets_do():
    g = np.random.default_rng(1)
    for n in (1, 3, 12, 60, 400, 5000):
        for j in (0.5, 0.85):
            share = round(2 * j * n / (1 + j))
            rates = []
            for _ in range(12):
                pool = g.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
                a, b = pool[:n], np.concatenate([pool[:share], pool[n : 2 * n - share]])
                x, y = minhash.signatures(np.concatenate([a, b]), np.array([n, n]))
                rates.append((x == y).mean())
            assert abs(np.mean(rates) - share / (2 * n - share)) < 0.06
    # what an empty bin takes is always a value of the set itself
    x = minhash.signatures(np.arange(5, dtype=np.uint64) * np.uint64(7919), np.array([2, 0, 3]))
    assert len(set(x[0].tolist())) <= 2 and (x[1] == minhash.NO).all() and len(set(x[2].tolist())) <= 3


def test_odd_rows(spark):
    long = " ".join(prose(random.Random(1), 60_000))
    texts = [None, "", " \n", "a", "A", "a b c d", "a  B\tc d", "a b c d e", "a b c d e f", long, long + " z", "É é", "é é"]
    check(spark, [*enumerate(texts), (None, "a b c d"), (None, None)])
    check(spark, [(1, "a b c d e"), (1, "q r s t u"), (0, "q r s t u"), (1, "a b c d e")])
    assert check(spark, []) == []


def test_drifting_families_and_a_large_group_lose_no_link(spark):
    r = random.Random(5)
    rows = []
    for n in (8, 30, 90, 400):
        for _ in range(4):
            words = prose(r, n)
            for _ in range(20):
                rows.append(" ".join(words))
                words = list(words)
                for _ in range(r.choice([1, 1, 2])):  # a step at either side of the threshold
                    words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
    base = prose(r, 200)
    rows += [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(200)] + [" ".join(base)] * 300
    r.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_like_sets_on_a_hub_that_is_like_neither_are_linked(spark, monkeypatch):
    """One bucket for all: every edge leads to the smallest node, the links are elsewhere."""
    monkeypatch.setattr(minhash, "bucket_keys", lambda x, *a: np.zeros((len(x), 1), np.uint64))
    r = random.Random(3)
    pairs = [prose(r, 120) for _ in range(12)]
    rows = [(k, " ".join(p)) for k, p in enumerate(pairs)] + [(100 + k, " ".join([*p[:-2], "y", "z"])) for k, p in enumerate(pairs)]
    assert sum(not x.kept for x in check(spark, rows)) == 12


def test_a_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_groups(docs).collect()), key=str)
    assert got == by_all_pairs(rows)


def test_edges_of_a_bucket_are_a_star(spark):
    nodes = spark.createDataFrame([(k, [1, k % 3]) for k in range(300)], "node bigint, keys array<bigint>")
    edges = {(r.a, r.b) for r in minhash.stars(nodes).collect()}
    assert edges == {(0, k) for k in range(1, 300)} | {(2, k) for k in range(5, 300, 3)}
