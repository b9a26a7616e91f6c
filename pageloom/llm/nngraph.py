"""NN-descent and greedy graph search within one part of a table's vectors, in numpy.

A part is a dict of arrays: its own nodes (``ids`` ascending, ``vec`` unit vectors in single
precision), their neighbours (``near`` ids, ``nearp`` their parts, ``sims`` how near they are,
``fresh``: new since the last round; a row for each node, -1 where there are fewer), and the
neighbours that live in other parts (``hid`` ascending, ``hpart``, ``hvec``). Messages are dicts
of arrays too. Nearness is the squared distance of unit vectors, negated: it orders as the cosine
does, and taken from differences it tells vectors apart whose cosines are all 1 in this precision.
"""

from __future__ import annotations

import numpy as np

Part = dict[str, np.ndarray]
NONE, LOW = np.int64(-1), np.float32(-9)
#: Rows that a block of first neighbours has at most, how many orders of blocks, and pairs scored at a time.
BLOCK, ORDERS, PAIRS = 128, 3, 1 << 18
#: Own nodes of a leaf where a search begins, and evenly spread ones.
LEAF, ENTRIES = 32, 16


def lottery(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """A number for each pair that says which pairs a sample takes."""
    x = (a.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) ^ b.astype(np.uint64)) + np.uint64(turn)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def rank(owner: np.ndarray) -> np.ndarray:
    """Place of each row among its owner's (rows of an owner stand together)."""
    if not len(owner):
        return np.zeros(0, np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return np.arange(len(owner)) - np.repeat(firsts, np.diff(np.append(firsts, len(owner))))


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range of so many, one after another."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def place_of(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where numbers stand in an ascending array; -1 for those that don't."""
    if not len(ids):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, at, -1)


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending and without repeats (by sorting, which is faster here than hashing)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def once(ids: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ascending and without repeats, the rest alike."""
    ids, first = np.unique(ids, return_index=True)
    return (ids, *(x[first] for x in rest))


def nearness(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows i of x with rows j of y, some at a time."""
    out = np.empty(len(i), np.float32)
    for a in range(0, len(i), PAIRS // 8):
        some = slice(a, a + PAIRS // 8)
        apart = x[i[some]] - y[j[some]]
        np.einsum("ij,ij->i", apart, apart, out=out[some])
    return np.negative(out, out=out)


# the tree that deals vectors to parts
def grow(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, thresholds) of a balanced tree: each node halves its share of the sample along the line between two far members."""
    r = np.random.default_rng(7)
    n = (1 << depth) - 1
    directions, cuts = np.zeros((n, sample.shape[1]), np.float32), np.zeros(n, np.float32)
    held = {0: np.arange(len(sample))}
    for node in range(n):
        rows = held.pop(node, np.zeros(0, np.int64))
        if len(rows) > 1:
            pick = sample[rows[r.integers(0, len(rows), min(len(rows), 64))]]
            sims = pick @ pick.T
            i, j = np.unravel_index(sims.argmin(), sims.shape)
            directions[node] = pick[i] - pick[j]
            along = sample[rows] @ directions[node]
            cuts[node] = np.median(along)
            held[2 * node + 1], held[2 * node + 2] = rows[along <= cuts[node]], rows[along > cuts[node]]
    return directions, cuts


def leaves(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector its leaf, and the leaf beyond the cut that it is nearest to."""
    directions, cuts = tree
    depth = len(cuts).bit_length()

    def down(flip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        node, closest, at = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full(len(x), -1)
        for level in range(depth):
            off = np.einsum("ij,ij->i", x, directions[node]) - cuts[node]
            right = off > 0
            if flip is not None:
                right ^= flip == level
            far = np.abs(off) / np.maximum(np.linalg.norm(directions[node], axis=1), 1e-9)
            at = np.where(far < closest, level, at)
            closest = np.minimum(closest, far)
            node = 2 * node + 1 + right
        return node - len(cuts), at

    own, level = down(None)
    return own, down(level)[0] if depth else own


# building
def halves(x: np.ndarray, most: int, seed: int) -> list[np.ndarray]:
    """Rows in blocks of at most so many, by halving along the line between two of them."""
    r = np.random.default_rng(seed)
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        i, j = r.integers(0, len(rows), 2)
        along = x[rows] @ (x[rows[i]] - x[rows[j]])
        order = np.argsort(along, kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def best_of(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n owners its closest others (rows of places, -1 where there are fewer) and how near; pairs may repeat."""
    out, sims = np.full((n, most), -1, dtype=np.int64), np.full((n, most), LOW, dtype=np.float32)
    if len(owner):
        order = np.lexsort([other, -sim, owner])
        owner, other, sim = owner[order], other[order], sim[order]
        # equal pairs are equally near, so they stand together
        fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])])
        owner, other, sim = owner[fresh], other[fresh], sim[fresh]
        place = rank(owner)
        keep = place < most
        out[owner[keep], place[keep]], sims[owner[keep], place[keep]] = other[keep], sim[keep]
    return out, sims


def begin(ids: np.ndarray, vec: np.ndarray, pid: int, gids: np.ndarray, gpart: np.ndarray, gvec: np.ndarray, degree: int) -> Part:
    """A part from its own nodes and guests of other parts: first neighbours from blocks."""
    x = np.concatenate([vec, gvec])
    every, parts = np.concatenate([ids, gids]), np.concatenate([np.full(len(ids), pid, np.int32), gpart])
    owner, other, sim = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for turn in range(ORDERS):
        for rows in halves(x, BLOCK, turn):
            own = x[rows] - x[rows].mean(axis=0)  # else rounding hides how close vectors differ
            square = (own * own).sum(axis=1)
            sims = 2 * own @ own.T - square[:, None] - square
            np.fill_diagonal(sims, LOW)
            most = min(degree, len(rows) - 1)
            if most > 0:
                at = np.argpartition(-sims, most - 1, axis=1)[:, :most]
                owner.append(np.repeat(rows, most))
                other.append(rows[at].ravel())
                sim.append(nearness(x, owner[-1], x, other[-1]))
    owner, other, sim = map(np.concatenate, (owner, other, sim))
    mine = owner < len(ids)
    near, sims = best_of(owner[mine], other[mine], sim[mine], len(ids), degree)
    return settled({"ids": ids, "vec": vec}, pid, near, sims, near >= 0, every, parts, np.concatenate([vec, gvec]))


def settled(part: Part, pid: int, near: np.ndarray, sims: np.ndarray, fresh: np.ndarray, every: np.ndarray, parts: np.ndarray, vec: np.ndarray) -> Part:
    """The part with neighbours given by their places in ``every``; the vectors of those that live elsewhere are kept."""
    none = near < 0
    used = np.unique(near[~none])
    away = used[parts[used] != pid]
    hid, hpart, hvec = once(every[away], parts[away], vec[away])
    return part | {"near": np.where(none, NONE, every[near]), "nearp": np.where(none, -1, parts[near]).astype(np.int32), "sims": sims, "fresh": fresh, "hid": hid, "hpart": hpart, "hvec": hvec}


def asks(part: Part, pid: int, every: bool = False, vectors: bool = True) -> dict[int, Part]:
    """To each other part: the new edges to its nodes (from ``v``, by place in ``vids``, to ``m``) with the vectors of those that they come from (if asked for), and the nodes ``watch`` that old edges lead to. ``every``: all edges are sent as new ones."""
    near, nearp = part["near"], part["nearp"]
    away = (near >= 0) & (nearp != pid)
    rows, cols = np.nonzero(away)
    out = {}
    order = np.argsort(nearp[rows, cols], kind="stable")
    rows, cols = rows[order], cols[order]
    to = nearp[rows, cols]
    new = part["fresh"][rows, cols] | every
    for q, a, b in cuts_of(to):
        r, m, f = rows[a:b], near[rows[a:b], cols[a:b]], new[a:b]
        v, at = np.unique(r[f], return_inverse=True)
        out[q] = {"vids": part["ids"][v], "v": at.astype(np.int32), "m": m[f], "watch": np.unique(m[~f])} | ({"vvec": part["vec"][v]} if vectors else {})
    return out


def cuts_of(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, first, end) of each run."""
    if not len(keys):
        return []
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [(int(keys[a]), int(a), int(b)) for a, b in zip(firsts, np.append(firsts[1:], len(keys)), strict=True)]


def heard(part: Part, letters: list[tuple[int, Part]], most: int, turn: int, vectors: bool = True) -> tuple[np.ndarray, ...]:
    """(place of m, v's id and part, and its vector if asked for): who of other parts lists an own node anew, a sample of at most so many each."""
    m = np.concatenate([np.zeros(0, np.int64), *(x["m"] for _, x in letters)])
    v = np.concatenate([np.zeros(0, np.int64), *(x["vids"][x["v"]] for _, x in letters)])
    p = np.concatenate([np.zeros(0, np.int32), *(np.full(len(x["m"]), frm, np.int32) for frm, x in letters)])
    at = place_of(part["ids"], m)
    order = np.lexsort([lottery(v, m, turn), at])
    order = order[(rank(at[order]) < most) & (at[order] >= 0)]
    out = at[order], v[order], p[order]
    if not vectors:
        return out
    vec = np.concatenate([np.zeros((0, part["vec"].shape[1]), np.float32), *(x["vvec"][x["v"]] for _, x in letters)])
    return *out, vec[order]


def replies(part: Part, pid: int, letters: list[tuple[int, Part]], most: int, turn: int, vectors: bool = True) -> dict[int, Part]:
    """To each part that asked: for every node ``m`` that it names, ``count`` entries: its neighbours and a sample of those that list it (``e``: the place in ``uids``, or -1 less that place if new; of watched nodes the new ones only), and the parts and vectors of all but the part's own (``upart``, ``uvec``, the first of ``uids``). To the part itself: who has listed its nodes. Without ``vectors``, whoever is told fetches these from their own parts (``wants``), each once."""
    hm, hv, hp, *hvec = heard(part, letters, most, turn, vectors)
    out = {}
    if len(hm):
        u, up, *uv = once(hv, hp, *hvec)
        m, count = np.unique(hm, return_counts=True)
        out[pid] = {"m": part["ids"][m], "count": count.astype(np.int32), "e": (-1 - place_of(u, hv)).astype(np.int32), "uids": u, "upart": up} | dict(zip(["uvec"], uv))
    if vectors:
        known, vecs = once(np.concatenate([part["ids"], part["hid"], hv]), np.concatenate([part["vec"], part["hvec"], *hvec]))
    for frm, x in letters:
        asked = np.unique(place_of(part["ids"], x["m"]))
        watched = np.setdiff1d(place_of(part["ids"], x["watch"]), asked)
        asked, watched = asked[asked >= 0], watched[watched >= 0]
        src, cols = np.nonzero(part["near"][asked] >= 0)
        src2, cols2 = np.nonzero(part["fresh"][watched] & (part["near"][watched] >= 0))
        src, cols = np.concatenate([asked[src], watched[src2]]), np.concatenate([cols, cols2])
        told = np.isin(hm, np.concatenate([asked, watched]))
        m = np.concatenate([src, hm[told]])
        e = np.concatenate([part["near"][src, cols], hv[told]])
        p = np.concatenate([part["nearp"][src, cols], hp[told]])
        new = np.concatenate([part["fresh"][src, cols], np.ones(told.sum(), bool)])
        if not len(m):
            continue
        order = np.argsort(m, kind="stable")
        m, e, p, new = m[order], e[order], p[order], new[order]
        each, count = np.unique(m, return_counts=True)
        u, up = once(e[p != frm], p[p != frm])
        theirs = np.unique(e[p == frm])
        at = np.where(p == frm, place_of(theirs, e) + len(u), place_of(u, e))
        out[frm] = {"m": part["ids"][each], "count": count.astype(np.int32), "e": np.where(new, -1 - at, at).astype(np.int32), "uids": np.concatenate([u, theirs]), "upart": up} | ({"uvec": vecs[place_of(known, u)]} if vectors else {})
    return out


def known_of(hid: np.ndarray, hpart: np.ndarray, letters: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    """(id, part) of the nodes of other parts that a part knows and those that replies name, each once."""
    uids = np.concatenate([hid[:0], *(x["uids"][: len(x["upart"])] for x in letters)])
    return once(np.concatenate([hid, uids]), np.concatenate([hpart, *(x["upart"] for x in letters)]))


def wants(hid: np.ndarray, pid: int, letters: list[Part]) -> dict[int, np.ndarray]:
    """To each other part the nodes whose vectors replies without them make a part fetch: those that it doesn't hold."""
    ids, parts = known_of(hid[:0], np.zeros(0, np.int32), letters)
    new = (place_of(hid, ids) < 0) & (parts != pid)
    ids, parts = ids[new], parts[new]
    order = np.argsort(parts, kind="stable")
    return {q: ids[order[a:b]] for q, a, b in cuts_of(parts[order])}


def merge(part: Part, pid: int, letters: list[Part], most: int, turn: int, fetched: list[tuple[np.ndarray, np.ndarray]] = ()) -> Part:
    """The part after a round: every node meets the neighbours of its neighbours, both ways, where one of the two steps is new, and keeps the closest. ``fetched``: (ids, vectors) of those that the replies name without one."""
    n, degree = part["near"].shape
    away, apart = known_of(part["hid"], part["hpart"], letters)
    stay = (apart != pid) & (place_of(part["ids"], away) < 0)
    away, apart = away[stay], apart[stay]
    # own nodes first, so that their places are those in the part; each vector is copied once
    every, parts = np.concatenate([part["ids"], away]), np.concatenate([np.full(n, pid, np.int32), apart])
    x = np.zeros((len(every), part["vec"].shape[1]), np.float32)
    x[:n] = part["vec"]
    for ids, vec in [(part["hid"], part["hvec"]), *((y["uids"][: len(y["upart"])], y["uvec"]) for y in letters if "uvec" in y), *fetched]:
        at = place_of(away, ids)
        x[n + at[at >= 0]] = vec if (at >= 0).all() else vec[at >= 0]

    def where(ids: np.ndarray) -> np.ndarray:
        own, far = place_of(part["ids"], ids), place_of(away, ids)
        return np.where(own >= 0, own, np.where(far >= 0, far + n, -1))

    near = where(part["near"].ravel()).reshape(n, degree)
    near[part["near"] < 0] = -1
    # steps from a node: (src, dst, new)
    r, c = np.nonzero(near >= 0)
    src, dst, new = [r.astype(np.int32)], [near[r, c].astype(np.int32)], [part["fresh"][r, c]]
    back = (near[r, c] < n) & part["fresh"][r, c]
    m, v = near[r, c][back], r[back]
    order = np.lexsort([lottery(v, m, turn), m])
    order = order[rank(m[order]) < most]
    src.append(m[order].astype(np.int32))
    dst.append(v[order].astype(np.int32))
    new.append(np.ones(len(order), bool))
    direct = [(m, v)]
    for y in letters:
        was_new = y["e"] < 0
        s, d = np.repeat(where(y["m"]), y["count"]), where(y["uids"])[np.where(was_new, -1 - y["e"], y["e"])]
        good = (s >= 0) & (d >= 0)
        src.append(s[good].astype(np.int32))
        dst.append(d[good].astype(np.int32))
        new.append(was_new[good])
        listed = good & (s < n)  # who lists an own node
        direct.append((s[listed], d[listed]))
    src, dst, new = map(np.concatenate, (src, dst, new))
    order = np.lexsort([~new, src])
    src, dst, new = src[order], dst[order], new[order]
    first = np.searchsorted(src, np.arange(len(every) + 1))
    n_all = np.diff(first)
    n_new = np.bincount(src[new], minlength=len(every))
    out, sims, fresh = np.full((n, degree), -1, dtype=np.int64), np.full((n, degree), LOW, dtype=np.float32), np.zeros((n, degree), bool)
    do, dd = (np.concatenate([y[i] for y in direct]) for i in (0, 1))
    order = np.argsort(do, kind="stable")
    do, dd = do[order], dd[order]
    step = max(1, PAIRS // max(1, degree * (degree + most)))
    for a in range(0, n, step):
        b = min(n, a + step)
        rr, cc = np.nonzero(near[a:b] >= 0)
        rr += a
        via = near[rr, cc]
        count = np.where(part["fresh"][rr, cc], n_all[via], n_new[via])
        i, j = np.searchsorted(do, [a, b])
        owner = np.concatenate([np.repeat(rr, count), do[i:j]])
        other = np.concatenate([dst[ranges(first[via], count)], dd[i:j]])
        key = distinct(owner * len(every) + other)
        owner, other = key // len(every), key % len(every)
        held = distinct(rr * len(every) + via)
        keep = (owner != other) & (place_of(held, key) < 0)
        owner, other = owner[keep], other[keep]
        sim = nearness(x, owner, x, other)
        better = sim > part["sims"][owner, -1]
        owner, other, sim = owner[better], other[better], sim[better]
        out[a:b], sims[a:b] = best_of(np.concatenate([rr, owner]) - a, np.concatenate([via, other]), np.concatenate([part["sims"][rr, cc], sim]), b - a, degree)
        o2, c2 = np.nonzero(out[a:b] >= 0)
        fresh[a + o2, c2] = place_of(held, (a + o2) * len(every) + out[a + o2, c2]) < 0
    return settled({"ids": part["ids"], "vec": part["vec"]}, pid, out, sims, fresh, every, parts, x)


def finished(part: Part, pid: int, letters: list[tuple[int, Part]], most: int) -> Part:
    """What search needs: for each own node (row of ``links``, -1 where there are fewer) the places, in own nodes and then ``hid``, of its neighbours and of a sample of those that list it; and a tree whose leaves (``leaf`` of each own node) say where to begin."""
    n, degree = part["near"].shape
    x = part["vec"]
    tree = grow(x, max(0, int(np.ceil(np.log2(max(1, n / LEAF))))))
    hm, hv, hp, hvec = heard(part, letters, most, 0)
    hid, hpart, hv2 = once(np.concatenate([part["hid"], hv]), np.concatenate([part["hpart"], hp]), np.concatenate([part["hvec"], hvec]))
    own, far = place_of(part["ids"], part["near"].ravel()), place_of(hid, part["near"].ravel())
    near = np.where(own >= 0, own, np.where(far >= 0, far + n, -1)).reshape(n, degree)
    near[part["near"] < 0] = -1
    r, c = np.nonzero((near >= 0) & (near < n))
    src = np.concatenate([near[r, c], hm])
    dst = np.concatenate([r, place_of(hid, hv) + n])
    order = np.lexsort([lottery(src, dst, 0), src])
    src, dst = src[order], dst[order]
    r, c = np.nonzero(near >= 0)
    owner, other = np.concatenate([r, src]), np.concatenate([near[r, c], dst])
    turn = np.concatenate([np.zeros(len(r), np.int64), np.ones(len(src), np.int64)])
    key, at = np.unique(owner * (n + len(hid)) + other, return_index=True)
    at = at[np.argsort(owner[at] * 2 + turn[at], kind="stable")]
    owner, other = owner[at], other[at]
    place = rank(owner)
    keep = place < degree + most
    links = np.full((n, degree + most), -1, dtype=np.int32)
    links[owner[keep], place[keep]] = other[keep]
    return {"ids": part["ids"], "vec": part["vec"], "links": links, "hid": hid, "hpart": hpart, "hvec": hv2, "directions": tree[0], "cuts": tree[1], "leaf": leaves(x, tree)[0].astype(np.int32)}


# search
def explore(part: Part, pid: int, queries: np.ndarray, seeds: list[tuple[np.ndarray, np.ndarray]], beam: int, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Greedy search for each query from its seeds (ids of own nodes, and which are expanded already; none: from the own nodes of its leaf, of the next one, and some evenly spread): (ids, parts, nearness, expanded, nodes scored) of the closest found. Own nodes among the closest are expanded until none is left."""
    n, h = len(part["ids"]), len(part["hid"])
    x = np.concatenate([part["vec"], part["hvec"]])
    every, parts = np.concatenate([part["ids"], part["hid"]]), np.concatenate([np.full(n, pid, np.int32), part["hpart"]])
    out = []
    step = max(1, (64 << 20) // max(1, n + h))
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        c = len(q)
        seen = np.zeros((c, n + h), dtype=bool)
        pool, sims, done = np.full((c, beam), -1, dtype=np.int64), np.full((c, beam), LOW, dtype=np.float32), np.ones((c, beam), dtype=bool)
        start = np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64)
        leaf, beside = leaves(q, (part["directions"], part["cuts"]))
        by_leaf = np.argsort(part["leaf"], kind="stable")
        firsts = np.searchsorted(part["leaf"][by_leaf], np.arange(len(part["cuts"]) + 2))
        rows, nodes, flags = [], [], []
        for i in range(c):
            ids, expanded = seeds[a + i]
            at = place_of(part["ids"], ids)
            at, expanded = at[at >= 0], expanded[at >= 0]
            if not len(ids):
                at = np.unique(np.concatenate([start, *(by_leaf[firsts[y] : firsts[y + 1]] for y in (leaf[i], beside[i]))]))
                expanded = np.zeros(len(at), bool)
            rows.append(np.full(len(at), i))
            nodes.append(at)
            flags.append(expanded)
        row, node, flag = map(np.concatenate, (rows, nodes, flags))
        scored = np.zeros(c, dtype=np.int64)
        while len(row):
            seen[row, node] = True
            scored += np.bincount(row, minlength=c)
            sim = nearness(q, row, x, node)
            pool, sims, done = kept_best(pool, sims, done, row, node, sim, flag, beam)
            todo = ~done & (pool >= 0) & (pool < n)
            pick = todo & (np.cumsum(todo, axis=1) <= width)
            r, k = np.nonzero(pick)
            done[r, k] = True
            found = part["links"][pool[r, k]].astype(np.int64)
            row, node = np.repeat(r, found.shape[1]), found.ravel()
            good = node >= 0
            key = distinct(row[good] * (n + h) + node[good])
            row, node = key // max(n + h, 1), key % max(n + h, 1)
            new = ~seen[row, node]
            row, node = row[new], node[new]
            flag = np.zeros(len(row), bool)
        for i in range(c):
            have = pool[i] >= 0
            out.append((every[pool[i][have]], parts[pool[i][have]], sims[i][have], done[i][have], int(scored[i])))
    return out


def kept_best(pool: np.ndarray, sims: np.ndarray, done: np.ndarray, row: np.ndarray, node: np.ndarray, sim: np.ndarray, flag: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The beams with (row, node) pairs added, closest first."""
    order = np.argsort(row, kind="stable")
    row, node, sim, flag = row[order], node[order], sim[order], flag[order]
    place = rank(row)
    wide = int(place.max()) + 1 if len(place) else 0
    c = len(pool)
    more, more_sims, more_done = np.full((c, wide), -1, dtype=np.int64), np.full((c, wide), LOW, dtype=np.float32), np.ones((c, wide), dtype=bool)
    more[row, place], more_sims[row, place], more_done[row, place] = node, sim, flag
    pool, sims, done = np.concatenate([pool, more], axis=1), np.concatenate([sims, more_sims], axis=1), np.concatenate([done, more_done], axis=1)
    at = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
    return tuple(np.take_along_axis(y, at, 1) for y in (pool, sims, done))
