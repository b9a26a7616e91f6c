"""Benchmark decontamination by the q-gram lemma.

Texts are compared as lower-case letters and digits with single spaces between words, by
their true code points. Every stretch of ``SEGMENT`` characters of a benchmark item that
begins at a multiple of ``STRIDE`` (and its last one) is a segment. One of m characters that
occurs in a document with at most e = floor(rate * m) edits shares at least
m - q + 1 - q * e of its q-grams with it, all within e + 1 neighbouring diagonals. Shared
q-grams of item and text are counted in diagonal bands twice as wide that overlap by half;
where a segment reaches the bound in a band, banded alignment verifies it, never across the
end of a text. So each ``SEGMENT + STRIDE - 1`` characters of an item that stand verbatim in
a document are found. Every q-gram of every whole text is looked up.

An item of fewer than ``SHORT`` characters must occur verbatim as whole words; one of fewer
than q characters has no q-gram and matches texts that consist of it.

The benchmark is broadcast in blocks of a bounded number of characters (a longer item is
spread over blocks). With more than one block, a single pass with a bit filter over the
q-grams of the whole benchmark (itself in parts of a bounded size) leaves the texts that can
reach a bound at all; these are checkpointed, and only they meet the blocks.

A text that shares many q-grams with the benchmark, as a long one that repeats a passage of it,
is worked through in slices of a bounded number of them, which overlap by a segment; what a
further match can't change is not looked at again.

Cases: null and empty texts match nothing, and so do items without letters or digits; an empty
table of documents or of items gives no row; texts of any length are searched whole, one at a
time beyond a megabyte; items may repeat (equal rows count once), and a null item id is reported as such; different texts
under one id are reported each; every row of documents reports its own matches, also where ids or texts
repeat; extra columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import checkpoint, column, steps, texts
from .features import ASSIGNED, CODES, DIGIT, MARK, SPACE, classes, code_points

Q, RATE, SEGMENT, STRIDE, SHORT = 10, 0.08, 72, 8, 40
#: Characters of a piece of an item, of a block of pieces, and of the benchmark that one filter covers.
PIECE, BLOCK_CHARS, FILTER_CHARS = 8192, 4_000_000, 64_000_000
#: Bits of the filter for each q-gram, and of the table that a block is first looked up in.
GRAM_BITS, LOOK_BITS = 16, 24
#: Alignments, hits, shared q-grams of texts and pieces, and UTF-8 bytes at a time.
ALIGN, HITS, ENTRIES, STEP = 2048, 1 << 16, 1 << 18, 1 << 20
#: Hashes of so many texts with leaks are broadcast to the documents; more are joined by a shuffle.
MOST_BROADCAST = 200_000
FAR = 1 << 20
#: Added to diagonals, so that none is negative.
SHIFT = 65_536


@lru_cache
def folding() -> np.ndarray:
    """Each code point in lower case if that is one character; 32 for all but letters, marks of letters and digits."""
    kinds = classes()
    table = np.arange(CODES, dtype=np.uint32)
    table[(kinds & (MARK | SPACE) > 0) & (kinds & DIGIT == 0)] = 32
    for some in ASSIGNED:
        for c in some:
            if table[c] != 32:
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
    return table


def normalised(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised characters of all texts, each text after one gap (0); where each stands in its own text; the starts (of what follows the gaps), then the end."""
    codes, starts = code_points(batch)
    low = folding()[codes]
    low[starts[1:] - 1] = 0
    own = np.arange(len(low)) - np.repeat(starts[:-1], np.diff(starts))
    keep = (low != 32) | np.concatenate([[True], low[:-1] > 32])
    keep &= ~((low == 32) & (own == 0))
    low, own, kept = low[keep], own[keep], np.cumsum(keep)
    ends = kept[starts[1:] - 1]
    return low, own, np.concatenate([[0], ends])


def gram_hashes(low: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q-gram at each place where one fits; by doubling."""
    base = 0x100000001B3
    h = low.astype(np.uint64) + np.uint64(1)
    done, wide = np.zeros(len(h), dtype=np.uint64), 0
    size, factor = 1, base
    while True:
        if q & size:
            n = len(h) - wide if wide else len(h)
            part = h[wide : wide + n]
            m = min(len(done), len(part))
            done = done[:m] * np.uint64(factor & (1 << 64) - 1) + part[:m] if wide else h.copy()
            wide += size
        if wide >= q:
            break
        m = len(h) - size
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        h = h[:m] * np.uint64(factor & (1 << 64) - 1) + h[size : size + m]
        size, factor = size * 2, factor * factor
    return (done ^ done >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Limits:
    """What a match asks for: the length of q-grams and the share of edits."""

    q: int = Q
    rate: float = RATE

    def edits(self, size: np.ndarray) -> np.ndarray:
        """Of a segment of so many characters; none where a whole item is short."""
        size = np.asarray(size, dtype=np.int64)
        return np.where(size < SHORT, 0, np.floor(self.rate * size + 1e-9)).astype(np.int64)

    def bound(self, size: np.ndarray) -> np.ndarray:
        """The q-grams that a segment of so many characters must share."""
        size = np.asarray(size, dtype=np.int64)
        return np.maximum(size - self.q + 1 - self.q * self.edits(size), 1)


@dataclass
class Index:
    """A block of the benchmark: its pieces, their segments, and the places of their q-grams."""

    limits: Limits
    items: tuple[pa.Array, pa.Array]
    item: np.ndarray
    chars: np.ndarray
    first: np.ndarray
    segments: np.ndarray
    gram: np.ndarray
    at: np.ndarray
    entry: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    tiny: dict[bytes, list[int]]

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.first)

    def starts(self, segment: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Where segments begin in their pieces: at the strides, the last one at the end."""
        return np.minimum((segment - self.segments[entry]) * STRIDE, np.maximum(self.size[entry] - SEGMENT, 0))


def pieces_of(text: str) -> list[np.ndarray]:
    """The normalised characters of an item, in pieces that overlap so far that each segment is in one."""
    low = normalised([text])[0][:-1]
    low = low[:-1] if len(low) and low[-1] == 32 else low
    if not len(low):
        return []
    whole = max(len(low) - SEGMENT, 0) // STRIDE * STRIDE  # no later piece holds a segment
    return [low[min(a, whole) :][:PIECE] for a in range(0, max(len(low) - (SEGMENT - STRIDE), 1), PIECE - (SEGMENT - STRIDE))]


def index_of(ids: pa.Array, origins: list[str], chars: list[np.ndarray], limits: Limits) -> Index:
    """The index of pieces, each with the id of its item and what tells the item's text from others."""
    known: dict[tuple, int] = {}
    number = np.array([known.setdefault(x, len(known)) for x in zip(ids.to_pylist(), origins, strict=True)], dtype=np.int64)
    items = pa.array([i for i, _ in known], ids.type), pa.array([o for _, o in known], pa.string())
    tiny: dict[bytes, list[int]] = defaultdict(list)
    for k, c in zip(number, chars, strict=True):
        if len(c) < limits.q:
            tiny[c.astype("<u4").tobytes()].append(int(k))
    long = [i for i, c in enumerate(chars) if len(c) >= limits.q]
    chars = [chars[i] for i in long]
    size = np.array([len(c) for c in chars], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    grams = np.concatenate([np.zeros(0, np.uint64), *(gram_hashes(c, limits.q) for c in chars)])
    n = np.maximum(size - limits.q + 1, 0)
    entry = np.repeat(np.arange(len(chars), dtype=np.int32), n)
    place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    order = np.argsort(grams, kind="stable")
    gram, at = np.unique(grams[order], return_index=True)
    seen = np.zeros(1 << LOOK_BITS, dtype=bool)
    seen[(gram >> np.uint64(64 - LOOK_BITS)).astype(np.int64)] = True
    count = -(-np.maximum(size - SEGMENT, 0) // STRIDE) + 1
    flat = np.concatenate([np.zeros(0, np.uint32), *chars])
    return Index(limits, items, number[long], flat, first, np.concatenate([[0], np.cumsum(count)]), gram, np.append(at, len(grams)), entry[order], place[order], seen, dict(tiny))


def align(low: np.ndarray, begins: np.ndarray, widths: int, patterns: np.ndarray, only: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern (a row) the fewest edits to any stretch of ``low`` whose diagonals lie in [begin, begin + widths), and where that stretch ends; ``only``: the one diagonal it begins on. No stretch holds a gap (0)."""
    n, size = patterns.shape
    at = begins[:, None] + np.arange(widths)
    last = len(low) - 1
    before = np.full((n, widths), 0 if only is None else FAR, dtype=np.int32)
    if only is not None:
        before[:, only] = 0
    for i in range(size):
        place = at + i
        ch = low[np.clip(place, 0, last)]
        gap = ((place < 0) | (place > last) | (ch == 0)) * np.int32(FAR)
        d = before + np.maximum(ch != patterns[:, i : i + 1], gap)
        # dropping a pattern character keeps the place and moves one diagonal down
        np.minimum(d[:, :-1], before[:, 1:] + 1, out=d[:, :-1])
        # passing over a character of the text moves one diagonal up
        cost = np.cumsum(np.maximum(gap, 1), axis=1) - np.maximum(gap[:, :1], 1)
        before = np.minimum.accumulate(d - cost, axis=1) + cost
        np.minimum(before, FAR, out=before)
    best = before.argmin(axis=1)
    return before[np.arange(n), best], begins + best + size


def known_grams(h: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(place in the text, number in the index) of the q-grams of a text that the index has."""
    maybe = np.flatnonzero(index.seen[(h >> np.uint64(64 - LOOK_BITS)).astype(np.int64)])
    if not len(maybe) or not len(index.gram):
        return (np.zeros(0, np.int64),) * 2
    slot = np.searchsorted(index.gram, h[maybe])
    slot[slot == len(index.gram)] = 0
    real = index.gram[slot] == h[maybe]
    return maybe[real], slot[real]


def slices_of(place: np.ndarray, slot: np.ndarray, starts: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """The places of known q-grams as ranges (first, end) that share about ``ENTRIES`` q-grams with the index, each reaching so far into the next one that a segment's q-grams lie in one of them. A text of several has its first and its last one looked at first."""
    before = np.concatenate([[0], np.cumsum(index.at[slot + 1] - index.at[slot])])
    if before[-1] <= ENTRIES:
        return [(0, len(place))] if len(place) else []
    cuts = np.searchsorted(before, np.arange(0, before[-1], ENTRIES), side="right") - 1
    texts_at = np.searchsorted(place, starts)
    long = np.flatnonzero(before[texts_at[1:]] - before[texts_at[:-1]] > ENTRIES)
    cuts = np.unique(np.concatenate([cuts, texts_at[long], texts_at[long + 1]]))
    cuts = cuts[cuts < len(place)]
    over = SEGMENT + 2 * (int(index.limits.edits(SEGMENT)) + 1)
    ends = np.append(np.searchsorted(place, place[cuts[1:]] + over), len(place))
    of = np.searchsorted(texts_at, cuts, side="right")
    first = np.concatenate([[True], of[1:] != of[:-1]])
    last = np.concatenate([of[1:] != of[:-1], [True]])
    order = np.lexsort([~(first | last), of])
    return [(int(cuts[k]), int(ends[k])) for k in order]


def shared_grams(place: np.ndarray, slot: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in the text, piece, place in the piece) of known q-grams; all of a piece at a time, few pieces where there are many."""
    times = index.at[slot + 1] - index.at[slot]
    total = int(times.sum())
    parts = max(1, min(-(-total // (4 * ENTRIES)), len(index.first) - 1))
    edges = np.linspace(0, len(index.first) - 1, parts + 1).astype(np.int64)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        begin, count = index.at[slot], times
        if parts > 1:  # a q-gram's entries stand in order of their pieces
            begin, count = entries_of(index, slot, low, high)
        row = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield np.repeat(place, count), index.entry[row].astype(np.int64), index.place[row].astype(np.int64)


def entries_of(index: Index, slot: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, how many) of the entries of q-grams that are in pieces from low to high."""
    each, back = np.unique(slot, return_inverse=True)
    own = [index.entry[index.at[k] : index.at[k + 1]] for k in each.tolist()]
    begin = np.array([index.at[k] + np.searchsorted(x, low) for k, x in zip(each.tolist(), own, strict=True)], dtype=np.int64)
    end = np.array([index.at[k] + np.searchsorted(x, high) for k, x in zip(each.tolist(), own, strict=True)], dtype=np.int64)
    return begin[back], (end - begin)[back]


def candidates(place: np.ndarray, entry: np.ndarray, own: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, its piece, band): where a segment shares as many q-grams with a diagonal band as the lemma asks for."""
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, none
    limits, size = index.limits, np.minimum(index.size, SEGMENT)
    wide = limits.edits(size) + 1
    band = (place - own + SHIFT) // wide[entry]
    entry, own, band = np.tile(entry, 2), np.tile(own, 2), np.concatenate([band, band - 1])
    order = np.lexsort([own, band, entry])
    entry, own, band = entry[order], own[order], band[order]
    fresh = np.concatenate([[True], (entry[1:] != entry[:-1]) | (band[1:] != band[:-1]) | (own[1:] != own[:-1])])
    entry, own, band = entry[fresh], own[fresh], band[fresh]
    group = np.cumsum(np.concatenate([[False], (entry[1:] != entry[:-1]) | (band[1:] != band[:-1])]))
    key = group * (2 * PIECE) + own
    bound, reach = limits.bound(size), size - limits.q
    # a hit counts if the bound-th from it on lies within one segment's reach
    end = np.arange(len(key)) + bound[entry] - 1
    dense = np.flatnonzero((end < len(key)) & (key[np.minimum(end, len(key) - 1)] - key <= reach[entry]))
    out: list[list[np.ndarray]] = [[none], [none], [none]]
    lead = np.arange(-(-SEGMENT // STRIDE) + 1)
    for a in range(0, len(dense), HITS):
        some = dense[a : a + HITS]
        e, p = entry[some], own[some]
        last = index.segments[e + 1] - index.segments[e] - 1
        t = np.concatenate([p[:, None] // STRIDE - lead, last[:, None]], axis=1)
        s = np.minimum(t * STRIDE, (index.size[e] - size[e])[:, None])
        good = (t >= 0) & (t <= last[:, None]) & (s <= p[:, None]) & (p[:, None] - s <= reach[e][:, None])
        row, col = np.nonzero(good)
        found = np.unique(group[some][row] * (2 * PIECE) + t[row, col])
        g, t = found // (2 * PIECE), found % (2 * PIECE)
        head = np.searchsorted(group, g)
        e = entry[head]
        segment = index.segments[e] + t
        s = g * (2 * PIECE) + index.starts(segment, e)
        count = np.searchsorted(key, s + reach[e], side="right") - np.searchsorted(key, s)
        full = count >= bound[e]
        for x, y in zip(out, (segment[full], e[full], band[head][full]), strict=True):
            x.append(y)
    segment, entry, band = (np.concatenate(x) for x in out)
    _, once = np.unique(segment * (1 << 40) + band + 1, return_index=True)
    return segment[once], entry[once], band[once]


def matches(batch: list[str], index: Index) -> tuple[np.ndarray, ...]:
    """Of each match of a segment: the text's number, the item's number, the segment (-1 for a tiny item), the edits, and the start and end in the text."""
    low, own, starts = normalised(batch)
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]

    def add(*columns: np.ndarray) -> None:
        for x, y in zip(found, columns, strict=True):
            x.append(np.asarray(y, dtype=np.int64))

    if index.tiny:
        for i in np.flatnonzero(np.diff(starts) <= index.limits.q + 1):
            text = low[starts[i] : starts[i + 1] - 1]
            text = text[:-1] if len(text) and text[-1] == 32 else text
            for k in index.tiny.get(text.tobytes(), ()):
                add([i], [k], [-1], [0], [own[starts[i]]], [own[starts[i] + len(text) - 1] + 1])
    told, back, sizes = Told(index, len(batch)), low[::-1], np.minimum(index.size, SEGMENT)
    places, slots = known_grams(gram_hashes(low, index.limits.q), index)
    for first, end in slices_of(places, slots, starts, index):
        if told.all_known(places[first:end], slots[first:end], starts):
            continue
        for shared in shared_grams(places[first:end], slots[first:end], index):
            segment, entry, band = candidates(*shared, index)
            for size in np.unique(sizes[entry]):
                mine = np.flatnonzero(sizes[entry] == size)
                e = int(index.limits.edits(size))
                for some in np.array_split(mine, -(-len(mine) // ALIGN)):
                    seg, piece = segment[some], entry[some]
                    # diagonals count from the piece's first character; the segment begins later
                    begins = band[some] * (e + 1) - SHIFT - e + index.starts(seg, piece)
                    wide = 2 * (e + 1) + 2 * e
                    new = ~told.known(seg, index.item[piece], begins, begins + wide + size, starts)
                    seg, piece, begins = seg[new], piece[new], begins[new]
                    if not len(seg):
                        continue
                    at = index.first[piece] + index.starts(seg, piece)
                    patterns = index.chars[at[:, None] + np.arange(size)]
                    edits, ends = align(low, begins, wide, patterns)
                    good = edits <= e
                    if not good.any():
                        continue
                    edits, ends, seg, piece, patterns = edits[good], ends[good], seg[good], piece[good], patterns[good]
                    # backwards from the end: the other end of the stretch
                    _, heads = align(back, len(low) - ends - e, 2 * e + 1, patterns[:, ::-1], e)
                    text = np.searchsorted(starts, ends - 1, side="right") - 1
                    heads = np.maximum(len(low) - heads, starts[text])
                    if size < SHORT:  # whole words only
                        word = ((heads == starts[text]) | (low[heads - 1] <= 32)) & (low[ends] <= 32)
                        text, seg, piece, edits, heads, ends = (x[word] for x in (text, seg, piece, edits, heads, ends))
                    told.add(text, index.item[piece], seg, edits, heads, ends)
                    add(text, index.item[piece], seg, edits, own[heads], own[ends - 1] + 1)
    return tuple(np.concatenate(x) for x in found)


class Told:
    """What is known of a batch's texts so far: the segments found in each, and of each item the stretch from the first to the last match and the fewest edits. A further match of a segment that was found, without an edit somewhere, within that stretch, changes nothing."""

    def __init__(self, index: Index, n: int):
        self.index, self.segments = index, np.zeros(0, np.int64)
        self.items = len(index.items[0])
        self.key, self.start, self.end, self.edits = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, text: np.ndarray, item: np.ndarray, segment: np.ndarray, edits: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if not len(text):
            return
        self.segments = np.union1d(self.segments, text * (self.index.segments[-1] + 1) + segment)
        key = np.concatenate([self.key, text * self.items + item])
        order = np.argsort(key, kind="stable")
        self.key, cut = np.unique(key[order], return_index=True)
        joined = lambda f, old, new: f.reduceat(np.concatenate([old, new])[order], cut)
        self.start, self.end, self.edits = joined(np.minimum, self.start, start), joined(np.maximum, self.end, end), joined(np.minimum, self.edits, edits)

    def known(self, segment: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which matches of segments, somewhere from start to end, would change nothing."""
        if not len(self.key):
            return np.zeros(len(segment), dtype=bool)
        text = np.searchsorted(starts, np.clip(start, 0, starts[-1] - 1), side="right") - 1
        at = np.minimum(np.searchsorted(self.key, text * self.items + item), len(self.key) - 1)
        same = (self.key[at] == text * self.items + item) & (self.edits[at] == 0) & (self.start[at] <= start) & (self.end[at] >= end)
        return same & np.isin(text * (self.index.segments[-1] + 1) + segment, self.segments)

    def all_known(self, place: np.ndarray, slot: np.ndarray, starts: np.ndarray) -> bool:
        """No match of a segment with these q-grams would change anything."""
        if not len(self.key):
            return False
        index, far = self.index, 2 * SEGMENT
        rows = np.unique(slot)
        pieces = np.unique(np.concatenate([index.entry[index.at[k] : index.at[k + 1]] for k in rows.tolist()])) if len(rows) <= HITS else np.arange(len(index.first) - 1)
        segment = np.concatenate([np.arange(index.segments[k], index.segments[k + 1]) for k in pieces.tolist()])
        item = np.repeat(index.item[pieces], index.segments[pieces + 1] - index.segments[pieces])
        one = np.ones(len(segment), np.int64)
        return bool(self.known(segment, item, one * (place[0] - far), one * (place[-1] + far), starts).all())


def benchmark_pieces(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item, origin, chars, size): the pieces of all distinct items; the origin tells the texts of an id apart."""
    kind = benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item"), F.sha2(item_text, 256).alias("origin"), F.col(item_text).alias("text")).where("text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            found = [pieces_of(t) for t in texts(b, "text")]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found]))
            every = [p for x in found for p in x]
            yield pa.RecordBatch.from_arrays([column(b, "item").take(at), column(b, "origin").take(at), pa.array([p.astype("<u4").tobytes() for p in every], pa.binary()), pa.array([len(p) for p in every], pa.int64())], names=["item", "origin", "chars", "size"])

    return items.mapInArrow(run, f"item {kind}, origin string, chars binary, size bigint")


def blocks_of(pieces: DataFrame, limits: Limits, most: int) -> Iterator[Index]:
    """The pieces as indexes of about ``most`` characters each; no pieces, no index."""
    blocks = -(-characters(pieces) // most)
    for k in range(blocks):
        table = pieces.where(F.pmod(F.xxhash64("item", "chars"), F.lit(blocks)) == k).orderBy("origin", "item", "chars").toArrow()
        yield index_of(table["item"].combine_chunks(), table["origin"].to_pylist(), [np.frombuffer(x, "<u4") for x in table["chars"].to_pylist()], limits)


def characters(pieces: DataFrame) -> int:
    return pieces.agg(F.sum("size")).first()[0] or 0


def filters_of(pieces: DataFrame, limits: Limits) -> Iterator[tuple[np.ndarray, int]]:
    """(bits, fewest q-grams of a segment) of filters that together cover all q-grams of the pieces; two bits for each q-gram."""
    total = characters(pieces)
    parts = -(-total // FILTER_CHARS)
    for k in range(parts):
        bits = max(10, int(np.ceil(np.log2(max(total // parts, 1) * GRAM_BITS))))
        table, least = np.zeros(1 << bits - 3, dtype=np.uint8), FAR
        for r in pieces.where(F.pmod(F.xxhash64("chars"), F.lit(parts)) == k).select("chars").toLocalIterator():
            low = np.frombuffer(r[0], "<u4")
            least = min(least, int(limits.bound(min(len(low), SEGMENT))))
            for x in two_bits(gram_hashes(low, limits.q), bits):
                np.bitwise_or.at(table, x >> 3, np.left_shift(1, x & 7).astype(np.uint8))
        yield table, least


def two_bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)


def may_match(batch: list[str], table: np.ndarray, least: int, limits: Limits) -> np.ndarray:
    """Which texts hold so many q-grams of the filter within the reach of one segment and its edits."""
    low, _, starts = normalised(batch)
    h = gram_hashes(low, limits.q)
    hit = np.ones(len(h), dtype=bool)
    for x in two_bits(h, len(table).bit_length() + 2):
        hit &= (table[x >> 3] >> (x & 7) & 1).astype(bool)
    at = np.flatnonzero(hit)
    reach = SEGMENT - limits.q + int(limits.edits(SEGMENT))
    end = np.arange(len(at)) + least - 1
    dense = at[(end < len(at)) & (at[np.minimum(end, len(at) - 1)] - at <= reach)] if len(at) else at
    out = np.zeros(len(batch), dtype=bool)
    out[np.searchsorted(starts, dense, side="right") - 1] = True
    return out


def screened(rows: DataFrame, pieces: DataFrame, limits: Limits) -> DataFrame:
    """The rows (with a ``text``) whose text passes a filter of the benchmark: one pass for each filter, a row once."""
    shared = [rows.sparkSession.sparkContext.broadcast(x) for x in filters_of(pieces, limits)]
    out = rows.withColumn("_screen", F.lit(False))
    for table in shared:

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for b in steps(batches, "text", STEP):
                known = column(b, "_screen").to_numpy(zero_copy_only=False)
                at = b.schema.get_field_index("_screen")
                yield b.set_column(at, "_screen", pa.array(known | may_match(texts(b, "text"), *table.value, limits)))

        out = out.mapInArrow(run, out.schema)
    return out.where("_screen").drop("_screen")


def report(rows: DataFrame, index: Broadcast, schema: str) -> DataFrame:
    """(row, id, item_id, origin, start, end, edits, segments) of each row (row, id, text) and each item that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP):
            found = np.stack(matches(texts(b, "text"), index.value))
            text, item, segment, edits, start, end = found[:, np.lexsort(found[2::-1])]
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
            fresh = new.copy()
            fresh[1:] |= segment[1:] != segment[:-1]
            cut = np.flatnonzero(new)
            pick = lambda f, x: f.reduceat(x, cut) if len(cut) else x
            which, items = pa.array(text[cut]), pa.array(item[cut])
            figures = pick(np.minimum, start), pick(np.maximum, end), pick(np.minimum, edits), pick(np.add, fresh.astype(np.int64))
            yield pa.RecordBatch.from_arrays([column(b, "row").take(which), column(b, "id").take(which), *(x.take(items) for x in index.value.items), *map(pa.array, figures)], names=["row", "id", "item_id", "origin", "start", "end", "edits", "segments"])

    return rows.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int | None = None) -> DataFrame:
    """(id, item_id, start, end, edits, segments): of each row and item that match, the stretch of the text from the first to the last match, the fewest edits of a segment, and how many segments match. ``most``: characters of a block."""
    limits, most, spark = Limits(q, rate), most or BLOCK_CHARS, docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"row bigint, id {kinds[0]}, item_id {kinds[1]}, origin string, start bigint, `end` bigint, edits bigint, segments bigint"
    pieces = checkpoint(benchmark_pieces(benchmark, item_col, item_text))

    def scan(some: DataFrame, several: Iterator[Index]) -> list[DataFrame]:
        return [report(some, spark.sparkContext.broadcast(index), schema) for index in several]

    if characters(pieces) <= most:
        found = scan(rows, blocks_of(pieces, limits, most))
    else:  # what is shorter than a segment is in one block; the others may be spread over several
        long = pieces.where(F.col("size") >= SEGMENT)
        spread = union(scan(checkpoint(screened(rows, long, limits)), blocks_of(long, limits, most)), spark, schema)
        joined = spread.groupBy("row", "id", "item_id", "origin").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"), F.sum("segments").alias("segments"))
        found = [joined, *scan(rows, blocks_of(pieces.where(F.col("size") < SEGMENT), limits, most))]
    return union(found, spark, schema).drop("row", "origin").withColumnRenamed("id", id_col)


def union(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, keep: list[str], q: int = Q, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int | None = None) -> DataFrame:
    """The ``keep`` columns (the text among them) of the documents without any match. With a single block each batch is filtered where it is read; with several, texts that match are told by their SHA-256."""
    limits, most = Limits(q, rate), most or BLOCK_CHARS
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    pieces = checkpoint(benchmark_pieces(benchmark, item_col, item_text))
    if characters(pieces) > most:
        digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
        named = docs.select(digest(F.col(f"`{text_col}`")).alias("_id"), F.col(f"`{text_col}`").alias("text"))
        leaks = checkpoint(contaminated(named, benchmark, q, rate, "_id", "text", item_col, item_text, most).select(F.col("_id").alias("_leak")).distinct())
        gone = F.broadcast(leaks) if leaks.count() <= MOST_BROADCAST else leaks
        return rows.join(gone, digest(F.col(f"`{text_col}`")) == F.col("_leak"), "left_anti")
    for index in blocks_of(pieces, limits, most):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in steps(batches, text_col, STEP):
                stays = np.ones(b.num_rows, dtype=bool)
                stays[matches(texts(b, text_col), shared.value)[0]] = False
                yield b.filter(pa.array(stays))

        rows = rows.mapInArrow(run, rows.schema)
    return rows
