"""URL filter: rules on host and path first, logistic regression on hashed n-grams for the rest.

The labelled table that stands in for a given one is made from words by one rule for both
classes, so that the model learns the words' n-grams and no form of host or path.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed (score 0); of the rules that fit, the longest wins, and of equally long ones that
with the longer host; repeated rows are judged alike; an empty table gives an empty result;
a control character in a url is a character like any other, and urls are scored whole,
however long. The rules and the labelled table are bounded by ``MOST_RULES`` and
``MOST_LABELLED`` rows (ValueError beyond).
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import column, steps, texts
from .features import code_points, sums

BITS, SIZES, MOST_RULES, MOST_LABELLED = 16, (3, 4, 5), 100_000, 100_000
#: Rows of the labelled table that have names only; weight of the rows to block beside the others.
NAMES, BALANCE = 2000, 0.5
# Words of hosts and paths to block, words of those to keep, and sounds of names that say nothing.
BLOCKED_WORDS = "ads adserver adult banner bet bets betting bingo bonus casino cheap clickbait coupon dating escort gamble jackpot loan loans lottery nude payday pills poker popup porn promo roulette sex sexy slots spam spin tracker viagra wager warez win winner xxx".split()
KEPT_WORDS = "about archive art article blog book books church city college culture docs edu family forum garden guide health help history home house journal law library magazine map museum music news notes open paper park people photos press recipe research river royal school science shop sports stories support teach theatre travel university village weather wiki".split()
SOUNDS = "b c d f g h k l m n p r s t v w ch sh th st tr br gr".split()
#: Both classes have these forms in the same shares: {0} and {1} are words of the class or names, {2} a number.
HOSTS = ("{0}.example.com", "www.{0}.example.net", "{0}-{1}.example.org", "m.{0}.example.com", "blog.{0}{1}.test", "{1}.{0}.example", "{0}{2}.test", "the{0}{1}.example")
PATHS = ("/", "/en/{2}", "/de/{2}.html", "/{1}/{2}", "/fr/{1}-{2}", "/p/{2}/{1}.php", "", "/es/{2}/")


def names(n: int) -> list[str]:
    """Names put together from sounds, the same ones each time."""
    drawn = random.Random(1)
    return ["".join(drawn.choice(SOUNDS) + drawn.choice("aeiou") + drawn.choice(("", "", "n", "r", "s", "l")) for _ in range(drawn.randint(2, 3))) for _ in range(n)]


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): each word in each host form, beside another word or a name; then names alone, which are kept."""
    rows = []
    other = names(2 * NAMES)
    for words, y in ((BLOCKED_WORDS, 1), (KEPT_WORDS, 0)):
        for i, w in enumerate(words):
            for j, h in enumerate(HOSTS):
                beside = words[(i * 3 + j + 1) % len(words)] if (i + j) % 2 else other[(i * len(HOSTS) + j) % len(other)]
                # a word stands first or second alike
                one, two = (w, beside) if j % 3 else (beside, w)
                path = PATHS[(i + j) % len(PATHS)].format("", w, 1000 * j + i)
                rows.append((h.format(one, two, (31 * i + j) % 400), path, y))
    for i, w in enumerate(other[:NAMES]):
        rows.append((HOSTS[i % len(HOSTS)].format(w, other[-1 - i], i % 400), PATHS[i // 8 % len(PATHS)].format("", other[(i + 400) % len(other)], 7 * i), 0))
    return rows


def host_of(url: Column) -> Column:
    """After the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), "^[^/?#]*", 0), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def buckets(hosts: Sequence[str], paths: Sequence[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of ``^host$`` and, apart from them, of the path; the starts of each row."""
    parts = [x for h, p in zip(hosts, paths, strict=True) for x in (f"^{h}$", p)]
    codes, cuts = code_points(parts)
    width = np.diff(cuts)
    side = np.repeat(np.arange(len(parts)) % 2, width).astype(np.uint64)
    left = np.repeat(cuts[1:] - 1, width) - np.arange(len(codes))  # characters of the own part from here on
    found = []
    for n in SIZES:
        h = side * np.uint64(0x51ED270B)
        for k in range(n):
            m = len(codes) - k
            h[:m] = h[:m] * np.uint64(0x100000001B3) + codes[k:]
        h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append(np.where(left < n, 1 << bits, (h >> np.uint64(64 - bits)).astype(np.int64)))
    return np.stack(found), cuts[::2] if len(parts) else cuts


def fit(rows: Sequence[tuple[str, str, int]], bits: int = BITS, rounds: int = 300, rate: float = 1.0, ridge: float = 0.1, balance: float = BALANCE) -> np.ndarray:
    """Weights of the buckets, then 0 for none, then the intercept; by gradient steps scaled with each bucket's frequency. The rows to block count ``balance`` times as much in all as the others."""
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"{len(rows)} labelled rows; at most {MOST_LABELLED} are allowed")
    w = np.zeros((1 << bits) + 2)
    if not rows:
        return w
    hosts, paths, y = zip(*rows, strict=True)
    b, starts = buckets(hosts, paths, bits)
    y, own = np.array(y, dtype=float), np.repeat(np.arange(len(rows)), np.diff(starts))
    size = np.maximum(sums((b < 1 << bits).sum(0), starts), 1)
    seen = np.zeros_like(w)
    share = np.where(y > 0, balance * (y == 0).sum() / max(y.sum(), 1), 1.0) if 0 < y.sum() < len(y) else np.ones(len(y))
    for _ in range(rounds):
        off = share * (y - 1 / (1 + np.exp(-margin(w, b, starts, size))))
        grad = np.zeros_like(w)
        for row in b:
            grad[:-1] += np.bincount(row, (off / np.sqrt(size))[own], len(w) - 1)
        grad[-2], grad[-1] = 0, off.sum()
        grad -= ridge * w
        seen += grad**2
        w += rate * grad / np.sqrt(seen + 1e-12) * 0.1
    return w


def margin(w: np.ndarray, b: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    return sums(w[b].sum(0), starts) / np.sqrt(size) + w[-1]


def score(w: np.ndarray, hosts: Sequence[str], paths: Sequence[str], bits: int = BITS) -> np.ndarray:
    """Probability of a page to block; 0 for an empty host."""
    if not len(hosts):
        return np.zeros(0)
    b, starts = buckets(hosts, paths, bits)
    size = np.maximum(sums((b < 1 << bits).sum(0), starts), 1)
    return np.where([bool(h) for h in hosts], 1 / (1 + np.exp(-margin(w, b, starts, size))), 0.0)


def index_of(rules: Sequence[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Host to its (path, verdict), the longest path first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are allowed")
    found: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        found.setdefault(host.lower(), []).append((path, verdict))
    return {h: sorted(x, key=lambda pv: -len(pv[0])) for h, x in found.items()}


def rule_of(host: str, path: str, index: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule of this host or of a domain above it, and its verdict."""
    best: tuple[int, int, str | None, str | None] = (-1, -1, None, None)
    at = 0
    while at >= 0 and host:
        domain = host[at:]
        for p, verdict in index.get(domain, ()):
            if path.startswith(p):
                best = max(best, (len(domain) + len(p), len(domain), domain + p, verdict), key=lambda x: x[:2])
                break
        at = host.find(".", at) + 1 or -1
    return best[2], best[3]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], rows: Sequence[tuple[str, str, int]] | None = None, id_col: str = "page_id", url_col: str = "url", most: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score): the rule's verdict, else block where the score exceeds ``most``."""
    shared = pages.sparkSession.sparkContext.broadcast((index_of(rules), fit(labelled() if rows is None else rows)))
    url = F.col(url_col)
    cut = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, w = shared.value
        for b in steps(batches, "path", 1 << 20):
            hosts, paths = texts(b, "host"), texts(b, "path")
            p = score(w, hosts, paths)
            found = [rule_of(h, x, index) for h, x in zip(hosts, paths, strict=True)]
            verdicts = [v or ("block" if s > most else "allow") for (_, v), s in zip(found, p, strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "host"), column(b, "path"), pa.array([r for r, _ in found], pa.string()), pa.array(verdicts, pa.string()), pa.array(p)], names=["id", "host", "path", "rule", "verdict", "score"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = cut.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, score double")
    return out.withColumnRenamed("id", id_col)
