"""Periodic runs of words by maximal pairs.

A pair of equal stretches of l words, p apart, is maximal if the words before them
differ and the words behind them differ.  Together the two cover l + p words with
period p that no neighbour extends: maximal pairs with l + p >= max(6, 4 p) are
exactly the runs, and where the same words have several such periods the smallest
counts.

Maximal pairs come from the LCP-interval tree of a text's suffixes, bottom up: each
interval keeps its positions in lists by the word to their left, joining the smaller
list into the larger; positions of different children and different left words are
a maximal pair of the interval's length.  The condition bounds the distance by a third
of that length, so only positions that near are looked up.  It also needs five
equal words or more: only suffixes whose first five words come again in their text
are sorted, the rest (nearly all, in prose) are told apart by hashes of five words
over a whole piece of texts at once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import U64, blob, mix, pieces, range_hash, running_sum, word_ranges

MIN_WORDS = 6   # least length of a run
MIN_POWER = 4   # least number of periods in a run
SEED = 5        # equal words that a run's maximal pair has at least: max(6, 4 p) - p


def repeated_seeds(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows in which some ``SEED`` words in a row come twice (by hash: hardly any more)."""
    s, e, row = word_ranges(data, off)
    if len(s) < SEED:
        return np.zeros(0, np.int64)
    word = range_hash(running_sum(data), s, e)
    n = len(s) - SEED + 1
    gram = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(SEED):
            gram = mix(gram * U64(0x9E3779B97F4A7C15) + word[k:k + n])
        whole = row[:n] == row[SEED - 1:]
        key, of = mix(gram + row[:n].astype(U64) * U64(0xA0761D6478BD642F))[whole], row[:n][whole]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    return np.unique(of[order[same]])


def _smaller(*keys: np.ndarray) -> np.ndarray:
    """For each tuple (keys[0][i], keys[1][i], ...), how many are smaller."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return out


def sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lcp): suffixes whose first ``SEED`` words come again, sorted, and each one's common prefix with the next.

    Prefix doubling from the ranks of ``SEED`` words (ends of the text are their own
    words); a suffix told apart from all others is not sorted again.  Common prefixes
    are read off the ranks of each step, from the longest down.
    """
    n = len(words)
    if n <= SEED:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.append(words, np.full(SEED, -1))
    rank = _smaller(*(padded[k:k + n] for k in range(SEED)))
    often = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    steps, length, at = [np.append(rank, -1)], SEED, often
    while len(at):
        second = steps[-1][at + length]  # equal prefixes end inside the text, or at its end
        order = np.lexsort((second, rank[at]))
        group, second = rank[at][order], second[order]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        place = np.arange(len(at))
        rank = rank.copy()
        rank[at[order]] += np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(new_group, place, 0))
        steps.append(np.append(rank, -1))
        length *= 2
        alone = new & np.append(new[1:], True)
        at = at[order][~alone]
    pos = often[np.argsort(rank[often], kind="stable")]
    i, j, lcp = pos[:-1].copy(), pos[1:].copy(), np.zeros(max(0, len(pos) - 1), np.int64)
    for k in range(len(steps) - 1, -1, -1):
        same = steps[k][i] == steps[k][j]
        for x in (i, j, lcp):
            x[same] += SEED << k
    for _ in range(SEED - 1):  # the last few words, one by one
        same = padded[i] == padded[j]
        for x in (i, j, lcp):
            x[same] += 1
    return pos, np.append(lcp, 0)


class _Interval:
    """Positions of an LCP interval: all in order, and in lists by the word to their left."""

    __slots__ = ("all", "by_left")

    def __init__(self, position: int, left: int):
        self.all, self.by_left = [position], {left: [position]}


def _near(big: _Interval, position: int, left: int, reach: int, lefts: list[int]):
    """Positions of ``big`` at most ``reach`` away whose left word is another one."""
    a, b = bisect_left(big.all, position - reach), bisect_right(big.all, position + reach)
    if b - a <= len(big.by_left):
        for x in big.all[a:b]:
            if lefts[x] != left:
                yield x
        return
    for other, among in big.by_left.items():
        if other != left:
            yield from among[bisect_left(among, position - reach):bisect_right(among, position + reach)]


def maximal_pairs(words: np.ndarray):
    """(i, j, l) of every maximal pair i < j with 3 (j - i) <= l and l >= ``SEED``."""
    pos, lcp = sorted_suffixes(words)
    lefts = [-1, *words[:-1].tolist()]

    def join(a: _Interval, b: _Interval, length: int):
        big, small = (a, b) if len(a.all) >= len(b.all) else (b, a)
        reach = length // (MIN_POWER - 1)
        for left, among in small.by_left.items():
            for x in among:
                for y in _near(big, x, left, reach, lefts):
                    yield (x, y, length) if x < y else (y, x, length)
        for left, among in small.by_left.items():
            mine = big.by_left.setdefault(left, [])
            for x in among:
                insort(mine, x)
                insort(big.all, x)
        return big

    stack: list[list] = []  # open intervals: [length, positions]
    for position, follows in zip(pos.tolist(), lcp.tolist()):
        now = _Interval(position, lefts[position])
        while stack and stack[-1][0] > follows:
            length, held = stack.pop()
            now = yield from join(held, now, length)
        if follows < SEED:
            stack = []
        elif stack and stack[-1][0] == follows:
            stack[-1][1] = yield from join(stack[-1][1], now, follows)
        else:
            stack.append([follows, now])


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers, by start, then period."""
    best: dict[tuple[int, int], int] = {}
    for i, j, length in maximal_pairs(words):
        p = j - i
        if length + p >= max(MIN_WORDS, MIN_POWER * p):
            key = i, length + p
            best[key] = min(p, best.get(key, p))
    return sorted((start, length, p) for (start, length), p in best.items())


def _kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stand in no run behind its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, p in found:
        step[start + p] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    ``runs``: (start, length, period) in words, by start, then period; ``collapsed``: the
    words that no run repeats, joined by one space.  Null and empty texts have no words, no
    runs and an empty ``collapsed``; repeated rows each give a row; a null doc_id is
    kept; an empty table gives no rows; other columns are not read.  A text of any
    length is worked on whole, in memory proportional to its words.
    """
    def work(batches):
        for rb in pieces(batches):
            data, off = blob(rb.column("text"))
            some = set(repeated_seeds(data, off).tolist())
            raw, cut = data.tobytes(), off.tolist()
            n_words, found, collapsed = [], [], []
            for k in range(rb.num_rows):
                words = raw[cut[k]:cut[k + 1]].split()
                here: list[tuple[int, int, int]] = []
                if k in some:
                    number: dict[bytes, int] = {}
                    here = runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
                n_words.append(len(words))
                if here:
                    words = [w for w, keep in zip(words, _kept(len(words), here).tolist()) if keep]
                found.append([dict(zip(("start", "length", "period"), r)) for r in here])
                collapsed.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(found, RUNS), pa.array(collapsed, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, _SCHEMA)


_WORDS = r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one document of ten, words from place a on repeat the first p of them.

    h = crc32 of the decimal doc_id, g = h div 10; where h % 10 = 0 and there are n > 0 words,
    a = g % n and p = 1 + (n - a) div (3 + g % 8).  A null doc_id is left as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("h", h).withColumn("words", F.expr(f"IF(h % 10 = 0, {_WORDS}, NULL)")) \
        .withColumn("n", F.size("words")).withColumn("g", F.expr("h DIV 10")) \
        .withColumn("a", F.expr("CAST(g % n AS INT)")).withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    text = F.expr("""IF(h % 10 = 0 AND n > 0,
        concat_ws(' ', transform(words, (w, i) -> IF(i >= a, words[a + (i - a) % p], w))), text)""")
    return rows.select("doc_id", text.alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The strongest run and digests of ``periodic_runs``, one row for each of its rows."""
    strongest = F.expr("""array_sort(runs, (l, r) -> CASE
        WHEN l.length * r.period <> r.length * l.period THEN IF(l.length * r.period > r.length * l.period, -1, 1)
        WHEN l.start <> r.start THEN IF(l.start < r.start, -1, 1)
        ELSE CAST(sign(l.period - r.period) AS INT) END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", F.get(strongest, F.lit(0))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
