"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased.  A document and an item are
compared when they share seeds, runs of ``min_tile`` words.  Their tiles come from
running Karp-Rabin matching: search the longest common runs first, mark them in
both texts, never reuse a marked word, and go on with shorter runs down to
``min_tile``.  Tiles may stand in any order, so reordered passages are caught.  An
item is leaked when its tiles cover ``coverage`` of its words or more.

The benchmark is a query set: it goes out in blocks of at most ``block_words``
words (each block one broadcast of a stated size, one pass over the documents).
Documents are never shuffled.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import U64, mix, pieces

WORD = re.compile(r"[^\W_]+")
MOD = (1 << 61) - 1
ROLL = 1_000_003


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _prefix(seq: list[int]) -> list[int]:
    out = [0]
    for x in seq:
        out.append((out[-1] * ROLL + x + 1) % MOD)
    return out


def tiles(pattern: list[int], text: list[int], min_tile: int, at: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pattern start, text start, length), longest first.

    ``at``: ascending starts in the text of all runs of ``min_tile`` words that
    occur in the pattern; a match can start nowhere else (None: anywhere).
    """
    m, n = len(pattern), len(text)
    if m < min_tile or n < min_tile:
        return []
    at = list(range(n - min_tile + 1)) if at is None else at
    reach = dict.fromkeys(at, 0)  # words that can match from here on
    for t in reversed(at):
        reach[t] = reach[t + 1] + 1 if t + 1 in reach else min_tile
    lo = at[0] if at else 0
    hp, ht = _prefix(pattern), _prefix(text[lo:at[-1] + min_tile]) if at else [0]
    used_p, used_t = [False] * m, set()
    out: list[tuple[int, int, int]] = []
    size = min(m, max(min_tile, 20))
    while True:
        power = pow(ROLL, size, MOD)
        grams: dict[int, list[int]] = defaultdict(list)
        for t in at:
            if reach[t] >= size and t not in used_t and not any(x in used_t for x in range(t + 1, t + size)):
                grams[(ht[t - lo + size] - ht[t - lo] * power) % MOD].append(t)
        found, longest = [], 0
        for p in range(m - size + 1) if grams else ():
            if any(used_p[p:p + size]):
                continue
            for t in grams.get((hp[p + size] - hp[p] * power) % MOD, ()):
                if p and t and pattern[p - 1] == text[t - 1] and not used_p[p - 1] and (t - 1) not in used_t:
                    continue  # part of the match that begins one word earlier
                k = 0
                while p + k < m and t + k < n and pattern[p + k] == text[t + k] and not used_p[p + k] and (t + k) not in used_t:
                    k += 1
                if k >= size:
                    found.append((-k, p, t))
                    longest = max(longest, k)
            if longest > 2 * size:
                break
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(found)
        while found:
            k, p, t = heapq.heappop(found)
            runs = _free(k, p, t, used_p, used_t, size)
            if runs != [(k, p, t)]:  # cut short by an earlier tile: what is left waits its turn
                for r in runs:
                    heapq.heappush(found, r)
                continue
            used_p[p:p - k] = [True] * -k
            used_t.update(range(t, t - k))
            out.append((p, t, -k))
        if size == min_tile:
            return out
        size = max(min_tile, size // 2)


def _free(neg: int, p: int, t: int, used_p: list[bool], used_t: set[int], size: int) -> list[tuple[int, int, int]]:
    """The unmarked runs of ``size`` words or more inside a match, as (-length, p, t)."""
    out, run = [], 0
    for x in range(-neg + 1):
        if x < -neg and not used_p[p + x] and (t + x) not in used_t:
            run += 1
        else:
            if run >= size:
                out.append((-run, p + x - run, t + x - run))
            run = 0
    return out


class Block:
    """Items of one block, ready to be compared with any text."""

    def __init__(self, rows: list[tuple[int, str]], min_tile: int, coverage: float):
        self.min_tile, self.coverage = min_tile, coverage
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if len(ids) >= min_tile:
                self.items.append((item, ids))
        self.seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, ids) in enumerate(self.items):
            for p, h in enumerate(grams(np.array(ids, dtype=np.int64), min_tile).tolist()):
                self.seeds[h].append((k, p))
        self.known = np.sort(np.fromiter(self.seeds, dtype=U64, count=len(self.seeds)))

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text index, item index, matched words, tiles, longest tile) of the leaked items."""
        if not self.items:
            return
        get, n = self.vocabulary.get, self.min_tile
        ids, ends = [], []
        for t in texts:
            ids.extend(map(get, words(t), repeat(-1)))
            ends.append(len(ids))
        stream = np.array(ids, dtype=np.int64)
        if len(stream) < n:
            return
        known = (stream >= 0).astype(np.int64)
        whole = np.convolve(known, np.ones(n, dtype=np.int64), "valid") == n
        ends_at = np.array(ends)
        for end in ends:
            whole[max(0, end - n + 1):end] = False
        at = np.flatnonzero(whole)
        h = grams(stream, n, at)
        place = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[place] == h
        at, h = at[hit], h[hit]
        owner = np.searchsorted(ends_at, at, side="right")
        cut = np.flatnonzero(np.diff(owner)) + 1
        for pos, gram in zip(np.split(at, cut), np.split(h, cut)):
            if not len(pos):
                continue
            d = int(np.searchsorted(ends_at, pos[0], side="right"))
            start = ends[d - 1] if d else 0
            seen: dict[int, set[int]] = defaultdict(set)
            for g in set(gram.tolist()):
                for k, p in self.seeds[g]:
                    seen[k].update(range(p, p + n))
            for k, covered in seen.items():
                item = self.items[k][1]
                if len(covered) < self.coverage * len(item):  # tiles lie inside the seeds
                    continue
                own = {g for g in set(gram.tolist()) if any(x == k for x, _ in self.seeds[g])}
                where = [int(p) - start for p, g in zip(pos.tolist(), gram.tolist()) if g in own]
                found = tiles(item, ids[start:ends[d]], n, where)
                matched = sum(x[2] for x in found)
                if matched >= self.coverage * len(item):
                    yield d, k, matched, len(found), max(x[2] for x in found)


def grams(ids: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each run of n word numbers (that starts at ``at``)."""
    if len(ids) < n:
        return np.zeros(0, dtype=U64)
    at = np.arange(len(ids) - n + 1) if at is None else at
    h = np.zeros(len(at), dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = mix(h * U64(0x9E3779B97F4A7C15) + ids[at + k].astype(U64) + U64(1))
    return h


def blocks(items: DataFrame, min_tile: int, coverage: float, block_words: int,
           id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The distinct items in blocks of about ``block_words`` words, each text in one block."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")) \
        .where("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, math.ceil(total / block_words))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text")
        yield Block([(r.item_id, r.text) for r in part.collect()], min_tile, coverage)


PAIRS = "doc_id long, item_id long, item_words long, matched_words long, n_tiles long, longest_tile long, coverage double"


def contaminated_pairs(docs: DataFrame, items: DataFrame, min_tile: int = 5, coverage: float = 0.8,
                       block_words: int = 200_000) -> DataFrame:
    """One row for each document row and item whose tiles cover ``coverage`` of the item.

    Items of fewer than ``min_tile`` words, null or empty, never match; null and
    empty documents match nothing; equal rows each give their rows.  An item
    repeated under the same id counts once.
    """
    spark, out = docs.sparkSession, None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for block in blocks(items, min_tile, coverage, block_words):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            block = sent.value
            for rb in pieces(batches):
                ids = rb.column("doc_id").to_pylist()
                rows = [(ids[d], block.items[k][0], len(block.items[k][1]), m, c, top, m / len(block.items[k][1]))
                        for d, k, m, c, top in block.leaks(rb.column("text").to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), pa.float64() if i == 6 else pa.int64()) for i, c in enumerate(zip(*rows))],
                        ["doc_id", "item_id", "item_words", "matched_words", "n_tiles", "longest_tile", "coverage"])

        part = texts.mapInArrow(run, PAIRS)
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, min_tile: int = 5, coverage: float = 0.8,
                    block_words: int = 200_000) -> DataFrame:
    """The documents (all columns, ``text`` among them) in which no item is leaked."""
    spark = docs.sparkSession
    for block in blocks(items, min_tile, coverage, block_words):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for rb in pieces(batches):
                bad = {d for d, *_ in sent.value.leaks(rb.column("text").to_pylist())}
                yield rb.filter(pa.array([d not in bad for d in range(rb.num_rows)])) if bad else rb

        docs = docs.mapInArrow(run, docs.schema)
    return docs
