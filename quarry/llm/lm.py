"""Language-model scoring from a log-frequency Bloom filter.

Counts of one- and two-word n-grams of the training texts are quantised to levels
1 + floor(log2 c).  An n-gram of level q is in the filter with each of the levels
1..q, so its level is found by probing 1, 2, ... until a probe fails; a false
positive can only raise it, and twice in a row rarely.  All bits of a probe lie in
one 64-bit word, and all words of an n-gram in the region its hash names: the task
that counts an n-gram also sets its bits, and no bit ever travels.

The filter has ``BITS_PER_TOKEN`` bits for each training token, however many there
are: no task holds more of it than its slice of hash space, which is probed where
it was filled.  The distinct n-grams of a piece of text travel there as hashes, and
their levels come back.

Probability of w after v: ``LAMBDA * c(v w) / c(v) + (1 - LAMBDA) * (c(w) + 1) / (N + V + 1)``
with the filter's counts.

The exact add-one unigram score is computed beside it: the ``head`` most frequent
words (a bounded table) are looked up where the text is, the others meet their
counts, and their slice of the filter, in the task that owns their hash.  Arrays of hashes travel packed, one row
for each piece of text (``PIECE`` bytes) and slice of hash space; there is a slice for every ``SLICE_TOKENS``
training tokens, whatever the number of partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import U64, ascii_lower, blob, each, held_out, mix, pieces, range_hash, running_sum, save, word_ranges

END = U64(0x8B1A0C52E97D364F)
HEAD = 1 << 18
PAIR = U64((1 << 64) - (1 << 16))  # pairs have 48 bits: at 10^10 of them 1 in 30,000 meets another, far under the filter's own errors
REGIONS = 12  # bits of the hash that name a region of the filter; more if there are more slices
PIECE = 3 << 20
SLICE_TOKENS = 1 << 21
BITS_PER_TOKEN = 16
PROBE_BITS = 4
LAMBDA = 0.7
FLUSH = 1 << 20


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 row offsets): the words of each row, then its end."""
    data, off = blob(column)
    data = ascii_lower(data)
    s, e, row = word_ranges(data, off)
    n = np.bincount(row, minlength=len(off) - 1) + 1
    cut = np.concatenate([[0], np.cumsum(n)])
    out = np.full(int(cut[-1]), END)
    out[np.arange(len(s)) + row] = range_hash(running_sum(data), s, e) if len(s) else np.zeros(0, U64)
    return out, cut


def pairs(words: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with the one before it, and which words have one before."""
    after = np.ones(len(words), dtype=bool)
    after[cut[:-1]] = False
    at = np.flatnonzero(after)
    with np.errstate(over="ignore"):
        return mix(words[at - 1] * U64(0x9E3779B97F4A7C15) + words[at]) & PAIR, at


def levels(count: np.ndarray) -> np.ndarray:
    return np.frexp(count.astype(np.float64))[1]  # 1 + floor(log2 c)


def _packed(kind: int, slices: int, keys: np.ndarray, extra: list[np.ndarray], chunk: int, zipped: bool = False):
    """Rows (slice, kind, chunk, keys, a, b) of arrays sorted by key; ``zipped``: compressed, the keys as gaps."""
    bound = (np.arange(1, slices, dtype=np.uint64) << U64(64 - int(math.log2(slices)))) if slices > 1 else np.zeros(0, U64)
    cut = [0, *np.searchsorted(keys, bound).tolist(), len(keys)]
    for k, (a, b) in enumerate(zip(cut, cut[1:])):
        if b > a:
            if zipped:
                yield (k, kind, chunk, _zip(np.diff(keys[a:b], prepend=U64(0))), *(_zip(x[a:b]) for x in extra))
            else:
                yield (k, kind, chunk, keys[a:b].tobytes(), *(x[a:b].tobytes() for x in extra))


def _zip(x: np.ndarray) -> bytes:
    """The array's byte planes, compressed, after their length."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True) if planes else b""


def _unzip(data, kind: type) -> np.ndarray:
    data = memoryview(data)
    if not len(data):
        return np.zeros(0, kind)
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(pa.py_buffer(data[8:]), size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _unzip_keys(data) -> np.ndarray:
    return np.cumsum(_unzip(data, U64), dtype=U64)


def _number(unique: np.ndarray) -> type:
    """The smallest type for the numbers of these words."""
    return np.uint16 if len(unique) <= 1 << 16 else np.uint32


_ROWS = "slice int, kind int, chunk long, keys binary, a binary, b binary"


def _batches(rows, limit: int = 8 << 20):
    """Record batches of some megabytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3]) + len(r[4]) + len(r[5])
        if size >= limit:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _ROWS.split(", ")])


class Counter:
    """Distinct hashes with their counts, merged as they come in bounded portions."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.more.append((keys, np.ones(len(keys), np.int64) if counts is None else counts))
        self.waiting += len(keys)
        if self.waiting >= FLUSH:
            self.merge()

    def merge(self) -> "Counter":
        if self.more:
            keys = np.concatenate([self.keys, *(k for k, _ in self.more)])
            counts = np.concatenate([self.counts, *(c for _, c in self.more)])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            self.keys = keys[start]
            self.counts = np.add.reduceat(counts[order], start) if len(start) else counts
            self.more, self.waiting = [], 0
        return self


def count_slices(df: DataFrame) -> int:
    """Slices of hash space while words are counted: a power of two, four for each shuffle partition at least."""
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, 1 << math.ceil(math.log2(n)))


def filter_slices(tokens_seen: int) -> int:
    """Slices of the filter: a power of two that grows with the training tokens, without a bound."""
    return max(16, 1 << math.ceil(math.log2(max(1, tokens_seen) / SLICE_TOKENS)) if tokens_seen > SLICE_TOKENS else 16)


def unigram_counts(docs: DataFrame, slices: int, head: int) -> DataFrame:
    """One row for each slice: its distinct words with counts, and its most frequent ones."""

    def count(batches):
        c = Counter()
        for rb in pieces(batches):
            keys, n = np.unique(tokens(rb.column("text"))[0], return_counts=True)
            c.add(keys, n)
            if len(c.keys) >= FLUSH:
                yield from _batches(_packed(0, slices, c.merge().keys, [c.counts, c.counts[:0]], 0))
                c = Counter()
        if len(c.merge().keys):
            yield from _batches(_packed(0, slices, c.keys, [c.counts, c.counts[:0]], 0))

    def total(batches):
        def one(k, c):
            c.merge()
            top = np.sort(np.argsort(-c.counts, kind="stable")[:max(1, head // slices)])
            return pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([c.keys.tobytes()]), pa.array([c.counts.tobytes()]), pa.array([c.keys[top].tobytes()]),
                 pa.array([c.counts[top].tobytes()]), pa.array([int(c.counts.sum())]), pa.array([len(c.keys)])],
                ["slice", "keys", "counts", "top_keys", "top_counts", "n", "v"])

        now, c = None, Counter()
        for rb in batches:
            for k, keys, a in each(rb, "slice", "keys", "a"):
                if k != now:
                    if now is not None:
                        yield one(now, c)
                    now, c = k, Counter()
                c.add(np.frombuffer(keys, U64), np.frombuffer(a, np.int64))
        if now is not None:
            yield one(now, c)

    return docs.mapInArrow(count, _ROWS).repartition("slice").sortWithinPartitions("slice") \
        .mapInArrow(total, "slice int, keys binary, counts binary, top_keys binary, top_counts binary, n long, v long")


class Filter:
    """Reads the levels of n-gram hashes from the whole filter, or from its words after ``first``."""

    def __init__(self, words: np.ndarray, per_region: int | None = None, first: int = 0, regions: int = REGIONS):
        self.words, self.first, self.regions = words, first, regions
        self.per_region = len(words) >> regions if per_region is None else per_region

    @staticmethod
    def probe(keys: np.ndarray, level: int | np.ndarray, per_region: int, regions: int = REGIONS) -> tuple[np.ndarray, np.ndarray]:
        """(word number, bits that must be set in it); ``regions``: bits of the hash that name the region."""
        with np.errstate(over="ignore"):
            h = mix(keys + np.asarray(level, dtype=U64) * U64(0xA0761D6478BD642F))
        word = (keys >> U64(64 - regions)) * U64(per_region) + (h >> U64(32)) % U64(per_region)
        bits = np.zeros(len(keys), dtype=U64)
        for k in range(PROBE_BITS):
            bits |= U64(1) << (h >> U64(6 * k) & U64(63))
        return word.astype(np.int64), bits

    def level(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        at = np.arange(len(keys))
        q = 1
        while len(at) and q < 64:
            word, bits = self.probe(keys[at], q, self.per_region, self.regions)
            at = at[(self.words[word - self.first] & bits) == bits]
            out[at] = q
            q += 1
        return out


def middle(q: np.ndarray) -> np.ndarray:
    """The middle of each level's counts (0 if absent)."""
    return np.where(q > 1, 0.75 * np.exp2(q), np.minimum(q, 1))


def filter_words(tokens_seen: int, max_bytes: int | None = None, regions: int = REGIONS) -> int:
    """64-bit words of the filter: the same number for each region."""
    need = tokens_seen * BITS_PER_TOKEN // 64
    return (max(1, (need if max_bytes is None else min(need, max_bytes // 8)) >> regions)) << regions


def log_probability(single: np.ndarray, both: np.ndarray, at: np.ndarray, cut: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 probability of each row, from the counts of its words and of the pairs that end ``at`` some."""
    p = (single + 1.0) / (n + v + 1.0)
    if len(at):
        both = np.minimum(both, np.minimum(single[at], single[at - 1]))
        p[at] = LAMBDA * both / np.maximum(single[at - 1], 1.0) + (1 - LAMBDA) * p[at]
    return np.add.reduceat(np.log10(p), cut[:-1]) if len(cut) > 1 else np.zeros(0)


def _found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key in the sorted ``among``, whether it is there)."""
    if not len(among):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), dtype=bool)
    place = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return place, among[place] == keys


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, mod: int = 7, rest: int = 2, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows that are not held out.  Null texts are empty (the end
    alone); a null doc_id is not held out; repeated rows count and score each;
    an empty table gives no rows; with nothing to learn from, V and N are 0; a very long
    text is a piece of its own, in memory proportional to its words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", mod, rest).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    uni = save(unigram_counts(rows.where("NOT held_out").select("text"), count_slices(docs), head), "lm-unigrams")
    top = uni.select("top_keys", "top_counts", "n", "v").orderBy("slice").toArrow().to_pydict()
    n, v = sum(top["n"]), sum(top["v"])
    head_keys = np.frombuffer(b"".join(top["top_keys"]), U64)
    head_counts = np.frombuffer(b"".join(top["top_counts"]), np.int64)
    slices = filter_slices(n)
    regions = max(REGIONS, int(math.log2(slices)))
    size = filter_words(n, regions=regions)
    sent_head = spark.sparkContext.broadcast((head_keys, head_counts))

    words_per_slice = size // slices

    def fill(k: int, counters: tuple[Counter, Counter]) -> Filter:
        """The part of the filter that a slice of hash space owns."""
        out = np.zeros(words_per_slice, dtype=U64)
        for c in counters:
            q = levels(c.merge().counts)
            for level in range(1, int(q.max()) + 1 if len(q) else 1):
                word, bits = Filter.probe(c.keys[q >= level], level, size >> regions, regions)
                np.bitwise_or.at(out, word - k * words_per_slice, bits)
        return Filter(out, size >> regions, k * words_per_slice, regions)

    def recut(batches):
        """The words' counts by slice of the filter."""
        for rb in batches:
            for keys, counts in each(rb, "keys", "counts"):
                keys, counts = np.frombuffer(keys, U64), np.frombuffer(counts, np.int64)
                yield from _batches(_packed(1, slices, keys, [counts, counts[:0]], 0))

    counted = uni.select("keys", "counts").mapInArrow(recut, _ROWS)

    def score(batches):
        """Per piece: one row of its texts as numbers of its distinct words, and its distinct n-grams by slice.

        The pairs carry how often they stand in rows to learn from.
        """
        task = TaskContext.get().partitionId()
        for number, rb in enumerate(pieces(batches, limit=PIECE)):
            chunk = task << 32 | number
            words, cut = tokens(rb.column("text"))
            unique, back = np.unique(words, return_inverse=True)
            pair, at = pairs(words, cut)
            pair, which = np.unique(pair, return_inverse=True)
            learn = np.repeat(~rb.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(cut))[at]
            times = np.bincount(which[learn], minlength=len(pair)).astype(np.int64)
            here = pa.table({"doc_id": rb.column("doc_id"), "held_out": rb.column("held_out"), "n_tokens": pa.array(np.diff(cut))})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, here.schema) as w:
                w.write_table(here)
            rare = unique[~_found(unique, sent_head.value[0])[1]]
            anywhere = int(mix(np.array([chunk], U64))[0]) % slices  # texts ask for nothing: they are dealt evenly
            yield _batch([(anywhere, 2, chunk, sink.getvalue().to_pybytes(), _zip(np.diff(unique, prepend=U64(0))), _zip(back.astype(_number(unique)))),
                          *_packed(3, slices, rare, [rare[:0], rare[:0]], chunk, True),
                          *_packed(4, slices, pair, [times, rare[:0]], chunk, True)])

    def look_up(batches):
        """Per slice: the words' counts and all pairs fill its part of the filter, then the n-grams are looked up in it."""
        def answers(k, one, asked):
            two = Counter()
            grams = {3: [], 4: []}
            for kind, _, keys, times in asked:
                grams[kind].append(_unzip_keys(keys))
                if kind == 4:
                    times = _unzip(times, np.int64)
                    two.add(grams[4][-1][times > 0], times[times > 0])
            filt = fill(k, (one, two))
            # all that is asked of this slice at once
            every = {kind: np.concatenate([np.zeros(0, U64), *g]) for kind, g in grams.items()}
            level = {kind: filt.level(x).astype(np.uint8) for kind, x in every.items()}
            place, hit = _found(every[3], one.keys)
            count = np.zeros(len(every[3]), np.int64)
            count[hit] = one.counts[place[hit]]
            at = {3: 0, 4: 0}
            nth = {3: 0, 4: 0}
            for kind, chunk, _, _ in asked:
                a = at[kind]
                b = at[kind] = a + len(grams[kind][nth[kind]])
                nth[kind] += 1
                yield k, kind, chunk, _zip(level[kind][a:b]), _zip(count[a:b]) if kind == 3 else b"", b""

        now, one, asked = None, Counter(), []
        for rb in batches:
            out = []
            for k, kind, chunk, keys, a, b in each(rb, "slice", "kind", "chunk", "keys", "a", "b"):
                if k != now:
                    if asked:
                        yield from _batches(answers(now, one, asked))
                    now, one, asked = k, Counter(), []
                if kind == 1:
                    one.add(np.frombuffer(keys, U64), np.frombuffer(a, np.int64))
                    one.merge()
                elif kind == 2:
                    out.append((k, kind, chunk, keys.to_pybytes(), a.to_pybytes(), b.to_pybytes()))
                else:
                    asked.append((kind, chunk, keys.to_pybytes(), a.to_pybytes()))
            yield from _batches(out)
        if asked:
            yield from _batches(answers(now, one, asked))

    def total(batches):
        """Per piece: its distinct n-grams meet what the slices found, in the order of their hashes."""
        head_keys, head_counts = sent_head.value

        def one(here, rare, two):
            t, unique = pa.ipc.open_stream(here[0]).read_all(), _unzip_keys(here[1])
            back = _unzip(here[2], _number(unique)).astype(np.int64)
            count = t["n_tokens"].to_numpy()
            cut = np.concatenate([[0], np.cumsum(count)])
            place, top = _found(unique, head_keys)
            exact, level = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
            exact[top] = head_counts[place[top]]
            level[top] = levels(exact[top])
            if rare:
                exact[~top] = np.concatenate([_unzip(a, np.int64) for _, a in rare])
                level[~top] = np.concatenate([_unzip(q, np.uint8) for q, _ in rare])
            pair, at = pairs(unique[back], cut)
            both = np.zeros(0)
            if len(pair):
                both = middle(np.concatenate([_unzip(q, np.uint8) for q, _ in two]).astype(np.int64))[np.unique(pair, return_inverse=True)[1]]
            row = np.repeat(np.arange(len(count)), count)
            sums = np.bincount(row, weights=np.log10(exact + 1.0)[back], minlength=len(count))
            known = np.bincount(row[exact[back] > 0], minlength=len(count))
            value = log_probability(middle(level)[back], both, at, cut, n, v)
            return pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), t["held_out"].combine_chunks(), pa.array(count), pa.array(known),
                 pa.array(np.full(len(count), n)), pa.array(sums - count * math.log10(n + v + 1)), pa.array(value)],
                [x.split()[0] for x in _SCORES.split(", ")])

        now, here, found = None, None, ([], [])
        for rb in batches:
            for chunk, kind, keys, a, b in each(rb, "chunk", "kind", "keys", "a", "b"):
                if chunk != now:
                    if now is not None:
                        yield one(here, *found)
                    now, here, found = chunk, None, ([], [])
                if kind == 2:
                    here = keys, a, b
                else:
                    found[kind - 3].append((keys, a))
        if now is not None:
            yield one(here, *found)

    found = rows.mapInArrow(score, _ROWS).unionByName(counted).repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(look_up, _ROWS)
    return found.repartition("chunk").sortWithinPartitions("chunk", "kind", "slice").mapInArrow(total, _SCORES)
