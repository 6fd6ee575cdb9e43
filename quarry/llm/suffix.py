"""Exact removal of repeated byte strings with a two-stage suffix array.

A byte goes when some string of ``LENGTH`` bytes that covers it also starts anywhere
else.  The job finds where equal strings can meet, then sorts suffixes there:

1. Every string of ``LENGTH`` bytes has an anchor, the ``GRAM``-byte gram in it with the
   smallest hash (the leftmost of equals); equal strings have equal anchors at the
   same offset.  The strings of one anchor in a text are neighbours: a stretch.
2. Stretches meet by their anchor's hash.  An anchor that occurs once has no
   repeated string.  Equal whole stretches repeat as they are, are settled at once
   (already in the task that reads them) and travel on as one.
3. Different stretches of one anchor are sorted: the suffixes smaller than their
   successor directly, all others induced from these by scanning the buckets of
   first bytes from the smallest to the largest; neighbours whose common prefix
   has ``LENGTH`` bytes or more are equal strings.
4. An anchor with more than ``HOT`` different stretches (a passage that a large share of
   the corpus quotes, seen at its edges) is not gathered: its strings go on as keys of
   their own, again met by hash, equal ones counted where they are read first.
5. The covered ranges return to their texts.

Texts are told apart by XXH64; equal texts are one text with several ids.  All that
is shuffled travels packed by slices of hash space, and a task holds one slice.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import U64, blob, each, mix, pieces, range_hash, running_sum, save

LENGTH = 200
GRAM = 64
HOT = 4096
#: Text that is sorted at a time: whole groups of stretches, up to this many bytes.
SORT_BYTES = 1 << 20
#: A task settles and ships this many stretches at a time.
FLUSH_ROWS = 1 << 18
_POS = U64(31)
_POS_MASK = U64((1 << 31) - 1)

#: One stretch: anchor hash, hash of the stretch, text key, first string, strings, offset of the anchor, seen before.
STRETCH = np.dtype([("key", "<u8"), ("body", "<u8"), ("text", "<i8"), ("lo", "<i4"), ("n", "<i4"), ("at", "<i4"), ("multi", "<i4")])
SPAN = np.dtype([("text", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


# ---------------------------------------------------------------- suffix array

def suffix_order(text: np.ndarray, first: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes starting at ``first[k] .. first[k] + count[k] - 1``, ordered by ``depth`` bytes at least.

    ``text`` ends in at least ``depth`` + 8 zero bytes and has one behind each stretch.
    """
    n = len(text)
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    run = np.zeros(n, dtype=np.int64)
    run[change[:-1] + 1] = 1
    run = np.cumsum(run)
    nxt = np.append(text[change[:-1] + 1], 255)  # the zeros at the end count as smaller: chains end there
    small = (text[change] < nxt)[run]  # smaller than its successor

    active = np.zeros(n + 1, dtype=np.int64)
    np.add.at(active, first, 1)
    np.add.at(active, first + count, -1)
    active = np.cumsum(active)[:n] > 0
    # a larger suffix is induced from its successor: follow each stretch to a smaller one
    place = np.where(small, np.arange(n), n)
    next_small = np.minimum.accumulate(place[::-1])[::-1]
    last = first + count - 1
    tail = np.minimum(next_small[last], n - 1)
    grow = np.zeros(n + 1, dtype=np.int64)
    np.add.at(grow, last, 1)
    np.add.at(grow, tail + 1, -1)
    active |= np.cumsum(grow)[:n] > 0

    words = eight(text)
    direct = sort_direct(words, np.flatnonzero(active & small), depth)
    head = text[direct]
    bound = np.searchsorted(head, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    large = active & ~small
    before = np.zeros(n, dtype=bool)
    before[1:] = large[:-1]  # the suffix one byte longer is active and waits to be induced
    for c in range(256):
        layer = np.concatenate(induced[c]) if induced[c] else direct[:0]
        whole = [layer]
        while len(layer):
            same = layer[before[layer]]
            layer = same[text[same - 1] == c] - 1
            whole.append(layer)
        whole.append(direct[bound[c]:bound[c + 1]])
        bucket = np.concatenate(whole)
        out.append(bucket)
        prev = bucket[before[bucket]] - 1
        char = text[prev]
        prev, char = prev[char > c], char[char > c]
        if len(prev):
            order = np.argsort(char, kind="stable")
            prev, char = prev[order], char[order]
            cut = np.flatnonzero(np.diff(char)) + 1
            for part in np.split(prev, cut):
                induced[text[part[0]]].append(part)
    return np.concatenate(out)


def eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number."""
    w = np.append(text, np.zeros(8, np.uint8)).astype(U64)
    for k in (1, 2, 4):
        w = (w[:-k] << U64(8 * k)) | w[k:]
    return w[:len(text)]


def sort_direct(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` bytes, eight at a time within ties."""
    order = np.argsort(words[at], kind="stable")
    at = at[order]
    w = words[at]
    fresh = np.concatenate([[True], w[1:] != w[:-1]]) if len(at) else np.zeros(0, bool)
    top = len(words) - 1
    for k in range(8, depth, 8):
        group = np.cumsum(fresh) - 1
        size = np.bincount(group, minlength=1)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        g, p = group[tied], at[tied]
        w = words[np.minimum(p + k, top)]
        order = np.lexsort((w, g))
        p, w, g = p[order], w[order], g[order]
        at[tied] = p
        same = np.zeros(len(tied), dtype=bool)
        same[1:] = (w[1:] == w[:-1]) & (g[1:] == g[:-1])
        fresh[tied] = ~same
    return at


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares ``depth`` bytes or more with the one before it."""
    out = np.zeros(len(order), dtype=bool)
    at = np.arange(1, len(order))
    for k in [*range(0, depth - 7, 8), depth - 8]:
        if not len(at):
            break
        at = at[words[order[at] + k] == words[order[at - 1] + k]]
    out[at] = True
    return out


def repeated(text: np.ndarray, first: np.ndarray, count: np.ndarray, owner: np.ndarray, multi: np.ndarray,
             depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, offset in it) of the strings that also start elsewhere.

    ``owner``: a number for each stretch's first string, its place in the corpus, so
    that a string met twice through two anchors is not taken for two; ``multi``:
    the stretch stands for several equal ones.
    """
    order = suffix_order(text, first, count, depth)
    stretch = np.searchsorted(first, order, side="right") - 1
    ok = (stretch >= 0) & (order < (first + count)[np.maximum(stretch, 0)])
    order, stretch = order[ok], stretch[ok]
    if not len(order):
        return order, order
    equal = common_prefixes(eight(text), order, depth)
    start = np.flatnonzero(~equal)
    with np.errstate(over="ignore"):
        me = owner[stretch] + (order - first[stretch]).astype(U64)
    often = (np.minimum.reduceat(me, start) != np.maximum.reduceat(me, start)) | (np.maximum.reduceat(multi[stretch].astype(np.int8), start) > 0)
    size = np.diff(np.append(start, len(order)))
    hit = np.repeat(often & (size > 1), size)
    return stretch[hit], (order - first[stretch])[hit]


# ---------------------------------------------------------------- stretches

def stretches(data: np.ndarray, off: np.ndarray, texts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """All stretches of the texts side by side in ``data``."""
    n, wide = len(data), length - gram + 1
    valid = np.zeros(n + 1, dtype=np.int64)
    long = np.flatnonzero(np.diff(off) >= length)
    if not len(long):
        return np.zeros(0, STRETCH)
    np.add.at(valid, off[long], 1)
    np.add.at(valid, off[long + 1] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(valid)[:n] > 0)
    sums = running_sum(data)
    grams = np.arange(n - gram + 1)
    h = range_hash(sums, grams, grams + gram)
    low = (h & ~_POS_MASK) | grams.astype(U64)
    step = 1
    while 2 * step <= wide:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if wide > step:
        low = np.minimum(low[:step - wide], low[wide - step:])
    anchor = (low[start] & _POS_MASK).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    lo, anchor = start[head], anchor[head]
    count = np.diff(np.append(head, len(start)))
    row = np.searchsorted(off, lo, side="right") - 1
    out = np.zeros(len(lo), STRETCH)
    out["key"], out["text"] = h[anchor], texts[row]
    out["lo"], out["n"], out["at"] = lo - off[row], count, anchor - lo
    with np.errstate(over="ignore"):
        out["body"] = mix(range_hash(sums, lo, lo + count + length - 1) + out["at"].astype(U64))
    return out


def settle(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the stretches that occur more than once as they are, and one of each."""
    if not len(rows):
        return np.zeros(0, SPAN), rows
    rows = rows[np.lexsort((rows["lo"], rows["text"], rows["body"], rows["key"]))]
    twin = np.zeros(len(rows), dtype=bool)  # the very same place, through a copy of the text
    for c in ("key", "body", "text", "lo"):
        same = rows[c][1:] == rows[c][:-1]
        twin[1:] = same if c == "key" else twin[1:] & same
    head = np.flatnonzero(~twin)
    multi = np.maximum.reduceat(rows["multi"], head)
    rows = rows[head]
    rows["multi"] = multi
    first = np.flatnonzero(np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["body"][1:] != rows["body"][:-1])]))
    size = np.diff(np.append(first, len(rows)))
    often = (size > 1) | (np.maximum.reduceat(rows["multi"], first) > 0)
    # those that were already marked have their spans
    told = rows[np.repeat(often, size) & (rows["multi"] == 0)]
    one = rows[first]
    one["multi"] = often
    return spans_of(told["text"], told["lo"], told["lo"] + told["n"] + length - 1), one


def spans_of(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Ranges merged where they touch, by text and place."""
    out = np.zeros(len(text), SPAN)
    if not len(text):
        return out
    out["text"], out["lo"], out["hi"] = text, lo, hi
    out = out[np.lexsort((out["lo"], out["text"]))]
    new_text = np.concatenate([[True], out["text"][1:] != out["text"][:-1]])
    group = np.cumsum(new_text)
    # the furthest end so far within a text: ends never cross a text's offset
    wide = int(out["hi"].max()) + 1
    far = np.maximum.accumulate(out["hi"] + group * wide) - group * wide
    head = np.flatnonzero(np.concatenate([[True], new_text[1:] | (out["lo"][1:] > far[:-1])]))
    merged = out[head].copy()
    merged["hi"] = far[np.append(head[1:], len(out)) - 1]
    return merged


# ---------------------------------------------------------------- the job

_ROWS = "slice int, kind int, data binary, bytes binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                      ["slice", "kind", "data", "bytes"])


def _slice_of(key: np.ndarray, slices: int) -> np.ndarray:
    return (mix(key.view(U64)) >> U64(64 - int(math.log2(slices)))).astype(np.int64)


def _dealt(rows: np.ndarray, field: str, kind: int, slices: int):
    """Rows (slice, kind, packed) of a structured array."""
    if not len(rows):
        return
    part = _slice_of(np.ascontiguousarray(rows[field]), slices)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cut = np.flatnonzero(np.diff(part)) + 1
    for p, k in zip(np.split(rows, cut), part[np.concatenate([[0], cut])].tolist()):
        yield (k, kind, p.tobytes(), b"")


def _by_slice(batches):
    """(slice, {kind: [(data, bytes), ...]}) of a partition sorted by slice."""
    now, held = None, {}
    for rb in batches:
        for k, kind, data, raw in each(rb, "slice", "kind", "data", "bytes"):
            if k != now:
                if now is not None:
                    yield now, held
                now, held = k, {}
            held.setdefault(kind, []).append((data, raw))
    if now is not None:
        yield now, held


def _array(parts: list, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(d for d, _ in parts), dtype) if parts else np.zeros(0, dtype)


def _meet(df: DataFrame) -> DataFrame:
    return df.repartition("slice").sortWithinPartitions("slice", "kind")


_TEXTS = "slice int, kind int, key long, text binary, ids array<long>, data binary"


def texts_once(docs: DataFrame, slices: int) -> DataFrame:
    """Rows (slice, kind 9, key, text, ids): the texts, each once for every task that reads it, with its rows' ids."""

    def rows(keys: pa.Array, text: pa.Array, ids: list):
        part = _slice_of(keys.to_numpy(zero_copy_only=False), slices).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(np.full(len(part), 9, np.int32)), keys, text.cast(pa.binary()),
             pa.array(ids, pa.list_(pa.int64())), pa.nulls(len(part), pa.binary())],
            ["slice", "kind", "key", "text", "ids", "data"])

    def run(batches):
        seen: dict[int, tuple[int, list]] = {}
        for rb in pieces(batches):
            keys, ids = rb.column("key").to_pylist(), rb.column("doc_id").to_pylist()
            fresh: dict[int, list] = {}
            at = []
            for k, (key, d) in enumerate(zip(keys, ids)):
                if key in seen:
                    seen[key][1].append(d)
                elif key in fresh:
                    fresh[key].append(d)
                else:
                    fresh[key] = [d]
                    at.append(k)
            for key in fresh:
                seen[key] = (0, [])
            if at:
                part = rb.take(pa.array(at))
                yield rows(part.column("key"), part.column("text"), [fresh[keys[k]] for k in at])
        late = [(k, ids) for k, (_, ids) in seen.items() if ids]
        if late:  # copies that came in later pieces: ids without the text
            yield rows(pa.array([k for k, _ in late]), pa.nulls(len(late), pa.string()), [i for _, i in late])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("key", F.xxhash64("text")).mapInArrow(run, _TEXTS)


def _slices(df: DataFrame) -> int:
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(4, math.ceil(math.log2(n)))


def repeated_spans(docs: DataFrame, slices: int, length: int, gram: int, hot: int) -> DataFrame:
    """Packed spans (slice of the text key) of all repeated strings; parts may overlap."""

    def read(batches):
        kept, size = [], 0
        seen: set[int] = set()
        for rb in pieces(batches):
            keys = rb.column("key").to_pylist()
            at = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if not at:
                continue
            part = rb.take(pa.array(at))
            kept.append(stretches(*blob(part.column("text")), part.column("key").to_numpy(zero_copy_only=False), length, gram))
            size += len(kept[-1])
            if size >= FLUSH_ROWS:
                yield out(np.concatenate(kept))
                kept, size = [], 0
        if size:
            yield out(np.concatenate(kept))

    def out(rows):
        spans, rows = settle(rows, length)
        return _batch([*_dealt(spans, "text", 1, slices), *_dealt(rows, "key", 0, slices)])

    def meet(batches):
        """Kind 0 in: stretches by anchor.  Out, by text: 1 spans, 2 stretches to sort, 3 strings to key."""
        for k, held in _by_slice(batches):
            spans, rows = settle(_array(held.get(0, []), STRETCH), length)
            for data, _ in held.get(1, []):
                yield _batch([(k, 1, data.to_pybytes(), b"")])
            first = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])) if len(rows) else np.zeros(0, np.int64)
            size = np.repeat(np.diff(np.append(first, len(rows))), np.diff(np.append(first, len(rows))))
            yield _batch([*_dealt(spans, "text", 1, slices), *_dealt(rows[(size > 1) & (size <= hot)], "text", 2, slices),
                          *_dealt(rows[size > hot], "text", 3, slices)])

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    met = save(_meet(texts.mapInArrow(read, _ROWS)).mapInArrow(meet, _ROWS), "suffix-met")

    def once(batches):
        seen: set[int] = set()
        for rb in pieces(batches):
            keys = rb.column("key").to_numpy(zero_copy_only=False)
            text = rb.column("text").to_pylist()
            part = _slice_of(keys, slices).tolist()
            rows = [(p, 9, np.int64(key).tobytes(), t.encode("utf-8", "surrogatepass"))
                    for p, key, t in zip(part, keys.tolist(), text) if len(t) * 4 >= length and key not in seen and not seen.add(key)]
            if rows:
                yield _batch(rows)

    def fetch(batches):
        """By text: the asked stretches with their bytes, back to their anchors (kind 0) or strings as keys (kind 4)."""
        now, asked, keyed, done = None, {}, {}, set()
        ready, ready_bytes, strings = [], 0, []

        def load(parts):
            rows = _array(parts, STRETCH)
            rows = rows[np.argsort(rows["text"], kind="stable")]
            cut = np.flatnonzero(np.diff(rows["text"])) + 1 if len(rows) else []
            return {int(p["text"][0]): p for p in np.split(rows, cut) if len(p)}

        def send():
            rows = np.concatenate([r for r, _ in ready])
            raw = [b for _, bs in ready for b in bs]
            part = _slice_of(np.ascontiguousarray(rows["key"]), slices)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            return _batch([(int(part[o[0]]), 0, rows[o].tobytes(), b"".join(raw[x] for x in o.tolist())) for o in np.split(order, cut)])

        def send_strings():
            spans, rows = settle(np.concatenate(strings), length)
            return _batch([*_dealt(spans, "text", 1, slices), *_dealt(rows, "key", 4, slices)])

        held: list = []
        for rb in batches:
            for k, kind, data, raw in each(rb, "slice", "kind", "data", "bytes"):
                if k != now:
                    now, asked, keyed, done, held = k, {}, {}, set(), []
                if kind != 9:
                    held.append((kind, data))
                    continue
                if held:
                    asked = load([(d, b"") for x, d in held if x == 2])
                    keyed = load([(d, b"") for x, d in held if x == 3])
                    held = []
                key = int(np.frombuffer(data, np.int64)[0])
                if key in done:
                    continue
                done.add(key)
                rows = asked.get(key)
                if rows is not None:
                    text = memoryview(raw)
                    ready.append((rows, [bytes(text[lo:lo + n + length - 1]) for lo, n in zip(rows["lo"].tolist(), rows["n"].tolist())]))
                    ready_bytes += int(rows["n"].sum()) + length * len(rows)
                rows = keyed.get(key)
                if rows is not None:
                    strings.append(single(rows, np.frombuffer(raw, np.uint8), length))
                if ready_bytes >= 4 << 20:
                    yield send()
                    ready, ready_bytes = [], 0
                if sum(map(len, strings)) >= FLUSH_ROWS:
                    yield send_strings()
                    strings = []
        if ready:
            yield send()
        if strings:
            yield send_strings()

    fetched = _meet(met.where("kind IN (2, 3)").unionByName(texts.mapInArrow(once, _ROWS))).mapInArrow(fetch, _ROWS)

    def sort(batches):
        """By anchor: kind 0 stretches to sort, kind 4 strings to count; kind 1 spans pass."""
        for k, held in _by_slice(batches):
            for data, _ in held.get(1, []):
                yield _batch([(k, 1, data.to_pybytes(), b"")])
            spans, _ = settle(_array(held.get(4, []), STRETCH), length)
            if len(spans):
                yield _batch(list(_dealt(spans, "text", 1, slices)))
            rows = _array(held.get(0, []), STRETCH)
            if not len(rows):
                continue
            raw = np.frombuffer(b"".join(b for _, b in held[0]), np.uint8)
            width = rows["n"].astype(np.int64) + length - 1
            at = np.cumsum(width) - width
            order = np.lexsort((rows["body"], rows["key"]))
            rows, at, width = rows[order], at[order], width[order]
            ends = np.flatnonzero(np.append(rows["key"][1:] != rows["key"][:-1], True)) + 1
            total = np.cumsum(width)
            a = 0
            while a < len(rows):
                room = (total[a - 1] if a else 0) + SORT_BYTES
                fit = ends[(ends > a) & (total[ends - 1] <= room)]
                b = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, a, side="right")])
                found = sort_stretches(rows[a:b], raw, at[a:b], width[a:b], length)
                if len(found):
                    yield _batch(list(_dealt(found, "text", 1, slices)))
                a = b

    found = _meet(fetched).mapInArrow(sort, _ROWS)
    return met.where("kind = 1").unionByName(found)


def single(rows: np.ndarray, raw: np.ndarray, length: int) -> np.ndarray:
    """Each string of some stretches of one text as a stretch of its own, keyed by its bytes."""
    n = rows["n"].astype(np.int64)
    lo = np.repeat(rows["lo"] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    sums = running_sum(raw)
    out = np.zeros(len(lo), STRETCH)
    out["key"] = range_hash(sums, lo, lo + length)
    out["body"] = mix(range_hash(sums, lo, lo + length // 2) ^ mix(range_hash(sums, lo + length // 2, lo + length)))
    out["text"], out["lo"], out["n"] = rows["text"][0], lo, 1
    out["multi"] = np.repeat(rows["multi"], n)
    return out


def sort_stretches(rows: np.ndarray, raw: np.ndarray, at: np.ndarray, width: np.ndarray, length: int) -> np.ndarray:
    """Spans of the repeated strings among the stretches (those that stand for several have theirs)."""
    first = np.cumsum(width + 1) - width - 1
    text = np.zeros(int((width + 1).sum()) + length + 16, dtype=np.uint8)
    index = np.repeat(first, width) + (np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width))
    text[index] = raw[np.repeat(at, width) + (index - np.repeat(first, width))]
    with np.errstate(over="ignore"):
        owner = mix(rows["text"].view(U64) if rows["text"].flags.c_contiguous else np.ascontiguousarray(rows["text"]).view(U64)) + rows["lo"].astype(U64)
    stretch, offset = repeated(text, first, rows["n"].astype(np.int64), owner, rows["multi"] > 0, length)
    new = rows["multi"][stretch] == 0
    stretch, offset = stretch[new], offset[new]
    lo = rows["lo"][stretch] + offset
    return spans_of(rows["text"][stretch], lo, lo + length)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    Null and empty texts have no bytes and the digest of nothing; a text of
    ``length`` bytes or more that stands in two rows goes whole; repeated rows each
    give a row, and are copies of each other; an empty table gives no rows.
    ``with_text`` adds the remaining bytes.
    """
    slices = _slices(docs)
    spans = save(repeated_spans(docs, slices, length, gram, hot), "suffix-spans")
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    marks = spans.selectExpr("slice", "1 AS kind", "CAST(0 AS LONG) AS key", "CAST(NULL AS BINARY) AS text",
                             "CAST(NULL AS ARRAY<LONG>) AS ids", "data")

    def cut(raw: bytes, ids: list, own: np.ndarray):
        n = len(raw)
        if len(ids) > 1 and n >= length:
            ranges, kept = [(0, n)], b""
        else:
            ranges = list(zip(own["lo"].tolist(), own["hi"].tolist()))
            kept, at = [], 0
            for lo, hi in ranges:
                kept.append(raw[at:lo])
                at = hi
            kept = b"".join([*kept, raw[at:]])
        digest = hashlib.sha256(kept).hexdigest()
        for d in ids:
            yield (d, n, n - len(kept), len(ranges), digest, *([kept] if with_text else []))

    def apply(batches):
        now, held, table, texts_of = None, [], np.zeros(0, SPAN), None
        key, raw, ids, out = None, None, [], []
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
        names = [x.split()[0] for x in fields.split(", ")]

        def close():
            a, b = np.searchsorted(table["text"], [key, key], side="left")[0], np.searchsorted(table["text"], key, side="right")
            out.extend(cut(raw, ids, table[a:b]))

        for rb in batches:
            for k, kind, x, t, i, d in each(rb, "slice", "kind", "key", "text", "ids", "data"):
                t = None if t is None else t.to_pybytes()
                if kind == 9 and k == now and not held and x == key:
                    raw = t if raw is None else raw
                    ids += i
                    continue
                if key is not None:
                    close()
                    key = None
                if k != now:
                    now, held, table = k, [], np.zeros(0, SPAN)
                if kind == 1:
                    held.append((d, b""))
                    continue
                if held:
                    rows = _array(held, SPAN)
                    table, held = spans_of(rows["text"], rows["lo"], rows["hi"]), []
                key, raw, ids = x, t, list(i)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if key is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return marks.unionByName(texts_once(docs, slices)).repartition("slice").sortWithinPartitions("slice", "kind", "key") \
        .mapInArrow(apply, fields)
