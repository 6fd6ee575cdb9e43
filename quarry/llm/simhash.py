"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: XXH64 (seed 42) of every word shingle, one majority vote per bit.
Search: 64 bits are cut into ``blocks`` runs; two fingerprints within ``radius``
differ in at most ``radius`` runs, so they agree on at least ``blocks - radius``
of them.  Each choice of that many runs is a table of buckets, so no link is
missed.  Inside a bucket the fingerprints are stored vertically: word p of a lane
block holds bit p of 64 of them.  One query is compared with 64 lanes at once:
the XOR of each plane is added to carry-save counters, and a (query, block) is
abandoned as soon as every lane has passed the radius.

Distinct fingerprints are compared, never copies.  A bucket of more than
``tile`` fingerprints is dealt over pairs of tiles, so no task holds it whole,
and a task returns a spanning forest of the links it found, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.base import U64, connected_components, pieces, save

SEED = 42
#: A byte's eight bits, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0].copy()


def text_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of every shingle of the ASCII-lower-cased words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) < shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    starts, ends = at[:len(words) - shingle + 1].tolist(), (at[shingle:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends)]


def majority(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Fingerprint of each row: a bit is set when over half of its hashes have it."""
    out = np.zeros(len(rows), dtype=U64)
    full = np.flatnonzero(rows)
    if not len(full):
        return out
    counts = rows[full]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    # eight counters of one byte in each word; a byte counts at most 255 shingles
    parts = -(-counts // 255)
    first = np.cumsum(parts) - parts
    part_start = np.repeat(starts - 255 * first, parts) + 255 * np.arange(parts.sum())
    lanes = np.add.reduceat(_SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)], part_start, axis=0)
    votes = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int64)
    won = (2 * votes > counts[:, None]).astype(np.uint8)
    out[full] = np.packbits(won, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; no words (null, empty): 0."""

    def run(batches):
        for rb in pieces(batches):
            hashes, rows = [], []
            for t in rb.column("text").to_pylist():
                h = text_hashes(t, shingle)
                hashes.append(np.array(h, dtype=U64))
                rows.append(len(h))
            fp = majority(np.concatenate(hashes), np.array(rows))
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, fp long")


def cut_bits(blocks: int) -> list[int]:
    """The mask of each of ``blocks`` runs of adjacent bits, of nearly equal length."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]


def bucket_links(fp: np.ndarray, run: np.ndarray, against: np.ndarray, radius: int,
                 step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``radius``; ``run`` (ascending) groups the rows.

    Rows of run r are compared with those of run ``against[r]``: r itself (each
    pair once), another run, or -1 (rows that are only compared with).
    """
    n, bits = len(fp), radius.bit_length()
    start = np.searchsorted(run, np.arange(len(against)))
    count = np.diff(np.append(start, n))
    rank = np.arange(n) - start[run]
    blocks_of = -(-count // 64)
    base = np.cumsum(blocks_of) - blocks_of
    block, lane = base[run] + rank // 64, (rank % 64).astype(U64)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(block) > 0]))
    planes = [np.bitwise_or.reduceat(((fp >> U64(p)) & U64(1)) << lane, heads) for p in range(64)]
    filled = np.bitwise_or.reduceat(U64(1) << lane, heads)

    to = against[run]
    own = to == run
    first = np.where(own, block, base[np.maximum(to, 0)])
    tasks = np.where(to < 0, 0, base[np.maximum(to, 0)] + blocks_of[np.maximum(to, 0)] - first)
    tasks[own & (count[run] == 1)] = 0
    ends = np.cumsum(tasks)
    left, right = [], []
    for lo in range(0, int(ends[-1]) if n else 0, step):
        t = np.arange(lo, min(lo + step, int(ends[-1])))
        q = np.searchsorted(ends, t, side="right")
        b = first[q] + (t - (ends[q] - tasks[q]))
        word = fp[q]
        alive = filled[b].copy()
        same = own[q] & (b == block[q])
        alive[same] &= ~((U64(2) << lane[q[same]]) - U64(1))
        counters = [np.zeros(len(q), dtype=U64) for _ in range(bits + 1)]
        for p in range(64):
            carry = planes[p][b] ^ (U64(0) - ((word >> U64(p)) & U64(1)))
            for c in counters[:-1]:
                c ^= carry
                carry = carry & ~c
            counters[-1] |= carry
            if p % 8 == 7:
                alive &= ~_above(counters, radius)
                keep = np.flatnonzero(alive)
                if len(keep) < len(alive) * 0.7:
                    q, b, word, alive = q[keep], b[keep], word[keep], alive[keep]
                    counters = [c[keep] for c in counters]
                    if not len(keep):
                        break
        for k in np.flatnonzero(alive):
            lanes = np.flatnonzero(np.unpackbits(alive[k:k + 1].astype("<u8").view(np.uint8), bitorder="little"))
            left.append(np.full(len(lanes), q[k]))
            right.append(heads[b[k]] + lanes)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter exceeds the radius (the last counter: overflow)."""
    more = np.zeros_like(counters[0])
    equal = ~more
    for k in range(len(counters) - 2, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more |= equal & counters[k]
            equal = equal & ~counters[k]
    return more | counters[-1]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) of the same components as the links a-b among n rows."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        root = new[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    member = np.flatnonzero(root != np.arange(n))
    return root[member], member


def links(distinct: DataFrame, radius: int = 4, blocks: int = 6, tile: int = 4096) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` within ``radius`` bits."""
    masks = cut_bits(blocks)
    tables = [sum(c) for c in combinations(masks, blocks - radius)]
    as_long = [m - (1 << 64) if m >> 63 else m for m in tables]
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(as_long)
    ])).alias("x")).select("x.t", "x.k", "fp")
    hot = keyed.groupBy("t", "k").count().where(F.col("count") > tile) \
        .select("t", "k", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = keyed.join(hot, ["t", "k"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))) \
        .withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))) \
        .select("t", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                (F.col("mine") > F.col("other")).cast("int").alias("side"), "fp") \
        .repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "side")

    def compare(cols: dict[str, np.ndarray]):
        fp = cols["fp"].view(U64)
        names = ("t", "k", "i", "j")
        new = np.concatenate([[True], np.any([np.diff(cols[c]) != 0 for c in (*names, "side")], axis=0)])
        run = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        i, j, side = (cols[c][head] for c in ("i", "j", "side"))
        against = np.arange(len(head))
        split = i != j
        pair = np.zeros(len(head), dtype=bool)
        if len(head) > 1:
            pair[:-1] = (side[1:] == 1) & (side[:-1] == 0) & np.all([cols[c][head[1:]] == cols[c][head[:-1]] for c in names], axis=0)
        against[split] = np.where(pair[split], against[split] + 1, -1)
        a, b = bucket_links(fp, run, against, radius)
        r, m = forest(a, b, len(fp))
        return pa.RecordBatch.from_arrays([pa.array(cols["fp"][r]), pa.array(cols["fp"][m])], ["a", "b"])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for rb in batches:
            now = {c: rb.column(c).to_numpy(zero_copy_only=False) for c in rb.schema.names}
            held = {c: np.concatenate([held[c], now[c]]) for c in now} if held else now
            if len(held["fp"]) < 1 << 17:
                continue
            same = np.all([held[c] == held[c][-1] for c in ("t", "k", "i", "j")], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield compare({c: x[:cut] for c, x in held.items()})
                held = {c: x[cut:] for c, x in held.items()}
        if held and len(held["fp"]):
            yield compare(held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 6,
                    tile: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, root): the group of each document under the links.

    ``component_id`` is the smallest non-null id of the group (null when the group
    has none), ``root`` its smallest fingerprint, which tells groups apart where ids repeat.  Null and empty texts have fingerprint 0 and are linked like any
    other; repeated rows each give a row; an empty table gives no rows.
    """
    fps = save(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(links(fps.select("fp").distinct(), radius, blocks, tile))
    at = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    at = save(at, "simhash-roots")
    lowest = at.groupBy("root").agg(F.min("rep").alias("component_id"))
    member = at.join(lowest, "root").select("fp", "component_id", "root")
    return fps.join(member, "fp").select("doc_id", "fp", "component_id", "root")


def hex_fingerprint(col: str = "fp"):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def keep_one(docs: DataFrame, groups: DataFrame, shingle: int = 4) -> DataFrame:
    """One document of each group, with the smallest id in it; rows without id stay.

    ``groups``: ``near_duplicates(docs)``.  Where rows share an id, each counts for the group of
    its own fingerprint (computed again for those rows only), so an unrelated text
    under the same id is kept for its group; of several rows of one group with its
    smallest id, the one with the smallest text stays.
    """
    groups = save(groups, "simhash-groups")
    chosen = groups.where("component_id = doc_id").groupBy("doc_id", "root").agg(F.min("fp").alias("fp"))
    often = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    named = docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    once = named.join(often, "doc_id", "left_anti")
    shared = named.join(often, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text"))
    prints = fingerprints(shared.select(F.col("_text").alias("doc_id"), "text"), shingle).distinct() \
        .select(F.col("doc_id").alias("_text"), F.col("fp").alias("_fp"))
    picked = chosen.select("doc_id", F.col("fp").alias("_fp"), F.col("root").alias("_root"))
    first = Window.partitionBy("doc_id", "_root").orderBy("text")
    several = shared.join(prints, "_text").join(picked, ["doc_id", "_fp"]) \
        .withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return once.select(*docs.columns).unionByName(several.select(*docs.columns)).unionByName(docs.where("doc_id IS NULL"))
