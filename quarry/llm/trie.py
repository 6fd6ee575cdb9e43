"""Prefix trie of conversations as a minimal-perfect-hash node table.

A node is a distinct sequence of first turns.  Its digest is a polynomial over the
SHA-256 of the turns, modulo 2**127 - 1, so that prefixes of one conversation that
several tasks hold are joined from their parts.  Equal digests are counted by a grouped
sum: conversations that many copy are added up where they are read.

The table is split into shards, each a whole subtree: a node with at most ``T`` rows
(conversations times their remaining turns) at or below it is light, and the topmost
light nodes are the roots of the shards.  A task lays whole shards out as flat numpy
arrays: digests get slots from a minimal perfect hash, a digest found in its
slot is compared in full, and counts are scattered to slots and added up through the
array of parent slots, deepest first.  The heavy nodes above, fewer than
``SHARDS`` at each depth, then do the same with what their light children hand up.

Texts are read once, for their digest and number of words, and never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import U64, mix, save

PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F
LIGHT = 1 << 17      # rows at or below a light node, if the input is small
SHARDS = 1 << 16     # heavy nodes at each depth, at most, if it is large
TABLE = 1 << 16      # nodes that a task lays out at once, at least
SEND_ROWS = 1 << 20  # heavy nodes (32 bytes each) that are broadcast; more are joined by salted keys
SALTS = 16
_LOW = (1 << 64) - 1


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, words, row): narrow rows of the turns; t1, t2 digest (role, text)."""
    said = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return said.select("conv_id", "turn", F.expr("sha2(concat(octet_length(role), ':', role, text), 256)").alias("digest"),
                       F.expr(r"CAST(regexp_count(text, '[^\\x20\\x09-\\x0D]+') AS LONG)").alias("words")) \
        .select("conv_id", "turn", F.expr("CAST(conv(substr(digest, 1, 16), 16, -10) AS LONG)").alias("t1"),
                F.expr("CAST(conv(substr(digest, 17, 16), 16, -10) AS LONG)").alias("t2"), "words",
                F.monotonically_increasing_id().alias("row"))


def _carried(sorted_rows: DataFrame, last: str) -> list[tuple]:
    """For each partition of sorted rows (one result row each): part, first conversation, and its last one's last row."""
    got = sorted_rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.expr(f"struct({last})")).alias("last")).collect()
    return sorted((r.part, r["first"], tuple(r["last"])) for r in got)


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, k, t1, t2, words): every turn's place in its conversation, by turn (null first), then digest.

    Turns are ranged over tasks by all their columns, so that a conversation of any
    length is spread; each task counts from 0 and what earlier ones held is added.
    """
    def count(batches):
        part, conv, k = TaskContext.get().partitionId(), None, 0
        for rb in batches:
            if not rb.num_rows:
                continue
            ids = rb.column("conv_id").to_numpy()
            new = np.concatenate([[ids[0] != conv], ids[1:] != ids[:-1]])
            at = np.arange(len(ids))
            place = at - np.maximum.accumulate(np.where(new, at, 0))
            if not new[0]:
                place[:int(np.argmax(new)) if new.any() else len(ids)] += k
            conv, k = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), rb.column("conv_id"), pa.array(place.astype(np.int64)), *(rb.column(c) for c in ("t1", "t2", "words"))],
                ["part", "conv_id", "k", "t1", "t2", "words"])

    order = ["conv_id", "turn", "t1", "t2", "row"]
    local = save(turns.repartitionByRange(*order).sortWithinPartitions(*order)
                 .mapInArrow(count, "part int, conv_id long, k long, t1 long, t2 long, words long"), "trie-turns")
    rows, held = [], (None, 0)
    for part, first, (last, k) in _carried(local, "conv_id, k"):
        before = held[1] if held[0] == first else 0
        if before:
            rows.append((part, first, before))
        held = last, k + 1 + (before if last == first else 0)
    ahead = turns.sparkSession.createDataFrame(rows, "part int, conv_id long, before long")  # one row a partition at most
    return local.join(F.broadcast(ahead), ["part", "conv_id"], "left") \
        .select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("k"), "t1", "t2", "words")


def as_they_are(turns: DataFrame) -> DataFrame:
    """Paths of the conversations: (conv_id, block, k, t1, t2, words), block -1 for the start of each, 1 for its turns."""
    starts = turns.where("k = 0").selectExpr("conv_id", "-1 AS block", "0L AS k", "0L AS t1", "0L AS t2", "0L AS words")
    return starts.unionByName(turns.selectExpr("conv_id", "1 AS block", "k", "t1", "t2", "words"))


def with_shared_starts(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Paths in which the first h turns of conversation c are those of c - c % every; h = crc32(c) % most."""
    h = f"crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {most}"
    own = turns.where(f"conv_id % {every} = 0 OR k >= {h}").selectExpr("conv_id", "1 AS block", "k", "t1", "t2", "words")
    starts = turns.where("k = 0").select("conv_id")
    heads = turns.where(f"conv_id % {every} = 0 AND k < {most - 1}").selectExpr("conv_id AS base", "k", "t1", "t2", "words")
    lent = starts.where(f"conv_id % {every} <> 0").selectExpr("conv_id", f"conv_id - conv_id % {every} AS base", f"{h} AS h") \
        .join(heads, "base").where("k < h").selectExpr("conv_id", "0 AS block", "k", "t1", "t2", "words")
    return starts.selectExpr("conv_id", "-1 AS block", "0L AS k", "0L AS t1", "0L AS t2", "0L AS words").unionByName(lent).unionByName(own)


def _whole(hi: int, lo: int) -> int:
    return (hi & _LOW) << 64 | lo & _LOW


def _halves(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(v.to_bytes(16, "little") for v in values), np.int64).reshape(-1, 2)
    return both[:, 1], both[:, 0]


_PREFIX = ["conv_id", "depth", "n1", "n2", "p1", "p2", "words", "below"]
_PREFIX_TYPES = "conv_id long, depth long, n1 long, n2 long, p1 long, p2 long, words long, below long"


def prefixes(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, n1, n2, p1, p2, words, below): every prefix of every path.

    n1, n2: its digest; p1, p2: its parent's; words: of its last turn; below: turns that
    follow it.  A task digests its part of a path from 0; parts are joined by
    D = D0 + BASE ** n0 * D', with n0 turns and digest D0 before it.
    """
    def digest(batches):
        part = TaskContext.get().partitionId()
        conv, rows = None, []  # of the conversation being read: block, digest, parent, words

        def flush():
            n1, n2 = _halves([r[0] for r in rows])
            p1, p2 = _halves([r[1] for r in rows])
            depth = np.array([r[3] for r in rows], np.int64)
            return [np.full(len(rows), conv, np.int64), depth, n1, n2, p1, p2, np.array([r[2] for r in rows], np.int64), depth[-1] - depth]

        def batch(done):
            cols = [np.concatenate(c) for c in zip(*done)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), part, np.int32)), *map(pa.array, cols)], ["part", *_PREFIX])

        done, size = [], 0
        value = power = depth = 0
        for rb in batches:
            for c, block, t1, t2, words in zip(*(rb.column(x).to_pylist() for x in ("conv_id", "block", "t1", "t2", "words"))):
                if c != conv:
                    if rows:
                        done.append(flush())
                        size += len(rows)
                        if size >= TABLE:
                            yield batch(done)
                            done, size = [], 0
                    conv, rows, value, power, depth = c, [], 0, 1, 0
                before = value
                if block >= 0:
                    value = (value + (_whole(t1, t2) % PRIME) * power) % PRIME
                    power = power * BASE % PRIME
                    depth += 1
                rows.append((value, before, words, depth))
        if rows:
            done.append(flush())
            yield batch(done)

    order = ["conv_id", "block", "k"]
    local = save(save(paths, "trie-paths").repartitionByRange(*order).sortWithinPartitions(*order)
                 .mapInArrow(digest, f"part int, {_PREFIX_TYPES}"), "trie-local")
    # turns and digest before the first conversation of a partition, if it began in an earlier one: one entry a partition at most
    ahead: dict[int, tuple[int, int, int]] = {}
    held: tuple = (None, 0, 0)
    for part, first, (last, depth, n1, n2) in _carried(local, "conv_id, depth, n1, n2"):
        n0, d0 = held[1:] if held[0] == first else (0, 0)
        if held[0] == first:
            ahead[part] = first, n0, d0
        held = (last, n0 + depth, (d0 + pow(BASE, n0, PRIME) * _whole(n1, n2)) % PRIME) if last == first else (last, depth, _whole(n1, n2))
    several = local.sparkSession.createDataFrame([(c,) for c in sorted({x[0] for x in ahead.values()})], "conv_id long")
    total = {r.conv_id: r.n for r in local.join(F.broadcast(several), "conv_id").groupBy("part", "conv_id").agg(F.max("depth").alias("n"))
             .groupBy("conv_id").agg(F.sum("n").alias("n")).collect()} if ahead else {}
    sent = local.sparkSession.sparkContext.broadcast((ahead, total))

    def joined(batches):
        ahead, total = sent.value
        whole = np.array(sorted(total), np.int64)
        for rb in batches:
            cols = {c: rb.column(c).to_numpy().copy() for c in _PREFIX}
            part = rb.column("part").to_numpy()
            across = np.flatnonzero(np.isin(cols["conv_id"], whole))
            for p in np.unique(part[across]).tolist():
                mine = across[part[across] == p]
                if p in ahead:
                    conv, n0, d0 = ahead[p]
                    at = mine[cols["conv_id"][mine] == conv]
                    power = pow(BASE, n0, PRIME)
                    for hi, lo in (("n1", "n2"), ("p1", "p2")):
                        if len(at):
                            cols[hi][at], cols[lo][at] = _halves([(d0 + power * _whole(a, b)) % PRIME for a, b in zip(cols[hi][at].tolist(), cols[lo][at].tolist())])
                    cols["depth"][at] += n0
            cols["below"][across] = [total[c] for c in cols["conv_id"][across].tolist()] - cols["depth"][across] if len(across) else 0
            yield pa.RecordBatch.from_arrays([pa.array(cols[c]) for c in _PREFIX], _PREFIX)

    return save(local.mapInArrow(joined, _PREFIX_TYPES), "trie-prefixes")


class SlotTable:
    """A minimal perfect hash of distinct digests: each gets its own slot from 0 to n - 1.

    Level by level, digests that are alone in their cell of a bit array stay there and
    the others go on to the next array; a slot is the number of set bits before the cell.
    """

    CELLS = 2  # cells for each digest that a level gets

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[np.ndarray] = []  # of each level: the slot of a cell, or -1
        self.hi, self.lo = np.zeros(len(hi), np.int64), np.zeros(len(lo), np.int64)
        left, taken = np.arange(len(hi)), 0
        while len(left):
            size = self.CELLS * len(left) + 1
            cell = self._cell(hi[left], lo[left], len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            slot = np.where(alone, np.cumsum(alone) - 1 + taken, -1)
            taken += int(alone.sum())
            placed = alone[cell]
            at = slot[cell[placed]]
            self.hi[at], self.lo[at] = hi[left[placed]], lo[left[placed]]
            self.levels.append(slot)
            left = left[~placed]
            if len(self.levels) > 200:
                raise ValueError("two nodes have one digest")

    @staticmethod
    def _cell(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(hi.astype(U64) * U64(0x9E3779B97F4A7C15) + mix(lo.astype(U64) + U64(level))) % U64(size)).astype(np.int64)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 if it has none: the whole digest in the slot is compared."""
        out, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, slot in enumerate(self.levels):
            at = slot[self._cell(hi[left], lo[left], level, len(slot))]
            out[left[at >= 0]] = at[at >= 0]
            left = left[at < 0]
        found = np.flatnonzero(out >= 0)
        wrong = found[(self.hi[out[found]] != hi[found]) | (self.lo[out[found]] != lo[found])]
        out[wrong] = -1
        return out


_NODE = ["conv_id", "depth", "n1", "n2", "p1", "p2", "n_convs", "words"]
_SUMS = ["above", "n_children", "n_leaves", "saved_tokens"]
_DONE = ["conv_id", "depth", "n1", "n2", "p1", "p2", "parent_conv_id", "top", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_DONE_TYPES = ", ".join(f"{c} {'boolean' if c == 'top' else 'long'}" for c in _DONE)


def accumulate(t: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Subtree sums of whole shards, beginning with what lies below them (``_SUMS``)."""
    table = SlotTable(t["n1"], t["n2"])
    slot, up = table.find(t["n1"], t["n2"]), table.find(t["p1"], t["p2"])
    up[t["depth"] == 0] = -1
    n = len(slot)

    def scattered(x: np.ndarray) -> np.ndarray:
        out = np.empty(n, x.dtype)
        out[slot] = x
        return out

    parent, depth, conv = scattered(up), scattered(t["depth"]), scattered(t["conv_id"])
    children, leaves, saved = (scattered(t[c]) for c in _SUMS[1:])
    saved += scattered((t["n_convs"] - 1) * t["words"])
    inside = parent >= 0
    np.add.at(children, parent[inside], 1)
    leaves[children == 0] = 1
    order = np.argsort(-depth, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        at = at[inside[at]]
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
    above = np.where(up >= 0, conv[up], t["above"])
    cols = {**{c: t[c] for c in _NODE}, "parent_conv_id": pa.array(above, mask=t["depth"] == 0), "top": up < 0,
            "n_children": children[slot], "n_leaves": leaves[slot], "saved_tokens": saved[slot]}
    return pa.RecordBatch.from_arrays([x if isinstance(x := cols[c], pa.Array) else pa.array(x) for c in _DONE], _DONE)


def _laid_out(batches):
    """Whole shards (rows sorted by r1, r2), many small ones at once."""
    held: list[dict] = []
    size = 0
    for rb in batches:
        if not rb.num_rows:
            continue
        now = {c: rb.column(c).to_numpy() for c in [*_NODE, *_SUMS, "r1", "r2"]}
        if size >= TABLE:
            # the last shard held may go on in this batch
            r1, r2 = held[-1]["r1"][-1], held[-1]["r2"][-1]
            new = (now["r1"] != r1) | (now["r2"] != r2)
            cut = int(np.argmax(new)) if new.any() else len(new)
            held.append({c: x[:cut] for c, x in now.items()})
            if cut == len(new):
                size += cut
                continue
            yield accumulate({c: np.concatenate([h[c] for h in held]) for c in held[0]})
            held, size, now = [], 0, {c: x[cut:] for c, x in now.items()}
        held.append(now)
        size += len(now["r1"])
    if held:
        yield accumulate({c: np.concatenate([h[c] for h in held]) for c in held[0]})


def ends_digests(rows: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256): SHA-256 of the decimal conv_ids of each node, ascending, comma-joined.

    ``rows``: n1, n2, conv_id.  They are ranged by all three, so a node of any number of
    conversations is sorted by many tasks.  A node inside one task's range is digested
    there; the first and last of a range go on as packed ids to one more task, which
    streams them in order (a digest of one text can't be split).
    """
    def work(batches):
        open_ids: list[np.ndarray] = []  # of the node being read
        node, first = None, True

        def packed(last: bool):
            ids = np.concatenate(open_ids)
            whole = not first and not last
            data = None if whole else pa.compress(np.diff(ids, prepend=0).tobytes(), "zstd", asbytes=True)
            sha = hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() if whole else None
            return *node, int(ids[0]), len(ids), data, sha

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

        names = ["n1", "n2", "low", "n", "ids", "sha"]
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]
        out, held = [], 0
        for rb in batches:
            n1, n2, ids = (rb.column(c).to_numpy() for c in ("n1", "n2", "conv_id"))
            if not len(ids):
                continue
            cuts = np.flatnonzero((n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                here = int(n1[a]), int(n2[a])
                if here != node:
                    if node is not None:
                        out.append(packed(False))
                        first = False
                    node, open_ids, held = here, [], 0
                elif held >= 1 << 18:  # a long list goes on in portions
                    first = True
                    out.append(packed(False))
                    open_ids, held = [], 0
                open_ids.append(ids[a:b])
                held += b - a
            if len(out) >= 1 << 14:
                yield batch(out)
                out = []
        if node is not None:
            out.append(packed(True))
        if out:
            yield batch(out)

    def stream(batches):
        node, sha = None, None
        for rb in batches:
            out = []
            for n1, n2, n, ids in zip(*(rb.column(c).to_pylist() for c in ("n1", "n2", "n", "ids"))):
                text = ",".join(map(str, np.cumsum(np.frombuffer(pa.decompress(ids, 8 * n, "zstd", asbytes=True), np.int64)).tolist()))
                if (n1, n2) != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (n1, n2), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["n1", "n2", "sha"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], ["n1", "n2", "sha"])

    order = ["n1", "n2", "conv_id"]
    parts = save(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
                 .mapInArrow(work, "n1 long, n2 long, low long, n long, ids binary, sha string"), "trie-ends")
    edges = parts.where("sha IS NULL").select("n1", "n2", "low", "n", "ids").repartition("n1", "n2") \
        .sortWithinPartitions("n1", "n2", "low").mapInArrow(stream, "n1 long, n2 long, sha string")
    return parts.where("sha IS NOT NULL").select("n1", "n2", "sha").unionByName(edges).withColumnRenamed("sha", "ends_sha256")


def _sent(heavy: DataFrame, small: bool) -> DataFrame:
    """Heavy nodes for a join by digest and salt: broadcast while their number is checked to be small."""
    salted = heavy.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return F.broadcast(salted) if small else salted


def node_table(prefix_rows: DataFrame, light: int = LIGHT) -> DataFrame:
    """Every node of the trie with its counts, from ``prefixes``.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    spark = prefix_rows.sparkSession
    nodes = save(prefix_rows.groupBy("n1", "n2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("words").alias("words"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("below") + 1).alias("rows")), "trie-nodes")
    most = nodes.agg(F.max("rows")).first()[0] or 0
    limit = max(light, most // SHARDS)
    heavy = nodes.where(F.col("rows") > limit)
    small = heavy.select("conv_id").limit(SEND_ROWS + 1).count() <= SEND_ROWS
    own = _sent(heavy.select(F.col("n1"), F.col("n2")), small)
    up = _sent(heavy.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("above")), small)
    # the topmost light node of each conversation is the root of the shard of all that lies below it
    tops = prefix_rows.select("conv_id", "depth", "n1", "n2", "p1", "p2", F.pmod("conv_id", F.lit(SALTS)).cast("int").alias("salt")) \
        .join(own, ["n1", "n2", "salt"], "left_anti").join(up, ["p1", "p2", "salt"], "left") \
        .where("above IS NOT NULL OR depth = 0").select("conv_id", F.col("n1").alias("r1"), F.col("n2").alias("r2"), "above")
    zero = F.lit(0).cast("long")
    shards = nodes.where(F.col("rows") <= limit).join(tops, "conv_id") \
        .select(*_NODE, F.coalesce("above", zero).alias("above"), *(zero.alias(c) for c in _SUMS[1:]), "r1", "r2")
    done = save(shards.repartition("r1", "r2").sortWithinPartitions("r1", "r2").mapInArrow(_laid_out, _DONE_TYPES), "trie-shards")
    handed = done.where("top AND depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    # fewer than SHARDS nodes at each depth: one table
    above = heavy.join(handed, ["n1", "n2"], "left").select(
        *_NODE, zero.alias("above"), *(F.coalesce(c, zero).alias(c) for c in _SUMS[1:]), zero.alias("r1"), zero.alias("r2")) \
        .repartition(1).mapInArrow(_laid_out, _DONE_TYPES)
    ends = ends_digests(prefix_rows.where("below = 0"))
    return done.unionByName(above).join(ends, ["n1", "n2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, shared_starts: bool = False, light: int = LIGHT) -> DataFrame:
    """The trie of all conversations: one row for each distinct sequence of first turns, with the root.

    ``conversations``: conv_id, turn, role, text; other columns are not read.  Turns go by
    turn, null first, and ties by the digest of (role, text); null role or text is
    empty.  A null conv_id names no conversation: its rows belong to none.  Repeated rows
    are turns of their own.  An empty table has no conversation, no root and no rows.
    ``shared_starts``: conversations are rebuilt by ``with_shared_starts`` first; one
    left without turns is a member of the root.  Texts of any length only meet their digest.
    """
    turns = numbered(save(turns_of(conversations), "trie-said"))
    return node_table(prefixes((with_shared_starts if shared_starts else as_they_are)(turns)), light)
