"""Helpers shared by the operators of this subpackage.

* Arrow batches cut into pieces of bounded text size, so that a task's Python
  memory follows ``PIECE_BYTES`` (or its one longest text), never its partition.
* Byte-level words ``[^\\x20\\x09-\\x0D]+`` of a whole piece at once, and 64-bit
  hashes of byte ranges from one running polynomial sum.
* Tables in the cluster's shared scratch folder, which cut lineage and survive
  the loss of an executor.
* Connected components by minimum neighbour and pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

PIECE_BYTES = 1 << 20
U64 = np.uint64

#: Space and the five ASCII controls from tab to carriage return; ``bytes.split()``
#: cuts at the same six.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def pieces(batches: Iterable[pa.RecordBatch], text_col: str = "text",
           limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches: under ``limit`` bytes of text each beside the first row."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(rb.column(text_col)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size.astype(np.int64)) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), rb.num_rows]):
            yield rb.slice(a, b - a)


def each(rb: pa.RecordBatch, *names: str):
    """The rows of a batch, binaries as views of its memory."""
    cols = [rb.column(c) for c in names]
    views = [pa.types.is_binary(c.type) for c in cols]
    for k in range(rb.num_rows):
        yield tuple(c[k].as_buffer() if v else c[k].as_py() for c, v in zip(cols, views))


def blob(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 row offsets in them (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_ranges(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; a word never crosses a row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~_SPACE[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = solid
    edge = off[(off > 0) & (off < len(data))]
    starts = solid & ~before[:-1]
    starts[edge] = solid[edge]
    after = np.empty(len(data), dtype=bool)
    after[:-1] = solid[1:]
    after[-1] = False
    ends = solid & ~after
    ends[edge - 1] = solid[edge - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


_BASE = 0x9E3779B97F4A7C15
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("up", ())) < n:
        size = -(-n // (1 << 20)) << 20
        inv = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inv)):
            with np.errstate(over="ignore"):
                p = np.full(size, U64(base))
                p[0] = 1
                _POW[name] = np.cumprod(p, dtype=U64)
    return _POW["up"], _POW["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h = h * U64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> U64(33))
        h = h * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


def running_sum(data: np.ndarray) -> np.ndarray:
    """Prefix sums S with S[e] - S[s] the polynomial of data[s:e] times base ** s."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * up[:len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One mixed 64-bit hash for each byte range, the same wherever the bytes stand."""
    _, down = _powers(len(sums) + 1)
    with np.errstate(over="ignore"):
        return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder of the shared scratch space and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def held_out(key: str, mod: int, rest: int):
    """crc32 of the key as text leaves ``rest`` on division by ``mod`` (null key: false)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod == rest, F.lit(False))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers
    to their ends and contracts the links to the ends that they join; rounds go
    on until no link is left.  Every step is a grouped minimum or an equi-join,
    and lineage is cut after each with a table in the shared folder.
    """
    edges = save(edges.where("a <> b").select(F.least("a", "b").alias("a"),
                                              F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    rounds: list[DataFrame] = []
    while not rounds or not is_empty(edges):
        both = edges.union(edges.select("b", "a"))
        at = save(both.groupBy(F.col("a").alias("node"))
                  .agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "cc-low")
        while True:
            up = at.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = save(at.join(up, "root").select("node", F.col("next").alias("root"),
                                                     (F.col("next") != F.col("root")).alias("moved")), "cc-jump")
            at = jumped.select("node", "root")
            if is_empty(jumped.where("moved")):
                break
        rounds.append(at)
        if is_empty(at):
            break
        a = at.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = at.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = save(edges.join(a, "a").join(b, "b").where("ra <> rb")
                     .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
    out = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = out.join(step, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
