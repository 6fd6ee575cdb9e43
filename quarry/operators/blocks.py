"""Cutting huge documents over many tasks.

``chunking.chunk_documents`` cuts a document in the task that holds its row.  Here a
document is dealt out in blocks of bytes.  Where the first cut of a block falls depends
on all blocks before it, but only through one number: the offset (0 to ``size`` - 1) of
the first chunk that starts in the block.  So each block works out, for every possible
entry offset, how many chunks start in it and at which offset the chain enters the next
block; these small functions are composed along the document; then every block is cut
at once from the entry it was given.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT_CHUNK_SIZE, DEFAULT_DELIMITERS
from quarry.functions import text as T
from quarry.session import scratch_path

DEFAULT_BLOCK_BYTES = 1 << 20
# Task functions travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def text_blocks(docs: DataFrame, size: int, block_bytes: int, key: str, text_col: str) -> DataFrame:
    """``key, copy, block_no, n_bytes, body``: each block's bytes and the next ``size``, which its
    last chunk may reach into.  ``copy`` tells rows of one key apart.  Blocks are dealt evenly."""
    data = docs.select(F.col(key), F.encode(F.col(text_col), "UTF-8").alias("_b")) \
        .where(F.col(key).isNotNull() & (F.octet_length("_b") > 0)) \
        .withColumn("copy", F.monotonically_increasing_id())
    last = F.floor((F.octet_length("_b") - 1) / F.lit(block_bytes)).cast("int")
    each = data.select(key, "copy", "_b", F.explode(F.sequence(F.lit(0), last)).alias("block_no"))
    start = F.col("block_no") * F.lit(block_bytes)
    return each.select(key, "copy", "block_no",
                       F.least(F.octet_length("_b") - start, F.lit(block_bytes)).alias("n_bytes"),
                       F.substring("_b", start + 1, F.lit(block_bytes + size)).alias("body")).repartition(key, "copy", "block_no")


def next_cuts(body: np.ndarray, n: int, size: int, delimiters: bytes) -> np.ndarray:
    """For a chunk that starts at each of a block's ``n`` positions: where the next one starts.

    ``body`` holds up to ``size`` bytes beyond the block; where it ends earlier, so does the document.
    """
    at = np.arange(n, dtype=np.int32)
    ends = np.minimum(at + size, len(body))
    after = np.where(np.isin(body, np.frombuffer(delimiters, np.uint8)), np.arange(1, len(body) + 1, dtype=np.int32), 0)
    cut = np.maximum.accumulate(after)[ends - 1]
    return np.where(at + size >= len(body), len(body), np.where(cut > at, cut, ends)).astype(np.int32)


def chains(nxt: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry offset: (offset at which the chain enters the next block, chunks started here).

    Doubling: after k rounds every position knows where 2^k cuts lead (positions at
    or past the end stay), so a block takes log2 of its chunks rounds of one array.
    """
    n = len(nxt)
    lead = np.concatenate([np.minimum(nxt, n + size), np.arange(n, n + size + 1, dtype=np.int32)])
    count = np.concatenate([np.ones(n, np.int32), np.zeros(size + 1, np.int32)])
    while (lead[:n] < n).any():
        count = count + count[lead]
        lead = lead[lead]
    entries = np.arange(size)
    return lead[entries] - n, count[entries]


def _block_chains(size: int, delimiters: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exits, counts = [], []
            for n, body in zip(batch.column("n_bytes").to_pylist(), batch.column("body")):
                data = np.frombuffer(body.as_buffer(), np.uint8)
                exit_at, count = chains(next_cuts(data, n, size, delimiters), size)
                exits.append(exit_at.astype(np.int32))
                counts.append(count.astype(np.int32))
            kind = pa.list_(pa.int32())
            cols = [batch.column(c) for c in batch.schema.names if c not in ("n_bytes", "body")]
            names = [c for c in batch.schema.names if c not in ("n_bytes", "body")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(exits, kind), pa.array(counts, kind)], [*names, "exits", "counts"])
    return run


def _cut_blocks(size: int, delimiters: bytes, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, pieces = [], [], []
            for k, n, body, entry, first in zip(batch.column(key).to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("body"),
                                                batch.column("entry").to_pylist(), batch.column("first_no").to_pylist()):
                data = body.as_buffer()
                nxt = next_cuts(np.frombuffer(data, np.uint8), n, size, delimiters)
                cuts, at = [], entry
                while at < n:
                    cuts.append(at)
                    at = int(nxt[at])
                cuts.append(at)
                raw = data.to_pybytes()
                pieces += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
                keys += [k] * (len(cuts) - 1)
                numbers += range(first, first + len(cuts) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(key).type), pa.array(numbers, pa.int32()),
                                              pa.array(pieces, pa.binary())], [key, "chunk_no", "bytes"])
    return run


def entries(maps: DataFrame, key: str) -> DataFrame:
    """``key, copy, block_no, entry, first_no``: the blocks' functions composed along each document.

    A document's functions are 8 x ``size`` bytes a block: one in 128 of its text with the defaults.
    """
    step = "struct(element_at(b.exits, s.entry + 1) AS entry, s.first_no + element_at(b.counts, s.entry + 1) AS first_no," \
           " concat(s.done, array(struct(b.block_no AS block_no, s.entry AS entry, s.first_no AS first_no))) AS done)"
    start = "struct(0 AS entry, 0 AS first_no, CAST(array() AS array<struct<block_no: int, entry: int, first_no: int>>) AS done)"
    walk = F.expr(f"aggregate(array_sort(collect_list(struct(block_no, exits, counts))), {start}, (s, b) -> {step}, s -> s.done)")
    return maps.groupBy(key, "copy").agg(walk.alias("_w")).select(key, "copy", F.inline("_w"))


def chunk_documents(docs: DataFrame, size: int = DEFAULT_CHUNK_SIZE, delimiters: str = DEFAULT_DELIMITERS,
                    key: str = "doc_id", text_col: str = "text", block_bytes: int = DEFAULT_BLOCK_BYTES) -> DataFrame:
    """The chunks of ``chunking.chunk_documents``, each document cut by as many tasks as it has blocks.

    The bytes are exchanged by block and written to the checkpoint folder, since both passes
    read them; the entries (24 bytes a block) come back by a join, which adaptive
    execution broadcasts where they are few.  Tasks share blocks by the size of the files.  Delimiters are ASCII characters.  Empty or NULL text gives
    no chunk; rows of one key are cut apart.
    """
    if size <= 0 or block_bytes < size:
        raise ValueError("chunk size must be positive and at most a block")
    if not delimiters.isascii():
        raise ValueError("delimiters must be ASCII characters")
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "blocks")
    text_blocks(docs, size, block_bytes, key, text_col).write.parquet(path)
    blocks = spark.read.parquet(path)
    kind, marks = blocks.schema[key].dataType.simpleString(), delimiters.encode()
    maps = blocks.mapInArrow(_block_chains(size, marks), f"`{key}` {kind}, copy long, block_no int, exits array<int>, counts array<int>")
    begun = blocks.join(entries(maps, key), [key, "copy", "block_no"], "left")  # an outer join broadcasts the entries or nothing
    cut = begun.mapInArrow(_cut_blocks(size, marks, key), f"`{key}` {kind}, chunk_no int, bytes binary")
    return cut.select(key, "chunk_no", T.lossy_text("bytes").alias("content"), F.octet_length("bytes").alias("n_bytes"))
