"""A document cut by many tasks is cut as one task cuts it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import blocks, chunking
from test_chunking import sequential_cuts


def _chain(data: bytes, size: int, block: int) -> list[bytes]:
    """Blocks, their functions composed, and the cuts made from the entries: no Spark."""
    out, entry = [], 0
    for start in range(0, len(data), block):
        n, body = min(block, len(data) - start), np.frombuffer(data[start:start + block + size], np.uint8)
        nxt = blocks.next_cuts(body, n, size, b"\n.?")
        exits, counts = blocks.chains(nxt, size)
        at, cuts = entry, []
        while at < n:
            cuts.append(data[start + at:start + int(nxt[at])])
            at = int(nxt[at])
        assert (at - n, len(cuts)) == (exits[entry], counts[entry])
        out, entry = out + cuts, int(exits[entry])
    return out


@pytest.mark.parametrize("seed", range(60))
def test_composed_blocks_equal_one_pass(seed):
    r = random.Random(seed)
    data = bytes(r.choice(b"ab.\n?cdefgh" if seed % 3 else b"abcdefg") for _ in range(r.randrange(1, 400)))
    size = r.randrange(1, 20)
    assert _chain(data, size, size + r.randrange(0, 40)) == sequential_cuts(data, size, b"\n.?")


@pytest.mark.parametrize("length", [15, 16, 17, 31, 32, 33, 48])
def test_documents_that_end_at_a_block(length):
    for text in (b"x" * length, b"." * length, b"x" * (length - 1) + b"."):
        assert _chain(text, 8, 16) == sequential_cuts(text, 8, b"\n.?")


def _rows(df):
    return sorted(map(tuple, df.select("doc_id", "chunk_no", "content", "n_bytes").collect()))


def test_equal_to_the_cutter_with_multibyte_text(spark):
    r = random.Random(5)
    docs = spark.createDataFrame(
        [(n, "".join(r.choice("aé龘😀.\n? ") for _ in range(r.randrange(0, 900)))) for n in range(40)] + [(41, None), (42, ""), (None, "x")],
        "doc_id long, text string")
    assert _rows(blocks.chunk_documents(docs, size=16, block_bytes=64)) == _rows(chunking.chunk_documents(docs, size=16))


def test_rows_of_one_key_are_cut_apart(spark):
    docs = spark.createDataFrame([(1, "one. two. three."), (1, "one. two. three."), (1, "other")], "doc_id long, text string")
    assert _rows(blocks.chunk_documents(docs, size=6, block_bytes=8)) == _rows(chunking.chunk_documents(docs, size=6))


def test_one_document_is_cut_by_several_tasks(spark):
    text = F.expr("array_join(transform(sequence(id, id + 79999), i -> sha2(CAST(i AS STRING), 256)), '. ')")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    cut = blocks.chunk_documents(docs, block_bytes=1 << 18)
    per_task = cut.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum("n_bytes").alias("n")).collect()
    total = 66 * 80_000 - 2
    assert sum(r.n for r in per_task) == total
    assert len(per_task) > 1 and max(r.n for r in per_task) < total * 0.7


def test_bad_parameters(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for bad in ({"size": 0}, {"size": 10, "block_bytes": 5}, {"delimiters": "é"}):
        with pytest.raises(ValueError):
            blocks.chunk_documents(docs, **bad)
