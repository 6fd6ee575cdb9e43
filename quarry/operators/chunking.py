"""Chunking: documents -> byte-bounded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT_CHUNK_SIZE, DEFAULT_DELIMITERS, SPREAD_BYTES
from quarry.functions import text as T


def spread_chunks(chunks: DataFrame, sized: DataFrame, n_bytes, *keys: str) -> DataFrame:
    """``chunks`` hash-partitioned on ``keys``, so many ways that a task gets about ``SPREAD_BYTES`` of text.

    ``n_bytes`` of ``sized`` adds up to the text (one cheap pass).  Left to itself, adaptive
    execution merges partitions until each core has one, and a task's hash tables grow
    with the input.
    """
    if sized.isStreaming:
        return chunks.repartition(*keys)
    total = sized.agg(F.sum(n_bytes).alias("t")).first()["t"] or 0
    parallel = sized.sparkSession.sparkContext.defaultParallelism
    return chunks.repartition(max(-(-total // SPREAD_BYTES), parallel), *keys)


def chunk_documents(docs: DataFrame, size: int = DEFAULT_CHUNK_SIZE,
                    delimiters: str = DEFAULT_DELIMITERS, key: str = "doc_id",
                    text_col: str = "text", spread: bool = True) -> DataFrame:
    """``(key, text)`` -> ``chunks(key, chunk_no, content, n_bytes)``.

    Chunks are at most ``size`` bytes, contiguous and non-overlapping; their
    bytes concatenate back to the document.  A cut inside a multi-byte char
    leaves U+FFFD in both neighbours.  Empty or NULL text gives no chunk.

    With ``spread`` the chunks are hash-partitioned on ``(key, chunk_no)``:
    one exchange of chunk text that splits long documents over many tasks
    and satisfies every later per-chunk grouping without another shuffle.  The
    text is measured first, for :func:`spread_chunks`.
    """
    starts = (docs.select(F.col(key), F.col(text_col).alias("_t"))
                  .where(F.col(key).isNotNull() & F.col("_t").isNotNull() & (F.length("_t") > 0))
                  .select(key, T.byte_pieces("_t", size, delimiters).alias("_pb"))
                  .select(key, "_pb", T.piece_lengths("_pb").alias("_pl"))
                  .select(key, "_pb", T.pack_pieces("_pl", size).alias("_s")))
    pieces = starts.select(key, T.join_pieces("_pb", "_s").alias("_c"))
    # The outer form keeps Spark from inferring a size filter on the array,
    # which would inline (and re-run) the whole cutting expression.
    out = (pieces.select(key, F.posexplode_outer("_c").alias("chunk_no", "_bin"))
                 .where(F.col("_bin").isNotNull() & F.col("chunk_no").isNotNull())
                 .select(key, F.col("chunk_no").cast("int").alias("chunk_no"),
                         T.lossy_text("_bin").alias("content"),
                         F.octet_length("_bin").cast("int").alias("n_bytes")))
    if spread:
        out = spread_chunks(out, docs, F.octet_length(text_col), key, "chunk_no")
    return out


def chunk_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks per document with min / max / mean chunk bytes."""
    return (chunks.groupBy(key)
                  .agg(F.count(F.lit(1)).alias("n_chunks"),
                       F.sum("n_bytes").alias("total_bytes"),
                       F.min("n_bytes").alias("min_bytes"),
                       F.max("n_bytes").alias("max_bytes"),
                       F.round(F.avg("n_bytes"), 6).alias("avg_bytes")))


def text_sizes(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and characters of each text (the reference's "chars" are bytes)."""
    return docs.select(key, F.octet_length(text_col).cast("bigint").alias("n_bytes"),
                       F.char_length(text_col).cast("bigint").alias("n_chars"))
