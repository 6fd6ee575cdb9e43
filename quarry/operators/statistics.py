"""Corpus statistics: mean chunk length and document frequencies, and the weights made from them.

Off by default.  ``Settings(avgdl="corpus")`` takes the mean length of the corpus' chunks
in place of the fixed one, ``Settings(idf=True)`` multiplies the query side of the dot
product by the inverse document frequency, so no posting is touched for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import BROADCAST_QUERY_TERMS_MAX_ROWS
from quarry.operators import skew
from quarry.operators.terms import CHUNK_KEYS


@dataclass(frozen=True)
class CorpusStats:
    size: DataFrame     # n_chunks, avgdl: one row, over the chunks that have terms
    terms: DataFrame    # term_index, df: in how many chunks a term of the index occurs


def marked(postings: DataFrame, keys=CHUNK_KEYS) -> DataFrame:
    """Postings with ``head`` (one row of each chunk) and ``new`` (one of each index of a chunk).

    Made where chunks are still together, so that statistics can be counted later from rows
    that are stored in any order, without bringing chunks together again.
    """
    w = Window.partitionBy(*keys).orderBy("term_index")
    return postings.select("*", (F.row_number().over(w) == 1).alias("head"),
                           (~F.lag("term_index").over(w).eqNullSafe(F.col("term_index"))).alias("new"))


def corpus_stats(postings: DataFrame, keys=CHUNK_KEYS) -> CorpusStats:
    """Statistics of term rows with ``dl`` and ``term_index``.

    Chunks are partitioned on their keys already, so lengths and the terms of a chunk
    are grouped in place; only (term_index, partial count) rows are exchanged.  Rows
    that are :func:`marked` need no grouping by chunk.
    """
    keys = list(keys)
    if "head" in postings.columns:
        size = postings.where("head").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avgdl"))
        return CorpusStats(size, postings.where("new").groupBy("term_index").agg(F.count(F.lit(1)).alias("df")))
    size = (postings.groupBy(*keys).agg(F.first("dl").alias("dl"))
                    .agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avgdl")))
    held = postings.select(*keys, "term_index").distinct()
    return CorpusStats(size, held.groupBy("term_index").agg(F.count(F.lit(1)).alias("df")))


def idf(df, n_chunks) -> Column:
    """``ln(1 + (N - df + 1/2) / (df + 1/2))``: positive for every df up to N."""
    df = F.col(df) if isinstance(df, str) else df
    n = F.lit(n_chunks).cast("double") if not isinstance(n_chunks, Column) else n_chunks.cast("double")
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def query_idf(qvec: DataFrame, stats: CorpusStats, n_chunks: int, max_query_terms: int) -> DataFrame:
    """Query weights times idf.  Terms that no chunk holds go: they can match nothing.

    The frequencies are cut down to the batch's terms first, and broadcast only where
    the batch's token count bounds them.
    """
    wanted = qvec.select("term_index").distinct()
    small = max_query_terms <= BROADCAST_QUERY_TERMS_MAX_ROWS
    df = stats.terms.join(F.broadcast(wanted) if small else wanted, "term_index", "left_semi")
    return (qvec.join(F.broadcast(df) if small else df, "term_index")
                .select("query_id", "term_index", (F.col("weight") * idf("df", n_chunks)).alias("weight")))


def with_document_frequency(postings: DataFrame, stats: CorpusStats, keys=CHUNK_KEYS, stored: bool = False) -> DataFrame:
    """Every posting with the ``df`` of its term; the rows of a hot term are spread, or stay where they are if ``stored``."""
    table = stats.terms.withColumn("_rows", F.col("df"))
    return skew.lookup(postings, table, ["term_index"], "df", "_rows", list(keys), stored=stored)
