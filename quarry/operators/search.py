"""Batch retrieval: query vectors x postings -> scores -> top-k hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import (BROADCAST_HITS_MAX_ROWS, BROADCAST_QUERY_TERMS_MAX_ROWS,
                           HOT_TERM_SALTS, MAX_HOT_TERMS, RANK_SALTS, SCORE_DECIMALS, Settings)
from quarry.operators import terms


def query_defaults(queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``query_id, query, limit, model`` with NULL limit / model defaulted."""
    return queries.select(
        "query_id", "query",
        F.coalesce(F.col("limit").try_cast("bigint"), F.lit(settings.default_limit)).alias("limit"),
        F.coalesce(F.col("model"), F.lit(settings.default_model)).alias("model"))


def query_vectors(queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``query_id, term_index, weight``: queries embedded like chunks (term level).

    Terms that share an index are not folded here: the dot product over
    term-level rows equals the one over folded vectors, since summing the
    weights of one index distributes over the product.
    """
    post = terms.embed(queries, terms.QUERY_KEYS, "query", settings)
    return post.select("query_id", "term_index", "weight")


def chunk_vectors(postings: DataFrame) -> DataFrame:
    """``doc_id, chunk_no, term_index, weight`` folded by index."""
    return terms.folded_weights(postings, terms.CHUNK_KEYS)


def _small(df: DataFrame, max_rows: int) -> bool:
    """Size check before a broadcast: count the rows of a (small) side."""
    return df.limit(max_rows + 1).count() <= max_rows


def batch_bounds(queries: DataFrame) -> dict:
    """One aggregate over the raw query batch: count, largest k, and an upper
    bound of query-term rows (tokens before stop-word removal)."""
    from quarry.functions.text import tokens
    r = queries.agg(F.count(F.lit(1)).alias("n"), F.max("limit").alias("k"),
                    F.sum(F.when(F.col("query").isNull(), F.lit(0))
                           .otherwise(F.size(tokens("query")))).alias("t")).first()
    return {"n_queries": int(r["n"] or 0), "max_k": int(r["k"] or 0), "max_terms": int(r["t"] or 0)}


def term_stats(dvec: DataFrame) -> DataFrame:
    """``term_index, n_postings``: posting-list length per index (partial aggregation)."""
    return dvec.groupBy("term_index").agg(F.count(F.lit(1)).alias("n_postings"))


def hot_terms(stats: DataFrame, max_hot: int = MAX_HOT_TERMS) -> DataFrame:
    """Indices holding more than 1/``max_hot`` of all postings.

    At most ``max_hot`` indices can pass, whatever the corpus size, so the
    result is safe to broadcast.
    """
    total = stats.agg(F.sum("n_postings").alias("t")).first()["t"] or 0
    return stats.where(F.col("n_postings") * F.lit(max_hot) > F.lit(total)).select("term_index")


def search_scores(qvec: DataFrame, dvec: DataFrame, max_query_terms: int | None = None,
                  hot: DataFrame | None = None, salts: int = HOT_TERM_SALTS,
                  force_shuffle: bool = False, term_buckets: int | None = None,
                  scratch: str | None = None) -> DataFrame:
    """``query_id, doc_id, chunk_no, score`` = dot product over shared indices.

    Small batches: the query side is broadcast (its row bound, or a count, is
    checked first) and the postings are streamed, with no shuffle of them.
    Large batches: a shuffle join on ``term_index`` in which the postings of
    hot terms are spread over ``salts`` buckets by ``(doc_id, chunk_no)`` and
    the matching query rows are replicated once per bucket; other terms keep
    salt 0.  Only keys and weights travel; text joins after the top-k.
    With ``term_buckets`` (a stored postings table partitioned by
    ``term_bucket = pmod(term_index, term_buckets)``) the join also matches
    on the bucket, which lets Spark prune bucket directories.
    The shuffle join writes the postings of the batch's terms to ``scratch`` first, if given:
    they are made once for the counts of the hot terms and for the join.
    """
    q = qvec.select("query_id", "term_index", F.col("weight").alias("qw"))
    d = dvec.select("doc_id", "chunk_no", "term_index", F.col("weight").alias("dw"),
                    *(["term_bucket"] if "term_bucket" in dvec.columns else []))
    keys = ["term_index"]
    if term_buckets and "term_bucket" in d.columns:
        q = q.withColumn("term_bucket", F.pmod(F.col("term_index"), F.lit(term_buckets)).cast("int"))
        keys = ["term_bucket", "term_index"]
    small = (max_query_terms <= BROADCAST_QUERY_TERMS_MAX_ROWS if max_query_terms is not None
             else _small(q, BROADCAST_QUERY_TERMS_MAX_ROWS))
    if small and not force_shuffle:
        pairs = d.join(F.broadcast(q), keys)
    else:
        if scratch is not None:
            wanted = q.select("term_index").distinct()
            d.join(F.broadcast(wanted) if small else wanted, "term_index", "left_semi").write.parquet(scratch)
            d = d.sparkSession.read.schema(d.schema).parquet(scratch)
        if hot is None:
            hot = hot_terms(term_stats(d))
        flag = F.broadcast(hot.select("term_index", F.lit(True).alias("_hot")))
        d = (d.join(flag, "term_index", "left")
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.hash("doc_id", "chunk_no"), F.lit(salts)))
                                    .otherwise(F.lit(0)))
              .drop("_hot"))
        q = (q.join(flag, "term_index", "left")
              .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                              .otherwise(F.array(F.lit(0)))))
              .drop("_hot"))
        pairs = d.join(q, keys + ["_salt"])
    return (pairs.groupBy("query_id", "doc_id", "chunk_no")
                 .agg(F.round(F.sum(F.col("qw") * F.col("dw")), SCORE_DECIMALS).alias("score")))


def restrict_to_terms(dvec: DataFrame, qvec: DataFrame, term_buckets: int) -> DataFrame:
    """Filter a stored, bucketed postings scan to the terms of a small batch.

    The distinct query indices (bounded by the batch's token count, which the
    caller checked) become literal IN lists: the bucket list prunes
    directories, the index list reaches the parquet reader, where term-sorted
    files let it skip row groups.  Only the posting lists of the query terms
    are read.
    """
    ids = sorted({r["term_index"] for r in qvec.select("term_index").distinct().collect()})
    if not ids:
        return dvec.where(F.lit(False))
    buckets = sorted({i % term_buckets for i in ids})
    return dvec.where(F.col("term_bucket").isin(buckets) & F.col("term_index").isin(ids))


def max_limit(limits: DataFrame) -> int:
    """Largest requested k of the batch (a one-row aggregate)."""
    v = limits.agg(F.max("limit").alias("m")).first()["m"]
    return int(v or 0)


def search_topk(scores: DataFrame, limits: DataFrame, max_k: int | None = None,
                n_queries: int | None = None, bounded: bool = False) -> DataFrame:
    """``query_id, rank, doc_id, chunk_no, score``: best ``limit`` per query.

    Ties break on ``doc_id, chunk_no``.  Two rankings, both by each query's own
    limit: first within ``RANK_SALTS`` shares of a query's candidates, then over
    what is left (at most ``RANK_SALTS`` x limit rows), so a query that matches a
    huge share of the corpus never gathers all its candidates in one task,
    whatever its limit and those of its neighbours.  The literal bound also
    lets Spark trim each map task where it can.  Scores of which a query has a few
    times its limit at most (``bounded``) are ranked once.
    """
    if max_k is None:
        max_k = max_limit(limits)
    lim = limits.select("query_id", F.col("limit").alias("_lim"))
    if (n_queries <= BROADCAST_HITS_MAX_ROWS if n_queries is not None
            else _small(lim, BROADCAST_HITS_MAX_ROWS)):
        lim = F.broadcast(lim)
    order = [F.col("score").desc(), "doc_id", "chunk_no"]
    best = scores.join(lim, "query_id")
    if not bounded:
        shares = best.withColumn("_share", F.pmod(F.hash("doc_id", "chunk_no"), F.lit(RANK_SALTS)))
        best = (shares.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_share").orderBy(*order)))
                      .where((F.col("rank") <= F.lit(max_k)) & (F.col("rank") <= F.col("_lim"))))
    return (best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
                .where((F.col("rank") <= F.lit(max_k)) & (F.col("rank") <= F.col("_lim")))
                .select("query_id", F.col("rank").cast("int").alias("rank"),
                        "doc_id", "chunk_no", "score"))


def search_single(qvec: DataFrame, dvec: DataFrame, query_id: int, k: int) -> DataFrame:
    """Top-k of one query: ``ORDER BY ... LIMIT k`` (TakeOrderedAndProject)."""
    one = qvec.where(F.col("query_id") == F.lit(query_id))
    return (search_scores(one, dvec)
            .orderBy(F.col("score").desc(), "doc_id", "chunk_no").limit(k))


def attach_content(hits: DataFrame, chunks: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Late join of ranked keys to chunk text (inner: hits without a chunk are skipped).

    ``max_hits`` is an upper bound of the hit count (queries x k), known
    without running the search; the hits are broadcast only under the cap.
    """
    h = hits
    if max_hits is not None and max_hits <= BROADCAST_HITS_MAX_ROWS:
        h = F.broadcast(h)
    return (chunks.select("doc_id", "chunk_no", "content")
                  .join(h, ["doc_id", "chunk_no"])
                  .select("query_id", "rank", "doc_id", "chunk_no", "score", "content"))


def retrieval_coverage(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: hits returned vs requested (zero-hit queries included)."""
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return (queries.select("query_id", "limit").join(n, "query_id", "left")
                   .select("query_id", F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"),
                           F.col("limit").cast("bigint").alias("limit"),
                           F.when(F.col("limit") > 0,
                                  F.round(F.coalesce("n_hits", F.lit(0)) / F.col("limit"), 6))
                            .alias("coverage")))
