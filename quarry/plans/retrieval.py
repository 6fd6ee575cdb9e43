"""Composed pipelines: corpus -> index, and query batch -> hits -> prompts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import (BROADCAST_FOUND_MAX_ROWS, BROADCAST_HITS_MAX_ROWS, BROADCAST_QUERY_TERMS_MAX_ROWS, DEFAULT_TERM_BUCKETS,
                           PAIR_ROWS_MAX_QUERIES, PUSHDOWN_MAX_QUERY_TERMS, Settings)
from quarry.operators import chunking, prompts, scoring, search, statistics, terms
from quarry.session import checkpoint_dir, drop_scratch, scratch_path
from quarry.sources.loads import Loads


@dataclass
class Index:
    chunks: DataFrame     # doc_id, chunk_no, content, n_bytes
    postings: DataFrame   # doc_id, chunk_no, lang, term, tf, dl, term_index, weight
    vectors: DataFrame | None   # doc_id, chunk_no, term_index, weight (folded by index)
    term_buckets: int | None = None   # set when postings carry term_bucket
    settings: Settings | None = None  # set when postings can be made again from stored chunks
    docs: DataFrame | None = None     # doc_id, text: set when the chunks are not stored
    stats: statistics.CorpusStats | None = None   # of all chunks, where settings can ask for them

    @property
    def search_side(self) -> DataFrame:
        """Term-level rows for scoring (same dot product as the folded vectors)."""
        cols = ["doc_id", "chunk_no", "term_index", "weight"]
        if "term_bucket" in self.postings.columns:
            cols.append("term_bucket")
        return self.postings.select(*cols)


def build_index(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id",
                text_col: str = "text") -> Index:
    """Documents -> chunks -> postings -> folded vectors, as one lazy plan (the text's size is taken at once)."""
    chunks = chunking.chunk_documents(docs, settings.chunk_size, settings.delimiters, key, text_col)
    if key != "doc_id":
        chunks = chunks.withColumnRenamed(key, "doc_id")
    postings = terms.embed(chunks, terms.CHUNK_KEYS, "content", settings)
    return Index(chunks, postings, search.chunk_vectors(postings), settings=settings,
                 docs=docs.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")),
                 stats=statistics.corpus_stats(postings))


def store_terms(index: Index, path: str) -> Index:
    """The index with its term rows and their statistics under ``path``: the corpus is embedded once,
    and all that needs the mean length or frequencies reads what was written."""
    s, spark = index.settings, index.chunks.sparkSession
    statistics.marked(terms.embed_terms(index.chunks, terms.CHUNK_KEYS, "content", s)).write.parquet(f"{path}/terms")
    rows = spark.read.parquet(f"{path}/terms")
    made = statistics.corpus_stats(rows)
    for part, df in (("size", made.size), ("frequencies", made.terms)):
        df.write.parquet(f"{path}/{part}")
    stats = statistics.CorpusStats(spark.read.parquet(f"{path}/size"), spark.read.parquet(f"{path}/frequencies"))
    mean = stats.size.first()["avgdl"] or 1.0 if s.corpus_length else None  # null where no chunk has terms
    postings = rows.drop("head", "new").withColumn("weight", terms.bm25_weight(s, mean))
    return replace(index, postings=postings, vectors=search.chunk_vectors(postings), stats=stats)


def batch_terms(index: Index, queries: DataFrame, path: str) -> Index:
    """The index with the term rows that a batch of queries needs under ``path``: those of its
    terms, and one of each chunk for the mean length.  The corpus is embedded once; the frequencies
    of the batch's terms, the mean and the postings are read from what was written."""
    s, spark = index.settings, index.chunks.sparkSession
    wanted = terms.embed_terms(queries, terms.QUERY_KEYS, "query", s).select("term_index", F.lit(True).alias("wanted")).distinct()
    rows = statistics.marked(terms.embed_terms(index.chunks, terms.CHUNK_KEYS, "content", s).drop("lang", "term"))
    rows = rows.join(F.broadcast(wanted), "term_index", "left").where(F.col("head") | F.col("wanted"))
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    asked = rows.where("wanted")
    size = rows.where("head").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avgdl"))
    stats = statistics.CorpusStats(size, asked.where("new").groupBy("term_index").agg(F.count(F.lit(1)).alias("df")))
    mean = size.first()["avgdl"] or 1.0 if s.corpus_length else None  # null where no chunk has terms
    postings = asked.drop("head", "new", "wanted").withColumn("weight", terms.bm25_weight(s, mean))
    return replace(index, postings=postings, vectors=None, stats=stats)


#: What a stored index says of itself (one row).
STORED_SETTINGS = "n_buckets int, statistics boolean, corpus_length boolean, k1 double, b double, fold string"


def write_index(index: Index, path: str, n_buckets: int = DEFAULT_TERM_BUCKETS) -> None:
    """Store chunks and postings; postings are partitioned by ``term_bucket``.

    Chunks are written first and the postings made from what was written, so the
    corpus is cut once and the work needs no executor-local copy.  The postings
    (only the columns that search reads) go through a ``REBALANCE`` on
    ``term_bucket``: adaptive execution splits a bucket that is too large (a term
    held by a third of all chunks) over several tasks and merges small ones.
    Files are sorted by term (tight parquet min/max per row group).  Every write
    is a load of its own: readers see the last complete one.

    Where the index' settings ask for corpus statistics, postings keep ``tf`` and ``dl`` and
    the marks of ``statistics.marked``, the statistics are counted from the written postings
    and stored beside them, and readers weigh with the stored mean length.
    """
    d = Loads(index.chunks.sparkSession, path, ["doc_id"])
    load, earlier = d.begin(), d.current()
    d.write(load, "chunks", index.chunks)
    chunks = d.rows("chunks", [load]).drop("load")
    dealt = chunking.spread_chunks(chunks, chunks, "n_bytes", "doc_id", "chunk_no") if index.settings else None
    postings = terms.embed(dealt, terms.CHUNK_KEYS, "content", index.settings) if index.settings else index.postings
    s = index.settings or Settings()
    measured = ["tf", "dl", "head", "new"] if s.uses_statistics else []
    if s.corpus_length:  # the mean is not known before the postings are
        postings = terms.embed_terms(dealt, terms.CHUNK_KEYS, "content", s)
    if s.uses_statistics:
        postings = statistics.marked(postings)
    post = (postings.select("doc_id", "chunk_no", "term_index", *measured, *([] if s.corpus_length else ["weight"]))
            .withColumn("term_bucket", F.pmod(F.col("term_index"), F.lit(n_buckets)).cast("int"))
            .hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term_index"))
    d.write(load, "postings", post, "term_bucket")
    if s.uses_statistics:
        stats = statistics.corpus_stats(d.rows("postings", [load]))
        d.write(load, "frequencies", stats.terms)
        d.write(load, "size", stats.size)
    d.write(load, "settings", d.spark.createDataFrame(
        [(n_buckets, s.uses_statistics, s.corpus_length, s.k1, s.b, s.fold)], STORED_SETTINGS))
    d.complete(load, covers=earlier)


def read_index(spark, path: str) -> Index:
    """Open the last complete index written by :func:`write_index`."""
    d = Loads(spark, path, ["doc_id"])
    if not d.exists():
        raise FileNotFoundError(f"no postings under {path}")
    last = [d.current()[-1].load]
    stored = d.rows("settings", last).first()
    postings, stats = d.rows("postings", last).drop("load"), None
    if stored["statistics"]:
        stats = statistics.CorpusStats(d.rows("size", last).drop("load"), d.rows("frequencies", last).drop("load"))
    if stored["corpus_length"]:
        mean = stats.size.first()["avgdl"]  # null where no chunk has terms
        postings = postings.withColumn("weight", terms.bm25_weight(Settings(k1=stored["k1"], b=stored["b"], fold=stored["fold"]), mean or 1.0))
    return Index(d.rows("chunks", last).drop("load"), postings, None, stored["n_buckets"], stats=stats)


@dataclass
class Answered:
    queries: DataFrame    # query_id, query, limit, model (defaults applied)
    hits: DataFrame       # query_id, rank, doc_id, chunk_no, score, content
    #: Hits with a key for their text, and what puts the texts in an array of keys, where texts must not be joined.
    keys: DataFrame | None = None
    texts: Callable[[DataFrame, str], DataFrame] | None = None

    def _filled(self, rows: DataFrame) -> DataFrame:
        return self.texts(rows, "retrieved") if self.texts else rows

    @property
    def contexts(self) -> DataFrame:
        """``query_id, n_hits, context``"""
        return prompts.context_of(self._filled(prompts.context_lists(self.keys or self.hits, self.queries)))

    @property
    def prompts(self) -> DataFrame:
        """``query_id, model, context, prompt``"""
        return self.assembled.select("query_id", "model", "context", "prompt")

    @property
    def assembled(self) -> DataFrame:
        """``query_id, model, n_hits, context, prompt``; what is joined is joined before there are texts."""
        q = self.queries.where(F.trim("model") != "").select("query_id", "query", "model")
        lists = q.join(prompts.context_lists(self.keys or self.hits, self.queries), "query_id", "left")
        return prompts.prompt_of(prompts.context_of(self._filled(lists))).select("query_id", "model", "n_hits", "context", "prompt")

    def responses(self, answers: DataFrame) -> DataFrame:
        """``query_id, response, retrieved``: answered queries with their retrieved texts."""
        return self._filled(prompts.responses(answers, self.keys or self.hits, self.queries))


def retrieve(queries: DataFrame, index: Index, settings: Settings = Settings(),
             force_shuffle: bool = False) -> Answered:
    """A whole batch of queries: embed, score, rank, fetch content, build prompts.

    Requests that fail on the way get an error row (``prompts.query_errors``)
    and nothing of the stage at which they fail or of later ones: neither hits nor
    prompts for a bad limit or a missing text, hits but no prompt for a model without a name.
    """
    qd = search.query_defaults(prompts.searchable(queries), settings)
    bounds = search.batch_bounds(qd)
    size, asked_terms = None, None
    unstored = index.docs is not None and not index.docs.isStreaming
    if settings.corpus_length and index.settings is not None and not index.settings.corpus_length:
        raise ValueError("the index is weighted with a fixed length")
    if settings.uses_statistics:
        if index.stats is None:
            raise ValueError("the index holds no corpus statistics; build or write it with settings that ask for them")
        if unstored and index.settings is not None and bounds["max_terms"] <= BROADCAST_QUERY_TERMS_MAX_ROWS:
            asked_terms = scratch_path(index.chunks.sparkSession, "asked-terms")
            index = batch_terms(index, qd, asked_terms)
        size = index.stats.size.first()
    if settings.corpus_length:
        settings = replace(settings, avgdl=size["avgdl"] or 1.0)  # no chunk with terms: nothing to weigh
    qvec = search.query_vectors(qd, settings)
    if settings.idf:
        qvec = statistics.query_idf(qvec, index.stats, size["n_chunks"], bounds["max_terms"])
    side = index.search_side
    if index.term_buckets and bounds["max_terms"] <= PUSHDOWN_MAX_QUERY_TERMS:
        side = search.restrict_to_terms(side, qvec, index.term_buckets)
    limits = qd.select("query_id", "limit")
    # rows read back are not together by chunk any more: they are brought together before pairs are made of them
    in_blocks = (bounds["n_queries"] > PAIR_ROWS_MAX_QUERIES or asked_terms is not None) and not force_shuffle and not side.isStreaming
    # postings that are not stored are written for the shuffle join, which reads them twice
    held = in_blocks or unstored and (force_shuffle or bounds["max_terms"] > BROADCAST_QUERY_TERMS_MAX_ROWS)
    scratch = scratch_path(side.sparkSession, "vectors") if held else None
    if in_blocks:
        scores = scoring.best_scores(qvec, side, limits, bounds["n_queries"], scratch)
    else:
        scores = search.search_scores(qvec, side, bounds["max_terms"], force_shuffle=force_shuffle,
                                      term_buckets=index.term_buckets, scratch=scratch)
    ranked = search.search_topk(scores, limits, bounds["max_k"], bounds["n_queries"], bounded=in_blocks)
    chunks, most = index.chunks, bounds["n_queries"] * bounds["max_k"]
    if unstored or held:
        checkpoint_dir(ranked.sparkSession)
        ranked = ranked.checkpoint()
    for path in (scratch, asked_terms):
        if path is not None:
            drop_scratch(side.sparkSession, path)
    if unstored:
        # chunks that are not stored: the ranked keys are fixed, so cut the documents hit again, not the corpus
        found = ranked.select("doc_id").distinct()
        if most <= BROADCAST_HITS_MAX_ROWS or in_blocks and search._small(found, BROADCAST_FOUND_MAX_ROWS):
            found = F.broadcast(found)
        chunks = chunking.chunk_documents(index.docs.join(found, "doc_id", "left_semi"), settings.chunk_size,
                                          settings.delimiters, spread=False)
    hits = search.attach_content(ranked, chunks, most)
    if not in_blocks:
        return Answered(qd, hits)
    # many hits a chunk: texts are stored once and read by those who need them, not sent to each
    packed: list[DataFrame] = []

    def texts(rows: DataFrame, column: str) -> DataFrame:
        if not packed:
            packed.append(scoring.packed_texts(chunks, scratch_path(chunks.sparkSession, "texts")))
        return scoring.with_texts(rows, column, packed[0], scratch_path(chunks.sparkSession, "lists"))
    return Answered(qd, hits, ranked.withColumn("content", F.struct("doc_id", "chunk_no")), texts)
