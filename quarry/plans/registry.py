"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL twins.

Every query reads the driver's tables (or what Spark derives from them) in
full.  ``ORACLE`` holds the DuckDB SQL for each query that SQL can express.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config as C
from quarry import oracle as O
from quarry.config import CONTEXT_SEPARATOR, DEFAULT_MODEL, DEFAULT_SEARCH_LIMIT, Settings
from quarry.functions import text as T
from quarry.operators import blocks, chunking, collection, prompts, search, statistics, terms, termtables
from quarry.plans import commands
from quarry.plans.retrieval import build_index, read_index, retrieve, store_terms, write_index
from quarry.session import drop_scratch, scratch_path, shuffles_dropped
from quarry.sources import files, tables
from quarry.streaming import jobs

S = Settings()
QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _index(spark, sf):
    return build_index(tables.documents(spark, sf), S)


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


# SQL building blocks ---------------------------------------------------------
WITH_CHUNKS = f"WITH RECURSIVE {O.chunks_cte()}"
WITH_DOC_POSTINGS = f"{WITH_CHUNKS}, {O.postings_cte('dpost', 'chunks', ['doc_id', 'chunk_no'], 'content')}"
WITH_SEARCH_BENCH = f"WITH RECURSIVE {O.benchmark_queries_cte()}, {O.search_ctes()}"
FILES_SQL = O.files_ctes()


# ---------------------------------------------------------------------------
# Sources (S1-S9)
# ---------------------------------------------------------------------------
@register("file_manifest", f"WITH {FILES_SQL} SELECT path, CAST(mtime AS TIMESTAMP) AS modified, length FROM files")
def q_file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The listing of the corpus files (a directory scan has the same columns)."""
    m = files.manifest(tables.corpus_files(spark, sf))
    return m.select("path", F.col("modificationTime").cast("timestamp_ntz").alias("modified"), "length")


@register("file_routing", f"WITH {FILES_SQL} SELECT path, ext, route FROM files")
def q_file_routing(spark: SparkSession, sf: str) -> DataFrame:
    return files.route(tables.corpus_files(spark, sf)).select("path", "ext", "route")


SQL_QUARANTINE = """SELECT path, CASE route WHEN 'no_extension' THEN 'no file extension'
         WHEN 'no_extractor' THEN 'no extractor for extension: ' || ext ELSE 'unsupported extension: ' || ext END AS reason
FROM {0} WHERE route <> 'text'
UNION ALL SELECT path, 'invalid UTF-8' FROM {0} WHERE route = 'text' AND NOT ok"""


@register("file_quarantine", f"WITH {FILES_SQL} {SQL_QUARANTINE.format('files')}")
def q_file_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    routed = files.route(tables.corpus_files(spark, sf))
    return files.quarantine(routed, files.rejected(files.read_text_files(routed)))


@register("read_text_files", f"WITH {FILES_SQL} SELECT doc_id, path, ext, text, n_bytes, content_sha FROM files_parsed")
def q_read_text_files(spark: SparkSession, sf: str) -> DataFrame:
    read = files.read_text_files(files.route(tables.corpus_files(spark, sf)))
    return files.parsed(read).select("doc_id", "path", "ext", "text", "n_bytes", "content_sha")


def _html_sql(col: str) -> str:
    out = (f"regexp_replace({col}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g')")
    out = f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in files.HTML_ENTITIES.items():
        out = f"replace({out}, {O.q(name)}, {O.q(char)})"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@register("extract_text", f"""SELECT md5('web/page-' || CAST(page_id AS VARCHAR) || '.html') AS doc_id, {_html_sql('html')} AS text,
       CAST(strlen({_html_sql('html')}) AS BIGINT) AS n_bytes FROM pages""")
def q_extract_text(spark: SparkSession, sf: str) -> DataFrame:
    """The raw pages to text, in column expressions (callables: ``files.extract_text``)."""
    read = files.read_html_files(files.route(tables.corpus_files(spark, sf)))
    return files.parsed(read).select("doc_id", "text", "n_bytes")


@register("incremental_diff", f"""WITH {FILES_SQL}, {O.files_ctes('later', changed=True)}
SELECT f.path, f.length FROM later f ANTI JOIN files_parsed p ON f.path = p.path AND f.length = p.n_bytes AND f.mtime = p.mtime""")
def q_incremental_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What a changed folder has left to read, once the text files were parsed."""
    parsed = files.parsed(files.read_text_files(files.route(tables.corpus_files(spark, sf))))
    return files.incremental_diff(tables.corpus_files(spark, sf, changed=True), parsed).select("path", "length")


@register("cache_integrity", f"""WITH {FILES_SQL}
SELECT path, content_sha, substr(doc_id, 1, 1) NOT IN ('0', '4', '8', 'c') AS ok FROM files_parsed""")
def q_cache_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """A stored parsed table in which some texts were spoilt after their hash was taken."""
    parsed = files.parsed(files.read_text_files(files.route(tables.corpus_files(spark, sf))))
    spoilt = F.substring("doc_id", 1, 1).isin("0", "4", "8", "c")
    path = scratch_path(spark, "spoilt")
    parsed.withColumn("text", F.when(spoilt, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).write.parquet(path)
    return files.cache_integrity(spark.read.parquet(path))


@register("text_sizes", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, "
                        "CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def q_text_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.text_sizes(tables.documents(spark, sf))


# ---------------------------------------------------------------------------
# Chunking (C1-C4)
# ---------------------------------------------------------------------------
@register("chunk_documents", f"{WITH_CHUNKS} SELECT doc_id, chunk_no, content, n_bytes FROM chunks")
def q_chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(tables.documents(spark, sf))


@register("chunk_stats", f"""{WITH_CHUNKS}
SELECT doc_id, count(*) AS n_chunks, sum(n_bytes) AS total_bytes, min(n_bytes) AS min_bytes,
       max(n_bytes) AS max_bytes, round(avg(n_bytes), 6) AS avg_bytes
FROM chunks GROUP BY doc_id""")
def q_chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_stats(chunking.chunk_documents(tables.documents(spark, sf)))


@register("chunk_lossy_cuts", f"""WITH RECURSIVE {O.chunks_cte(size=64)}
SELECT doc_id, chunk_no, content, n_bytes FROM chunks WHERE contains(content, chr(65533))""")
def q_chunk_lossy_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """64-byte chunks whose cut fell inside a multi-byte character."""
    ch = chunking.chunk_documents(tables.documents(spark, sf), size=64)
    return ch.where(F.col("content").contains("\ufffd"))


@register("chunk_blocks", f"{WITH_CHUNKS} SELECT doc_id, chunk_no, content, n_bytes FROM chunks")
def q_chunk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """C1 with each document dealt over tasks in blocks of 4 KB (so that these documents have many)."""
    return blocks.chunk_documents(tables.documents(spark, sf), block_bytes=4096)


# ---------------------------------------------------------------------------
# Terms and BM25
# ---------------------------------------------------------------------------
@register("detect_language", f"""WITH {O.analyzed_cte('an', 'documents', ['doc_id'], 'text')}
SELECT a.doc_id, a.lang_detected, a.lang, d.lang AS label, a.lang = d.lang AS agrees
FROM an a JOIN documents d USING (doc_id)""")
def q_detect_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    an = terms.analyze(docs, ["doc_id"], "text")
    return (an.join(docs.select("doc_id", F.col("lang").alias("label")), "doc_id")
              .select("doc_id", "lang_detected", "lang", "label", (F.col("lang") == F.col("label")).alias("agrees")))


@register("tokenize", f"""SELECT doc_id, pos, token FROM (
  SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
  FROM (SELECT doc_id, {O.tokens_sql('text')} AS t FROM documents))""")
def q_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    return docs.select("doc_id", F.posexplode(T.tokens("text")).alias("pos", "token")) \
               .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


@register("tokenize_decomposed", f"""SELECT doc_id, pos, token FROM (
  SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
  FROM (SELECT doc_id, {O.tokens_sql('nfc_normalize(text)')} AS t FROM documents))""")
def q_tokenize_decomposed(spark: SparkSession, sf: str) -> DataFrame:
    """E2 + E3: the documents with their accents written as combining marks give the same tokens."""
    docs = tables.documents(spark, sf)
    apart = F.col("text")
    for letter, mark in (("a", 0x300), ("e", 0x301), ("e", 0x300), ("u", 0x308), ("o", 0x308), ("a", 0x308), ("n", 0x303), ("c", 0x327),
                         ("o", 0x301), ("i", 0x301), ("u", 0x301), ("a", 0x301), ("e", 0x302), ("o", 0x302), ("i", 0x302), ("u", 0x300)):
        for base in (letter, letter.upper()):
            apart = F.replace(apart, F.lit(unicodedata.normalize("NFC", base + chr(mark))), F.lit(base + chr(mark)))
    return docs.select("doc_id", F.posexplode(T.tokens(apart)).alias("pos", "token")) \
               .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


@register("stopword_filter", f"""WITH {O.analyzed_cte('an', 'documents', ['doc_id'], 'text')}
SELECT doc_id, lang, CAST(len(tokens) AS BIGINT) AS n_tokens,
       CAST(len(list_filter(tokens, lambda t: NOT {O.stopword_sql('t', 'lang')})) AS BIGINT) AS n_kept
FROM an""")
def q_stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    an = terms.analyze(tables.documents(spark, sf), ["doc_id"], "text")
    kept = F.expr(f"size(filter(tokens, t -> NOT ({T._stopword_sql('t', 'lang')})))")
    return an.select("doc_id", "lang", F.size("tokens").cast("bigint").alias("n_tokens"),
                     kept.cast("bigint").alias("n_kept"))


@register("stem_vocabulary", f"""{WITH_DOC_POSTINGS}
SELECT lang, token, {O.stem_sql('token', 'lang')} AS term FROM (SELECT DISTINCT lang, token FROM dpost_tk)""")
def q_stem_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """E5: the distinct (language, token) vocabulary of the chunks, stemmed once."""
    idx = chunking.chunk_documents(tables.documents(spark, sf))
    toks = terms.token_rows(terms.analyze(idx), stemming=False)
    vocab = toks.select("lang", F.col("term").alias("token")).distinct()
    return vocab.select("lang", "token", T.stem("token", "lang").alias("term"))


@register("term_index", f"""{WITH_DOC_POSTINGS}
SELECT term, term_index, count(*) AS n_chunks FROM dpost GROUP BY term, term_index""")
def q_term_index(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary with its 32-bit index and chunk frequency."""
    post = _index(spark, sf).postings
    return post.groupBy("term", "term_index").agg(F.count(F.lit(1)).alias("n_chunks"))


@register("term_frequency", f"{WITH_DOC_POSTINGS} SELECT doc_id, chunk_no, lang, term, tf, dl FROM dpost")
def q_term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).postings.select("doc_id", "chunk_no", "lang", "term", "tf", "dl")


SQL_BM25 = (f"{WITH_DOC_POSTINGS} SELECT doc_id, chunk_no, term, term_index, tf, dl, "
            f"round(weight, 6) AS weight FROM dpost")


@register("bm25_weights", SQL_BM25)
def q_bm25_weights(spark: SparkSession, sf: str) -> DataFrame:
    p = _index(spark, sf).postings
    return p.select("doc_id", "chunk_no", "term", "term_index", "tf", "dl", _r6("weight"))


@register("folded_weights", f"""{WITH_DOC_POSTINGS}, {O.vectors_cte('dvec', 'dpost', ['doc_id', 'chunk_no'])}
SELECT doc_id, chunk_no, term_index, round(weight, 6) AS weight FROM dvec""")
def q_folded_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).vectors.select("doc_id", "chunk_no", "term_index", _r6("weight"))


@register("sparse_vectors", f"""{WITH_DOC_POSTINGS}, {O.vectors_cte('dvec', 'dpost', ['doc_id', 'chunk_no'])}
SELECT doc_id, chunk_no, CAST(count(*) AS INTEGER) AS n_entries,
       string_agg(CAST(term_index AS VARCHAR), ',' ORDER BY term_index) AS indices,
       string_agg(CAST(CAST(round(weight * 100000) AS BIGINT) AS VARCHAR), ',' ORDER BY term_index) AS weights
FROM dvec GROUP BY doc_id, chunk_no""")
def q_sparse_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = terms.sparse_vectors(_index(spark, sf).vectors)
    return v.select("doc_id", "chunk_no", F.size("indices").alias("n_entries"),
                    F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"),
                    F.array_join(F.transform("values", lambda x: F.round(x * 100000).cast("bigint").cast("string")), ",")
                     .alias("weights"))


@register("embed_chunks", f"""{WITH_DOC_POSTINGS}
SELECT doc_id, chunk_no, lang, count(*) AS n_terms, max(dl) AS dl, round(sum(weight), 6) AS weight_sum
FROM dpost GROUP BY doc_id, chunk_no, lang""")
def q_embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Per-chunk summary of the embedded corpus (language detected per chunk)."""
    p = _index(spark, sf).postings
    return (p.groupBy("doc_id", "chunk_no", "lang")
             .agg(F.count(F.lit(1)).alias("n_terms"), F.max("dl").alias("dl"),
                  F.round(F.sum("weight"), 6).alias("weight_sum")))


@register("embed_queries", f"""WITH {O.benchmark_queries_cte()}, {O.postings_cte('qpost', 'queries', ['query_id'], 'query')}
SELECT query_id, lang, term, term_index, tf, dl, round(weight, 6) AS weight FROM qpost""")
def q_embed_queries(spark: SparkSession, sf: str) -> DataFrame:
    q = tables.benchmark_queries(spark, sf)
    p = terms.embed(q, terms.QUERY_KEYS, "query", S)
    return p.select("query_id", "lang", "term", "term_index", "tf", "dl", _r6("weight"))


@register("detect_language_joined", f"""WITH {O.analyzed_cte('an', 'documents', ['doc_id'], 'text')}
SELECT doc_id, lang_detected, lang FROM an WHERE len(tokens) > 0""")
def q_detect_language_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The vote as a join with the stop-word table and a grouped count."""
    counts = termtables.token_counts(tables.documents(spark, sf), ["doc_id"], "text")
    an = termtables.analyze(counts, termtables.stopword_table(spark), ["doc_id"])
    return an.select("doc_id", "lang_detected", "lang").distinct()


@register("stopword_filter_joined", f"""WITH {O.analyzed_cte('an', 'documents', ['doc_id'], 'text')}
SELECT doc_id, lang, token, count(*) AS n FROM (SELECT doc_id, lang, unnest(tokens) AS token FROM an)
WHERE NOT {O.stopword_sql('token', 'lang')} GROUP BY ALL""")
def q_stopword_filter_joined(spark: SparkSession, sf: str) -> DataFrame:
    """J6 + E4: tokens that an anti join with the stop-word table of their language leaves."""
    counts = termtables.token_counts(tables.documents(spark, sf), ["doc_id"], "text")
    stop = termtables.stopword_table(spark)
    return termtables.drop_stopwords(termtables.analyze(counts, stop, ["doc_id"]), stop).select("doc_id", "lang", "token", "n")


@register("bm25_weights_joined", SQL_BM25)
def q_bm25_weights_joined(spark: SparkSession, sf: str) -> DataFrame:
    """E1-E10 by tables: stop words joined, each word of the vocabulary stemmed once."""
    p = termtables.embed(chunking.chunk_documents(tables.documents(spark, sf)), settings=S)
    return p.select("doc_id", "chunk_no", "term", "term_index", "tf", "dl", _r6("weight"))


CORPUS_S = Settings(avgdl="corpus", idf=True)
WITH_CORPUS_POSTINGS = f"{WITH_CHUNKS}, {O.postings_cte('dpost', 'chunks', ['doc_id', 'chunk_no'], 'content', avgdl=O.CORPUS_AVGDL)}"


@register("corpus_statistics", f"""{WITH_CORPUS_POSTINGS}, {O.FREQUENCY_CTES}
SELECT term_index, df, (SELECT n_chunks FROM corpus) AS n_chunks, round({O.CORPUS_AVGDL}, 6) AS avgdl FROM freq""")
def q_corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, their mean length, and in how many of them each term index occurs."""
    stats = statistics.corpus_stats(_index(spark, sf).postings)
    return stats.terms.select("term_index", "df", stats.size.select("n_chunks").scalar().alias("n_chunks"),
                              F.round(stats.size.select("avgdl").scalar(), 6).alias("avgdl"))


@register("bm25_idf_weights", f"""{WITH_CORPUS_POSTINGS}, {O.FREQUENCY_CTES}
SELECT doc_id, chunk_no, term, term_index, tf, dl, df, round(weight, 6) AS weight, round(weight * {O.IDF_SQL}, 6) AS idf_weight
FROM dpost JOIN freq USING (term_index)""")
def q_bm25_idf_weights(spark: SparkSession, sf: str) -> DataFrame:
    """E8-E10 with corpus statistics: mean chunk length for the fixed one, weights times idf."""
    idx = store_terms(build_index(tables.documents(spark, sf), CORPUS_S), scratch_path(spark, "idf-terms"))
    p = statistics.with_document_frequency(idx.postings, idx.stats, stored=True)
    share = F.col("weight") * statistics.idf("df", idx.stats.size.select("n_chunks").scalar())
    return p.select("doc_id", "chunk_no", "term", "term_index", "tf", "dl", "df", _r6("weight"), F.round(share, 6).alias("idf_weight"))


SQL_IDF_TOPK = f"""WITH RECURSIVE {O.benchmark_queries_cte()}, {O.search_ctes(idf=True, avgdl=O.CORPUS_AVGDL)}
SELECT query_id, rank, doc_id, chunk_no, score FROM hits"""


@register("search_idf_topk", SQL_IDF_TOPK)
def q_search_idf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A6 with corpus statistics, from the corpus."""
    a = retrieve(tables.benchmark_queries(spark, sf), build_index(tables.documents(spark, sf), CORPUS_S), CORPUS_S)
    return a.hits.select("query_id", "rank", "doc_id", "chunk_no", "score")


@register("search_idf_stored", SQL_IDF_TOPK)
def q_search_idf_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stored index, whose statistics are stored with it."""
    stored = scratch_path(spark, "idf-index")
    write_index(build_index(tables.documents(spark, sf), CORPUS_S), stored)
    a = retrieve(tables.benchmark_queries(spark, sf), read_index(spark, stored), CORPUS_S)
    return a.hits.select("query_id", "rank", "doc_id", "chunk_no", "score")


# ---------------------------------------------------------------------------
# Search (J1-J3, A5-A9, P2-P4)
# ---------------------------------------------------------------------------
@register("query_defaults", f"""WITH {O.conversation_queries_cte()}
SELECT query_id, query, CAST(coalesce("limit", {DEFAULT_SEARCH_LIMIT}) AS BIGINT) AS "limit",
       coalesce(model, '{DEFAULT_MODEL}') AS model FROM queries""")
def q_query_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return search.query_defaults(tables.conversation_queries(spark, sf), S)


@register("search_scores", f"{WITH_SEARCH_BENCH} SELECT query_id, doc_id, chunk_no, score FROM scores")
def q_search_scores(spark: SparkSession, sf: str) -> DataFrame:
    qd = search.query_defaults(tables.benchmark_queries(spark, sf), S)
    return search.search_scores(search.query_vectors(qd, S), _index(spark, sf).search_side)


SQL_SEARCH_TOPK = f"{WITH_SEARCH_BENCH} SELECT query_id, rank, doc_id, chunk_no, score, content FROM hits"


@register("search_topk", SQL_SEARCH_TOPK)
def q_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: top-10 BM25 chunks per benchmark query, with their text."""
    return retrieve(tables.benchmark_queries(spark, sf), _index(spark, sf), S).hits


@register("search_requests", f"""WITH RECURSIVE {O.conversation_queries_cte()}, {O.search_ctes()}
SELECT query_id, rank, doc_id, chunk_no, score FROM hits""")
def q_search_requests(spark: SparkSession, sf: str) -> DataFrame:
    """User turns that ask for 0, 1, 5, 1500 and the default number of hits; bad requests get none."""
    a = retrieve(tables.conversation_queries(spark, sf), _index(spark, sf), S)
    return a.hits.select("query_id", "rank", "doc_id", "chunk_no", "score")


@register("search_shuffled", f"{WITH_SEARCH_BENCH} SELECT query_id, rank, doc_id, chunk_no, score FROM hits")
def q_search_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """The shuffle join with salted hot terms that large query batches take."""
    a = retrieve(tables.benchmark_queries(spark, sf), _index(spark, sf), S, force_shuffle=True)
    return a.hits.select("query_id", "rank", "doc_id", "chunk_no", "score")


@register("search_single", f"""{WITH_SEARCH_BENCH}
SELECT query_id, doc_id, chunk_no, score FROM scores
WHERE query_id = (SELECT min(query_id) FROM queries)
ORDER BY score DESC, doc_id, chunk_no LIMIT {DEFAULT_SEARCH_LIMIT}""")
def q_search_single(spark: SparkSession, sf: str) -> DataFrame:
    """One request (the first benchmark item), ORDER BY + LIMIT."""
    qd = search.query_defaults(tables.benchmark_queries(spark, sf), S)
    first = qd.agg(F.min("query_id").alias("m")).first()["m"]
    return search.search_single(search.query_vectors(qd, S), _index(spark, sf).search_side,
                                first, DEFAULT_SEARCH_LIMIT)


@register("retrieval_coverage", f"""{WITH_SEARCH_BENCH}
SELECT q.query_id, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hits, CAST(q."limit" AS BIGINT) AS "limit",
       CASE WHEN q."limit" > 0 THEN round(coalesce(h.n, 0) / q."limit", 6) END AS coverage
FROM qdef q LEFT JOIN (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id) h USING (query_id)""")
def q_retrieval_coverage(spark: SparkSession, sf: str) -> DataFrame:
    a = retrieve(tables.benchmark_queries(spark, sf), _index(spark, sf), S)
    return search.retrieval_coverage(a.hits, a.queries)


SQL_CONTEXTS = f"""
ctx AS (
  SELECT q.query_id, CAST(coalesce(h.n, 0) AS INTEGER) AS n_hits, coalesce(h.context, '') AS context
  FROM qdef q LEFT JOIN (
    SELECT query_id, count(*) AS n, string_agg(content, {O.SEPARATOR_SQL} ORDER BY rank) AS context
    FROM hits GROUP BY query_id) h USING (query_id)
)"""


@register("retrieval_context", f"{WITH_SEARCH_BENCH}, {SQL_CONTEXTS} SELECT query_id, n_hits, context FROM ctx")
def q_retrieval_context(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve(tables.benchmark_queries(spark, sf), _index(spark, sf), S).contexts


# ---------------------------------------------------------------------------
# Prompts and responses (Q1-Q7)
# ---------------------------------------------------------------------------
@register("prompts", f"""{WITH_SEARCH_BENCH}, {SQL_CONTEXTS}
SELECT q.query_id, q.model, c.context, {O.prompt_sql('c.context', 'q.query')} AS prompt
FROM qdef q JOIN ctx c USING (query_id)""")
def q_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve(tables.benchmark_queries(spark, sf), _index(spark, sf), S).prompts


@register("request_prompts", f"""WITH RECURSIVE {O.conversation_queries_cte()}, {O.search_ctes()}, {SQL_CONTEXTS}
SELECT q.query_id, q.model, c.n_hits, md5({O.prompt_sql('c.context', 'q.query')}) AS prompt_md5 FROM qdef q JOIN ctx c USING (query_id)""")
def q_request_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Q3 + Q4: prompts of requests with models of their own; a bad request gets no prompt."""
    a = retrieve(tables.conversation_queries(spark, sf), _index(spark, sf), S)
    made = a.assembled.select("query_id", "model", "n_hits", F.md5(F.encode("prompt", "UTF-8")).alias("prompt_md5"))
    return made.join(a.queries.select("query_id"), "query_id")  # digests, not texts, meet the requests


@register("responses", f"""WITH RECURSIVE {O.conversation_queries_cte()}, {O.conversation_answers_cte()}, {O.search_ctes()}, {SQL_CONTEXTS}
SELECT q.query_id, a.response, c.n_hits AS n_retrieved, md5(c.context) AS retrieved_md5
FROM qdef q JOIN answers a USING (query_id) JOIN ctx c USING (query_id) WHERE a.response IS NOT NULL""")
def q_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Q5 + Q6: user turns answered by the following assistant turn, with the digest of their retrieved texts."""
    a = retrieve(tables.conversation_queries(spark, sf), _index(spark, sf), S)
    r = a.responses(tables.conversation_answers(spark, sf))
    return r.select("query_id", "response", F.size("retrieved").alias("n_retrieved"),
                    F.md5(F.encode(F.array_join("retrieved", CONTEXT_SEPARATOR), "UTF-8")).alias("retrieved_md5"))


SQL_REQUEST_FAILS = {k: f"(u.conv_id + 2 * u.turn) % {tables.FAILURE_DIVISOR} IN ({', '.join(map(str, v))})" for k, v in (
    ("text", tables.NO_TEXT), ("model", tables.NAMELESS_MODEL), ("refused", tables.REFUSED))}


@register("query_errors", f"""
WITH asked AS (
  SELECT {O.CONV_QUERY_ID.replace('conv_id', 'u.conv_id').replace('turn', 'u.turn')} AS query_id,
         (u.conv_id + u.turn) % {len(tables.REQUEST_LIMITS)} AS kind, {SQL_REQUEST_FAILS['text']} AS no_text,
         {SQL_REQUEST_FAILS['model']} AS nameless, {SQL_REQUEST_FAILS['refused']} AS refused, a.text AS answer
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
staged AS (
  SELECT *, CASE WHEN kind IN ({tables.REQUEST_LIMITS.index(1500)}, {tables.REQUEST_LIMITS.index(-1)}) THEN 'request'
                 WHEN no_text THEN 'search' WHEN nameless THEN 'prompt'
                 WHEN answer IS NULL OR refused THEN 'response' END AS stage FROM asked)
SELECT query_id, stage, CASE stage WHEN 'request' THEN 422 ELSE 500 END AS status_code,
       CASE stage WHEN 'request' THEN {O.q(C.BAD_LIMIT_DETAIL)} WHEN 'search' THEN {O.q(C.SEARCH_FAILED + C.NO_QUERY_TEXT)}
                  WHEN 'prompt' THEN {O.q(C.REQUEST_FAILED + C.NO_MODEL_NAME)}
                  ELSE CASE WHEN answer IS NOT NULL THEN {O.q(C.RESPONSE_FAILED + tables.REFUSAL)} ELSE {O.NO_RESPONSE_SQL} END END AS detail
FROM staged WHERE stage IS NOT NULL""")
def q_query_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Q7: requests that fail, by the first stage at which they do."""
    queries, answers = tables.failing_requests(spark, sf)
    return prompts.query_errors(answers, queries)


# ---------------------------------------------------------------------------
# Collections
# ---------------------------------------------------------------------------
def _points(spark, sf):
    idx = _index(spark, sf)
    return collection.points(idx.chunks, idx.vectors)


def _made_points(spark, sf, path) -> None:
    with shuffles_dropped(spark):
        _points(spark, sf).write.option("compression", "zstd").parquet(path)


WITH_POINTS = f"""{WITH_DOC_POSTINGS}, {O.vectors_cte('dvec', 'dpost', ['doc_id', 'chunk_no'])},
pts AS (SELECT doc_id, chunk_no, count(*) AS n_entries FROM dvec GROUP BY doc_id, chunk_no),
ids AS ({O.numbered('(SELECT CAST(doc_id AS VARCHAR) AS doc_id, chunk_no, n_entries FROM pts)')})"""


@register("point_ids", f"{WITH_POINTS} SELECT point_id, doc_id, chunk_no FROM ({O.numbered('pts')})")
def q_point_ids(spark: SparkSession, sf: str) -> DataFrame:
    """K4: dense ids 1..N in (doc_id, chunk_no) order for a fresh collection."""
    p = _points(spark, sf).select("doc_id", "chunk_no")
    return collection.dense_ids(p, collection.POINT_KEYS, 0)


@register("skipped_chunks", f"""{WITH_DOC_POSTINGS}
SELECT c.doc_id, c.chunk_no, c.n_bytes, 'no terms after stop-word removal' AS reason
FROM chunks c ANTI JOIN (SELECT DISTINCT doc_id, chunk_no FROM dpost) p USING (doc_id, chunk_no)""")
def q_skipped_chunks(spark: SparkSession, sf: str) -> DataFrame:
    idx = _index(spark, sf)
    return collection.skipped_chunks(idx.chunks, idx.vectors)


def _loaded_collection(spark, sf, mode: str, loads: int) -> DataFrame:
    path = scratch_path(spark, "collection")
    collection.create_collection(spark, path)
    pts = _points(spark, sf)
    for _ in range(loads):
        collection.upsert_collection(spark, path, pts, mode)
    return collection.read_collection(spark, path)


@register("collection_create", f"{WITH_POINTS} SELECT true AS created, false AS created_again, count(*) AS n_points FROM ids")
def q_collection_create(spark: SparkSession, sf: str) -> DataFrame:
    """K2: created once, left alone the second time; the load then finds it."""
    path = scratch_path(spark, "collection")
    first, second = collection.create_collection(spark, path), collection.create_collection(spark, path)
    collection.upsert_collection(spark, path, _points(spark, sf))
    return collection.read_collection(spark, path).agg(F.count(F.lit(1)).alias("n_points")) \
        .select(F.lit(first).alias("created"), F.lit(second).alias("created_again"), "n_points")


@register("collection_stats", f"""{WITH_POINTS}
SELECT count(*) AS n_points, count(DISTINCT doc_id) AS n_docs, CAST(sum(n_entries) AS BIGINT) AS n_entries FROM ids""")
def q_collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    """K2 + K3 + K7: create, load once, count."""
    return collection.collection_stats(_loaded_collection(spark, sf, "upsert", 1))


@register("collection_upsert", f"{WITH_POINTS} SELECT point_id, doc_id, chunk_no, n_entries FROM ids")
def q_collection_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """K3 + K5: loading the same corpus twice in upsert mode leaves one copy."""
    c = _loaded_collection(spark, sf, "upsert", 2)
    return c.select("point_id", "doc_id", "chunk_no", F.size("indices").cast("bigint").alias("n_entries"))


@register("collection_append", f"""{WITH_POINTS}
SELECT point_id, doc_id, chunk_no FROM ids
UNION ALL SELECT point_id + (SELECT count(*) FROM ids), doc_id, chunk_no FROM ids""")
def q_collection_append(spark: SparkSession, sf: str) -> DataFrame:
    """K4 + K5 + A10: a second load in append mode adds a second copy with new ids."""
    return _loaded_collection(spark, sf, "append", 2).select("point_id", "doc_id", "chunk_no")


@register("collection_shrink_append", f"""{WITH_POINTS}
SELECT point_id, doc_id, chunk_no FROM ids WHERE CAST(doc_id AS BIGINT) % 2 = 1 OR chunk_no = 0
UNION ALL SELECT point_id + (SELECT count(*) FROM ids), doc_id, chunk_no FROM ids""")
def q_collection_shrink_append(spark: SparkSession, sf: str) -> DataFrame:
    """K3 + K4: documents that shrink to one chunk keep its id, and a later append never meets a given id again."""
    path, made = scratch_path(spark, "collection"), scratch_path(spark, "points")
    collection.create_collection(spark, path)
    _made_points(spark, sf, made)  # embedded once for all loads
    pts = spark.read.parquet(made)
    collection.upsert_collection(spark, path, pts)
    even = pts.where("doc_id % 2 = 0")
    collection.upsert_collection(spark, path, even.where("chunk_no = 0"), replaced=even.select("doc_id"))
    collection.upsert_collection(spark, path, pts, "append")
    drop_scratch(spark, made)
    return collection.read_collection(spark, path).select("point_id", "doc_id", "chunk_no")


@register("collection_compact", f"{WITH_POINTS} SELECT point_id, doc_id, chunk_no, n_entries FROM ids")
def q_collection_compact(spark: SparkSession, sf: str) -> DataFrame:
    """K3: two loads of everything, then one compacted load in their place."""
    path, made = scratch_path(spark, "collection"), scratch_path(spark, "points")
    collection.create_collection(spark, path)
    _made_points(spark, sf, made)  # embedded once for both loads
    for _ in range(2):
        collection.upsert_collection(spark, path, spark.read.parquet(made))
    drop_scratch(spark, made)
    collection.compact_collection(spark, path)
    return _stored(spark, path)


WITH_LOADED = f"WITH RECURSIVE {FILES_SQL}, {O.points_ctes('files_parsed', 'pts')}, ids AS ({O.numbered('pts')})"
SQL_LOADED = f"{WITH_LOADED} SELECT point_id, doc_id, chunk_no, n_entries FROM ids"


def _stored(spark, path) -> DataFrame:
    return collection.read_sizes(spark, path)


def _paths(spark, name):
    return scratch_path(spark, f"{name}-collection"), scratch_path(spark, f"{name}-parsed")


@register("load_command", SQL_LOADED)
def q_load_command(spark: SparkSession, sf: str) -> DataFrame:
    """The whole ``load`` command over the corpus files: route, quarantine what cannot be read,
    parse the text files, chunk, embed, create and fill a collection; returns the collection."""
    coll, parsed = _paths(spark, "load")
    commands.load_files(spark, tables.corpus_files(spark, sf), coll, parsed, S)
    return _stored(spark, coll)


@register("load_second_collection", SQL_LOADED)
def q_load_second_collection(spark: SparkSession, sf: str) -> DataFrame:
    """A second collection over the same parsed table gets every text from it."""
    coll, parsed = _paths(spark, "first")
    other, _ = _paths(spark, "second")
    for c in (coll, other):
        commands.load_files(spark, tables.corpus_files(spark, sf), c, parsed, S)
    return _stored(spark, other)


@register("load_append_twice", f"""{WITH_LOADED}
SELECT point_id, doc_id, chunk_no, n_entries FROM ids
UNION ALL SELECT point_id + (SELECT count(*) FROM ids), doc_id, chunk_no, n_entries FROM ids""")
def q_load_append_twice(spark: SparkSession, sf: str) -> DataFrame:
    """K5: the same folder loaded twice in append mode is there twice."""
    coll, parsed = _paths(spark, "append")
    for _ in range(2):
        commands.load_files(spark, tables.corpus_files(spark, sf), coll, parsed, S, mode="append")
    return _stored(spark, coll)


@register("load_full_refresh", f"""WITH RECURSIVE {FILES_SQL},
read AS (SELECT doc_id, text FROM files_parsed UNION ALL SELECT md5(path), body FROM files WHERE ext = 'html'),
{O.points_ctes('read', 'pts')}
SELECT r.doc_id, 1 AS n_versions, sha256(r.text) AS content_sha, coalesce(p.n, 0) AS n_points
FROM read r LEFT JOIN (SELECT doc_id, count(*) AS n FROM pts GROUP BY doc_id) p USING (doc_id)""")
def q_load_full_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + K1: a corrected extractor and a full refresh: the new text wins, one row a version in the parsed table."""
    coll, parsed = _paths(spark, "refresh")
    got = tables.corpus_files(spark, sf)
    commands.load_files(spark, got, coll, parsed, S, extractors={"html": lambda raw: "an early and wrong text"})
    commands.load_files(spark, got, coll, parsed, S, extractors={"html": lambda raw: raw.decode()}, full_refresh=True)
    points = collection.read_collection(spark, coll).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_points"))
    rows = commands.parsed_table(spark, parsed).live("texts")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_versions"), F.max("content_sha").alias("content_sha")) \
        .join(points, "doc_id", "left").select("doc_id", "n_versions", "content_sha", F.coalesce("n_points", F.lit(0)).alias("n_points"))


WITH_CHANGED = f"""{WITH_LOADED}, {O.files_ctes('later', changed=True)}, {O.points_ctes('later_parsed', 'now')},
kept AS (SELECT i.point_id, n.* FROM now n JOIN ids i USING (doc_id, chunk_no)),
fresh AS ({O.numbered('(SELECT * FROM now ANTI JOIN ids USING (doc_id, chunk_no))', '(SELECT count(*) FROM ids)')})"""


@register("load_changed_documents", f"""{WITH_CHANGED}
SELECT point_id, doc_id, chunk_no, n_entries FROM kept UNION ALL SELECT point_id, doc_id, chunk_no, n_entries FROM fresh""")
def q_load_changed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """S6 + J5: a folder whose files change, some into unreadable ones: no old text stays."""
    coll, parsed = _paths(spark, "changed")
    for changed in (False, True):
        commands.load_files(spark, tables.corpus_files(spark, sf, changed), coll, parsed, S)
    return _stored(spark, coll)


@register("load_quarantine", f"WITH {O.files_ctes('later', changed=True)} {SQL_QUARANTINE.format('later')}")
def q_load_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """S3: the stored report of the second load, unreadable files that were loaded before among them."""
    coll, parsed = _paths(spark, "quarantine")
    for changed in (False, True):
        n = commands.load_files(spark, tables.corpus_files(spark, sf, changed), coll, parsed, S, full_refresh=True)["load"]
    return collection.store(spark, coll).rows("quarantine", [n]).select("path", "reason")


SQL_SERVED = f"""WITH RECURSIVE {FILES_SQL}, {O.benchmark_queries_cte()},
{O.search_ctes(source='files_parsed')}
SELECT query_id, rank, doc_id, chunk_no, score, content FROM hits"""


@register("serve_command", SQL_SERVED)
def q_serve_command(spark: SparkSession, sf: str) -> DataFrame:
    """``load`` the corpus files into a collection, then ``serve`` the
    benchmark queries from its postings (non-empty check included)."""
    coll, parsed = _paths(spark, "serve")
    commands.load_files(spark, tables.corpus_files(spark, sf), coll, parsed, S)
    return commands.serve(spark, coll, tables.benchmark_queries(spark, sf), S).hits


# ---------------------------------------------------------------------------
# Streaming
# ---------------------------------------------------------------------------
# What a micro-batch of a table takes (at least one file): its cost is that of its rows and not of its start.
STREAM_BYTES = 256 << 20


def _stream_table(spark, sf, name):
    """A table as a stream, be it one file or a folder of files; a micro-batch takes files up to ``STREAM_BYTES``."""
    schema = tables.table(spark, sf, name).schema
    # a pattern, since a plain path to a file would be taken for the folder of the table
    return (spark.readStream.schema(schema).option("maxBytesPerTrigger", str(STREAM_BYTES))
                 .parquet(f"{sf.rstrip('/')}/{name}.parque[t]"))


@register("stream_ingest", SQL_BM25)
def q_stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a stream -> postings per micro-batch (equals the batch result)."""
    sink, ck = scratch_path(spark, "ingest-sink"), scratch_path(spark, "ingest-ckpt")
    jobs.ingest_stream(_stream_table(spark, sf, "documents"), sink, ck, S).awaitTermination()
    p = jobs.read_sink(spark, sink)
    return p.select("doc_id", "chunk_no", "term", "term_index", "tf", "dl", _r6("weight"))


SQL_STREAM_LOADED = f"""WITH RECURSIVE {FILES_SQL}, docs AS (SELECT * FROM files_parsed), {O.points_ctes('docs', 'pts')}
SELECT doc_id, chunk_no, n_entries FROM pts"""


@register("stream_load_command", SQL_STREAM_LOADED)
def q_stream_load_command(spark: SparkSession, sf: str) -> DataFrame:
    """T1 + K3: files that arrive as a stream, each micro-batch a load of its own."""
    coll, parsed = _paths(spark, "stream")
    arriving = tables.document_files(_stream_table(spark, sf, "documents"))
    commands.stream_files(arriving, coll, parsed, scratch_path(spark, "stream-ckpt"), S).awaitTermination()
    return _stored(spark, coll).drop("point_id")


@register("stream_search", SQL_SEARCH_TOPK)
def q_stream_search(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark queries as a stream, answered against the static index."""
    sink, ck = scratch_path(spark, "search-sink"), scratch_path(spark, "search-ckpt")
    qs = _stream_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"),
        F.lit(None).cast("int").alias("limit"), F.lit(None).cast("string").alias("model"))
    # store the index once; every micro-batch then reads it instead of rebuilding it
    stored = scratch_path(spark, "search-index")
    write_index(_index(spark, sf), stored)
    jobs.search_stream(qs, read_index(spark, stored), sink, ck, S).awaitTermination()
    return jobs.read_sink(spark, sink)


# Audit parameters for the registered queries: requests per user per day vs. 5.
AUDIT_WINDOW, AUDIT_LIMIT = "1 day", 5
SQL_RATE_AUDIT = f"""
SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS n,
       least(count(*), {AUDIT_LIMIT}) AS admitted, greatest(count(*) - {AUDIT_LIMIT}, 0) AS throttled
FROM events GROUP BY user_id, date_trunc('day', ts)"""


@register("rate_audit", SQL_RATE_AUDIT)
def q_rate_audit(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.rate_audit(tables.events(spark, sf), AUDIT_WINDOW, AUDIT_LIMIT)


@register("stream_rate_audit", SQL_RATE_AUDIT)
def q_stream_rate_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The same audit as a watermarked streaming aggregation (update mode)."""
    sink, ck = scratch_path(spark, "audit-sink"), scratch_path(spark, "audit-ckpt")
    jobs.rate_audit_stream(_stream_table(spark, sf, "events"), sink, ck,
                           AUDIT_WINDOW, AUDIT_LIMIT).awaitTermination()
    return jobs.read_rate_audit(spark, sink)


# The events of the first hours of each day arrive after all others, against a watermark of ten days.
LATE_BEFORE_HOUR, LATE_WATERMARK_DAYS = 6, 10


@register("stream_late_rows", f"""
WITH mark AS (SELECT max(ts) - INTERVAL {LATE_WATERMARK_DAYS} DAY AS passed FROM events WHERE hour(ts) >= {LATE_BEFORE_HOUR}),
arrived AS (
  SELECT user_id, date_trunc('day', ts) AS window_start,
         hour(ts) < {LATE_BEFORE_HOUR} AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT passed FROM mark) AS late
  FROM events)
SELECT user_id, window_start, count(*) AS n_arrived, count(*) FILTER (NOT late) AS n_counted,
       count(*) FILTER (late) AS n_late
FROM arrived GROUP BY user_id, window_start""")
def q_stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What the audit's watermark drops, per client and window, when part of the events comes late."""
    ev, src = tables.events(spark, sf), scratch_path(spark, "late-events")
    sink, arrivals = scratch_path(spark, "late-sink"), scratch_path(spark, "late-arrivals")
    checkpoints = scratch_path(spark, "late-ckpt"), scratch_path(spark, "late-arrivals-ckpt")
    late = F.hour("ts") < LATE_BEFORE_HOUR
    for part in (~late, late):
        ev.where(part).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ev.schema).parquet(src)
        jobs.rate_audit_stream(stream, sink, checkpoints[0], AUDIT_WINDOW, AUDIT_LIMIT,
                               f"{LATE_WATERMARK_DAYS} days").awaitTermination()
        jobs.arrivals_stream(stream, arrivals, checkpoints[1], AUDIT_WINDOW).awaitTermination()
    return jobs.late_rows(spark, sink, arrivals)
