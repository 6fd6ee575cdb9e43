"""Term processing and BM25 sparse vectors.

The same functions embed chunks (keys ``doc_id, chunk_no``) and queries (key
``query_id``): tokens -> language vote -> stop-word removal -> stemming ->
term frequency -> BM25 weight -> 32-bit term index -> sparse vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import lexicon
from quarry.functions import text as T

CHUNK_KEYS = ("doc_id", "chunk_no")
QUERY_KEYS = ("query_id",)


def analyze(texts: DataFrame, keys=CHUNK_KEYS, text_col: str = "content") -> DataFrame:
    """Per text: ``tokens``, ``lang_detected`` (nullable) and effective ``lang``.

    Row-local (no shuffle, no join).  Vote: the distinct tokens that are a
    stop word of any language are found once with a hash IN-set; each
    language then counts its own words in that short list; the counts are
    columns of their own projection, so the choice reads them instead of
    recomputing them.
    """
    keys = list(keys)
    codes = lexicon.language_codes()
    toks = texts.select(*keys, T.tokens(text_col).alias("tokens"))
    present = toks.select(*keys, "tokens", T.stopwords_present("tokens").alias("_sw"))
    counts = present.select(*keys, "tokens", *[T.vote_count("_sw", c).alias(f"_n_{c}") for c in codes])
    return (counts.select(*keys, "tokens", T.pick_language({c: f"_n_{c}" for c in codes}).alias("lang_detected"))
                  .withColumn("lang", T.effective_language("lang_detected")))


def token_rows(analyzed: DataFrame, keys=CHUNK_KEYS, drop_stopwords: bool = True,
               stemming: bool = True) -> DataFrame:
    """One row per kept token occurrence: ``keys, lang, dl, term``.

    Stop words are dropped from the token array before the explode, so the
    text length ``dl`` (kept tokens) is known row-locally and no per-text
    window or join is needed later.
    """
    keys = list(keys)
    kept = (F.expr(f"filter(tokens, t -> NOT ({T._stopword_sql('t', 'lang')}))")
            if drop_stopwords else F.col("tokens"))
    rows = analyzed.select(*keys, "lang", kept.alias("_kept"))
    # explode_outer: no inferred size filter, which would tokenize twice.
    rows = (rows.select(*keys, "lang", F.size("_kept").alias("dl"), F.explode_outer("_kept").alias("token"))
                .where(F.col("token").isNotNull()))
    term = T.stem("token", "lang") if stemming else F.col("token")
    return rows.select(*keys, "lang", "dl", term.alias("term"))


def term_frequency(tokens: DataFrame, keys=CHUNK_KEYS) -> DataFrame:
    """``keys, lang, term, tf, dl`` (dl = kept tokens of the text).

    Chunk input is hash-partitioned on the chunk keys, so the grouping reuses
    that partitioning (no exchange).  ``lang`` and ``dl`` are constant per
    text, so they ride along as aggregates instead of grouping keys.
    """
    keys = list(keys)
    return (tokens.groupBy(*keys, "term")
                  .agg(F.count(F.lit(1)).alias("tf"), F.first("lang").alias("lang"), F.first("dl").alias("dl"))
                  .select(*keys, "lang", "term", "tf", F.col("dl").cast("bigint").alias("dl")))


def mean_length(tf: DataFrame, keys=CHUNK_KEYS):
    """Mean ``dl`` of the texts that have terms, as a one-value column of the same plan."""
    return tf.groupBy(*keys).agg(F.first("dl").alias("dl")).agg(F.avg("dl")).scalar()


def bm25_weight(settings: Settings = Settings(), avgdl=None):
    """Weight of ``tf`` occurrences in a text of ``dl`` tokens (unrounded double)."""
    sat = T.bm25_saturation("tf", "dl", settings.k1, settings.b, settings.avgdl if avgdl is None else avgdl)
    return F.col("tf") * sat if settings.fold == "occurrence" else sat


def bm25_weights(tf: DataFrame, settings: Settings = Settings(), avgdl=None) -> DataFrame:
    """Adds ``term_index`` and ``weight``; ``avgdl`` stands in for the one of the settings."""
    return tf.select("*", T.term_index("term").alias("term_index"), bm25_weight(settings, avgdl).alias("weight"))


def embed(texts: DataFrame, keys=CHUNK_KEYS, text_col: str = "content",
          settings: Settings = Settings()) -> DataFrame:
    """Postings (long form): ``keys, lang, term, term_index, tf, dl, weight``.

    With ``avgdl="corpus"`` the texts given are the corpus.
    """
    analyzed = analyze(texts, keys, text_col)
    toks = token_rows(analyzed, keys, stemming=settings.stemming)
    tf = term_frequency(toks, keys)
    return bm25_weights(tf, settings, mean_length(tf, keys) if settings.corpus_length else None)


def embed_terms(texts: DataFrame, keys=CHUNK_KEYS, text_col: str = "content",
                settings: Settings = Settings()) -> DataFrame:
    """Postings that are not weighted yet: ``keys, lang, term, term_index, tf, dl``."""
    toks = token_rows(analyze(texts, keys, text_col), keys, stemming=settings.stemming)
    return term_frequency(toks, keys).withColumn("term_index", T.term_index("term"))


def folded_weights(postings: DataFrame, keys=CHUNK_KEYS) -> DataFrame:
    """Sparse-vector entries: weights of terms sharing one index are summed."""
    keys = list(keys)
    return postings.groupBy(*keys, "term_index").agg(F.sum("weight").alias("weight"))


def sparse_vectors(entries: DataFrame, keys=CHUNK_KEYS) -> DataFrame:
    """Nested form: ``keys, indices ARRAY<BIGINT>, values ARRAY<DOUBLE>`` sorted by index."""
    keys = list(keys)
    pairs = F.array_sort(F.collect_list(F.struct("term_index", "weight")))
    return (entries.groupBy(*keys).agg(pairs.alias("_p"))
                   .select(*keys,
                           F.transform("_p", lambda x: x["term_index"]).alias("indices"),
                           F.transform("_p", lambda x: x["weight"]).alias("values")))
