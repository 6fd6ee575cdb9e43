"""The term path as joins with tables: stop words by (language, term), stems by vocabulary.

Gives the rows of ``terms.embed``.  A text's distinct tokens are counted first, so each is
compared, judged and stemmed once a text and not once an occurrence; each distinct
(language, token) of the corpus is stemmed once and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import lexicon
from quarry.functions import text as T
from quarry.operators import skew
from quarry.operators.terms import CHUNK_KEYS, bm25_weights, mean_length
from quarry.session import scratch_path, shuffles_dropped


def stopword_table(spark: SparkSession) -> DataFrame:
    """``lang, term``: the fixed word lists (a few thousand rows)."""
    rows = [(c, w) for c in lexicon.language_codes() for w in lexicon.stopwords(c)]
    return spark.createDataFrame(rows, "lang string, term string")


def token_counts(texts: DataFrame, keys=CHUNK_KEYS, text_col: str = "content") -> DataFrame:
    """``keys, token, n``: the distinct tokens of each text (no exchange where texts are
    partitioned on their keys)."""
    each = texts.select(*keys, F.explode_outer(T.tokens(text_col)).alias("token")).where(F.col("token").isNotNull())
    return each.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def language_votes(counts: DataFrame, stopwords: DataFrame, keys=CHUNK_KEYS) -> DataFrame:
    """``keys, lang_detected``: the language with most of its stop words among a text's
    distinct tokens, the alphabetically first of equals; texts without any have no row."""
    found = counts.join(F.broadcast(stopwords.select("lang", F.col("term").alias("token"))), "token")
    tally = found.groupBy(*keys, "lang").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("less"), "lang"))
    return tally.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.lang").alias("lang_detected"))


def analyze(counts: DataFrame, stopwords: DataFrame, keys=CHUNK_KEYS) -> DataFrame:
    """``keys, token, n, lang_detected, lang`` for each distinct token of a text."""
    return (counts.join(language_votes(counts, stopwords, keys), list(keys), "left")
                  .withColumn("lang", T.effective_language("lang_detected")))


def drop_stopwords(analyzed: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Rows whose token is no stop word of their text's language (broadcast anti join)."""
    listed = stopwords.select("lang", F.col("term").alias("token"))
    return analyzed.join(F.broadcast(listed), ["lang", "token"], "left_anti")


def vocabulary(kept: DataFrame) -> DataFrame:
    """``lang, token, n_texts, term``: the distinct vocabulary, each word stemmed once."""
    words = kept.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n_texts"))
    return words.withColumn("term", T.stem("token", "lang"))


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, name)
    with shuffles_dropped(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def embed(texts: DataFrame, keys=CHUNK_KEYS, text_col: str = "content",
          settings: Settings = Settings()) -> DataFrame:
    """Postings ``keys, lang, term, tf, dl, term_index, weight``, as ``terms.embed`` gives them.

    The kept tokens and their vocabulary are written to scratch tables, since the lookup of the
    stems needs both several times: texts are cut and judged in one pass.
    """
    keys = list(keys)
    stop = stopword_table(texts.sparkSession)
    kept = drop_stopwords(analyze(token_counts(texts, keys, text_col), stop, keys), stop)
    kept = kept.withColumn("dl", F.sum("n").over(Window.partitionBy(*keys)))
    if settings.stemming:
        kept = _written(kept, "kept-tokens")
        kept = skew.lookup(kept, _written(vocabulary(kept), "vocabulary"), ["lang", "token"], "term", "n_texts", keys, stored=True)
    else:
        kept = kept.withColumn("term", F.col("token"))
    tf = (kept.groupBy(*keys, "term").agg(F.sum("n").alias("tf"), F.first("lang").alias("lang"), F.first("dl").alias("dl"))
              .select(*keys, "lang", "term", "tf", "dl"))
    return bm25_weights(tf, settings, mean_length(tf, keys) if settings.corpus_length else None)
