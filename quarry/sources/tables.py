"""Readers for the input tables and the query sets derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _turn_id():
    """query_id of a conversation turn."""
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


# The requests made of conversation turns ask for different numbers of hits (-1: a bad
# request) and models (fixed values, by the remainder of conv_id + turn).
REQUEST_LIMITS = (0, 1, 5, 1500, None, -1)
REQUEST_MODELS = ("small-model", None, None, "large-model")


# Of the requests for the account of errors, by conv_id + 2 * turn (fixed values): the divisor, and
# the remainders of those without a text, of those whose model has no name, and of those that the service refuses.
FAILURE_DIVISOR, NO_TEXT, NAMELESS_MODEL, REFUSED = 11, (3,), (4, 7), (5, 9)
REFUSAL = "the rate limit of the service"


def _by_remainder(values: tuple, kind: str):
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(values)))
    out = F.lit(None).cast(kind)
    for k, v in enumerate(values):
        if v is not None:
            out = F.when(n == k, F.lit(v).cast(kind)).otherwise(out)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``queries(query_id, query, limit, model)`` from the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"),
        F.lit(None).cast("bigint").alias("limit"), F.lit(None).cast("string").alias("model"))


def conversation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations as a second query set, with limits and models of their own."""
    c = table(spark, sf_dir, "conversations")
    return c.where(F.col("role") == "user").select(
        _turn_id().alias("query_id"), F.col("text").alias("query"),
        _by_remainder(REQUEST_LIMITS, "bigint").alias("limit"), _by_remainder(REQUEST_MODELS, "string").alias("model"))


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``answers(query_id, response)``: the assistant turn that follows a user turn."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn")
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return u.join(a, ["conv_id", "turn"]).select(_turn_id().alias("query_id"), "response")


def _fails(remainders: tuple):
    return F.pmod(F.col("conv_id") + 2 * F.col("turn"), F.lit(FAILURE_DIVISOR)).isin(*remainders)


def failing_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All user turns as requests and their answers, some of which fail at each stage (limits as text, one kind no number)."""
    c = table(spark, sf_dir, "conversations")
    limit = _by_remainder(REQUEST_LIMITS, "string")
    queries = c.where(F.col("role") == "user").select(
        _turn_id().alias("query_id"), F.when(~_fails(NO_TEXT), F.col("text")).alias("query"),
        F.when(limit == "1500", F.lit("many")).otherwise(limit).alias("limit"),
        F.when(_fails(NAMELESS_MODEL), F.lit(" ")).otherwise(_by_remainder(REQUEST_MODELS, "string")).alias("model"))
    turn = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    answers = turn.select(_turn_id().alias("query_id"), F.when(~_fails(REFUSED), F.col("response")).alias("response"),
                          F.when(_fails(REFUSED), F.lit(REFUSAL)).alias("error"))
    return queries, answers


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# Modification times of files derived from table rows, first and changed.
DERIVED_FILE_MTIME, CHANGED_FILE_MTIME = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
# Extension of a document's file by doc_id % 50 (others: .txt); BAD_UTF8's content gets an FF byte in front.
DOCUMENT_EXTENSIONS = {7: ".pdf", 11: "", 17: ".md"}
BAD_UTF8 = 13


def document_files(docs: DataFrame, changed: bool = False) -> DataFrame:
    """Documents as ``binaryFile``-shaped rows, of all kinds a folder may hold.

    ``changed``: a later state of the folder, in which every third document has a
    further sentence and, of the others, every seventh is no longer UTF-8.
    """
    n, more = F.pmod("doc_id", F.lit(50)), F.pmod("doc_id", F.lit(3)) == 0
    bad = n == BAD_UTF8
    text, mtime = F.col("text"), F.lit(DERIVED_FILE_MTIME)
    if changed:
        spoilt = ~more & (F.pmod("doc_id", F.lit(7)) == 0)
        bad, text = bad | spoilt, F.when(more, F.concat("text", F.lit(" Amended."))).otherwise(F.col("text"))
        mtime = F.when(more | spoilt, F.lit(CHANGED_FILE_MTIME)).otherwise(mtime)
    ext = F.lit(".txt")
    for k, v in DOCUMENT_EXTENSIONS.items():
        ext = F.when(n == k, F.lit(v)).otherwise(ext)
    content = F.when(bad, F.concat(F.unhex(F.lit("FF")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    return docs.select(F.concat(F.lit("corpus/"), F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), ext).alias("path"),
                       mtime.cast("timestamp").alias("modificationTime"), F.octet_length(content).cast("bigint").alias("length"),
                       content.alias("content"))


def corpus_files(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """The corpus as files: documents under ``corpus/<source>/`` and raw pages as ``.html`` under ``web/``."""
    p = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("web/page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.lit(DERIVED_FILE_MTIME).cast("timestamp").alias("modificationTime"),
        F.octet_length("html").cast("bigint").alias("length"), F.encode("html", "UTF-8").alias("content"))
    return document_files(documents(spark, sf_dir), changed).unionByName(p)
