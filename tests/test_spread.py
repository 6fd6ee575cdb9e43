"""A task of the term path gets a fixed amount of text, however large the corpus."""

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import chunking
from quarry.plans.retrieval import build_index


def test_partitions_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(chunking, "SPREAD_BYTES", 1 << 14)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("words of text "), "id", F.lit(". ")), 100).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    chunks = chunking.chunk_documents(docs)
    assert chunks.rdd.getNumPartitions() == -(-total // (1 << 14))
    most = max(r["n"] for r in build_index(docs).postings.groupBy(F.spark_partition_id()).agg(
        F.countDistinct("doc_id", "chunk_no").alias("n")).collect())
    assert most < 80   # of some 800 chunks
    assert chunks.agg(F.sum("n_bytes")).first()[0] == total


def test_no_text_and_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert chunking.chunk_documents(docs).count() == 0
    assert config.SPREAD_BYTES > 0
