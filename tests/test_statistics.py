"""Corpus statistics, the term path by tables, and the skew-safe lookup."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import collection, skew, statistics, terms, termtables
from quarry.plans import commands
from quarry.plans.retrieval import build_index, read_index, retrieve, write_index
from quarry.session import scratch_path

DOCS = [(1, "alpha beta beta"), (2, "alpha gamma"), (3, "alpha"), (4, ""), (5, None), (6, "the of and")]
QUERIES = [(1, "alpha gamma", None, None), (2, "zebra", None, None), (3, None, None, None)]
BOTH = Settings(avgdl="corpus", idf=True)


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string, limit long, model string")


def test_statistics_count_chunks_that_have_terms(spark):
    stats = build_index(docs(spark), BOTH).stats
    assert tuple(stats.size.first()) == (3, 2.0)
    assert sorted(r.df for r in stats.terms.collect()) == [1, 1, 3]


def test_statistics_of_an_empty_corpus(spark):
    idx = build_index(docs(spark, []), BOTH)
    assert tuple(idx.stats.size.first()) == (0, None) and idx.stats.terms.count() == 0
    assert retrieve(queries(spark), idx, BOTH).hits.count() == 0


def test_idf_and_mean_length_worked_values(spark):
    idx = build_index(docs(spark), BOTH)
    got = {(r.query_id, r.doc_id): r.score for r in retrieve(queries(spark), idx, BOTH).hits.collect()}
    sat = lambda tf, dl: tf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 2.0))
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    q = sat(1, 2)
    want = {(1, 1): q * idf(3) * sat(1, 3), (1, 2): q * sat(1, 2) * (idf(3) + idf(1)), (1, 3): q * idf(3) * sat(1, 1)}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}


def test_off_by_default(spark):
    plain, idx = Settings(), build_index(docs(spark))
    assert not plain.uses_statistics
    w = {(r.doc_id, r.term): r.weight for r in idx.postings.collect()}
    assert w[(2, "alpha")] == pytest.approx(1.363881, abs=1e-6)


def test_stored_index_keeps_its_statistics(spark):
    path = scratch_path(spark, "stat-index")
    write_index(build_index(docs(spark), BOTH), path)
    lazy = retrieve(queries(spark), build_index(docs(spark), BOTH), BOTH).hits
    stored = retrieve(queries(spark), read_index(spark, path), BOTH).hits
    assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, stored.collect()))


def test_an_index_without_statistics_refuses_to_use_them(spark):
    path = scratch_path(spark, "plain-index")
    write_index(build_index(docs(spark)), path)
    with pytest.raises(ValueError):
        retrieve(queries(spark), read_index(spark, path), Settings(idf=True))
    with pytest.raises(ValueError):
        retrieve(queries(spark), build_index(docs(spark)), BOTH)


def test_serving_a_collection_with_idf(spark):
    """Frequencies of a collection are those of its live points: a replaced document counts once."""
    path, s = scratch_path(spark, "idf-coll"), Settings(idf=True)
    collection.create_collection(spark, path)
    for rows in (DOCS, [(3, "alpha gamma delta")]):
        idx = build_index(docs(spark, rows))
        collection.upsert_collection(spark, path, collection.points(idx.chunks, idx.vectors))
    now = [r for r in DOCS if r[0] != 3] + [(3, "alpha gamma delta")]
    want = retrieve(queries(spark), build_index(docs(spark, now)), s).hits
    got = commands.serve(spark, path, queries(spark), s).hits
    assert {(r.query_id, int(r.doc_id), r.score) for r in got.collect()} == {(r.query_id, r.doc_id, r.score) for r in want.collect()}
    with pytest.raises(ValueError):
        commands.serve(spark, path, queries(spark), BOTH)


@pytest.mark.parametrize("stemming", [True, False])
def test_tables_give_the_rows_of_expressions(spark, stemming):
    rows = DOCS + [(7, "der Hund und die Katze sind nicht im Haus"), (8, "le chat et la maison des chevaux"), (8, "twice")]
    texts = docs(spark, rows).select("doc_id", F.monotonically_increasing_id().alias("chunk_no"), F.col("text").alias("content"))
    s = Settings(stemming=stemming)
    rounded = lambda df: sorted((r.doc_id, r.chunk_no, r.lang, r.term, r.tf, r.dl, r.term_index, round(r.weight, 9))
                                for r in df.collect())
    texts = spark.createDataFrame(texts.collect(), texts.schema)
    assert rounded(termtables.embed(texts, settings=s)) == rounded(terms.embed(texts, settings=s))


def test_each_vocabulary_word_is_stemmed_once(spark):
    texts = docs(spark, [(n, "cats boxes cats") for n in range(50)]).select("doc_id", F.lit(0).alias("chunk_no"), F.col("text").alias("content"))
    stop = termtables.stopword_table(spark)
    kept = termtables.drop_stopwords(termtables.analyze(termtables.token_counts(texts), stop), stop)
    assert {tuple(r) for r in termtables.vocabulary(kept).collect()} == {("en", "cats", 50, "cat"), ("en", "boxes", 50, "boxe")}


def test_lookup_spreads_a_hot_key(spark):
    """A key of nearly all rows is answered by the broadcast and its rows are dealt out."""
    rows = spark.createDataFrame([(n, "hot" if n < 900 else f"k{n}") for n in range(1000)] + [(1000, "unknown")], "n long, k string")
    table = rows.where("k != 'unknown'").groupBy("k").agg(F.count(F.lit(1)).alias("m")).withColumn("v", F.upper("k"))
    for most in (10, 10_000):  # the one key is hot, then all are
        got = skew.lookup(rows, table, ["k"], "v", "m", ["n"], max_hot=most).collect()
        assert len(got) == 1001
        assert all(r.v == (None if r.k == "unknown" else r.k.upper()) for r in got)
