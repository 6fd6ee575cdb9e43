"""Queries that need the corpus several times embed it once."""

from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import collection, scoring, search, skew, statistics, terms, termtables
from quarry.plans import registry, retrieval
from quarry.plans.retrieval import build_index, retrieve, store_terms
from quarry.session import scratch_path

BOTH = Settings(avgdl="corpus", idf=True)


def docs(spark):
    return spark.createDataFrame([(i, "alpha " * (i % 3) + f"beta word{i}. the of") for i in range(40)] + [(90, None), (91, "the of")],
                                 "doc_id long, text string")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_marked_rows_count_as_chunks_do(spark):
    rows = terms.embed_terms(build_index(docs(spark)).chunks)
    rows = rows.unionByName(rows.where("doc_id = 5").withColumn("term", F.lit("same index")))  # two terms of one index
    want, got = statistics.corpus_stats(rows), statistics.corpus_stats(statistics.marked(rows).repartition(5, "term"))
    assert got.size.first() == want.size.first()
    assert sorted(map(tuple, got.terms.collect())) == sorted(map(tuple, want.terms.collect()))
    assert "Window" in optimized(got.size) and optimized(got.size).count("Aggregate") < optimized(want.size).count("Aggregate")


def test_stored_terms_give_the_weights_of_the_lazy_index(spark):
    idx = build_index(docs(spark), BOTH)
    held = store_terms(idx, scratch_path(spark, "terms"))
    assert "posexplode" not in optimized(held.postings) + optimized(held.stats.terms) + optimized(held.stats.size)
    rows = lambda x, **kw: sorted((r.doc_id, r.chunk_no, r.term, r.tf, r.dl, r.df, round(r.weight, 9)) for r in
                                  statistics.with_document_frequency(x.postings, x.stats, **kw).collect())
    assert rows(held, stored=True) == rows(idx)
    nothing = store_terms(build_index(docs(spark).limit(0), BOTH), scratch_path(spark, "terms"))
    assert nothing.postings.count() == 0


def test_stored_lookup_keeps_every_row(spark):
    rows = spark.createDataFrame([(n, "hot" if n < 90 else f"k{n}") for n in range(100)] + [(100, "unknown"), (101, None)], "n long, k string")
    table = rows.where("k != 'unknown'").groupBy("k").agg(F.count(F.lit(1)).alias("m")).withColumn("v", F.upper("k"))
    for most in (2, 10_000):
        got = skew.lookup(rows, table, ["k"], "v", "m", ["n"], max_hot=most, stored=True).collect()
        assert sorted(r.n for r in got) == list(range(102))
        assert all(r.v == (None if r.k in (None, "unknown") else r.k.upper()) for r in got)


def test_the_shuffle_join_makes_its_postings_once(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "alpha", 5, None), (2, "beta word7", None, None)], "query_id long, query string, limit long, model string")
    idx, seen, hot = build_index(docs(spark)), [], search.hot_terms
    want = retrieve(asked, idx).hits
    monkeypatch.setattr(search, "hot_terms", lambda stats: (seen.append(optimized(stats)), hot(stats))[1])
    got = retrieve(asked, idx, force_shuffle=True).hits
    assert seen and "posexplode" not in seen[0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_both_loads_of_the_compacted_collection_take_the_same_points(spark, monkeypatch, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    seen, upsert = [], collection.upsert_collection
    monkeypatch.setattr(collection, "upsert_collection", lambda s, p, new: (seen.append(optimized(new)), upsert(s, p, new))[1])
    got = registry.q_collection_compact(spark, str(tmp_path)).collect()
    assert len(seen) == 2 and not any("posexplode" in p for p in seen)
    assert sorted(r.point_id for r in got) == list(range(1, 41))


def test_a_batch_with_statistics_embeds_the_corpus_once(spark, monkeypatch):
    """Mean length, frequencies and scores come from the rows of the batch's terms, which are written once."""
    asked = spark.createDataFrame([(1, "alpha", 5, None), (2, "beta word7", None, None), (3, "nowhere", None, None)],
                                  "query_id long, query string, limit long, model string")
    idx, seen, scores = build_index(docs(spark), BOTH), [], scoring.best_scores
    path = scratch_path(spark, "once-index")
    retrieval.write_index(idx, path)
    want = retrieve(asked, retrieval.read_index(spark, path), BOTH).hits
    monkeypatch.setattr(scoring, "best_scores", lambda q, d, *a: (seen.extend(map(optimized, (q, d))), scores(q, d, *a))[1])
    got = retrieve(asked, idx, BOTH).hits.select(*want.columns)
    assert seen and not any("posexplode" in p for p in seen)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert retrieve(asked, build_index(docs(spark).limit(0), BOTH), BOTH).hits.count() == 0


def test_the_joined_term_path_reads_the_texts_once(spark):
    """Tokens and vocabulary are written, so that the lookup of the stems does not cut and judge the texts again."""
    idx = build_index(docs(spark))
    got = termtables.embed(idx.chunks)
    assert "posexplode" not in optimized(got) and "Generate" not in optimized(got)
    rows = lambda df: sorted((r.doc_id, r.chunk_no, r.lang, r.term, r.tf, r.dl, r.term_index, round(r.weight, 9)) for r in df.collect())
    assert rows(got) == rows(idx.postings)


def test_all_loads_of_the_shrunk_collection_take_the_same_points(spark, monkeypatch, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    seen, upsert = [], collection.upsert_collection
    monkeypatch.setattr(collection, "upsert_collection", lambda s, p, new, *a, **kw: (seen.append(optimized(new)), upsert(s, p, new, *a, **kw))[1])
    got = registry.q_collection_shrink_append(spark, str(tmp_path)).collect()
    assert len(seen) == 3 and not any("posexplode" in p for p in seen)
    assert sorted(r.point_id for r in got) == list(range(1, 81))
