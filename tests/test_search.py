from pyspark.sql import functions as F

from quarry.config import CONTEXT_SEPARATOR
from quarry.plans.retrieval import build_index, retrieve


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def ask(spark, rows, limit=None, model=None):
    return spark.createDataFrame(
        [(i, q, limit, model) for i, q in enumerate(rows)],
        "query_id long, query string, limit int, model string")


def test_reference_request(spark):
    # the reference's API test: 'Is this a test?' with limit 1 against test.txt
    idx = build_index(corpus(spark, [(1, "This is a test!\n")]))
    a = retrieve(ask(spark, ["Is this a test?"], limit=1), idx)
    hits = a.hits.collect()
    assert [(h.rank, h.content) for h in hits] == [(1, "This is a test!\n")]
    p = a.prompts.first()
    assert p.model == "gpt-4.1"
    assert p.prompt == ("Based on this context:\n\n```text\nThis is a test!\n\n```\n\n, reply to this query:"
                        "\n\n```text\nIs this a test?\n```")


def test_zero_hit_query_still_gets_a_prompt(spark):
    idx = build_index(corpus(spark, [(1, "alpha beta gamma")]))
    a = retrieve(ask(spark, ["zzzz qqqq"]), idx)
    assert a.hits.count() == 0
    ctx = a.contexts.first()
    assert (ctx.n_hits, ctx.context) == (0, "")
    assert a.prompts.count() == 1


def test_null_limit_defaults_to_ten(spark):
    docs = [(i, f"apple number {i}.") for i in range(25)]
    idx = build_index(corpus(spark, docs))
    a = retrieve(ask(spark, ["apple"]), idx)
    assert a.hits.count() == 10
    assert [h.doc_id for h in a.hits.orderBy("rank").collect()] == list(range(10))


def test_ties_break_on_doc_id(spark):
    idx = build_index(corpus(spark, [(7, "same words here"), (3, "same words here")]))
    a = retrieve(ask(spark, ["same words"], limit=2), idx)
    assert [h.doc_id for h in a.hits.orderBy("rank").collect()] == [3, 7]


def test_limits_per_query_and_context_order(spark):
    idx = build_index(corpus(spark, [(1, "red apple"), (2, "red red apple"), (3, "green pear")]))
    q = spark.createDataFrame([(1, "red apple", 1, None), (2, "red", None, "m")],
                              "query_id long, query string, limit int, model string")
    a = retrieve(q, idx)
    per = {r.query_id: r.n for r in a.hits.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert per == {1: 1, 2: 2}
    ctx = {r.query_id: r.context for r in a.contexts.collect()}
    assert ctx[2] == "red red apple" + CONTEXT_SEPARATOR + "red apple"
    assert {r.query_id: r.model for r in a.prompts.collect()} == {1: "gpt-4.1", 2: "m"}


def stored_index(spark, sf_smoke, n_buckets=8):
    from quarry.plans.retrieval import read_index, write_index
    from quarry.session import scratch_path
    from quarry.sources import tables
    path = scratch_path(spark, "index")
    write_index(build_index(tables.documents(spark, sf_smoke)), path, n_buckets=n_buckets)
    return read_index(spark, path)


def test_topk_plan_trims_before_shuffle(spark, sf_smoke):
    from quarry.sources import tables
    a = retrieve(tables.benchmark_queries(spark, sf_smoke), stored_index(spark, sf_smoke))
    plan = a.hits._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "BroadcastHashJoin" in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_an_unstored_corpus_is_cut_once(spark, sf_smoke):
    from quarry.sources import tables
    a = retrieve(tables.benchmark_queries(spark, sf_smoke), build_index(tables.documents(spark, sf_smoke)))
    plan = a.hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and "LeftSemi" in plan  # the documents hit, for their content


def test_large_limits_rank_in_two_steps(spark):
    docs = [(i, f"apple number {i % 7}.") for i in range(300)]
    idx = build_index(corpus(spark, docs))
    q = spark.createDataFrame([(1, "apple", 3_000_000_000, None), (2, "apple", 5, None), (3, "apple", 0, None), (4, "apple", -1, None)],
                              "query_id long, query string, limit long, model string")
    a = retrieve(q, idx)
    per = {r.query_id: r["count"] for r in a.hits.groupBy("query_id").count().collect()}
    assert per == {1: 300, 2: 5}
    assert {r.query_id for r in a.prompts.collect()} == {1, 2, 3}
    first = [r.doc_id for r in a.hits.where("query_id = 1").orderBy("rank").limit(5).collect()]
    assert first == [r.doc_id for r in a.hits.where("query_id = 2").orderBy("rank").collect()]


def test_salted_shuffle_path_equals_broadcast(spark, sf_smoke):
    from quarry.sources import tables
    idx = build_index(tables.documents(spark, sf_smoke))
    q = tables.benchmark_queries(spark, sf_smoke)
    b = retrieve(q, idx).hits.select("query_id", "rank", "doc_id", "chunk_no", "score")
    s_ans = retrieve(q, idx, force_shuffle=True).hits
    plan = retrieve(q, stored_index(spark, sf_smoke), force_shuffle=True).hits._jdf.queryExecution().executedPlan().toString()
    s = s_ans.select("query_id", "rank", "doc_id", "chunk_no", "score")
    assert sorted(map(tuple, b.collect())) == sorted(map(tuple, s.collect()))
    assert "_salt" in plan


def test_hot_terms_bound(spark):
    from quarry.operators.search import hot_terms
    stats = spark.createDataFrame([(i, 1) for i in range(100)] + [(1000, 500)], "term_index long, n_postings long")
    assert [r.term_index for r in hot_terms(stats, max_hot=4).collect()] == [1000]


def test_stored_index_serves_same_hits(spark, sf_smoke):
    from quarry.plans.retrieval import read_index, write_index
    from quarry.session import scratch_path
    from quarry.sources import tables
    idx = build_index(tables.documents(spark, sf_smoke))
    path = scratch_path(spark, "index")
    write_index(idx, path, n_buckets=8)
    stored = read_index(spark, path)
    assert stored.term_buckets == 8
    q = tables.benchmark_queries(spark, sf_smoke)
    a = retrieve(q, idx).hits
    b = retrieve(q, stored).hits
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    one = q.where("query_id = 0")
    plan = retrieve(one, stored).hits._jdf.queryExecution().executedPlan().toString()
    assert "term_bucket" in plan


def test_small_batch_pushes_terms_into_stored_scan(spark, sf_smoke):
    from quarry.plans.retrieval import read_index, write_index
    from quarry.session import scratch_path
    from quarry.sources import tables
    idx = build_index(tables.documents(spark, sf_smoke))
    path = scratch_path(spark, "index")
    write_index(idx, path, n_buckets=16)
    stored = read_index(spark, path)
    one = tables.benchmark_queries(spark, sf_smoke).where("query_id = 1")
    hits = retrieve(one, stored).hits
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "In(term_index" in plan
    a = retrieve(one, idx).hits.select("query_id", "rank", "doc_id", "chunk_no", "score")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, hits.select(*a.columns).collect()))


def test_hot_term_is_detected_and_spread(spark):
    from quarry.config import HOT_TERM_SALTS
    from quarry.operators.search import hot_terms, term_stats
    from quarry.functions import text as T
    docs = [(i, f"zebra common words number{i} here.") for i in range(200)]
    idx = build_index(corpus(spark, docs))
    hot = {r.term_index for r in hot_terms(term_stats(idx.search_side), max_hot=10).collect()}
    zebra = spark.range(1).select(T.term_index(F.lit("zebra")).alias("i")).first().i
    assert zebra in hot
    q = ask(spark, ["zebra"])
    a = retrieve(q, idx).hits.select("doc_id", "score")
    b = retrieve(q, idx, force_shuffle=True).hits.select("doc_id", "score")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    # the hot term's postings land in every salt bucket
    salts = (idx.search_side.where(F.col("term_index") == zebra)
             .select(F.pmod(F.hash("doc_id", "chunk_no"), F.lit(HOT_TERM_SALTS)).alias("s")).distinct().count())
    assert salts == HOT_TERM_SALTS


def test_responses_and_errors(spark):
    from quarry.operators import prompts as P
    idx = build_index(corpus(spark, [(1, "red apple"), (2, "red red apple"), (3, "green pear")]))
    q = spark.createDataFrame([(1, "red", 2, None), (2, "pear", None, None), (3, "plum", -1, None)],
                              "query_id long, query string, limit int, model string")
    a = retrieve(q.where("query_id < 3"), idx)
    answers = spark.createDataFrame([(1, "It is red."), (2, None)], "query_id long, response string")
    r = {x.query_id: (x.response, x.retrieved) for x in P.responses(answers, a.hits, a.queries).collect()}
    assert r == {1: ("It is red.", ["red red apple", "red apple"])}
    errs = {x.query_id: (x.status_code, x.detail) for x in P.query_errors(answers, q).collect()}
    assert errs[2][0] == 500 and errs[3][0] == 422 and 1 not in errs


def test_errors_by_stage(spark):
    from quarry.operators import prompts as P
    idx = build_index(corpus(spark, [(1, "red apple"), (2, "green pear")]))
    q = spark.createDataFrame(
        [(1, "red", "2", None), (2, "red", "two", None), (3, "red", "-1", ""), (4, None, "1", ""), (5, "red", None, " "),
         (6, "pear", "3", "m"), (7, "pear", None, "m"), (8, "pear", "1", "m"), (9, "", "1", "m")],
        "query_id long, query string, limit string, model string")
    answers = spark.createDataFrame(
        [(1, None, "x"), (1, "yes", None), (1, "yes", None), (6, None, "a"), (6, None, "b"), (7, None, None), (4, "no", None), (9, "none", None)],
        "query_id long, response string, error string")
    errs = {r.query_id: (r.stage, r.status_code) for r in P.query_errors(answers, q).collect()}
    assert errs == {2: ("request", 422), 3: ("request", 422), 4: ("search", 500), 5: ("prompt", 500),
                    6: ("response", 500), 7: ("response", 500), 8: ("response", 500)}
    details = {r.query_id: r.detail for r in P.query_errors(answers, q).collect()}
    assert details[6].endswith(" of b") and details[7] == details[8]
    # a failing request has what comes before its stage and nothing else; others are not disturbed
    a = retrieve(q, idx)
    assert sorted(r.query_id for r in a.hits.collect()) == [1, 5, 6, 7, 8]
    assert sorted(r.query_id for r in a.prompts.collect()) == [1, 6, 7, 8, 9]
    # empty tables
    assert P.query_errors(answers.limit(0), q.where("query_id = 1")).first().stage == "response"
    assert P.query_errors(answers, q.limit(0)).count() == 0

