import pytest
from pyspark.sql import functions as F

from quarry.operators import collection
from quarry.plans.retrieval import build_index
from quarry.session import scratch_path
from quarry.sources.loads import Loads


@pytest.fixture(scope="module")
def pts(spark, sf_smoke):
    idx = build_index(spark.read.parquet(f"{sf_smoke}/documents.parquet"))
    return collection.points(idx.chunks, idx.vectors).checkpoint()


def test_create_is_idempotent(spark):
    path = scratch_path(spark, "coll")
    assert collection.create_collection(spark, path) is True
    assert collection.create_collection(spark, path) is False
    assert collection.read_collection(spark, path).count() == 0


def test_missing_collection_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        collection.read_collection(spark, scratch_path(spark, "nothing"))


def test_empty_collection_refused_for_serving(spark):
    path = scratch_path(spark, "coll")
    collection.create_collection(spark, path)
    with pytest.raises(RuntimeError):
        collection.require_points(collection.read_collection(spark, path))


def test_reload_upsert_unchanged_append_doubled(spark, pts):
    n = pts.count()
    up = scratch_path(spark, "coll")
    collection.create_collection(spark, up)
    collection.upsert_collection(spark, up, pts)
    first = {(r.doc_id, r.chunk_no): r.point_id for r in collection.read_collection(spark, up).collect()}
    collection.upsert_collection(spark, up, pts)
    second = {(r.doc_id, r.chunk_no): r.point_id for r in collection.read_collection(spark, up).collect()}
    assert len(first) == n and first == second
    ap = scratch_path(spark, "coll")
    collection.create_collection(spark, ap)
    collection.upsert_collection(spark, ap, pts, mode="append")
    collection.upsert_collection(spark, ap, pts, mode="append")
    c = collection.read_collection(spark, ap)
    assert c.count() == 2 * n
    assert sorted(r.point_id for r in c.select("point_id").collect()) == list(range(1, 2 * n + 1))


def test_dense_ids_contiguous_in_key_order(spark, pts):
    ids = collection.dense_ids(pts.select("doc_id", "chunk_no"), ["doc_id", "chunk_no"], 100).collect()
    ids.sort(key=lambda r: (r.doc_id, r.chunk_no))
    assert [r.point_id for r in ids] == list(range(101, 101 + len(ids)))


def test_upsert_replaces_whole_documents(spark, pts):
    path = scratch_path(spark, "coll")
    collection.create_collection(spark, path)
    collection.upsert_collection(spark, path, pts)
    before = {(r.doc_id, r.chunk_no): r.point_id for r in collection.read_collection(spark, path).collect()}
    one = str(max(pts.groupBy("doc_id").count().collect(), key=lambda r: r["count"]).doc_id)
    changed = pts.where(F.col("doc_id") == one).where("chunk_no < 2").withColumn("content", F.lit("changed"))
    collection.upsert_collection(spark, path, changed)
    after = collection.read_collection(spark, path).collect()
    assert [r.content for r in after if r.doc_id == one] == ["changed"] * 2
    want = {k: v for k, v in before.items() if k[0] != one or k[1] < 2}
    assert {(r.doc_id, r.chunk_no): r.point_id for r in after} == want
    # a document without new points goes altogether
    collection.upsert_collection(spark, path, changed.limit(0), replaced=changed.select("doc_id"))
    assert collection.read_collection(spark, path).where(F.col("doc_id") == one).count() == 0


def test_ids_are_never_given_twice(spark, pts):
    path = scratch_path(spark, "coll")
    collection.create_collection(spark, path)
    few = pts.orderBy("doc_id", "chunk_no").limit(4).checkpoint()
    collection.upsert_collection(spark, path, few)
    collection.upsert_collection(spark, path, few.where("chunk_no = 0"))
    collection.upsert_collection(spark, path, few, "append")
    ids = [r.point_id for r in collection.read_collection(spark, path).collect()]
    assert len(ids) == len(set(ids)) and max(ids) == 8


def size_of(path):
    import os
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_a_small_load_writes_little_and_an_unfinished_one_is_ignored(spark, pts):
    path = scratch_path(spark, "coll")
    collection.create_collection(spark, path)
    collection.upsert_collection(spark, path, pts)
    whole = size_of(path)
    one = pts.where(F.col("doc_id") == pts.first().doc_id).checkpoint()
    collection.upsert_collection(spark, path, one)
    assert size_of(path) - whole < whole / 4
    s = collection.store(spark, path)
    lost = spark.createDataFrame([("x", 0, "lost", "text", [1], [1.0], 1)], collection.SCHEMAS["points"])
    s.write(s.begin(), "points", lost)  # never completed
    assert collection.read_collection(spark, path).count() == pts.count()
    before = sorted(map(tuple, collection.read_collection(spark, path).select("point_id", "doc_id", "chunk_no").collect()))
    collection.compact_collection(spark, path)
    after = sorted(map(tuple, collection.read_collection(spark, path).select("point_id", "doc_id", "chunk_no").collect()))
    assert len(s.current()) == 1 and after == before and len(after) == pts.count()


def test_two_writers_at_once(spark, pts):
    """Two loads that run side by side: no id is given twice, and the one that finishes last wins."""
    from concurrent.futures import ThreadPoolExecutor
    path = scratch_path(spark, "coll")
    collection.create_collection(spark, path)
    few = pts.orderBy("doc_id", "chunk_no").limit(6).checkpoint()
    with ThreadPoolExecutor(4) as pool:
        loads = list(pool.map(lambda k: collection.upsert_collection(
            spark, path, few.withColumn("content", F.lit(f"writer {k}")), "append" if k % 2 else "upsert"), range(4)))
    assert len(set(loads)) == 4
    s = collection.store(spark, path)
    ids = [r.point_id for r in s.with_ids(s.rows("ids")).collect()]
    new = [r.point_id for r in s.with_ids(s.rows("ids").where("given = load")).collect()]
    assert len(new) == len(set(new)) and set(ids) == set(new) and sorted(new) == list(range(1, len(new) + 1))
    c = collection.read_collection(spark, path).collect()
    order = [f.load for f in s.finished()]
    last_upsert = max(order.index(loads[0]), order.index(loads[2]))
    winners = {f"writer {loads.index(n)}" for n in order[last_upsert:]}
    assert {r.content for r in c} == winners and len(c) == 6 * len(winners)
    assert len({r.point_id for r in c}) == len(c)


def test_a_load_that_finishes_during_a_compaction_is_kept(spark, pts):
    path = scratch_path(spark, "coll")
    collection.create_collection(spark, path)
    few = pts.orderBy("doc_id", "chunk_no").limit(3).checkpoint()
    collection.upsert_collection(spark, path, few)
    s = collection.store(spark, path)
    now, compacted = s.current(), s.begin()
    for part in ("points", "ids", "docs", "postings"):
        s.write(compacted, part, s.live(part).drop("load"), *(["term_bucket"] if part == "postings" else []))
    collection.upsert_collection(spark, path, few.withColumn("content", F.lit("later")))
    s.complete(compacted, covers=now)
    assert [r.content for r in collection.read_collection(spark, path).collect()] == ["later"] * 3
    assert s.live("postings").select("doc_id", "chunk_no").distinct().count() == 3


def test_appended_copies_stay_apart_after_compaction(spark, pts):
    from quarry.plans import commands
    path = scratch_path(spark, "coll")
    collection.create_collection(spark, path)
    one = pts.orderBy("doc_id", "chunk_no").limit(1).checkpoint()
    for _ in range(2):
        collection.upsert_collection(spark, path, one, "append")
    q = spark.createDataFrame([(1, one.first().content, None, None)], "query_id long, query string, limit long, model string")
    before = sorted(map(tuple, commands.serve(spark, path, q).hits.collect()))
    collection.compact_collection(spark, path)
    assert len(before) == 2 and sorted(map(tuple, commands.serve(spark, path, q).hits.collect())) == before


def test_fields_are_searched_apart(spark, pts):
    from quarry.plans import commands
    path = scratch_path(spark, "coll")
    collection.create_collection(spark, path)
    three = pts.orderBy("doc_id", "chunk_no").limit(3).checkpoint()
    collection.upsert_collection(spark, path, three, field="title")
    assert collection.read_collection(spark, path).count() == 0
    assert collection.read_collection(spark, path, "title").count() == 3
    q = spark.createDataFrame([(1, three.first().content, None, None)], "query_id long, query string, limit long, model string")
    assert commands.serve(spark, path, q, field="title").hits.count() > 0
    with pytest.raises(RuntimeError):
        commands.serve(spark, path, q)


def test_a_load_keeps_no_shuffle_files_and_writes_every_bucket(spark, monkeypatch):
    """Postings go out in passes, each bucket once; what a step shuffled is dropped with it, and the setting is put back."""
    from quarry.session import CLEAN_UP
    path, seen, write = scratch_path(spark, "coll"), [], Loads.write
    monkeypatch.setattr(Loads, "write", lambda self, load, part, df, *by: (seen.append((part, spark.conf.get(CLEAN_UP, None))), write(self, load, part, df, *by))[1])
    collection.create_collection(spark, path)
    seen.clear()
    rows = [(f"d{i}", 0, "text", list(range(i, i + 70)), [1.0 + i] * 70) for i in range(3)]
    collection.upsert_collection(spark, path, spark.createDataFrame(rows, "doc_id string, chunk_no int, content string, indices array<bigint>, values array<double>"))
    assert [part for part, _ in seen].count("postings") == 4 and {on for _, on in seen} == {"true"}
    assert spark.conf.get(CLEAN_UP, None) != "true"
    postings, _, buckets = collection.read_postings(spark, path)
    got = sorted((r.doc_id, r.term_index, r.term_bucket, r.weight) for r in postings.collect())
    assert got == [(d, i, i % buckets, v) for d, _, _, ids, (v, *_) in rows for i in ids]
    sizes = sorted(map(tuple, collection.read_sizes(spark, path).collect()))
    assert sizes == [(1, "d0", 0, 70), (2, "d1", 0, 70), (3, "d2", 0, 70)]


def test_threads_leave_the_setting_as_it_was(spark):
    """The first to enter is the first to leave: the others keep the setting, and it does not stay."""
    from quarry.session import CLEAN_UP, shuffles_dropped
    before = spark.conf.get(CLEAN_UP, None)
    first, second = shuffles_dropped(spark), shuffles_dropped(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(CLEAN_UP) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(CLEAN_UP, None) == before
