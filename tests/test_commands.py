import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import collection
from quarry.plans import commands
from quarry.session import scratch_path

PDF = {"pdf": lambda b: b.decode("latin-1").split(" ", 1)[1]}


def make_folder():
    d = tempfile.mkdtemp(prefix="quarry-load-", dir="/tmp")
    files = {"test.txt": "This is a test!\n", "unsupported.json": '{"test": "this is a test"}\n',
             "notes.md": "# Notes\nApples and pears are fruit.\n"}
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    with open(os.path.join(d, "sample.pdf"), "wb") as f:
        f.write(b"%PDF-1.4 Sample PDF about oranges.")
    return d


def ask(spark, text, limit=None):
    return spark.createDataFrame([(1, text, limit, None)], "query_id long, query string, limit int, model string")


def test_load_then_serve(spark):
    d = make_folder()
    coll, parsed = scratch_path(spark, "coll"), scratch_path(spark, "parsed")
    r = commands.load(spark, d, coll, parsed, extractors=PDF)
    assert r["files"] == 4 and r["parsed"] == 3 and r["quarantined"] == 1
    pts = collection.read_collection(spark, coll)
    assert pts.count() == 3
    ans = commands.serve(spark, coll, ask(spark, "Is this a test?", 1))
    assert [h.content for h in ans.hits.collect()] == ["This is a test!\n"]
    oranges = commands.serve(spark, coll, ask(spark, "oranges"))
    assert [h.content for h in oranges.hits.collect()] == ["Sample PDF about oranges."]


def contents(spark, coll):
    return sorted(r.content for r in collection.read_collection(spark, coll).collect())


def test_reload_is_incremental(spark):
    d = make_folder()
    coll, parsed = scratch_path(spark, "coll"), scratch_path(spark, "parsed")
    commands.load(spark, d, coll, parsed, extractors=PDF)
    before = sorted(map(tuple, collection.read_collection(spark, coll).select("point_id", "doc_id", "content").collect()))
    r = commands.load(spark, d, coll, parsed, extractors=PDF)
    assert (r["files"], r["parsed"], r["loaded"], r["quarantined"]) == (4, 0, 0, 1)
    after = sorted(map(tuple, collection.read_collection(spark, coll).select("point_id", "doc_id", "content").collect()))
    assert before == after
    with open(os.path.join(d, "test.txt"), "w") as f:
        f.write("Changed text about bananas.\nSecond line.")
    r = commands.load(spark, d, coll, parsed, extractors=PDF)
    assert r["parsed"] == r["loaded"] == 1
    pts = collection.read_collection(spark, coll)
    assert pts.where(F.col("content").contains("bananas")).count() == 1
    assert pts.where(F.col("content").contains("This is a test")).count() == 0
    assert pts.count() == 3


def test_a_second_collection_gets_the_cached_texts(spark):
    d = make_folder()
    one, two, parsed = scratch_path(spark, "coll"), scratch_path(spark, "coll"), scratch_path(spark, "parsed")
    commands.load(spark, d, one, parsed, extractors=PDF)
    r = commands.load(spark, d, two, parsed, extractors=PDF)
    assert (r["parsed"], r["loaded"]) == (0, 3) and contents(spark, one) == contents(spark, two)


def test_a_failure_after_parsing_loses_nothing(spark, monkeypatch):
    d = make_folder()
    coll, parsed = scratch_path(spark, "coll"), scratch_path(spark, "parsed")

    def fail(*a, **k):
        raise OSError("the store is away")

    with monkeypatch.context() as m:
        m.setattr(commands.collection, "upsert_collection", fail)
        with pytest.raises(OSError):
            commands.load(spark, d, coll, parsed, extractors=PDF)
    r = commands.load(spark, d, coll, parsed, extractors=PDF)
    assert (r["parsed"], r["loaded"]) == (0, 3) and len(contents(spark, coll)) == 3


def test_full_refresh_takes_the_fresh_text(spark):
    d = make_folder()
    coll, parsed = scratch_path(spark, "coll"), scratch_path(spark, "parsed")
    commands.load(spark, d, coll, parsed, extractors={"pdf": lambda b: "a wrong text"})
    r = commands.load(spark, d, coll, parsed, extractors=PDF, full_refresh=True)
    assert r["parsed"] == r["loaded"] == 3
    assert "Sample PDF about oranges." in contents(spark, coll) and "a wrong text" not in contents(spark, coll)
    assert commands.parsed_table(spark, parsed).live("texts").count() == 3


def test_append_adds_a_second_copy_each_of_which_can_be_found(spark):
    d = make_folder()
    coll, parsed = scratch_path(spark, "coll"), scratch_path(spark, "parsed")
    for _ in range(2):
        commands.load(spark, d, coll, parsed, extractors=PDF, mode="append")
    ids = [r.point_id for r in collection.read_collection(spark, coll).collect()]
    assert sorted(ids) == list(range(1, 7))
    hits = commands.serve(spark, coll, ask(spark, "oranges")).hits.collect()
    assert [(h.rank, h.content) for h in sorted(hits)] == [(1, "Sample PDF about oranges."), (2, "Sample PDF about oranges.")]
    assert hits[0].score == hits[1].score


def test_spoilt_cache_is_read_again_and_unreadable_files_go(spark):
    d = make_folder()
    coll, parsed = scratch_path(spark, "coll"), scratch_path(spark, "parsed")
    commands.load(spark, d, coll, parsed, extractors=PDF)
    cache = commands.parsed_table(spark, parsed)
    n = cache.begin()
    spoilt = cache.live("texts").drop("load").withColumn("text", F.concat("text", F.lit("!"))).checkpoint()
    cache.write(n, "texts", spoilt)
    cache.write(n, "gone", spoilt.select(*commands.VERSION))
    cache.complete(n)
    other = scratch_path(spark, "coll")
    r = commands.load(spark, d, other, parsed, extractors=PDF)
    assert r["parsed"] == 3 and contents(spark, other) == contents(spark, coll)
    with open(os.path.join(d, "test.txt"), "wb") as f:
        f.write(b"no longer text \xff\xfe")
    with open(os.path.join(d, "notes.md"), "w") as f:
        f.write("the of and")  # only stop words: no point is left
    r = commands.load(spark, d, coll, parsed, extractors=PDF)
    assert r["quarantined"] == 2 and contents(spark, coll) == ["Sample PDF about oranges."]
    report = collection.store(spark, coll).rows("quarantine", [r["load"]])
    assert {os.path.basename(x.path): x.reason for x in report.collect()}["test.txt"] == "invalid UTF-8"
    assert collection.store(spark, coll).rows("skipped", [r["load"]]).count() == 1


def test_files_known_by_path_keep_their_first_text(spark):
    d = make_folder()
    coll, parsed = scratch_path(spark, "coll"), scratch_path(spark, "parsed")
    commands.load(spark, d, coll, parsed, extractors=PDF, key="path")
    first = contents(spark, coll)
    with open(os.path.join(d, "test.txt"), "w") as f:
        f.write("A longer text that no one reads.")
    with open(os.path.join(d, "new.txt"), "w") as f:
        f.write("A new file.")
    r = commands.load(spark, d, coll, parsed, extractors=PDF, key="path")
    assert r["loaded"] == 1 and contents(spark, coll) == sorted([*first, "A new file."])
    r = commands.load(spark, d, scratch_path(spark, "coll"), parsed, extractors=PDF, key="path")
    assert (r["parsed"], r["loaded"]) == (0, 4)
    assert commands.load(spark, d, coll, parsed, extractors=PDF)["parsed"] == 1


def test_each_file_is_extracted_once(spark, tmp_path):
    d, log = make_folder(), str(tmp_path / "calls")

    def counting(b):
        with open(log, "a") as f:
            f.write("x")
        return "text of a file"

    ex = {"pdf": counting, "json": counting}
    commands.load(spark, d, scratch_path(spark, "coll"), scratch_path(spark, "parsed"), extractors=ex, strict=True)
    assert os.path.getsize(log) == 2


def test_a_pdf_without_extractor_is_reported(spark):
    d = make_folder()
    r = commands.load(spark, d, scratch_path(spark, "coll"), scratch_path(spark, "parsed"))
    assert r["quarantined"] == 2


def test_one_request_reads_its_posting_lists_only(spark):
    d = make_folder()
    coll = scratch_path(spark, "coll")
    commands.load(spark, d, coll, scratch_path(spark, "parsed"), extractors=PDF)
    plan = commands.serve(spark, coll, ask(spark, "oranges")).hits._jdf.queryExecution().executedPlan().toString()
    assert "term_bucket" in plan and "In(term_index" in plan.replace("EqualTo(term_index", "In(term_index")


def test_strict_load_refuses_unsupported(spark):
    d = make_folder()
    with pytest.raises(ValueError):
        commands.load(spark, d, scratch_path(spark, "coll"), scratch_path(spark, "parsed"), strict=True)


def test_serve_refuses_empty_collection(spark):
    coll = scratch_path(spark, "coll")
    collection.create_collection(spark, coll)
    with pytest.raises(RuntimeError):
        commands.serve(spark, coll, ask(spark, "anything"))


def test_stream_load(spark):
    d = tempfile.mkdtemp(prefix="quarry-inbox-", dir="/tmp")
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write("First file about cherries.")
    coll, parsed = scratch_path(spark, "coll"), scratch_path(spark, "parsed")
    ck = scratch_path(spark, "ck")
    commands.stream_load(spark, d, coll, parsed, ck).awaitTermination()
    with open(os.path.join(d, "b.txt"), "w") as f:
        f.write("Second file about plums.")
    commands.stream_load(spark, d, coll, parsed, ck).awaitTermination()
    texts = sorted(r.content for r in collection.read_collection(spark, coll).collect())
    assert texts == ["First file about cherries.", "Second file about plums."]


def test_serve_from_points_equals_postings(spark, sf_smoke):
    from quarry.plans.retrieval import build_index, retrieve
    from quarry.sources import tables
    # a collection's document keys are strings
    idx = build_index(tables.documents(spark, sf_smoke).withColumn("doc_id", F.col("doc_id").cast("string")))
    coll = scratch_path(spark, "coll")
    collection.create_collection(spark, coll)
    collection.upsert_collection(spark, coll, collection.points(idx.chunks, idx.vectors))
    q = tables.benchmark_queries(spark, sf_smoke)
    a = retrieve(q, idx).hits.select("query_id", "rank", "doc_id", "chunk_no", "score")
    b = commands.serve(spark, coll, q).hits.select("query_id", "rank", "doc_id", "chunk_no", "score")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_a_load_embeds_once_and_leaves_no_copies(spark, monkeypatch):
    """The scratch copies of a load go with it, failed or not, and chunks without terms still get their row."""
    made = []
    monkeypatch.setattr(commands, "scratch_path", lambda s, name: made.append(scratch_path(s, name)) or made[-1])
    d = make_folder()
    with open(os.path.join(d, "empty.md"), "w") as f:
        f.write("the and of\n")
    coll, parsed = scratch_path(spark, "coll"), scratch_path(spark, "parsed")
    n = commands.load(spark, d, coll, parsed, extractors=PDF)["load"]
    assert made and not [p for p in made if os.path.exists(p)]
    rows = collection.store(spark, coll).rows("skipped", [n]).collect()
    assert [(r.chunk_no, r.n_bytes) for r in rows] == [(0, 11)]
    with pytest.raises(ValueError):
        commands.load(spark, d, coll, parsed, strict=True)
    assert not [p for p in made if os.path.exists(p)]


def test_a_first_load_shuffles_no_content(spark, monkeypatch):
    """Nothing is looked up where all is read, few versions are broadcast, and the scratch copy of the texts goes early."""
    from quarry.operators import collection as stored
    rows = [(f"/x/{n}.txt", n, b"alpha beta %d." % n) for n in range(4)] + [("/x/bad.txt", 9, b"\xff"), (None, 1, b"no path")]
    files_df = spark.createDataFrame(rows, "path string, n int, content binary") \
        .selectExpr("path", "timestamp'2024-01-01 00:00:00' AS modificationTime", "cast(n AS long) AS length", "content")
    plans, left, saved, upsert = [], [], commands._saved, stored.upsert_collection

    def watch(df, name, paths):
        if name == "read":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(df, name, paths)

    def at_upsert(*a, **kw):
        import os
        left.extend(os.listdir(os.path.dirname(coll)))
        return upsert(*a, **kw)

    monkeypatch.setattr(commands, "_saved", watch)
    monkeypatch.setattr(stored, "upsert_collection", at_upsert)
    coll, parsed = scratch_path(spark, "first-coll"), scratch_path(spark, "first-parsed")
    before = set(os.listdir(os.path.dirname(coll.removeprefix("file:"))))
    out = commands.load_files(spark, files_df, coll, parsed)
    assert (out["files"], out["parsed"], out["quarantined"]) == (6, 4, 2)
    assert "Join" not in plans[0]
    assert not any(p.startswith("read-") for p in set(left) - before)
    commands.load_files(spark, files_df.unionByName(files_df.where("length = 1 AND path IS NOT NULL").selectExpr(
        "'/x/new.txt' AS path", "modificationTime", "length", "content")), coll, parsed)
    assert "BroadcastHashJoin" in plans[1] and "SortMergeJoin" not in plans[1]
    assert stored.read_collection(spark, coll).count() == 5
