import datetime as dt
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from quarry.plans import registry
from quarry.session import scratch_path
from quarry.streaming import jobs


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_ingest_equals_batch(spark, sf_smoke):
    assert _sorted(registry.q_stream_ingest(spark, sf_smoke)) == _sorted(registry.q_bm25_weights(spark, sf_smoke))


def test_stream_search_equals_batch(spark, sf_smoke):
    s = registry.q_stream_search(spark, sf_smoke).select("query_id", "rank", "doc_id", "chunk_no", "score")
    b = registry.q_search_topk(spark, sf_smoke).select("query_id", "rank", "doc_id", "chunk_no", "score")
    assert _sorted(s) == _sorted(b)


def test_stream_rate_audit_equals_batch(spark, sf_smoke):
    s = registry.q_stream_rate_audit(spark, sf_smoke)
    b = registry.q_rate_audit(spark, sf_smoke)
    assert _sorted(s) == _sorted(b)


def test_late_rows_past_watermark_are_dropped(spark):
    d = tempfile.mkdtemp(prefix="quarry-events-", dir="/tmp")
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    first = pd.DataFrame({"user_id": [1, 1, 1], "ts": [t0, t0 + dt.timedelta(minutes=30), t0 + dt.timedelta(hours=2)]})
    late = pd.DataFrame({"user_id": [1, 1], "ts": [t0 + dt.timedelta(seconds=5), t0 + dt.timedelta(hours=2, seconds=1)]})
    spark.createDataFrame(first).coalesce(1).write.parquet(os.path.join(d, "a"))
    src = os.path.join(d, "a")
    stream = (spark.readStream.schema("user_id long, ts timestamp_ntz")
                   .option("maxFilesPerTrigger", "1").parquet(src))
    sink, ck = scratch_path(spark, "audit"), scratch_path(spark, "audit-ck")
    jobs.rate_audit_stream(stream, sink, ck, window="1 hour", limit=1, watermark="10 minutes").awaitTermination()
    # second batch: one row far behind the watermark, one inside the open window
    spark.createDataFrame(late).coalesce(1).write.mode("append").parquet(src)
    stream = (spark.readStream.schema("user_id long, ts timestamp_ntz")
                   .option("maxFilesPerTrigger", "1").parquet(src))
    jobs.rate_audit_stream(stream, sink, ck, window="1 hour", limit=1, watermark="10 minutes").awaitTermination()
    out = {r.window_start.hour: (r.n, r.admitted, r.throttled)
           for r in jobs.read_rate_audit(spark, sink).collect()}
    assert out[12] == (2, 1, 1)     # the 12:00:05 row came after the watermark passed 13:50
    assert out[14] == (2, 1, 1)     # 14:00:01 is still inside the open window


def test_windows_do_not_merge_when_clocks_change(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="quarry-events-", dir="/tmp"), "e")
    hours = [dt.datetime(2024, 3, 10, h, 30) for h in (1, 2, 3, 4)]  # 02:30 does not exist in New York
    rows = spark.createDataFrame([(1, t) for t in hours], "client long, at timestamp_ntz")
    rows.coalesce(1).write.parquet(d)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        sink, ck = scratch_path(spark, "audit"), scratch_path(spark, "audit-ck")
        stream = spark.readStream.schema(rows.schema).parquet(d)
        jobs.rate_audit_stream(stream, sink, ck, window="1 hour", limit=1, client_col="client", ts_col="at").awaitTermination()
        out = {(r.window_start, r.n) for r in jobs.read_rate_audit(spark, sink).collect()}
        assert out == {(t.replace(minute=0), 1) for t in hours}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_rate_audit_limits(spark):
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, s)) for s in range(7)],
                               "user_id long, ts timestamp_ntz")
    r = jobs.rate_audit(ev, "1 minute", 5).first()
    assert (r.n, r.admitted, r.throttled) == (7, 5, 2)


def test_stream_audit_independent_of_session_time_zone(spark, sf_smoke):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        s = registry.q_stream_rate_audit(spark, sf_smoke)
        b = registry.q_rate_audit(spark, sf_smoke)
        assert _sorted(s) == _sorted(b)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_late_rows_are_counted_by_window(spark):
    src = os.path.join(tempfile.mkdtemp(prefix="quarry-events-", dir="/tmp"), "e")
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    first = [(1, t0), (1, t0 + dt.timedelta(hours=2)), (None, t0), (2, None)]
    late = [(1, t0 + dt.timedelta(seconds=5)), (1, t0 + dt.timedelta(seconds=5)), (None, t0), (3, t0),
            (1, t0 + dt.timedelta(hours=2, seconds=1))]
    sink, arrivals = scratch_path(spark, "audit"), scratch_path(spark, "arrivals")
    cks = scratch_path(spark, "audit-ck"), scratch_path(spark, "arrivals-ck")
    for rows in (first, late):
        spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(src)
        jobs.rate_audit_stream(stream, sink, cks[0], "1 hour", 1, "10 minutes").awaitTermination()
        jobs.arrivals_stream(stream, arrivals, cks[1], "1 hour").awaitTermination()
    out = {(r.user_id, r.window_start.hour): (r.n_arrived, r.n_counted, r.n_late)
           for r in jobs.late_rows(spark, sink, arrivals).collect()}
    assert out == {(1, 12): (3, 1, 2), (None, 12): (2, 1, 1), (3, 12): (1, 0, 1), (1, 14): (2, 2, 0)}


def test_streams_read_tables_stored_as_folders(spark, sf_smoke):
    """A table is a folder of part files at size; each stream reads all of them."""
    sf = tempfile.mkdtemp(prefix="quarry-parts-", dir="/tmp")
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet").where("doc_id < 60")
    docs.repartition(3).write.parquet(os.path.join(sf, "documents.parquet"))
    spark.read.parquet(f"{sf_smoke}/pages.parquet").where("page_id < 5").write.parquet(os.path.join(sf, "pages.parquet"))
    spark.read.parquet(f"{sf_smoke}/events.parquet").repartition(3).write.parquet(os.path.join(sf, "events.parquet"))
    assert _sorted(registry.q_stream_ingest(spark, sf)) == _sorted(registry.q_bm25_weights(spark, sf))
    assert _sorted(registry.q_stream_rate_audit(spark, sf)) == _sorted(registry.q_rate_audit(spark, sf))
    loaded = registry.q_stream_load_command(spark, sf)
    assert _sorted(loaded) == _sorted(registry.q_load_command(spark, sf).drop("point_id"))
    assert loaded.count() > 60
