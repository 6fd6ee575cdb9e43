"""Structured Streaming jobs: ingest, retrieval, and the per-client rate audit.

Ingest and retrieval reuse the batch functions inside ``foreachBatch``
(ranking needs ``row_number``, which a streaming plan refuses).  Every
micro-batch writes its own ``batch_id`` partition with dynamic overwrite, so
a replayed batch replaces its earlier output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import DEFAULT_RATE_LIMIT_PER_MINUTE, Settings
from quarry.plans.retrieval import Index, build_index, retrieve


def _write_batch(df: DataFrame, sink: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("batch_id").parquet(sink))


def ingest_stream(docs_stream: DataFrame, sink: str, checkpoint: str,
                  settings: Settings = Settings(), key: str = "doc_id", text_col: str = "text",
                  available_now: bool = True):
    """Documents arriving as a stream -> postings appended per micro-batch."""
    if settings.corpus_length:
        raise ValueError("avgdl='corpus' needs the whole corpus, and a micro-batch is not it")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        idx = build_index(batch, settings, key, text_col)
        _write_batch(idx.postings.select("doc_id", "chunk_no", "lang", "term", "term_index", "tf", "dl", "weight"),
                     sink, batch_id)

    w = docs_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def search_stream(queries_stream: DataFrame, index: Index, sink: str, checkpoint: str,
                  settings: Settings = Settings(), available_now: bool = True):
    """Queries arriving as a stream, answered against a static index.

    Pass a stored index (``read_index``): a lazily built one would be rebuilt
    by every micro-batch.  Small micro-batches push their terms into the
    postings scan.
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        _write_batch(retrieve(batch, index, settings).hits, sink, batch_id)

    w = queries_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("batch_id")


# ---------------------------------------------------------------------------
# Rate audit: requests per client in tumbling windows vs. a per-window limit
# ---------------------------------------------------------------------------
def rate_audit(events: DataFrame, window: str = "1 minute",
               limit: int = DEFAULT_RATE_LIMIT_PER_MINUTE,
               client_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """``user_id, window_start, n, admitted, throttled`` per client and window."""
    g = (events.groupBy(F.col(client_col).alias("user_id"), F.window(ts_col, window).alias("w"))
               .agg(F.count(F.lit(1)).alias("n")))
    return g.select("user_id", F.col("w.start").alias("window_start"), "n",
                    F.least(F.col("n"), F.lit(limit)).alias("admitted"),
                    F.greatest(F.col("n") - F.lit(limit), F.lit(0)).alias("throttled"))


DAY_MICROS = 86_400_000_000


def _instant(col: str):
    """The instant whose UTC wall clock shows the NTZ value."""
    return F.expr(f"timestamp_micros(CAST(datediff(CAST({col} AS DATE), DATE'1970-01-01') AS BIGINT) * {DAY_MICROS}"
                  f" + hour({col}) * 3600000000L + minute({col}) * 60000000L + CAST(extract(SECOND FROM {col}) * 1000000 AS BIGINT))")


def _wall_clock(col: str):
    """The UTC wall clock of an instant, as NTZ."""
    return F.expr(f"CAST(date_add(DATE'1970-01-01', CAST(floor(unix_micros({col}) / {DAY_MICROS}) AS INT)) AS TIMESTAMP_NTZ)"
                  f" + make_dt_interval(0, 0, 0, CAST(pmod(unix_micros({col}), {DAY_MICROS}) AS DECIMAL(18, 0)) / 1000000)")


def rate_audit_stream(events_stream: DataFrame, sink: str, checkpoint: str,
                      window: str = "1 minute", limit: int = DEFAULT_RATE_LIMIT_PER_MINUTE,
                      watermark: str = "10 minutes", available_now: bool = True,
                      client_col: str = "user_id", ts_col: str = "ts"):
    """Streaming audit in update mode; each batch appends changed windows.

    A ``TIMESTAMP_NTZ`` column is read as UTC wall-clock time and turned into
    a TIMESTAMP (watermarks refuse NTZ) field by field, without the session's time
    zone, so windows align with the batch audit in any zone, daylight saving
    included; ``window_start`` is written back as NTZ.  Rows later than the
    watermark are dropped by Spark.  Read the result with
    :func:`read_rate_audit`, which keeps the latest count per window.
    """
    wall_clock = dict(events_stream.dtypes)[ts_col] == "timestamp_ntz"
    ev = events_stream.withColumn(ts_col, _instant(ts_col)) if wall_clock else events_stream
    audit = rate_audit(ev.withWatermark(ts_col, watermark), window, limit, client_col, ts_col)
    if wall_clock:
        audit = audit.withColumn("window_start", _wall_clock("window_start"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, sink, batch_id)

    w = (audit.writeStream.outputMode("update").foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_rate_audit(spark: SparkSession, sink: str) -> DataFrame:
    """Latest row per ``(user_id, window_start)`` across update batches."""
    s = spark.read.parquet(sink)
    last = F.max_by(F.struct("n", "admitted", "throttled"), "batch_id")
    return (s.groupBy("user_id", "window_start").agg(last.alias("r"))
             .select("user_id", "window_start", "r.n", "r.admitted", "r.throttled"))


def arrivals_stream(events_stream: DataFrame, sink: str, checkpoint: str, window: str = "1 minute",
                    available_now: bool = True, client_col: str = "user_id", ts_col: str = "ts"):
    """Rows per client and window as they arrive, late or not, one partition of counts a micro-batch.

    The account beside :func:`rate_audit_stream`, over the same source with a
    checkpoint of its own.  It holds no state and no watermark: each micro-batch
    is counted by itself and the counts are added when they are read.
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        g = batch.groupBy(F.col(client_col).alias("user_id"), F.window(ts_col, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
        _write_batch(g.select("user_id", F.col("w.start").alias("window_start"), "n"), sink, batch_id)

    w = events_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def late_rows(spark: SparkSession, sink: str, arrivals: str) -> DataFrame:
    """``user_id, window_start, n_arrived, n_counted, n_late``: what the audit's watermark dropped.

    ``sink`` is that of :func:`rate_audit_stream`, ``arrivals`` that of
    :func:`arrivals_stream`.  A row that arrived was counted or dropped, so the
    difference is exact once both have read the same input; while one is ahead, its
    lead shows as late (or as a negative number).  Rows without a time belong to
    no window.  One exchange, by (client, window).
    """
    zero = F.lit(0).cast("bigint")
    counted = read_rate_audit(spark, sink).select("user_id", "window_start", zero.alias("a"), F.col("n").alias("c"))
    arrived = read_sink(spark, arrivals).select("user_id", "window_start", F.col("n").alias("a"), zero.alias("c"))
    return (arrived.unionByName(counted).groupBy("user_id", "window_start")
            .agg(F.sum("a").alias("n_arrived"), F.sum("c").alias("n_counted"))
            .withColumn("n_late", F.col("n_arrived") - F.col("n_counted")))
