"""Collections: points, their ids and postings, where the newest load of a document counts.

A point is a chunk with its sparse vector.  Parts of a stored collection:
``points`` (doc_id, chunk_no, content, field, indices, values), ``ids`` (doc_id,
chunk_no, given, nth), ``postings`` (term_bucket, term_index, doc_id, chunk_no, field,
weight), ``docs`` (doc_id, path, modificationTime, length, content_sha),
``skipped`` and ``quarantine``; ``copy`` is the load that first wrote a row.  A load
writes its own documents only.  A point's id is the ``nth`` that load ``given`` gave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT_FIELD, DEFAULT_TERM_BUCKETS
from quarry.operators import terms
from quarry.session import shuffles_dropped
from quarry.sources.loads import Loads

POINT_KEYS = ["doc_id", "chunk_no"]
# Term buckets of a collection that one task writes (their rows of a point travel side by side), and that are shuffled at once.
BUCKETS_A_TASK, BUCKETS_A_PASS = 8, 16
SCHEMAS = {
    "points": "doc_id string, chunk_no int, content string, field string, indices array<bigint>, values array<double>, copy long",
    "ids": "doc_id string, chunk_no int, given long, nth long, copy long",
    "postings": "term_index bigint, doc_id string, chunk_no int, field string, weight double, copy long, term_bucket int",
    "docs": "doc_id string, path string, modificationTime timestamp, length bigint, content_sha string",
    "skipped": "doc_id string, chunk_no int, n_bytes int, reason string",
    "quarantine": "path string, reason string",
    "gone": "doc_id string",
}


# ---------------------------------------------------------------------------
# Points
# ---------------------------------------------------------------------------
def points(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``doc_id, chunk_no, content, indices, values`` for chunks that have a vector.

    Both inputs are partitioned on the chunk keys, so the join needs no
    extra exchange of the vectors side.
    """
    nested = terms.sparse_vectors(vectors, terms.CHUNK_KEYS)
    return (chunks.select(*POINT_KEYS, "content").join(nested, POINT_KEYS)
                  .select(*POINT_KEYS, "content", "indices", "values"))


def skipped_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without any vector entry (no token left after stop-word removal)."""
    has = vectors.select(*POINT_KEYS).distinct()
    return (chunks.select(*POINT_KEYS, "n_bytes").join(has, POINT_KEYS, "left_anti")
                  .select(*POINT_KEYS, "n_bytes", F.lit("no terms after stop-word removal").alias("reason")))


def dense_ids(df: DataFrame, order_cols, base: int = 0, id_col: str = "point_id") -> DataFrame:
    """Ids ``base + 1, base + 2, ...`` in ``order_cols`` order, without a global window.

    Range-partition and sort, checkpoint (fixes partition contents for both
    passes and cuts lineage), count rows per partition (one row per
    partition), turn the counts into offsets, and add each row's position
    inside its partition.  Pass narrow rows (keys); join the ids back.
    """
    from quarry.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    order_cols = list(order_cols)
    ranged = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols).checkpoint(eager=True)
    tagged = ranged.select("*", F.spark_partition_id().alias("_pid"),
                           F.monotonically_increasing_id().alias("_mid"))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a running sum over this tiny table is cheap
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .select((F.lit(int(base)) + F.col("_off") + pos + 1).cast("long").alias(id_col), *df.columns))


# ---------------------------------------------------------------------------
# Stored collections
# ---------------------------------------------------------------------------
def store(spark: SparkSession, path: str) -> Loads:
    return Loads(spark, path, ["doc_id"], SCHEMAS)


def collection_exists(spark: SparkSession, path: str) -> bool:
    return store(spark, path).exists()


def create_collection(spark: SparkSession, path: str, n_buckets: int = DEFAULT_TERM_BUCKETS) -> bool:
    """Create an empty collection if absent; returns True when it was created."""
    s = store(spark, path)
    if s.exists():
        return False
    # two creators at once write the same parts, empty both
    spark.createDataFrame([(n_buckets,)], "n_buckets int").coalesce(1).write.mode("ignore").parquet(f"{path}/settings")
    first = s.begin()
    for part in ("points", "ids", "docs", "postings"):
        s.write(first, part, spark.createDataFrame([], SCHEMAS[part]), *(["term_bucket"] if part == "postings" else []))
    s.complete(first)
    return True


def _open(spark: SparkSession, path: str) -> Loads:
    s = store(spark, path)
    if not s.exists():
        raise FileNotFoundError(f"collection {path} does not exist; create it first")
    return s


def term_buckets(spark: SparkSession, path: str) -> int:
    return spark.read.schema("n_buckets int").parquet(f"{path}/settings").agg(F.max("n_buckets")).first()[0]


def read_collection(spark: SparkSession, path: str, field: str = DEFAULT_FIELD) -> DataFrame:
    """``point_id, doc_id, chunk_no, content, indices, values`` of the live points of a field."""
    s = _open(spark, path)
    pts = s.live("points").where(F.col("field") == field)
    return (pts.join(s.with_ids(s.live("ids")).drop("load"), [*POINT_KEYS, "copy"])
               .select("point_id", *POINT_KEYS, "content", "indices", "values"))


def read_sizes(spark: SparkSession, path: str, field: str = DEFAULT_FIELD) -> DataFrame:
    """``point_id, doc_id, chunk_no, n_entries`` of the live points: vectors are counted before anything is joined."""
    s = _open(spark, path)
    pts = s.live("points", lambda p: p.where(F.col("field") == field)
                 .select(*POINT_KEYS, "copy", F.size("indices").cast("bigint").alias("n_entries"), "load"))
    return (pts.drop("load").join(s.with_ids(s.live("ids")).drop("load"), [*POINT_KEYS, "copy"])
               .select("point_id", *POINT_KEYS, "n_entries"))


def read_postings(spark: SparkSession, path: str, field: str = DEFAULT_FIELD) -> tuple[DataFrame, DataFrame, int]:
    """(postings, points, term buckets) of the live points of a field, each row with its ``copy``."""
    s = _open(spark, path)
    return (s.live("postings").where(F.col("field") == field), s.live("points").where(F.col("field") == field),
            term_buckets(spark, path))


def assign_ids(keys: DataFrame, old: DataFrame, load: int) -> DataFrame:
    """``doc_id, chunk_no, given, nth``: a key of ``old`` keeps its id, the others are the load's first, second, ..."""
    both = keys.select(*POINT_KEYS).join(old.select(*POINT_KEYS, "given", "nth"), POINT_KEYS, "left")
    fresh = dense_ids(both.where("given IS NULL").select(*POINT_KEYS), POINT_KEYS, id_col="nth")
    return both.where("given IS NOT NULL").unionByName(fresh.withColumn("given", F.lit(load).cast("long")))


def upsert_collection(spark: SparkSession, path: str, new: DataFrame, mode: str = "upsert",
                      replaced: DataFrame | None = None, field: str = DEFAULT_FIELD,
                      parts: dict[str, DataFrame | Callable[[DataFrame], DataFrame]] | None = None) -> int:
    """Add a load of points (without ids); returns its number.

    ``upsert``: every document of ``replaced`` (by default those of ``new``) loses its
    earlier points, those without new points too; a key already present keeps its
    id, the others get new ones.  ``append``: all get new ids.  New ids follow those of
    all loads that finished earlier; two loads at once never give the same one.
    ``parts``: further rows to store with the load, or what makes them of its written
    points.  Content and vectors are written once; ids and postings are made from what was written.
    """
    if mode not in ("upsert", "append"):
        raise ValueError("mode must be 'upsert' or 'append'")
    with shuffles_dropped(spark):
        return _upsert(_open(spark, path), term_buckets(spark, path), new, mode, replaced, field, parts)


def _upsert(s: Loads, buckets: int, new: DataFrame, mode: str, replaced: DataFrame | None, field: str,
            parts: dict[str, DataFrame | Callable[[DataFrame], DataFrame]] | None) -> int:
    load = s.begin()
    copy = F.lit(load).cast("long").alias("copy")
    s.write(load, "points", new.select(F.col("doc_id").cast("string").alias("doc_id"), "chunk_no", "content",
                                       F.lit(field).alias("field"), "indices", "values", copy))
    written = s.rows("points", [load])
    for part, rows in (parts or {}).items():
        s.write(load, part, rows(written) if callable(rows) else rows)
    if mode == "upsert":
        gone = written.select("doc_id") if replaced is None else replaced.select(F.col("doc_id").cast("string").alias("doc_id"))
        s.write(load, "gone", gone.distinct())
        ids = assign_ids(written, s.live("ids"), load)
    else:
        ids = dense_ids(written.select(*POINT_KEYS), POINT_KEYS, id_col="nth").withColumn("given", F.lit(load).cast("long"))
    s.write(load, "ids", ids.select(*POINT_KEYS, "given", "nth", copy))
    write_postings(s, load, written, buckets, field)
    s.complete(load, n_ids=s.rows("ids", [load]).where(F.col("given") == load).count())
    return load


def write_postings(s: Loads, load: int, written: DataFrame, buckets: int, field: str = DEFAULT_FIELD) -> None:
    """Postings by term bucket, through a REBALANCE that splits a hot bucket over several writers.

    A task takes ``BUCKETS_A_TASK`` buckets of a share of the points: a point's entries of these
    travel one after the other and its keys compress to little.  What the load has in common is added after the exchange,
    and the buckets are written ``BUCKETS_A_PASS`` at a time: the points are read more often, and fewer rows lie in shuffle files.
    """
    entries = written.select(*POINT_KEYS, F.explode(F.arrays_zip("indices", "values")).alias("e"))
    post = entries.select(F.col("e.indices").alias("term_index"), *POINT_KEYS, F.col("e.values").alias("weight"))
    bucket = F.pmod("term_index", F.lit(buckets)).cast("int")
    post = post.withColumn("_group", F.floor(bucket / F.lit(BUCKETS_A_TASK)))
    for first in range(0, buckets, BUCKETS_A_PASS):
        some = post.where((bucket >= first) & (bucket < first + BUCKETS_A_PASS)).hint("rebalance", "_group").drop("_group") \
            .withColumn("term_bucket", bucket).sortWithinPartitions("term_bucket", "term_index") \
            .withColumn("field", F.lit(field)).withColumn("copy", F.lit(load).cast("long"))
        s.write(load, "postings", some, "term_bucket")


def compact_collection(spark: SparkSession, path: str) -> int:
    """Rewrite the live rows as one load (a separate, occasional job)."""
    with shuffles_dropped(spark):
        return _open(spark, path).compact(["points", "ids", "docs", "postings"], {"postings": ["term_bucket"]})


def collection_stats(points_df: DataFrame) -> DataFrame:
    """One row: points, documents and stored vector entries."""
    return points_df.agg(F.count(F.lit(1)).alias("n_points"),
                         F.countDistinct("doc_id").alias("n_docs"),
                         F.coalesce(F.sum(F.size("indices")), F.lit(0)).cast("bigint").alias("n_entries"))


def require_points(points_df: DataFrame) -> None:
    """Serving precondition: refuse an empty collection."""
    if not points_df.take(1):
        raise RuntimeError("the collection holds no points; load documents first")
