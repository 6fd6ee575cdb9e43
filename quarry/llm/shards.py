"""Contiguous, byte-balanced shards from global prefix sums.

Rows are ranged and sorted by key, and each range is one partition.  The totals of
the partitions (one row each) are summed up into offsets; a row's place among all
bytes is its partition's offset plus the bytes before it there.  The line of all
bytes is cut at equal targets, and a row belongs to the shard that holds its middle,
so shard sizes differ from the target by half a row at each end.

DataFrame expressions only.  Texts are read once, for their size and checksum, and
never shuffled: 40 bytes a row are.  A key that many rows share is split like any
other, since each row carries its own number behind the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.base import save

SHARDS = 8


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, row): UTF-8 bytes plus 1 and unsigned CRC-32 (null: no bytes), and the row's own number."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"),
                F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))


def prefix_sums(rows: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """``rows`` with ``before`` (sum of ``size`` over all earlier rows) and ``place`` (their number).

    Earlier: smaller in ``order``, whose columns together tell rows apart.  Only one
    row for each partition meets in the window over the totals.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = save(ranged, "shards-ranged")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(whole), F.lit(0)).alias("bytes0"),
                            F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("part").orderBy(*order)
    local = ranged.withColumn("before", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)) \
        .withColumn("place", F.row_number().over(inside) - 1)
    return local.join(F.broadcast(offsets), "part") \
        .select(*rows.columns, (F.col("before") + F.col("bytes0")).alias("before"), (F.col("place") + F.col("n0")).alias("place"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    Order: doc_id (null first), then checksum and size; rows equal in all three are
    alike.  ``slot`` counts the rows of a shard from 0 in that order.  Null and empty
    texts have size 1; a row larger than a shard's target leaves shards beside it
    empty; repeated rows each get a place; an empty table gives no rows; other
    columns of ``docs`` are not read.  ``grown_shard`` is null: the law is ``bytes``.
    """
    numbered = save(prefix_sums(save(measured(docs), "shards-measured"), ["doc_id", "text_crc32", "size", "row"]), "shards-numbered")
    total = numbered.agg(F.coalesce(F.max(F.col("before") + F.col("size")), F.lit(1))).first()[0]
    # the row's middle among `total` bytes; in halves, so that all stays whole
    middle = F.expr(f"CAST(least((2 * before + size) * {int(shards)} DIV {2 * int(total)}, {int(shards) - 1}) AS INT)")
    cut = numbered.withColumn("shard", middle)
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
