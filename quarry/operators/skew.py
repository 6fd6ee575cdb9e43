"""A key lookup that no hot key can gather in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import HOT_TERM_SALTS, MAX_HOT_TERMS


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], value: str, weight: str,
           spread: list[str], max_hot: int = MAX_HOT_TERMS, salts: int = HOT_TERM_SALTS, stored: bool = False) -> DataFrame:
    """``rows`` with the ``value`` that ``table`` (one row a key) has for their ``keys``.

    ``weight`` says how many of ``rows`` have a key.  Keys with more than 1/``max_hot``
    of all rows (at most ``max_hot`` of them, whatever the input) get their value from a
    broadcast; their rows are then dealt by ``spread`` over ``salts`` keys that meet
    nothing in the shuffle join of the others, so a key of a third of all rows gathers
    nowhere.  Keys that ``table`` does not hold get null.  ``stored`` rows, which cost little to
    read twice, are split instead: those of the hot keys are not shuffled at all.
    """
    total = table.agg(F.sum(weight).alias("t")).scalar()
    hot = table.where(F.col(weight) * F.lit(max_hot) > total).select(*keys, F.col(value).alias("_hot"))
    if stored:
        few = rows.join(F.broadcast(hot), keys).withColumnRenamed("_hot", value)
        return few.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.select(*keys, value), keys, "left"))
    rest = table.select(*keys, F.lit(0).alias("_salt"), F.col(value).alias("_rest"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.hash(*spread), F.lit(salts)) + 1))
    return (dealt.join(rest, [*keys, "_salt"], "left")
                 .withColumn(value, F.coalesce("_hot", "_rest")).drop("_hot", "_salt", "_rest"))
