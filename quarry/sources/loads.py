"""A table whose newest version of each key counts, as Parquet partitioned by ``load``.

Each part of the table is one Parquet dataset, ``<path>/<part>/load=N/``, written with
dynamic partition overwrite: a load adds a partition and rewrites nothing, and a load
that runs again replaces its own.  Two small tables beside the parts say what counts:

* ``loads`` (load, done, n_ids, covers): one row for each finished load, written
  last.  Rows of a load without one are never read.  ``done`` orders the loads.
* ``gone`` (the keys, load): the keys whose rows of earlier loads a load replaces.

The newest version of a key comes from the latest load that names it (a grouped
maximum) and an anti join of the rows of earlier loads.  A load number is the time it
began and a random tail, so two writers need no agreement.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOADS = "load long, done long, n_ids long, covers array<long>"
TAIL = 1000  # random tail of a load number, after its microseconds


@dataclass(frozen=True)
class Finished:
    """A finished load: its place in the order, and how many ids the loads before it gave."""

    load: int
    place: int
    first_id: int
    covers: tuple[int, ...]


class Loads:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schemas: dict[str, str] | None = None):
        self.spark, self.path, self.keys, self.schemas = spark, path.rstrip("/"), list(keys), schemas or {}

    def _listed(self, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
        """A few numbers for each load, as a relation of the plan."""
        values = ", ".join("(" + ", ".join(f"{x}L" for x in r) + ")" for r in rows)
        return self.spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")

    # ------------------------------------------------------------ finished loads
    def finished(self) -> list[Finished]:
        """All finished loads in order (one row for each load ever made)."""
        t = self._read("loads", LOADS)
        rows = sorted(t.collect(), key=lambda r: (r.done, r.load)) if t is not None else []
        out, ids = [], 0
        for place, r in enumerate(rows):
            out.append(Finished(r.load, place, ids, tuple(r.covers or ())))
            ids += r.n_ids
        return out

    def current(self) -> list[Finished]:
        """The finished loads that no later one has taken in."""
        every = self.finished()
        covered = {n for f in every for n in f.covers}
        return [f for f in every if f.load not in covered]

    def exists(self) -> bool:
        return self._read("loads", LOADS) is not None

    @staticmethod
    def begin() -> int:
        """A load number that no other writer has."""
        return time.time_ns() // 1000 * TAIL + random.randrange(TAIL)

    def complete(self, load: int, n_ids: int = 0, covers: list[Finished] = ()) -> None:
        """From now on the load counts.  One that covers others stands where the last of them stood."""
        t = self._read("loads", LOADS)
        last = t.agg(F.max("done")).first()[0] or 0 if t is not None else 0
        done = max(time.time_ns() // 1000, last + 1)
        if covers:
            done = t.where(F.col("load") == max(covers, key=lambda f: f.place).load).first()["done"]
        self.write(load, "loads", self.spark.range(1, numPartitions=1).select(
            F.lit(done).cast("long").alias("done"), F.lit(n_ids).cast("long").alias("n_ids"),
            F.array(*[F.lit(f.load).cast("long") for f in covers]).cast("array<long>").alias("covers")))

    # ------------------------------------------------------------ parts
    def write(self, load: int, part: str, df: DataFrame, *partition_by: str) -> None:
        """Ids repeat by row within a file: they take less as a dictionary, which may be larger than Parquet's default."""
        df.withColumn("load", F.lit(load).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .option("compression", "zstd").option("parquet.dictionary.page.size", str(4 << 20)) \
            .partitionBy("load", *partition_by).parquet(f"{self.path}/{part}")

    def _read(self, part: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        try:
            return reader.parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def has(self, part: str) -> bool:
        return self._read(part, self._schema(part)) is not None

    def _schema(self, part: str) -> str | None:
        return f"{self.schemas[part]}, load long" if part in self.schemas else None

    def rows(self, part: str, loads: list[int] | None = None) -> DataFrame:
        """All rows of a part with their ``load``, replaced ones too."""
        t = self._read(part, self._schema(part))
        if t is None:
            raise FileNotFoundError(f"{self.path} holds no {part}; create it first")
        return t.where(F.col("load").cast("long").isin([f.load for f in self.current()] if loads is None else list(loads)))

    def live(self, part: str, narrowed: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The newest version of every key, with its ``load``.

        Rows of loads after which nothing was replaced are read without a join.  ``narrowed`` makes
        what is wanted of rows (their keys and ``load`` kept) before older ones are joined.
        """
        now = self.current()
        rows = narrowed(self.rows(part, [f.load for f in now]))
        gone = self._read("gone", self._schema("gone"))
        if gone is None or len(now) < 2:
            return rows
        named = {r.load for r in gone.select("load").distinct().collect()}  # one row a load
        replacing = [f for f in now if f.load in named]
        last = max((f.place for f in replacing), default=-1)
        older, newer = [f for f in now if f.place < last], [f for f in now if f.place >= last]
        if not older:
            return rows
        place = self._listed([(f.load, f.place) for f in now], "load", "_place")
        latest = gone.where(F.col("load").isin([f.load for f in replacing])).join(F.broadcast(place), "load") \
            .groupBy(*self.keys).agg(F.max("_place").alias("_gone"))
        old = narrowed(self.rows(part, [f.load for f in older])).join(F.broadcast(place), "load")
        same = [old[k].eqNullSafe(latest[k]) for k in self.keys]
        kept = old.join(latest, [*same, latest["_gone"] > old["_place"]], "left_anti").select(*rows.columns)
        return kept.unionByName(narrowed(self.rows(part, [f.load for f in newer])))

    def with_ids(self, rows: DataFrame, given: str = "given", nth: str = "nth", out: str = "point_id") -> DataFrame:
        """Adds the id of a row that was the ``nth`` new one of load ``given``.

        A load's ids follow those of all loads finished before it, so the ranges of two
        loads never meet, whoever of them finished first.
        """
        first = self._listed([(f.load, f.first_id) for f in self.finished()], given, "_first")
        return rows.join(F.broadcast(first), given).withColumn(out, F.col("_first") + F.col(nth)).drop("_first")

    def compact(self, parts: list[str], partition_by: dict[str, list[str]] | None = None) -> int:
        """One load of everything that is live; returns its number."""
        now, load = self.current(), self.begin()
        for part in parts:
            if self.has(part):
                self.write(load, part, self.live(part).drop("load"), *(partition_by or {}).get(part, []))
        self.complete(load, covers=now)
        return load
