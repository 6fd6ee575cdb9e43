"""Session helper and shared-storage locations."""

from __future__ import annotations

import contextlib
import tempfile
import threading

from pyspark.sql import SparkSession

_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "quarry",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir``.  Only a local-mode session (tests,
    bench) gets a scratch folder of its own when the setting is absent; on a
    cluster a machine-local folder would be lost with its executor, so the
    setting is required there.
    """
    global _LOCAL_DIR
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _LOCAL_DIR is None:
            _LOCAL_DIR = tempfile.mkdtemp(prefix="quarry-ckpt-", dir="/tmp")
        d = _LOCAL_DIR
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_LOCAL_DIR: str | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark drops the shuffle files of a statement when the statement ends, and not when the driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, what a finished write or count has shuffled goes at once: a job of many writes holds the files of one.

    Several threads may be within it at once; the last to leave puts the session's setting back.
    """
    session = spark._jsparkSession.sessionUUID()
    with _DROPPING_LOCK:
        n, before = _DROPPING.get(session, (0, None))
        if not n:
            before = spark.conf.get(CLEAN_UP, None)
            spark.conf.set(CLEAN_UP, "true")
        _DROPPING[session] = n + 1, before
    try:
        yield
    finally:
        with _DROPPING_LOCK:
            n, before = _DROPPING.pop(session)
            if n > 1:
                _DROPPING[session] = n - 1, before
            elif before is None:
                spark.conf.unset(CLEAN_UP)
            else:
                spark.conf.set(CLEAN_UP, before)


_DROPPING: dict[str, tuple[int, str | None]] = {}  # sessions within it: how many are, and the setting before
_DROPPING_LOCK = threading.Lock()


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more (in whatever store it lies)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
