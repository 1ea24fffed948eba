"""Tables written to the folder that driver and executors share.

Iterative operators cut their lineage by writing a Parquet table and reading it
back, so a lost executor costs a re-read and not a recomputation. The folder is
the one the cluster names in ``spark.checkpoint.dir``; only a local session may
leave it unset, and then gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises where a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    paths = _OPEN.setdefault(spark.sparkContext.applicationId, set())
    if not paths:
        atexit.register(_drop_all, spark, paths)
    paths.add(path)
    return path


def saved(df: DataFrame, name: str = "table", paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` and read it back. The path is appended to ``paths``, for drop()."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no DataFrame needs any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _OPEN.get(spark.sparkContext.applicationId, set()).discard(path)


def _drop_all(spark: SparkSession, paths: set[str]) -> None:
    try:
        drop(spark, *list(paths))
    except Exception:  # the JVM may have ended before Python does
        pass
