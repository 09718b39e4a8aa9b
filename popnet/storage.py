"""Intermediate tables in the folder that the cluster shares, and the session's settings."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def session(app: str = "popnet", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the plans expect; those given win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.executorEnv.OMP_NUM_THREADS": "1",
    } | conf
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a fresh one of our own, if the session is a local one.

    On a cluster every executor would write to its own disk, so there it is an error.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="popnet-shared-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, whatever store it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def files(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """The files in a folder whose names begin so, in the order of their names, whatever the store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return sorted(str(f.getPath().toString()) for f in found if str(f.getPath().getName()).startswith(prefix))


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)
    except Exception:  # the session has ended before: the folder's owner cleans it
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The lineage ends there; the table goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/popnet-{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


#: Where the tables of ``written`` are, while their DataFrames live.
_paths: dict[int, tuple[weakref.ref, str]] = {}


def released(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and nothing will read any more; others are let be."""
    for df in tables:
        ref, path = _paths.pop(id(df), (None, ""))
        if ref is not None and ref() is df:
            _forget(df.sparkSession, path)
