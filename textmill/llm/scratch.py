"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of our own on one machine, as in tests;
    on a cluster an error, since executors would not see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def fresh(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used; removed when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/textmill/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made[path] = spark
    return path


@contextlib.contextmanager
def no_shuffles_left(spark: SparkSession):
    """Within, Spark removes the shuffle files of each execution as it ends; the caller's setting comes back."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read back: its lineage ends at files that outlive lost executors, and
    the shuffles that made it are gone."""
    spark = df.sparkSession
    path = fresh(spark, name)
    with no_shuffles_left(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textmill_path = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Remove tables made by table() that no later result reads."""
    for t in tables:
        drop(t.sparkSession, t._textmill_path)


def _clear() -> None:
    for path, spark in list(_made.items()):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return
