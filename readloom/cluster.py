"""Tables in the folder that all executors share.

A step whose result is read more than once, or whose lineage must be cut, is written there as Parquet.
Such a table outlives any executor, so a later stage never recomputes half a pipeline for a lost block.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions without a setting, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="readloom-")
            atexit.register(_delete, spark, _LOCAL[app])
        found = _LOCAL[app]
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, for a cluster on which it isn't installed."""
    import os
    import zipfile

    import readloom

    root = os.path.dirname(os.path.abspath(readloom.__file__))
    with tempfile.TemporaryDirectory() as folder:  # only until the driver has taken the file
        path = os.path.join(folder, "readloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(at, n), os.path.join("readloom", os.path.relpath(os.path.join(at, n), root)))
        spark.sparkContext.addPyFile(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        pass  # the session has ended; the folder belongs to it


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the table read back: the plan so far is run once and cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/readloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Shuffle rows over many tasks. For kernels that take long over few bytes, whose partitions would otherwise be put together by their size."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)
