"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "colophon", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config(CHECKPOINT_CONF, _local_folder())
        .getOrCreate()
    )


def _local_folder() -> str:
    """A temporary folder for one machine, gone when the process ends."""
    path = tempfile.mkdtemp(prefix="colophon_")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, if it comes in fewer (one small file); else as it is.

    For steps that are dear per row. Large inputs have parts enough and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, one machine) a temporary folder is
    made and set, so that one session always uses one folder.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get(CHECKPOINT_CONF, None) or conf.get(CHECKPOINT_CONF, None)
    if not path:
        path = _local_folder()
        spark.conf.set(CHECKPOINT_CONF, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; survives lost executors.

    Against a checkpoint the columns stay prunable and sizes are known to the
    planner, which decides joins by them. The files are deleted when the process
    ends, since what is returned is read later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_delete_written, spark)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def _delete_written(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        fs = spark._jvm.org.apache.hadoop.fs
        for path in _WRITTEN:
            where = fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.clear()


def join_split(rows: DataFrame, side: DataFrame, on: Sequence[str], n: str, total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """``rows`` joined with ``side``, which has one row per key and in ``n`` how often the key occurs among ``rows`` (``total``).

    Keys of at least a ``share``-th of all rows, of which there can't be more than
    ``share``, are broadcast; rows of all others are shuffled and merged, so that
    no task holds a hot key and nothing that grows is broadcast. ``n`` is left out.
    """
    least, on = max(2, total // share), list(on)
    hot = side.where(F.col(n) >= least).drop(n).withColumn("_hot", F.lit(True))
    rest = side.where(F.col(n) < least).drop(n)
    seen = rows.join(F.broadcast(hot), on, "left")
    others = [c for c in side.columns if c not in (*on, n)]
    known = seen.where(F.col("_hot").isNotNull()).drop("_hot")
    return known.unionByName(seen.where(F.col("_hot").isNull()).drop("_hot", *others).join(rest.hint("merge"), on, how))
