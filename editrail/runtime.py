"""Session helpers: settings, checkpoints that survive lost executors, table reads."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    A machine-local folder is used only if the session names none and runs on one machine (tests).
    """
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="editrail-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df written as a table to the shared checkpoint folder and read again: no lineage, and no work done twice.

    The files are compressed and survive lost executors. They go when the session's Python ends, or with `release`.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/editrail-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._editrail_path = path
    return out


#: (session, path) of the tables that `cut` wrote and nobody has released.
_written: list[tuple[SparkSession, str]] = []


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that `cut` made. No later query may read them."""
    for t in tables:
        path = getattr(t, "_editrail_path", None)
        for entry in [e for e in _written if e[1] == path]:
            _written.remove(entry)
            _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; files in a shared folder are the cluster's to sweep
        pass


@atexit.register
def _sweep() -> None:
    while _written:
        spark, path = _written.pop()
        if spark._jsc is not None and spark.sparkContext._jsc is not None:
            _delete(spark, path)


#: Rows of a table that may be broadcast: about 100 bytes each.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count proves it small, else as it is: the join then shuffles, and AQE splits skew."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per context, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_editrail_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="editrail-code-"), "editrail-code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(archive)
    sc._editrail_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its few files would keep most of them idle; large inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def latest(df: DataFrame, keys: list[str], by: list) -> DataFrame:
    """One row per key: the greatest in the order `by` (columns, descending, nulls last).

    row_number() = 1 lets Spark drop losers before the shuffle, so a hot key costs little.
    """
    order = [F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in by]
    mark = "__latest_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(mark, F.row_number().over(w)).where(F.col(mark) == 1).drop(mark)


def session(app: str = "editrail", master: str | None = None) -> SparkSession:
    """A session with the settings that this package is tuned for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": os.environ.get("EDITRAIL_SHUFFLE_PARTITIONS", "8"),
        "spark.ui.enabled": "false",
    }
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
