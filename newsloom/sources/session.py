"""Session helpers: table access, Arrow batch size and lineage cuts that survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch handed to Python. News texts are a few KB each, so a batch stays at a few MB.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of any executor; once for each Spark context.

    The archive holds code only; executors fetch it from the driver.
    """
    sc = spark.sparkContext
    if getattr(sc, "_newsloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="newsloom-code-")) / "newsloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._newsloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a single parquet file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower Spark's default Arrow batch (10,000 rows) for wide text rows; a value the user set is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores where its source has fewer splits than there are cores.

    A small file is one split, however much work its rows cost. A table with more splits comes back as it is, so nothing
    is moved at scale, and so does what a shuffle has dealt out already (asking for its splits would run it).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    try:
        conf = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # not set anywhere
        conf = None
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_newsloom_dir", None)
    if not made:
        made = f"file://{tempfile.mkdtemp(prefix='newsloom-')}"
        spark._newsloom_dir = made
    return made


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut whose files outlive any executor.

    The files are deleted when the driver's JVM ends, or before by ``drop_cuts``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    made = getattr(spark.sparkContext, "_newsloom_cuts", None)
    if made is None:
        made = spark.sparkContext._newsloom_cuts = []
    made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` has written in this session, once the results built on them are used; how many."""
    made = getattr(spark.sparkContext, "_newsloom_cuts", [])
    for path in made:
        where, files = _file_system(spark, path)
        files.delete(where, True)
    n = len(made)
    made.clear()
    return n
