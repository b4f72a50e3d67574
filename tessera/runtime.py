"""What operators need from the session: this package's code on the executors, and a shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of a batch of rows for Python, where the session does not say: both sides hold a batch or two a core.
BATCH, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a session; theirs need not have it installed. Batches get smaller."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-code-")) / f"{package.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    if spark.conf.get(BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one, a session on one machine gets a temporary folder;
    on a cluster that would lose data, so it is an error."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tessera-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder. A session that has ended leaves it."""
    if spark.sparkContext._jsc is None:
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as gone:  # the JVM may already be down when the interpreter exits
        print(f"could not remove {path}: {type(gone).__name__}")


def written(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost no rework."""
    path = fresh_path(spark, name)
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    # What the plan shuffled is of no use once the table stands, and need not wait for the driver's garbage collection.
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        out.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` returned, when nothing reads it any more."""
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        remove(table.sparkSession, folder)


#: Whether shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an input, as Spark estimates them, up to which ``spread`` deals its rows anew.
SMALL_INPUT = 48 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` with the rows of a small input dealt over all cores; one file with one row group is else one task.
    Large inputs have splits enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_INPUT and df.rdd.getNumPartitions() < 4 * cores else df


def modified(spark: SparkSession, path: str) -> tuple:
    """What tells two states of a table's files apart: names, sizes and times of change."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))
