"""Sessions, the package on their workers, and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch between the JVM and a Python worker, both of which hold it: by rows alone, ten thousand long texts
#: would be one batch. A session that sets another bound than Spark's own keeps it.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers of the session's cluster, through Spark's own file server, and
    bounds the batches sent to them by their bytes."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="twinsieve-")
        atexit.register(shutil.rmtree, folder, True)
        archive = shutil.make_archive(os.path.join(folder, "twinsieve"), "zip", os.path.dirname(here), os.path.basename(here))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors see: the one named in spark.checkpoint.dir. Only a session on a
    single machine that names none gets a temporary one; on a cluster that is a RuntimeError."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
            named = tempfile.mkdtemp(prefix="twinsieve-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Has Spark remove the files of a query's exchanges when it ends, not when the driver happens to collect garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a checkpoint to a task that reads it, where it has more partitions than that asks for.
READ_BYTES = 8 << 20
#: Shuffle partitions a core up to which a checkpoint has a file for each; beyond it one file holds JOINED of them, but a
#: checkpoint has FILES a core at least.
MANY, JOINED, FILES = 16, 8, 4


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there, so that neither lost executors nor later
    readers run the plan again. The exchanges on the way to it are not needed any more, and their files go.

    Where there are many partitions, a task writes several, one after another, as one file: for each file of a local folder
    Hadoop starts processes that set its permissions, each of which is a second copy of the executor for a moment."""
    conf, cores = df.sparkSession.conf, df.sparkSession.sparkContext.defaultParallelism
    checkpoint_folder(df.sparkSession)
    parts = int(conf.get("spark.sql.shuffle.partitions"))
    if parts > MANY * cores:
        df = df.coalesce(max(FILES * cores, parts // JOINED))
    before = conf.get(CLEANUP_KEY, None)
    conf.set(CLEANUP_KEY, "true")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.unset(CLEANUP_KEY) if before is None else conf.set(CLEANUP_KEY, before)


def compact(df: DataFrame) -> DataFrame:
    """A checkpoint, read by as many tasks as its bytes ask for, but at least one a core: each task of an exchange writes
    files of its own, so a small table in hundreds of partitions takes more disk in blocks of files than in rows. Row ids
    must not be drawn from it."""
    path = _checkpoint_file(df)
    if path is None:
        return df
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    wanted = max(sc.defaultParallelism, -(-size // READ_BYTES))
    if 2 * wanted > df._jdf.queryExecution().analyzed().rdd().getNumPartitions():
        return df
    sc._jvm.System.gc()  # Spark removes the files of exchanges that nothing refers to when the driver collects garbage
    return df.coalesce(wanted)


def _checkpoint_file(df: DataFrame) -> str | None:
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() == "Repartition":
        plan = plan.child()
    if not plan.getClass().getSimpleName().startswith("LogicalRDD"):
        return None
    path = plan.rdd().getCheckpointFile()
    return path.get() if path.isDefined() else None


def release(df: DataFrame) -> None:
    """Removes the files of a checkpoint that nothing reads any more; does nothing to other DataFrames."""
    path = _checkpoint_file(df)
    if path is not None:
        remove_folder(df.sparkSession, path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session as the tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("twinsieve")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
