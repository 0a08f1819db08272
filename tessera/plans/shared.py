"""Session-level helpers: table reads and lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The setting in which a cluster names the folder that all executors share.
SHARED_DIR = "spark.checkpoint.dir"
#: The setting by which a job's shuffled files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set (tests), a temporary one is made and set.

    A cluster without the setting is an error: a machine-local folder would not be seen by the other executors.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get(SHARED_DIR) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError(f"{SHARED_DIR} must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-shared-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised by a reliable checkpoint in the shared folder; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_owned: set[str] = set()


def _removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder, such as an application's when it ends; what a killed one leaves can be told by its name."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001, S110 - the gateway may be gone first
        pass


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once as parquet in the shared folder and read again.

    Unlike a checkpoint the columns stay prunable and compressed, which suits results that several branches read.
    What the job shuffled is removed when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    # one folder an application: what a dead one leaves behind can be told from what a live one reads
    own = f"{shared_dir(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    if own not in _owned:
        _owned.add(own)
        atexit.register(_removed, spark, own)
    path = f"{own}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _removed(df.sparkSession, folder)


def observed(df: DataFrame, name: str, *columns: Column) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows (and ``columns``, aggregates) as they pass, whatever action runs; the observation has the sums when it ends.

    Progress within a run is the engine's own: stages and tasks by ``statusTracker`` and the listeners.
    """
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *columns), seen


#: Partitions a core that keep the last tasks of a stage short.
_WAVES = 4


def spread(df: DataFrame) -> DataFrame:
    """``df`` in enough partitions for work that costs much CPU per byte read: as they are, or dealt out where a scan has few splits."""
    n = _WAVES * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


__all__ = ["F", "cut", "discard", "observed", "shared_dir", "spread", "stored", "table"]
