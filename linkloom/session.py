"""Session construction and shared scratch space.

Jobs that need to cut lineage or land intermediate files use the folder the
cluster names in ``spark.checkpoint.dir`` (a shared, fault-tolerant store on a
real cluster).  Only when the setting is absent -- local runs and tests -- do
we create one ourselves; on a cluster its absence is an error, as a folder of
one machine can't be read by the others.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "linkloom", extra: dict | None = None) -> SparkSession:
    """A session with the settings every linkloom job assumes.

    * UTC session zone (epoch <-> text conversions),
    * AQE with partition coalescing and skew-join splitting,
    * Arrow for pandas hand-offs, batches of 128 rows for model calls is set per job,
    * no web UI.
    """
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", os.environ.get("LINKLOOM_DRIVER_MEMORY", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder; create a local one only if none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    local = tempfile.mkdtemp(prefix="linkloom-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one job step."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/linkloom-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage by writing a Parquet table to the shared scratch folder.

    Survives executor loss (unlike ``localCheckpoint``), keeps plans of
    iterative jobs small, and -- unlike ``DataFrame.checkpoint()`` -- the
    re-read table carries real size statistics, so join planning stays cheap
    and broadcast decisions stay informed.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out.scratch_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


#: Tables written within the open scopes, innermost last.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch_scope() -> Iterator[list[DataFrame]]:
    """Delete the tables that ``materialize`` writes within the block when it ends, also by an error.

    For jobs whose result stands elsewhere by then; a table that is still to be
    read is taken off the list that the block is given.
    """
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()
        for df in made:
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete the table of a ``materialize``d frame that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
