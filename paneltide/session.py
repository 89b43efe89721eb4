"""Spark session helpers.

The library never creates a cluster configuration of its own beyond what a
local test needs; on a cluster the caller's session is used as is. Only
settings that are *unset* are filled in (checkpoint directory, AQE flags).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on. AQE re-plans joins and coalesces partitions at
# runtime; skew-join splits hot partitions of sort-merge joins.
_RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "paneltide") -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("PANELTIDE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in _RUNTIME_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    A local scratch folder is chosen only for local sessions (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="paneltide-ckpt-", dir=os.environ.get("PANELTIDE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


_MAT_COUNTER = [0]
_WRITTEN: list[str] = []


def materialise(df, name: str = "table"):
    """Cut lineage by writing ``df`` as Parquet under the session's checkpoint
    folder (a shared folder on a cluster) and reading it back.

    Unlike ``Dataset.checkpoint`` on an unpersisted plan, the plan is computed once;
    the re-read table carries file statistics, so later joins can be broadcast
    from measured sizes, and a lost executor only costs a re-read."""
    import uuid

    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    _MAT_COUNTER[0] += 1
    path = f"{root}/paneltide-{name}-{_MAT_COUNTER[0]}-{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


def drop_materialised(spark: SparkSession) -> int:
    """Delete every table that :func:`materialise` wrote in this process, through the
    file system that Spark uses. For the end of a job: frames that read such a table, and
    results memoised in the session, cannot be evaluated afterwards."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
