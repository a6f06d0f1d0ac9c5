"""Session construction and the shared working folder.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (set by
whoever runs the cluster). Only on a local master — tests, the bench — and
where it is unset do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark import SparkConf
from pyspark.sql import SparkSession


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "tessera",
    extra: dict | None = None,
) -> SparkSession:
    """A session tuned for these operators.

    * AQE on: runtime coalescing of small shuffle partitions and skew-join
      splitting of hot partitions.
    * Arrow on: the few Python paths (mapInArrow / applyInArrow) batch rows.
    * UI off: no server is started.

    Master, shuffle partitions and driver memory that spark-submit or the
    caller has set stay as they are; only a bare local session gets our own.
    """
    given = SparkConf()
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder
    if master or not given.contains("spark.master"):
        b = b.master(master or f"local[{cpus}]")
        shuffle_partitions = shuffle_partitions or int(cpus)
        b = b.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    if shuffle_partitions and not given.contains("spark.sql.shuffle.partitions"):
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (
        b.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    Where none is set, a local master gets a temporary one; any other raises,
    since executors of a cluster would each write to their own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


#: Folders handed out by this driver and not removed yet.
_MADE: set[str] = set()


def shared_dir(spark: SparkSession, purpose: str = "out") -> str:
    """A fresh, unique folder under the shared checkpoint folder.

    It holds tables that later stages of a lazy result read, so it stays until
    ``cleanup`` is called.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tessera-{purpose}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


def cleanup(spark: SparkSession, keep: Iterable[str] = ()) -> int:
    """Remove the folders that ``shared_dir`` has handed out since the last call, but for ``keep``.

    Call it when the results made so far are written or read: frames that
    still read these tables fail afterwards. Returns how many were removed.
    """
    return remove(spark, _MADE - set(keep))


def remove(spark: SparkSession, paths: Iterable[str]) -> int:
    """Remove folders of ``shared_dir`` that nothing reads any more; returns how many were removed."""
    gone, jvm = 0, spark._jvm
    for path in sorted(paths):
        where = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
        _MADE.discard(path)
    return gone
