"""Session settings and the shared working folder.

Scratch output (staged stream input, checkpoints, saved tables) always goes
under the folder the cluster names in ``spark.checkpoint.dir``.  Only when
that is unset (local runs, tests) do we pick a temporary folder and set it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale.  AQE re-plans joins and shuffle partition
# counts from runtime sizes and splits skewed sort-merge-join partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


MB = 1024 * 1024


def scale_settings(input_bytes: int, target_partition_bytes: int = 256 * MB,
                   min_partitions: int = 8) -> dict[str, str]:
    """Shuffle and scan sizing for an input of ``input_bytes``.

    AQE can coalesce shuffle partitions but never split them, so the
    initial count must come from the data: one partition per
    ``target_partition_bytes`` of input (for 100 TB at 256 MB that is
    about 400k), which AQE then merges toward the advisory size.  Scan
    splits use the same target, so a task's input and its shuffle output
    both fit comfortably in executor memory and spill only in rare cases."""
    n = max(min_partitions, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "epiframe", extra: dict | None = None) -> SparkSession:
    """A session with the settings above.  The master and the number of
    shuffle partitions are left to spark-submit unless given."""
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.  Where none is set, a temporary
    one will do if everything runs on this machine (a ``local`` master); on a
    cluster executors could not share it, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="epiframe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/epiframe/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df, name: str):
    """Cut lineage: write ``df`` as Parquet under the shared checkpoint folder
    and return it read back.  One job (a reliable ``checkpoint`` computes the
    plan twice unless cached), survives executor loss, and later scans still
    get column pruning and filter pushdown."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
