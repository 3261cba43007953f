"""One place that builds or adapts the SparkSession.

Cluster settings (shuffle partitions, checkpoint folder, executor memory) are
taken from the session when they are already set; the defaults below only fill
gaps, which is what happens in tests and in ``bench.py`` on ``local[N]``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "scorewright",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass the cluster's own session to the
    library functions instead; nothing here is required by them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        cores = re.fullmatch(r"local\[(\d+)\]", master)
        if cores:
            b = b.config("spark.scorewright.scan.partitions", cores[1])
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("SCOREWRIGHT_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_CKPT: str | None = None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables: the one that
    ``spark.checkpoint.dir`` names, else the one set on the context.

    Only a local master may do without either (tests): it gets a folder of its
    own.  On a cluster such a folder would be the driver's disk alone, so this
    raises."""
    global _LOCAL_CKPT
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or _LOCAL_CKPT
    if not d:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _LOCAL_CKPT = tempfile.mkdtemp(prefix="scorewright-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
