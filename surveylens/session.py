"""Session helpers: configuration, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest size of a side that is shipped as a broadcast.
MAX_BROADCAST_BYTES = 32 << 20


def build_session(master: str | None = None, app: str = "surveylens",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with AQE on and UTC time; used by tests and the bench.

    On a cluster the caller's own session is used instead of this one; an
    existing session found here gets these settings and the log level.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
        # delete checkpoint files once their DataFrame is garbage collected
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    The cluster names it in ``spark.checkpoint.dir``; only when nothing is
    set and everything runs in this process (a local test) is a scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            # a machine-local folder would not survive the loss of an executor
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        configured = tempfile.mkdtemp(prefix="surveylens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def table_size(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of ``df``, by one aggregate: eight bytes for a number, the
    length of a text, and what a row takes besides."""
    size = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        size = size + (F.coalesce(F.octet_length(c), F.lit(0)) if f.dataType.typeName() in ("string", "binary")
                       else F.lit(8))
    row = df.select(size.cast("bigint").alias("b")).agg(F.count("b"), F.sum("b")).first()
    return row[0], row[1] or 0


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if its rows take at most ``max_bytes``; otherwise it is
    returned without a hint and the planner keeps a shuffle join."""
    return F.broadcast(df) if table_size(df)[1] <= max_bytes else df
