"""Session construction and the few session-level helpers every job uses."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes (as written) of a side that may be broadcast.
BROADCAST_BYTES = 32 << 20
# Bytes of a batch that enters a Python worker (see ``small_batches``).
BATCH_BYTES = 2 << 20


def build_session(master: str | None = None, app: str = "pagewright",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session tuned for this library: AQE with skew-join splitting,
    Arrow transfer for the Python stages, UTC session time, no UI."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only a local-mode session (tests, laptops) may
    fall back to a fresh private folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative jobs need a shared, "
                "reliable folder on a cluster")
        configured = tempfile.mkdtemp(prefix="pagewright-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (cuts lineage, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Arrow batches that enter Python workers end at ``size`` bytes (by
    default at 10,000 rows, of whatever length) in jobs started inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read
    it back: a column-pruned cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(table: DataFrame) -> int:
    """Bytes of a table that is read from files, as the planner sees them."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written once (see ``scratch_table``) and marked for broadcast if
    its files have at most ``max_bytes``; otherwise the planner joins it by
    shuffle, with AQE splitting skew. For small aggregated sides that several
    plans read: rule tables, profiles, per-site summaries."""
    table = scratch_table(df, "side")
    return F.broadcast(table) if table_bytes(table) <= max_bytes else table


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables under the checkpoint root."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, name)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per context):
    the package is zipped on the driver and distributed with addPyFile."""
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="pagewright-py-"), "pagewright.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
