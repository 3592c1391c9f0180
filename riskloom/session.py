"""Session helpers: building a local session for tests/bench, the shared
checkpoint folder, and size-checked broadcasting."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default upper bound on rows for a side whose size is checked before it is
# broadcast (``broadcast_if_small``).
BROADCAST_MAX_ROWS = 200_000


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "riskloom") -> SparkSession:
    """Local session used by tests and the bench.  On a cluster, use the
    session the platform gives you; the library reads its settings."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared, fault-tolerant folder and is
    used as is.  Only when it is unset in local mode (tests) a fresh scratch
    folder is created and set; elsewhere an unset folder is an error, as no
    machine's own disk would do."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the shared checkpoint folder (reliable
    checkpoint, survives executor loss) and return the truncated frame."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_scratch(df: DataFrame, name: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet, with the writer's ``options``, to a fresh folder
    of the shared checkpoint folder; the table read back, and where it is."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a table of ``write_scratch`` that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def beside(spark: SparkSession, work: Callable) -> Iterator[Future]:
    """Run ``work``, whose jobs do not need those of the block, in a thread of
    its own: Spark gives the executors' idle cores to its jobs."""
    with ThreadPoolExecutor(1) as pool:
        yield pool.submit(inheritable_thread_target(spark)(work))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking its size; beyond the bound the
    frame is returned unchanged and Spark plans a shuffle join."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
