"""Session helpers used by the queries, tests, bench and scripts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the submitted session is used as it is."""
    return (
        SparkSession.builder.master(master)
        .appName("skysift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from its place (a cluster ships
    it with --py-files instead) and bounds an Arrow batch by its bytes, so that
    long texts cannot fill a worker and narrow rows come many at a time."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir). Only a
    local session may do without that setting; it uses a temporary folder."""
    global _local_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _local_dir is None:
            _local_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
        root = _local_dir
    return f"{root.rstrip('/')}/skysift-{uuid.uuid4().hex}"


#: Rows of a part, and most parts, of a table whose rows are few but dear.
SPREAD_ROWS, SPREAD_PARTS = 512, 64


def spread(df: DataFrame) -> DataFrame:
    """A stored table dealt to parts by its rows: a fit that goes over a small table
    hundreds of times has all cores, where by its bytes it would be one task. The
    number follows from the rows alone, so a fit is the same on any cluster."""
    rows = df.count()
    return stored(df.repartition(max(1, min(SPREAD_PARTS, -(-rows // SPREAD_ROWS)), -(-rows // (1 << 20)))))


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and a
    lost executor costs no more than the stage that it ran."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
