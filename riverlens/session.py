"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators assume (UTC timestamps, AQE, Arrow for pandas UDFs).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "riverlens",
                shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the settings the library expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the whole cluster
            builder = builder.config("spark.driver.memory", conf.pop("driver_memory", "12g"))
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint dir; set a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; without it executors would write where the driver cannot read, so that
    is an error. Only local runs (tests, the bench) fall back to a temp folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="riverlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def materialize(df, name: str = "table", file_rows: int = 0):
    """Cut lineage by writing ``df`` as parquet under the shared checkpoint folder and
    reading it back (a written table: survives executor loss, re-plans nothing). With
    ``file_rows`` a file holds no more rows, so that later reads are dealt evenly over the cores."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.parquet(path)


#: Written tables that queries share, by application, study and input; ``release_tables`` forgets them.
STUDIES: dict[tuple, tuple] = {}


#: Folders below the checkpoint folder that hold what queries have written.
WRITTEN = ("tables", "archives", "models", "streams")


def release_tables(spark: SparkSession) -> None:
    """Delete all that queries have written below this session's checkpoint folder: tables, archives, models and streams.

    Call it when no DataFrame built on them is needed any more.
    """
    for name in WRITTEN:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{name}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    STUDIES.clear()
