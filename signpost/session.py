"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed side even where that costs a later operator one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.unionOutputPartitioning": "true",
    # call-site capture on every column expression makes building a large plan several times slower
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "signpost", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix=f"{app}-"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions(df: DataFrame) -> int:
    """Partition count for a layout several operators share.

    A count given outright is kept by adaptive execution. It would otherwise merge the partitions by the bytes they
    receive, too few tasks where the rows multiply after the exchange, as hits of a common word do.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Spark's setting by which an execution that has ended drops what it exchanged.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write the rows and read them again: computed once, and there whatever executor is lost.

    What was exchanged for them goes with the write; else it stays until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor reaches, as the cluster names it; without one a folder in the warehouse, which is shared too."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/shared"
