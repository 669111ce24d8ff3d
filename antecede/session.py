"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, checkpoints: str | None = None) -> SparkSession:
    """A session for tests and the bench, with its checkpoint folder; a cluster brings its own."""
    return (
        SparkSession.builder.config(
            "spark.checkpoint.dir", checkpoints or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .master(f"local[{cores}]")
        .appName("antecede")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    It comes from ``spark.checkpoint.dir``. Only a local session made elsewhere without
    one gets a temporary folder; a cluster without one is an error, since a machine-local
    folder would be lost with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a table in the checkpoint folder.

    ``DataFrame.checkpoint`` keeps the estimated size of the plan it cuts. A join's estimate is a product, so in a loop
    that joins a table to itself the estimate squares in each round, until the driver does nothing but multiply it. A stored
    table has the size of its files, and its columns are compressed."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.checkpoint_path = path
    return table


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that ``checkpointed`` returned. Only for one that nothing will read again: the tables
    made from it must be written themselves."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.checkpoint_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
