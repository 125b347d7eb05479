"""Session settings that every job, test and bench of this package shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("corpuscle")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) a local folder is used and
    remembered in the session under a name of its own, so that later calls share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.corpuscle.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corpuscle-")
        spark.conf.set("spark.corpuscle.scratch", root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows from a table in the shared scratch folder.

    Cuts the lineage where several later steps need one result, so that it is
    computed once, and a lost executor does not set off computing it again.
    """
    spark = df.sparkSession
    place = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def widen(scan: DataFrame) -> DataFrame:
    """A plain scan with work for every core.

    Chunking and embedding are bound by the processor, and a small file is a single
    partition. A scan that already has as many partitions as there are cores, as any
    large one does, is left alone; so this never moves more than a small input.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
