"""Session settings and lineage control shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


FILE_FACTOR = "10"  # rows in memory by their parquet size: names and relations repeat and are stored as dictionary entries


def size_files(spark: SparkSession) -> None:
    """Have the optimizer size tables by their rows, not by their compressed files, unless the session has its own factor."""
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) == 1.0:
        spark.conf.set(name, FILE_FACTOR)


def join_in_place(spark: SparkSession) -> None:
    """Let rows that lie together by one key of a join stay there, instead of shuffling both sides by all of its keys."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def beside(rows: DataFrame) -> DataFrame:
    """One side of a join of tables that both grow with the questions: such rows meet where they lie, or travel by the keys, and none
    is sent to every task, however small it looks."""
    join_in_place(rows.sparkSession)
    return rows.hint("merge")


def get_spark(app: str = "kgspark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster leave ``master`` unset and pass sizes through ``conf``; adaptive execution then picks the
    number of reduce tasks and splits skewed join partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # at run time, once all partitions of a side are seen to be small: hash instead of sort, or send it to all tasks
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
        "spark.sql.sources.fileCompressionFactor": FILE_FACTOR,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``, which all executors share; only a local master may fall back to a temp folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)


def _new_place(spark: SparkSession) -> tuple[str, str]:
    ensure_checkpoint_dir(spark)
    name = f"kgspark_{uuid.uuid4().hex}"
    return name, f"{spark.sparkContext.getCheckpointDir()}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as parquet into the shared folder and go on from there.

    They survive the loss of executors, are read column by column, and their size is known to the optimizer, which can
    then choose joins by it.
    """
    spark = df.sparkSession
    size_files(spark)
    _, path = _new_place(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str, placed: bool = False) -> DataFrame:
    """Write a table bucketed and sorted by the keys into the shared folder; joins and groupings on the keys then read it
    in place, without a shuffle. Use it for a side that several steps join with. Rows that already lie together by the keys
    (``placed``: out of a join, a grouping or such a table) are written where they are; others are shuffled first."""
    spark = df.sparkSession
    size_files(spark)
    name, path = _new_place(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    (df if placed else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)
