"""Tables written between stages, in a folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
WAREHOUSE = "spark.sql.warehouse.dir"


def work_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse.

    Both are places every executor reaches, so a table written there outlives the machine that
    wrote it. A warehouse in a plain folder is such a place for a local master only: a cluster that
    has no other one must name its shared folder. Tables of an application lie under
    ``lexmill/<application id>``; see ``clear``.
    """
    context = spark.sparkContext
    root = spark.conf.get(SETTING, None) or context.getConf().get(SETTING) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    warehouse = spark.conf.get(WAREHOUSE).rstrip("/")
    if warehouse.startswith(("file:", "/")) and not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder all executors reach; the warehouse {warehouse} may lie on one machine")
    return f"{warehouse}/work"


def app_root(spark: SparkSession) -> str:
    return f"{work_root(spark)}/lexmill/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{app_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> bool:
    """Remove the tables this application has written between stages; True if there were any.

    Results that still read from them must have been written elsewhere before.
    """
    for name in spark.catalog.listTables(pattern=f"{_table_prefix(spark)}*"):
        spark.sql(f"DROP TABLE IF EXISTS {name.name}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(app_root(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once, in folders by ``partition_by``, and go on from the files. Runs a job.

    Each task writes its own rows into the folders, without a shuffle; input that is already laid
    out by folder stays that way.

    This cuts the lineage, survives lost executors, and gives the optimizer the true size of the
    table, so that it broadcasts small results by its own threshold and never large ones.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def _table_prefix(spark: SparkSession) -> str:
    application = spark.sparkContext.applicationId
    return "lexmill_" + "".join(c if c.isalnum() else "_" for c in application.lower()) + "_"


def materialize_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialize``, with the rows laid out by ``key``, one file per bucket. Runs a job.

    Grouping by ``key``, or joining another table of as many buckets, then needs no shuffle. The layout
    is kept in the session's catalog, as a table over the files, which ``clear`` drops.
    """
    spark = df.sparkSession
    table = _table_prefix(spark) + uuid.uuid4().hex
    rows = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key)
    rows.option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)
