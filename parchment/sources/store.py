"""Letters' tables on disk, bucketed by letter: what belongs to one letter lies in one bucket of every table.

Joins and groups by letter over such tables need no exchange, whatever their number. Tables are written once, into the folder
that the cluster shares, and may be read by any number of jobs.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

KEY = "letter_id"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of its own for a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df as it is now, written to the shared folder: what is numbered or ranged stays so, whichever executor is lost."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def put(spark: SparkSession, tables: dict[str, DataFrame], folder: str, name: str, buckets: int | None = None) -> dict[str, DataFrame]:
    """The tables, written as `{name}_{table}` under folder in so many buckets by letter, and read again.

    buckets: as many as the session's shuffle partitions, if none are given. All tables of a store must have the same
    number. A row without a letter lies in a bucket as well. A table that is there already is replaced.
    """
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = {}
    for table, df in tables.items():
        writer = df.repartition(n, KEY).write.bucketBy(n, KEY).sortBy(KEY).mode("overwrite").option("path", f"{folder}/{name}_{table}")
        writer.saveAsTable(f"{name}_{table}")
        out[table] = spark.table(f"{name}_{table}")
    return out
