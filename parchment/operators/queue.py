"""The inbox as tables: places in a listing, what is still to be done, and the report of each finished letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parchment.sources.store import cut

#: The verdicts' folders in the order in which they are searched.
FOLDERS = ["LEGITIMATE", "MANUAL REVIEW", "SUSPICIOUS"]


def places(df: DataFrame, group: str, first: Column, second: str, parts: int = 64) -> DataFrame:
    """df with `place`, from 1 in each group, in the order of first and second; rows equal in both are placed in any order.

    Rows are sorted into `parts` ranges of (group, first, second), so a group of any size, also one whose rows are equal in
    first, lies in many of them. A row's place is its number in its range and the sizes of its group's ranges before; these
    are one row for each range and group.
    """
    ranged = df.withColumn("__first", first).repartitionByRange(parts, group, "__first", second).sortWithinPartitions(group, "__first", second)
    # An id is the range's number and, in its lower 33 bits, the row's within it. Two plans would sample two sets of ranges, so
    # rows are written with their ids.
    rows = cut(ranged.withColumns({"__id": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}))
    sizes = rows.groupBy(group, "__part").agg(F.count("*").alias("n"), F.min("__id").alias("__least"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), "__least", before.alias("__before"))
    out = rows.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return out.withColumn("place", F.col("__before") + F.col("__id") - F.col("__least") + 1).drop("__first", "__id", "__part", "__g", "__p", "__least", "__before")


def unprocessed(letters: DataFrame, done: DataFrame, most: int = 0) -> DataFrame:
    """The letters whose file has no row in done, by file name; the first `most` of them, all with 0."""
    left = letters.join(done.select("file_name").distinct(), "file_name", "left_anti")
    return left.orderBy("file_name").limit(most) if most else left


def with_reports(letters: DataFrame, reports: DataFrame) -> DataFrame:
    """letters with the verdict, score and saved time of their file's report; of several, that of the first folder, then the latest."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(f) for f in FOLDERS]), F.col("verdict")), F.lit(0)), F.lit(99))
    best = reports.groupBy("file_name").agg(F.min_by(F.struct("verdict", "score", "saved_at"), F.struct(rank, -F.unix_seconds(F.col("saved_at").cast("timestamp")), "score")).alias("r"))
    return letters.join(best, "file_name", "left").select(*letters.columns, F.col("r.verdict").alias("report_verdict"), F.col("r.score").alias("report_score"), F.col("r.saved_at").alias("processed_at"))


def answered(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests with the results that name them; results of other requests are dropped."""
    return requests.join(results, "custom_id")
