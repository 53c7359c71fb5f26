"""What comes in: listings of folders, letters that fail and why, and batches of requests under two limits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from parchment.config import DEFAULT
from parchment.operators import queue
from parchment.sources.store import cut

#: The places of a file, in the order in which they are listed.
STATUSES = ["unprocessed", "processing", "processed"]


def listing(spark: SparkSession, folders: dict[str, list[str]], pattern: str = "*") -> DataFrame:
    """(file_name, path, status, size_kb, modified) of the files of all folders, by status; contents are not read.

    Folders of one status are put together, each row keeping its path. A file under `name.processing` is listed as name. Files
    without a byte are not listed.
    """
    out = None
    for status, paths in folders.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)
        name = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.processing$", "")
        rows = files.select(name.alias("file_name"), "path", F.lit(status).alias("status"), F.ceil(F.col("length") / 1024).cast("int").alias("size_kb"), F.col("modificationTime").alias("modified"))
        out = rows if out is None else out.unionByName(rows)
    return out


def inbox(files: DataFrame, reports: DataFrame) -> DataFrame:
    """A listing with each finished file's report and `place`, from 1: waiting and running files by name, finished ones by time, the latest first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    done = F.col("status") == "processed"
    late = F.when(done, -F.unix_micros(F.col("modified").cast("timestamp"))).otherwise(0)
    known = queue.with_reports(files, reports)
    known = known.withColumns({c: F.when(done, F.col(c)) for c in ("report_verdict", "report_score", "processed_at")}).withColumn("all", F.lit(1))
    return queue.places(known, "all", F.struct(rank.alias("rank"), late.alias("late"), F.col("file_name").alias("name")), "path").drop("all")


# ---------------------------------------------------------------- letters that fail


def faults(size: Column, name: Column, text: Column, max_bytes: int = DEFAULT.max_bytes) -> Column:
    """Why a letter cannot be read, the first reason of several; null for one that can."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "no name").when(~F.coalesce(F.lower(name).rlike(r"(?:\.pdf|\.txt)$"), F.lit(False)), "not a letter file").when(F.coalesce(size, F.lit(0)) <= 0, "empty file")
        .when(size > max_bytes, "too large").when(text.isNull(), "unreadable").when(F.contains(text, F.lit("\x00")) | F.contains(text, F.lit("�")), "not text")
    )


def sift(letters: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good, failed): rows without a reason, and the others with it in a column reason. A row that fails stops no other."""
    marked = letters.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def guarded(letters: DataFrame, step, schema: str) -> DataFrame:
    """letters through a Python step, a row at a time: (letter_id, the step's fields, error).

    step takes a row as a dict and returns one. A row on which it raises has null fields and the error's type and text, cut to
    200 characters; the rest passes.
    """
    out = StructType.fromDDL(f"letter_id long, {schema}, error string")
    names = out.names[1:-1]

    def one(row: dict) -> dict:
        try:
            got = step(row)
            return {"letter_id": row["letter_id"], **{n: got.get(n) for n in names}, "error": None}
        except Exception as e:  # whatever it is, it is this row's alone
            return {"letter_id": row["letter_id"], **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"[:200]}

    def rows(found):
        kind = to_arrow_schema(out)
        for b in found:
            yield pa.RecordBatch.from_pylist([one(r) for r in b.to_pylist()], schema=kind)

    return letters.mapInArrow(rows, out)


def fault_report(failed: DataFrame, samples: int = 10) -> DataFrame:
    """(reason, n, samples): how many letters fail for each reason, and the first names of them, joined by "|"."""
    first = failed.withColumn("k", F.row_number().over(W.partitionBy("reason").orderBy("file_name", "letter_id"))).filter(F.col("k") <= samples)
    named = first.groupBy("reason").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("file_name", F.lit("")).alias("file_name")))), lambda r: r["file_name"]), "|").alias("samples"))
    return failed.groupBy("reason").agg(F.count("*").alias("n")).join(named, "reason")


# ---------------------------------------------------------------- batches of requests

#: What a batch may hold.
MOST_REQUESTS, MOST_BYTES = 100_000, 256 << 20


def unanswered(requests: DataFrame, results: DataFrame) -> DataFrame:
    """The requests that no result names: these are sent, at first and again."""
    return requests.join(results.select("custom_id"), "custom_id", "left_anti")


def running(df: DataFrame, order: str, value: str, parts: int = 64) -> DataFrame:
    """df with place, from 1, and total, the sum of value up to and with a row, in the order of a column without repeats.

    Rows lie in ranges of order; each range is summed apart, and what lies before a range is added.
    """
    ranged = cut(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
    inside = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = ranged.withColumns({"place": F.row_number().over(W.partitionBy("__part").orderBy(order)), "total": F.sum(value).over(inside)})
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.sum(value).alias("v"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("__v"))
    return rows.join(starts, "__part").withColumns({"place": F.col("place") + F.col("__n"), "total": F.col("total") + F.col("__v")}).drop("__part", "__n", "__v")


def batches(requests: DataFrame, most: int = MOST_REQUESTS, most_bytes: int = MOST_BYTES, parts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(batched, refused): requests (custom_id, n_bytes) with batch, from 0 and without gaps in the order of custom_id.

    A batch holds at most `most` requests and most_bytes bytes. A request of more bytes than that is refused, one of more
    than half of them is a batch of its own; the others are cut by their place and by the bytes before them, the limit less
    the largest request, so a batch that begins before a cut stays within the limit. The same requests get the same numbers.
    """
    fits, refused = sift(requests, F.when(F.col("n_bytes") > most_bytes, "request too large"))
    alone = F.col("n_bytes") * 2 > most_bytes
    summed = running(fits.withColumn("small", F.when(alone, 0).otherwise(F.col("n_bytes")).cast("long")), "custom_id", "small", parts)
    largest = fits.filter(~alone).agg(F.coalesce(F.max("n_bytes"), F.lit(0)).alias("largest"))
    cell = F.struct(F.floor((F.col("place") - 1) / most).alias("by_number"), F.floor(F.col("total") / (F.lit(most_bytes) - F.col("largest"))).alias("by_bytes"), F.when(alone, F.col("custom_id")).alias("own"))
    cells = summed.crossJoin(F.broadcast(largest)).withColumn("cell", cell)  # one row
    firsts = cells.groupBy("cell").agg(F.min("place").alias("first"))
    numbers = queue.places(firsts.withColumn("all", F.lit(1)), "all", F.col("first"), "first", parts).select("cell", (F.col("place") - 1).alias("batch"))
    return cells.join(numbers, "cell").select(*requests.columns, "batch"), refused
