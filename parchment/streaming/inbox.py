"""The inbox as a file stream: the checkpoint takes the place of claims and renames, a failed batch is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.config import DEFAULT, Settings
from parchment.functions.text import slug
from parchment.operators import extract, forensic, report

SCHEMA = "letter_id long, file_name string, full_text string"


def screen(letters: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Extracted fields and text signals of letters, batch or stream."""
    out = extract.extract(letters, settings)
    out = out.withColumn("red_phrases", forensic.red_phrases(F.col("full_text"))).withColumn("artifacts", forensic.template_artifacts(F.col("full_text")))
    state = F.when((F.size("red_phrases") > 0) | (F.size("artifacts") > 0) | (F.col("joining_date") < F.col("offer_date")), "HOLD").otherwise("PASS")
    return out.withColumn("screen", F.coalesce(state, F.lit("PASS"))).withColumn("slug", slug(F.col("file_name")))


def start(spark: SparkSession, inbox: str, out: str, checkpoint: str, every: str | None = None, max_files: int = 1000, settings: Settings = DEFAULT):
    """Screens Parquet letters that arrive in inbox into out, by verdict folders. every: an interval such as "30 minutes"; without one, what is there now is taken and the query ends."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(inbox)
    writer = screen(stream, settings).writeStream.format("parquet").partitionBy("screen").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_reports(stream: DataFrame, checkpoint: str, *targets: str, every: str | None = None):
    """Writes a stream of (file_name, verdict, html) to all targets, each report once whatever is run again."""
    writer = stream.writeStream.foreachBatch(report.report_sink(*targets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
