"""Folders, failing rows, batches, stores and sinks."""

import os

from pyspark.sql import functions as F

from parchment.operators import intake, report, signals
from parchment.plans import verdicts
from parchment.plans.settings import SUITED
from parchment.streaming import inbox


def test_listing_is_a_walk_of_the_folders(spark, tmp_path):
    names = {"in": ["b.pdf", "a.pdf.processing", "c d.pdf"], "more": ["z.pdf"], "done": ["old.pdf", "new.pdf", "none.pdf"]}
    for folder, files in names.items():
        os.mkdir(tmp_path / folder)
        for k, f in enumerate(files):
            (tmp_path / folder / f).write_bytes(b"x" * (1 + 1500 * k))
            os.utime(tmp_path / folder / f, (1_700_000_000 + k, 1_700_000_000 + k))
    at = lambda *fs: [str(tmp_path / f) for f in fs]
    waiting = intake.listing(spark, {"unprocessed": at("in", "more")}, "*.pdf").unionByName(intake.listing(spark, {"processing": at("in")}, "*.processing")).unionByName(intake.listing(spark, {"processed": at("done")}))
    reports = spark.createDataFrame([("old.pdf", "SUSPICIOUS", 20, "2025-01-01"), ("old.pdf", "LEGITIMATE", 90, "2024-01-01"), ("b.pdf", "LEGITIMATE", 91, "2024-01-01")], "file_name string, verdict string, score int, saved_at string")
    got = intake.inbox(waiting, reports.withColumn("saved_at", F.to_timestamp("saved_at"))).orderBy("place").collect()
    assert [(r.place, r.file_name, r.status, r.size_kb, r.report_score) for r in got] == [
        (1, "b.pdf", "unprocessed", 1, None), (2, "c d.pdf", "unprocessed", 3, None), (3, "z.pdf", "unprocessed", 1, None), (4, "a.pdf", "processing", 2, None),
        (5, "none.pdf", "processed", 3, None), (6, "new.pdf", "processed", 2, None), (7, "old.pdf", "processed", 1, 90),
    ]
    assert got[2].path.endswith("/more/z.pdf") and got[6].modified.timestamp() == 1_700_000_000


def test_a_row_that_fails_stops_no_other(spark):
    df = spark.createDataFrame([(k, None if k == 3 else str(k)) for k in range(6)], "letter_id long, n string")
    got = {r.letter_id: (r.half, r.word, r.error) for r in intake.guarded(df, lambda r: {"half": 12 / int(r["n"]), "word": r["n"]}, "half double, word string").collect()}
    assert got[2] == (6.0, "2", None) and got[0][2].startswith("ZeroDivisionError") and got[3][:2] == (None, None) and got[3][2].startswith("TypeError") and len(got) == 6


def test_reports_of_failures_hold_ten_names(spark):
    rows = [(k, f"n{k:02}.doc", 5, "t") for k in range(25)] + [(30, "x.pdf", 5, "t"), (31, None, 5, "t")]
    df = spark.createDataFrame(rows, "letter_id long, file_name string, size long, text string")
    good, bad = intake.sift(df, intake.faults(F.col("size"), F.col("file_name"), F.col("text")))
    got = {r.reason: (r.n, r.samples) for r in intake.fault_report(bad).collect()}
    assert good.count() == 1 and got == {"not a letter file": (25, "|".join(f"n{k:02}.doc" for k in range(10))), "no name": (1, "")}


def test_batches_stay_within_both_limits(spark):
    sizes = [(f"r{k:04}", (k * 37) % 90 + 1) for k in range(500)] + [("r0100x", 100), ("r0200x", 101), ("r0300x", 51), ("r0400x", 50)]
    df = spark.createDataFrame(sizes, "custom_id string, n_bytes long")
    for most, limit in ((7, 100), (1000, 100), (3, 10_000)):
        good, bad = intake.batches(df, most, limit, 5)
        got = {}
        for r in good.collect():
            got.setdefault(r.batch, []).append(r)
        assert sorted(got) == list(range(len(got))) and all(len(b) <= most and sum(r.n_bytes for r in b) <= limit for b in got.values())
        assert sum(map(len, got.values())) + bad.count() == len(sizes) and {r.custom_id for r in bad.collect()} == {i for i, n in sizes if n > limit}
        again = {r.custom_id: r.batch for r in intake.batches(df.repartition(3), most, limit, 5)[0].collect()}
        assert again == {r.custom_id: k for k, b in got.items() for r in b}
    assert intake.batches(df.limit(0))[0].count() == 0


def test_a_batch_that_is_written_again_leaves_each_report_once(spark, tmp_path):
    one, two = (spark.createDataFrame(rows, "file_name string, verdict string, html string") for rows in ([("a.pdf", "LEGITIMATE", "<a>"), ("b.pdf", "MANUAL REVIEW", "<b>")], [("b.pdf", "SUSPICIOUS", "<b2>"), ("c.pdf", "odd", "<c>")]))
    targets = [str(tmp_path / "reports"), str(tmp_path / "saved")]
    write = report.report_sink(*targets)
    write(one, 0)
    write(two, 1)
    write(two, 1)  # run again
    report.write_reports(one, targets[0], 0)  # a crash between the two targets
    write(one, 0)
    for t in targets:
        got = {r.file_name: (r.verdict, r.html, r.batch) for r in report.written_reports(spark, t).collect()}
        assert got == {"a.pdf": ("LEGITIMATE", "<a>", 0), "b.pdf": ("SUSPICIOUS", "<b2>", 1), "c.pdf": ("MANUAL_REVIEW", "<c>", 1)}
        assert spark.read.parquet(t).count() == 4


def test_a_stream_writes_reports_to_both_targets(spark, tmp_path):
    rows = [(f"{k}.pdf", "SUSPICIOUS", f"<{k}>") for k in range(6)]
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], "file_name string, verdict string, html string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for _ in range(2):
        stream = spark.readStream.schema("file_name string, verdict string, html string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        inbox.start_reports(stream, f"{tmp_path}/cp", f"{tmp_path}/r", f"{tmp_path}/s").awaitTermination()
    for t in "rs":
        assert sorted((r.file_name, r.verdict, r.html) for r in report.written_reports(spark, f"{tmp_path}/{t}").collect()) == rows and spark.read.parquet(f"{tmp_path}/{t}").count() == 6


def test_signals_of_a_store_need_no_exchange(spark, sf):
    """Neither for groups nor for joins, however large the tables: no side is broadcast here."""
    tables = verdicts._store(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    df = signals.signals(*[tables[n] for n in ("letters", "pages", "features", "lines", "images", "meta")], SUITED.as_of)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and plan.count("Bucketed: true") >= 6
    assert df.count() == tables["letters"].count()
