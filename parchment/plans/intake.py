"""Queries of what comes in: lives of files, names they are kept under, letters that fail, batches of requests; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.operators import intake, lifecycle
from parchment.plans.catalog import query
from parchment.sources import letters as src

# ---------------------------------------------------------------- lives of files

_KIND = "CASE event_type WHEN 'signup' THEN 'arrive' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'revert' ELSE 'recover' END"
_MOVES = ", ".join(f"('{k}', {before}, {after})" for k, to in lifecycle.MOVES.items() for before, after in enumerate(to))
_NAMES = ", ".join(f"'{s}'" for s in lifecycle.STATES)
_SUMS = ", ".join(f"p.{k} + CASE WHEN n.kind = '{k}' AND m.before <> m.after THEN 1 ELSE 0 END" for k in lifecycle.COUNTED)


@query("file_lives", f"""WITH RECURSIVE e AS (SELECT event_id, ts, concat('letter_', user_id, '.pdf') AS file_name, {_KIND} AS kind FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY ts, event_id) AS i FROM e), m(kind, before, after) AS (VALUES {_MOVES}),
p AS (SELECT file_name, CAST(0 AS BIGINT) AS i, 0 AS state, {", ".join(f"CAST(0 AS BIGINT) AS {k}" for k in lifecycle.COUNTED)}, CAST(0 AS BIGINT) AS refused, CAST(NULL AS TIMESTAMP) AS since FROM (SELECT DISTINCT file_name FROM e) AS x
  UNION ALL SELECT p.file_name, n.i, m.after, {_SUMS}, p.refused + CASE WHEN m.before = m.after THEN 1 ELSE 0 END, CASE WHEN m.before <> m.after THEN n.ts ELSE p.since END FROM p JOIN n ON p.file_name = n.file_name AND n.i = p.i + 1 JOIN m ON m.kind = n.kind AND m.before = p.state)
SELECT file_name, [{_NAMES}][state + 1] AS state, {", ".join(lifecycle.COUNTED)}, refused, epoch_us(since) AS since FROM p QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY i DESC) = 1""")
def _(spark, sf_dir):
    """Each file's state and counts, from events some of which come twice and none in order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.concat(F.lit("letter_"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("file_name"), F.expr(_KIND).alias("kind"))
    out = lifecycle.fold(events.unionByName(events.filter("event_id % 3 = 0")))
    return out.withColumn("since", F.unix_micros("since"))


_ARRIVED = "SELECT o_orderkey AS letter_id, concat(CASE WHEN o_custkey % 2 = 0 THEN 'offer' ELSE concat('offer ', CAST(o_custkey % 200 AS STRING)) END, CASE WHEN o_custkey % 7 = 0 THEN concat('_', CAST(o_custkey % 5 AS STRING)) WHEN o_custkey % 11 = 0 THEN '_07' ELSE '' END, CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN '.pdf' WHEN 1 THEN '.v2.txt' ELSE '' END) AS file_name FROM {orders}"
_TAKEN = "SELECT concat('offer', CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat('_', CAST(c_custkey * 3 AS STRING)) END, '.pdf') AS file_name FROM {customer}"
_PART = lambda k: f"regexp_extract(file_name, '(?s)^(.*?)([.][^./]*)?$', {k})"


@query("saved_names", f"""WITH a AS (SELECT *, {_PART(1)} AS stem, {_PART(2)} AS ending FROM ({src.plain(_ARRIVED)}) AS x), t AS (SELECT DISTINCT file_name FROM ({src.plain(_TAKEN)}) AS x),
w AS (SELECT a.*, row_number() OVER (PARTITION BY a.file_name ORDER BY letter_id) - CASE WHEN t.file_name IS NULL THEN 1 ELSE 0 END AS k FROM a LEFT JOIN t ON a.file_name = t.file_name),
u AS (SELECT DISTINCT regexp_replace({_PART(1)}, '_[1-9][0-9]*$', '') AS stem, {_PART(2)} AS ending, CAST(regexp_extract({_PART(1)}, '_([1-9][0-9]*)$', 1) AS BIGINT) AS number FROM (SELECT file_name FROM a UNION SELECT file_name FROM t) AS y WHERE regexp_matches({_PART(1)}, '_[1-9][0-9]*$')),
c AS (SELECT stem, ending, max(k) AS most FROM w GROUP BY stem, ending), n AS (SELECT c.stem, c.ending, most, (SELECT count(*) FROM u WHERE u.stem = c.stem AND u.ending = c.ending) AS used FROM c),
f AS (SELECT stem, ending, number, row_number() OVER (PARTITION BY stem, ending ORDER BY number) AS k FROM (SELECT stem, ending, unnest(range(1, most + used + 1)) AS number FROM n) AS z ANTI JOIN u USING (stem, ending, number))
SELECT w.letter_id, w.file_name, CASE WHEN w.k = 0 THEN w.file_name ELSE w.stem || '_' || f.number || w.ending END AS saved_name FROM w LEFT JOIN f ON w.stem = f.stem AND w.ending = f.ending AND w.k = f.k""")
def _(spark, sf_dir):
    """Finished files beside those that are there: names that are taken get the smallest free numbers, in order of arrival."""
    arrivals = src.build(spark, sf_dir, _ARRIVED).withColumn("order", F.col("letter_id"))
    return lifecycle.free_names(arrivals, src.build(spark, sf_dir, _TAKEN)).select("letter_id", "file_name", "saved_name")


# ---------------------------------------------------------------- letters that fail

_FILES = """SELECT o_orderkey AS letter_id, CASE CAST(o_orderkey % 19 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('letter_', CAST(o_orderkey AS STRING), '.docx') WHEN 3 THEN concat('LETTER_', CAST(o_orderkey AS STRING), '.PDF') WHEN 4 THEN 'pdf' ELSE concat('letter_', CAST(o_orderkey AS STRING), '.pdf') END AS file_name,
  CASE CAST(o_orderkey % 23 AS INT) WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS BIGINT) WHEN 2 THEN CAST(52428801 AS BIGINT) WHEN 3 THEN CAST(52428800 AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size,
  CASE CAST(o_orderkey % 29 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'broken � text' WHEN 2 THEN '' ELSE 'Dear' END AS text FROM {orders}"""
_FAULT = """CASE WHEN coalesce(file_name, '') = '' THEN 'no name' WHEN NOT (lower(file_name) LIKE '%.pdf' OR lower(file_name) LIKE '%.txt') THEN 'not a letter file' WHEN coalesce(size, 0) <= 0 THEN 'empty file' WHEN size > 52428800 THEN 'too large' WHEN text IS NULL THEN 'unreadable' WHEN contains(text, '�') THEN 'not text' END"""


def _sifted(spark, sf_dir):
    files = src.build(spark, sf_dir, _FILES)
    return intake.sift(files, intake.faults(F.col("size"), F.col("file_name"), F.col("text")))


@query("failed_letters", f"SELECT letter_id, file_name, {_FAULT} AS reason FROM ({src.plain(_FILES)}) AS x WHERE {_FAULT} IS NOT NULL")
def _(spark, sf_dir):
    """Letters that cannot be read, each with its reason; the others pass."""
    return _sifted(spark, sf_dir)[1].select("letter_id", "file_name", "reason")


@query("failure_report", f"""WITH f AS (SELECT letter_id, coalesce(file_name, '') AS name, {_FAULT} AS reason, row_number() OVER (PARTITION BY {_FAULT} ORDER BY file_name NULLS FIRST, letter_id) AS k FROM ({src.plain(_FILES)}) AS x)
SELECT reason, count(*) AS n, string_agg(name, '|' ORDER BY k) FILTER (k <= 10) AS samples FROM f WHERE reason IS NOT NULL GROUP BY reason""")
def _(spark, sf_dir):
    """How many letters fail for each reason, with the first ten names."""
    return intake.fault_report(_sifted(spark, sf_dir)[1])


# ---------------------------------------------------------------- batches of requests

_MOST, _BYTES = 400, 1 << 20
_ASKED = f"SELECT concat('letter-', CAST(o_orderkey AS STRING)) AS custom_id, CASE WHEN o_orderkey % 97 = 0 THEN CAST({_BYTES} + o_orderkey % 2 AS BIGINT) WHEN o_orderkey % 53 = 0 THEN CAST({_BYTES // 2} + o_orderkey % 3 - 1 AS BIGINT) ELSE CAST(floor(o_totalprice / 40) AS BIGINT) END AS n_bytes FROM {{orders}}"
_RESULTS = "SELECT concat('letter-', CAST(o_orderkey AS STRING)) AS custom_id FROM {orders} WHERE o_orderkey % 3 = 0"


@query("request_batches", f"""WITH r AS (SELECT * FROM ({src.plain(_ASKED)}) AS x ANTI JOIN ({src.plain(_RESULTS)}) AS y USING (custom_id)), f AS (SELECT *, n_bytes * 2 > {_BYTES} AS alone FROM r WHERE n_bytes <= {_BYTES}),
s AS (SELECT *, row_number() OVER (ORDER BY custom_id) AS place, sum(CASE WHEN alone THEN 0 ELSE n_bytes END) OVER (ORDER BY custom_id) AS total, {_BYTES} - max(n_bytes) FILTER (NOT alone) OVER () AS width FROM f),
c AS (SELECT *, min(place) OVER (PARTITION BY (place - 1) // {_MOST}, CAST(total AS BIGINT) // width, CASE WHEN alone THEN custom_id END) AS first FROM s)
SELECT custom_id, n_bytes, dense_rank() OVER (ORDER BY first) - 1 AS batch, CAST(NULL AS VARCHAR) AS reason FROM c UNION ALL SELECT custom_id, n_bytes, NULL, 'request too large' FROM r WHERE n_bytes > {_BYTES}""")
def _(spark, sf_dir):
    """Requests that have no answer yet, in batches under a limit of number and one of bytes."""
    left = intake.unanswered(src.build(spark, sf_dir, _ASKED), src.build(spark, sf_dir, _RESULTS))
    good, bad = intake.batches(left, _MOST, _BYTES)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("custom_id", "n_bytes", F.lit(None).cast("long").alias("batch"), "reason"))
