"""What users do with pages over time: runs that supersede each other, and edit histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.operators import history
from brakta.plans.staging import folder
from brakta.queries.base import table
from brakta.streaming import runs

#: Kinds of events as frames of runs, and as entries of an edit log.
FRAME = {"view": "ocr_started", "click": "ocr_done", "signup": "detection_started", "purchase": "done", "error": "error"}
ENTRY = {"click": "edit", "view": "edit", "purchase": "edit", "signup": "undo", "error": "redo"}


def _frames(events: DataFrame) -> DataFrame:
    """Users are pages; tokens rise with time, but some frames come after those of a later run."""
    kind = F.create_map(*[F.lit(x) for pair in FRAME.items() for x in pair])[F.col("event_type")]
    token = F.floor((F.col("event_id") + F.pmod(F.col("event_id") * 7919, F.lit(3001))) / 1000)
    return events.select(F.col("user_id").alias("page"), token.alias("token"), kind.alias("kind"), F.col("props").alias("payload"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of frames, followed to its end; the state of every page's last run."""
    schema = table(spark, d, "events").schema
    out = folder(spark, "runs")
    # As a pattern: a stream starts from folders or patterns, and the table may be one file.
    runs.write_latest(spark, _frames(spark.readStream.schema(schema).parquet(f"{d}/events.[p]arquet")), f"{out}/changes", f"{out}/state")
    return runs.now(spark.read.parquet(f"{out}/changes"))


def page_versions(spark: SparkSession, d: str) -> DataFrame:
    """Seven pages with long logs."""
    kind = F.create_map(*[F.lit(x) for pair in ENTRY.items() for x in pair])[F.col("event_type")]
    log = table(spark, d, "events").select(F.pmod("user_id", F.lit(7)).alias("page"), F.col("event_id").alias("version"), kind.alias("kind"), "ts")
    return history.versions(log, "page", ["ts"], "kind", "version")


QUERIES = {f.__name__: f for f in (latest_runs, page_versions)}

_case = lambda names: "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
_LOG = f"(SELECT user_id % 7 AS page, event_id AS version, {_case(ENTRY)} AS kind, ts FROM events)"

SQL = {
    "latest_runs": f"""
        WITH frames AS (
            SELECT user_id AS page, (event_id + event_id * 7919 % 3001) // 1000 AS token, {_case(FRAME)} AS kind, props AS payload, ts, event_id FROM events
        ), seen AS (
            SELECT *, max(token) OVER (PARTITION BY page ORDER BY ts, event_id) AS newest,
                   count(*) FILTER (kind IN ('done', 'error')) OVER (PARTITION BY page, token ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
            FROM frames
        ), taken AS (
            SELECT *, token = newest AND ended = 0 AS counts, max(token) OVER (PARTITION BY page) AS last FROM seen
        )
        SELECT page, last AS token, CAST(count(*) FILTER (counts AND token = last) AS BIGINT) AS frames,
               arg_max(kind, (ts, event_id)) FILTER (counts) AS stage, arg_max(payload, (ts, event_id)) FILTER (counts AND kind = 'done') AS result,
               max(payload) FILTER (counts AND token = last AND kind = 'error') AS error, CAST(count(*) FILTER (NOT counts) AS BIGINT) AS dropped
        FROM taken GROUP BY page, last""",
    "page_versions": history.sql(_LOG, "page", "ts"),
}
