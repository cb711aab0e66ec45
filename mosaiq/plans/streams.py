"""Streaming queries: each runs a file stream over what is there and returns the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.plans.curation import SQL_SCENES
from mosaiq.plans.registry import query
from mosaiq.streaming import capture


@query("""SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf):
    """Counts per type and window of six hours equal those of a batch."""
    stream = capture.tumbling(capture.read_stream(spark, f"{sf}/events.parquet"), ["event_type"], "ts", "6 hours", "3650 days")
    return capture.run_to_end(stream, "complete", "tumbling").select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("""SELECT event_id FROM (SELECT DISTINCT event_id FROM events)""")
def stream_dedup(spark, sf):
    stream = capture.deduplicated(capture.read_stream(spark, f"{sf}/events.parquet"), "event_id", "ts", "3650 days")
    return capture.run_to_end(stream.select("event_id"), "append", "dedup")


@query(SQL_SCENES)
def stream_scene_filter(spark, sf):
    """Observations kept per user: each differs enough from the last one kept. Files hold events in no order, so all go into one batch."""
    stream = capture.read_stream(spark, f"{sf}/events.parquet", per_trigger=None).select("user_id", "event_id", "value")
    return capture.run_to_end(capture.kept_scenes(stream, "user_id", "event_id", "value", 10.0), "append", "scenes")
