"""Streaming extensions over events."""

from __future__ import annotations

from boardsift.catalog import query
from boardsift.streaming import windows


@query("extension", "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    return windows.drained(windows.tumbling(windows.events(spark, sf_dir)), "complete")


@query("extension", "SELECT DISTINCT event_id, user_id FROM events")
def stream_distinct(spark, sf_dir):
    return windows.drained(windows.distinct(windows.events(spark, sf_dir)), "append")
