"""Streams give the same rows in one batch and in many."""

from takeweave.streaming import jobs


def test_distinct_events_in_many_batches(spark, tmp_path):
    for day in (9, 1, 5, 1):
        rows = spark.range(20).selectExpr(f"id + {day} * 100 as event_id", f"timestamp_ntz'2024-01-0{day} 00:00:00' as ts", "id % 3 as user_id", "'x' as event_type", "1.0D as value", "'{}' as props")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = jobs.finished(jobs.distinct_events(jobs.event_stream(spark, str(tmp_path), files_per_trigger=1))).collect()
    assert sorted((r.event_id, r.user_id) for r in got) == [(100 * d + i, i % 3) for d in (1, 5, 9) for i in range(20)]
