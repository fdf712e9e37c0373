from __future__ import annotations

import __spark_entry__ as entry_points


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.columns == ["id", "name", "type", "best_photo_id", "photo_count", "avg_timestamp", "avg_gps_lat", "avg_gps_lon"] and rows.count() == 880


def test_every_sql_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
