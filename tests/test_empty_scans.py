"""Cosines of scans that show nothing."""

from __future__ import annotations

import pytest

from tidewell.operators import features


def test_scans_that_show_nothing(spark):
    rows = [(1, 0, 2.0, 4.0, 0.0), (1, 1, 1.0, 4.0, 9.0), (2, 0, 1.0, 4.0, 0.0), (3, 0, 0.0, 4.0, 1.0)]
    matches = spark.createDataFrame(rows, "k long, scan long, weight double, expected double, observed double")
    totals = spark.createDataFrame([(k, 4.0) for k in (1, 2, 3)], "k long, total double")
    cosines = lambda **empty: {r.k: r.cosine for r in features.elution_cosine(matches, totals, ["k"], "scan", "weight", "expected", "observed", "total", **empty).collect()}
    assert cosines() == {1: pytest.approx(0.2), 2: 0.0}
    assert cosines(empty=1.0) == {1: pytest.approx(1.0), 2: 1.0}


def test_query_of_times_without_value(spark, tmp_path):
    import duckdb

    from tidewell import plans

    con, out = duckdb.connect(), str(tmp_path / "events.parquet")
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(i::INT) AS ts, i % 3 AS user_id, ['a', 'b'][(i % 2 + 1)::INT] AS event_type,
      CASE WHEN i % 7 = 0 THEN 0.0 ELSE i % 5 + 0.5 END AS value FROM range(60) t(i)) TO '{out}' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS FROM '{out}'")
    got = {r.user_id: r.cosine for r in plans.QUERIES["score_elution_cosine"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(dict(con.execute(plans.ORACLE_SQL["score_elution_cosine"]).fetchall()), abs=2e-6)
