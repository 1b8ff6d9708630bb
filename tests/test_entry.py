import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver compares all.
SOME = ["filter_gt", "fillna_interpolate", "resample_first", "asof_nearest", "descriptive_stats", "smoothing_ema", "psd_welch", "alert_window", "sliding_window_agg", "spec_batch"]


def test_entry(spark):
    assert entry.entry(spark).count() >= 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    rel = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    want = sorted(map(str, (tuple(r[cols.index(c)] for c in sorted(cols)) for r in rel.fetchall())))
    assert sorted(cols) == sorted(df.columns) and got == want


def test_asof_nearest_equals_sql_where_times_repeat(spark, tmp_path):
    """Right rows of equal time: the first by id. Left rows of one id stay apart. Distances are in whole milliseconds."""
    con = duckdb.connect()
    con.execute(
        """CREATE VIEW events AS
        SELECT k * 1000 + i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 700) AS ts, 1 AS user_id, CASE WHEN i % 5 = 1 THEN 'purchase' ELSE 'error' END AS event_type, CAST(k * 1000 + i AS DOUBLE) AS value
        FROM range(100) a(i), range(4) b(k)
        UNION ALL SELECT 7, TIMESTAMP '2024-01-01', 1, 'error', 7.5
        UNION ALL SELECT 9000, NULL, 1, 'purchase', 8.5
        UNION ALL SELECT 9001, NULL, 1, 'error', 9.5"""
    )
    con.execute(f"COPY (SELECT * FROM events ORDER BY event_id DESC) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted((r.event_id, r.value, r.r_id is None, r.r_id, r.pressure) for r in entry.queries()["asof_nearest"](spark, str(tmp_path)).collect())
    want = sorted((e, v, i is None, i, p) for e, v, i, p in con.execute(f"SELECT event_id, value, r_id, pressure FROM ({entry.oracle_sql()['asof_nearest']})").fetchall())
    assert got == want
    assert len(got) == 322 and [r[3] for r in got if r[:2] == (3002, 3002.0)] == [1]
