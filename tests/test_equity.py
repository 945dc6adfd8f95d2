"""Drawdowns of compounded curves that lose everything, against the SQL of the run's tables."""

import datetime

import duckdb
import pytest

from barlab.operators.equity import drawdown_episodes, drawdown_statistics
from barlab.operators.experiment import daily_close, dated_curve

SQL = """WITH s AS (SELECT exit_date AS date, row_number() OVER w AS no, product(1 + return_pct / 100) OVER w AS v FROM trades WINDOW w AS (ORDER BY exit_date, order_id ROWS UNBOUNDED PRECEDING)),
cu AS (SELECT date, max_by(v, no) AS value FROM s GROUP BY date), dc AS (SELECT *, max(value) OVER (ORDER BY date) AS peak FROM cu), dd AS (SELECT *, value / peak - 1 AS drawdown FROM dc),
ep AS (SELECT *, sum(CAST(drawdown >= 0 AS INT)) OVER (ORDER BY date) AS e FROM dd), eg AS (SELECT min(drawdown) AS depth, count(*) FILTER (drawdown < 0) AS points, min(date) AS peak_date FROM ep GROUP BY e HAVING min(drawdown) < 0)
SELECT row_number() OVER (ORDER BY depth, peak_date) AS rank, round(depth, 6) AS depth, points FROM eg"""
# returns in percent by date: a short loses over all it had, then gains and losses run the value down to 0
RUNS = {
    "below, then nothing": [[-180.0], [-50.0], [25.0], [-99.0] * 200, [30.0], [10.0]], "nothing on the first date": [[-99.0] * 200, [20.0], [-20.0]],
    "above, then nothing": [[50.0], [-10.0], [80.0], [-99.0] * 200, [5.0]], "a loss of just everything": [[-200.0], [-100.0], [40.0]],
}


@pytest.mark.parametrize("name", RUNS)
def test_episodes_of_a_run_that_loses_everything(spark, name):
    day = datetime.datetime(2020, 1, 1)
    rows = [(f"o{i:02d}-{n:04d}", day + datetime.timedelta(days=i), r) for i, rs in enumerate(RUNS[name]) for n, r in enumerate(rs)]
    trades = spark.createDataFrame(rows, "order_id string, exit_date timestamp_ntz, return_pct double")
    curve = daily_close(dated_curve(trades))
    got = sorted((r["rank"], round(r.depth, 6), r.points) for r in drawdown_episodes(curve).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE trades (order_id VARCHAR, exit_date TIMESTAMP, return_pct DOUBLE)")
    con.executemany("INSERT INTO trades VALUES (?, ?, ?)", rows)
    assert got == sorted(con.execute(SQL).fetchall())
    assert drawdown_statistics(curve).count() == 1
