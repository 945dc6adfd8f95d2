"""Properties of the sequential operators, which have no SQL."""

import random
from datetime import datetime, timedelta

from barlab.operators.execution import select_non_overlapping


def trades(spark, n=120, cases=2, seed=4):
    r, day = random.Random(seed), datetime(2020, 1, 1)
    rows = []
    for i in range(n):
        start = day + timedelta(days=r.randrange(60))
        rows.append((f"c{i % cases}", f"s{r.randrange(12)}", f"o{i:04d}", "trend", r.choice(["long", "short"]), r.choice(["a", "b"]), 0.05, start, start + timedelta(days=r.randrange(0, 9))))
    return spark.createDataFrame(rows, "case_id string, stock_code string, order_id string, strategy_name string, side string, sector string, risk_fraction double, entry_date timestamp_ntz, exit_date timestamp_ntz")


def test_gate_is_greedy_by_entry(spark):
    got = select_non_overlapping(trades(spark), ["case_id"], sequence="order_id").toPandas().sort_values(["case_id", "entry_date", "order_id"])
    for _, g in got.groupby("case_id"):
        until = None
        for t in g.itertuples():
            free = until is None or t.entry_date > until
            assert (t.status == "accepted") == free
            until = t.exit_date if free else until
