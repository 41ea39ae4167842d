"""Alert states over one order of each series, and quotients of series without a copy in the driver."""

import datetime as dt
import random

import pytest

from folioflow.operators import ops
from folioflow.plans import monitoring

T0 = dt.datetime(2026, 1, 1)


def plain(rows, hold, gap):
    """rows: at, bad, in order of at; samples of one time count as one for breaks."""
    out, since, last = [], None, None
    for at in sorted({a for a, _ in rows}):
        own = [bad for a, bad in rows if a == at]
        if not all(own) or (gap is not None and last is not None and at - last > gap):
            since = None
        since = at if since is None and any(own) else since
        out += [(at, bad, "inactive" if not bad else "firing" if at - since >= hold else "pending") for bad in own]
        last = at
    return sorted(out)


@pytest.mark.parametrize("gap", [None, 90])
def test_states_against_a_plain_fold(spark, gap):
    rng = random.Random(4)
    of = {k: sorted((60 * rng.randrange(60), rng.random() < 0.8) for _ in range(40)) for k in range(6)}
    of = {k: v if gap is None else [x for n, x in enumerate(v) if n == 0 or v[n - 1][0] != x[0]] for k, v in of.items()}
    t = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=at), bad) for k, v in of.items() for at, bad in v], "k int, ts timestamp, bad boolean")
    got = ops.firing(t, 180, ["k"], gap).collect()
    for k, v in of.items():
        assert sorted((int((r.ts - T0).total_seconds()), r.bad, r.state) for r in got if r.k == k) == plain(v, 180, gap)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_series_is_sent_to_the_driver(spark, sf_dir):
    assert "Broadcast" not in plan(monitoring.QUERIES["alert_disk_space_low"](spark, sf_dir))


def test_a_series_is_sorted_once(spark, sf_dir):
    p = plan(monitoring.QUERIES["alert_service_down"](spark, sf_dir))
    assert p.count(" Sort [") == 1 and p.count("Exchange hashpartitioning(instance") == 1
