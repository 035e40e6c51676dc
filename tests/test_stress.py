"""Every open priced position meets every shock, whether its wallet can be replayed or not."""

import datetime

import pytest

from tideledger.catalog import q_risk
from tideledger.catalog.common import QUERIES
from tideledger.operators.signals import SHOCK_PERCENT

START = datetime.datetime(2024, 1, 2)
NO_BIRTH = (9, 19)  # the binding creates no account whose number ends in 9


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Accounts 8 to 21 with five positions each, their steps in order, and marks of markets 1 to 4."""
    path = str(tmp_path_factory.mktemp("stress"))
    rows = []
    for i, event in enumerate(range(8 * 50, 22 * 50)):
        marks = event % 5 != 4
        rows.append((event, START + datetime.timedelta(minutes=i), event % 7, "view" if marks else "click", 1.0 + event % 90))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.write.parquet(f"{path}/events.parquet")
    return path


def test_every_open_priced_position_meets_every_shock(spark, folder):
    held = q_risk.positions(spark, folder).where("is_open and mark_pns is not null").select("account_id", "perpetual_id").collect()
    rows = QUERIES["J7_position_x_shock"](spark, folder).collect()
    found = [(r.account_id, r.perpetual_id, r.shock_percent) for r in rows]
    assert sorted(found) == sorted((*h, s) for h in held for s in SHOCK_PERCENT)
    assert {r.account_id for r in rows if not r.eligible} == set(NO_BIRTH)
    assert {r.account_id for r in rows} == set(range(8, 22))


def test_the_report_counts_the_eligible_rows(spark, folder):
    rows = [r for r in QUERIES["J7_position_x_shock"](spark, folder).collect() if r.eligible]
    report = {r.shock_percent: (r.positions_evaluated, r.breached) for r in QUERIES["G11_stress_report"](spark, folder).collect()}
    assert report == {
        s: (sum(r.shock_percent == s for r in rows), sum(r.breached for r in rows if r.shock_percent == s)) for s in SHOCK_PERCENT
    }
