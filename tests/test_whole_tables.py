"""Queries that have to answer for every row of their table."""

import datetime as dt
from urllib.parse import urlparse

from folioflow.plans import analytics


def test_webhook_events_judges_every_page(spark, tmp_path):
    urls = ["https://a.example.org/x", "https://hooks.example.com/x", "HTTP://Hooks.Example.com:8080/", "ftp://hooks.example.com/x", "https://other.net/", "/relative/x", "hooks.example.com/x", "", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")

    def reason(url):
        parsed = urlparse(url or "")
        if parsed.scheme not in ("http", "https") or not parsed.netloc:
            return "not_absolute"
        return None if parsed.hostname == "hooks.example.com" else "host_not_allowed"

    got = {r.page_id: r.reason for r in analytics.webhook_events(spark, str(tmp_path)).collect()}
    assert got == {k: reason(u) for k, u in enumerate(urls)}
    assert set(got.values()) == {None, "not_absolute", "host_not_allowed"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_ocr_cer_of_every_order_key(spark, sf_dir):
    from folioflow.sources.tables import run_sql

    texts = {r.job_id: (r.text, r.predicted) for r in run_sql(spark, sf_dir, analytics.PREDICTED).filter("job_id < 400").collect()}
    got = {r.job_id: r.cer for r in analytics.ocr_cer(spark, sf_dir).filter("job_id < 400").collect()}
    assert got.keys() == texts.keys() and any(k % 12 == 5 for k in got)
    for k, pair in texts.items():
        e, p = (" ".join(x.split()).lower() for x in pair)
        assert abs(got[k] - distance(e, p) / len(e)) < 1e-6


def test_absent_series_takes_the_services_of_the_table(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(1, 1, "click", t0, 1.0), (2, 1, "refund", t0 + dt.timedelta(hours=1), 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.service, r.hour) for r in analytics.absent_series(spark, str(tmp_path)).collect()}
    assert got == {("click", t0 + dt.timedelta(hours=1)), ("refund", t0)}
