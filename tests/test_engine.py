import datetime as dt

import pytest
from pyspark.sql import functions as F

from tellal.engine import Engine
from tellal.operators import analytics
from tellal.plans.query import AnalyticsQuery, NotFound
from tellal.sources.star import from_events, read_snapshot, write_snapshot

DAY = dt.datetime(2020, 6, 15, 22, 30)


def test_from_submission_to_answers(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"))
    texts = ["Bursa'da selde yaralı sayısı 12 olarak açıklandı.", "Ankara'da belediye park çalışmalarını tamamladı.", "Bursa'da selde yaralı sayısı 12 olarak açıklandı."]
    receipts = engine.submit(spark.createDataFrame([(t, DAY) for t in texts], "raw_text string, submitted_at timestamp"), DAY)
    assert receipts.count() == 3 and engine.raw_reports().count() == 2 and engine.raw_reports(1, 1).count() == 1
    # half past ten in the evening, UTC, is the next day in Istanbul
    series = engine.time_series(AnalyticsQuery(("FLOOD",)), "province").collect()
    assert [(str(r.occurred_on), r.province_name, r.value) for r in series] == [("2020-06-16", "Bursa", 12)]
    assert engine.summary().collect()[-1].incident_count == 2
    report = engine.raw_reports().first()
    assert engine.raw_report(report.raw_report_id).count() == 1 and engine.by_digest(report.text_hash).count() == 1
    with pytest.raises(NotFound):
        engine.raw_report("none")
    assert engine.outcomes().count() == 0 and engine.outcomes("ANALYZED").count() == 2
    assert "null" not in "".join(r.payload for r in engine.signals().collect())
    engine.register_views()
    assert spark.sql("select count(*) from incident join incident_metric on id = incident_id").first()[0] == 1
    types, places = engine.metadata()
    assert types.count() == 19 and places.count() == 81
    labels = analytics.labelled(spark.createDataFrame([("FIRE", "TEST"), ("X", "Y")], "event_type string, metric_type string"), types).orderBy("event_type").collect()
    assert [(r.event_label, r.metric_label) for r in labels] == [("Yangın", "Yapılan test"), ("X", "Y")]
    assert engine.incidents().where(F.col("event_type") == "OTHER").first().metrics == []


def test_an_empty_store_still_has_a_total(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "empty"))
    assert [(r.level, r.incident_count) for r in engine.summary().collect()] == [("TOTAL", 0)] and engine.time_series().count() == 0


def test_a_snapshot_answers_the_same_and_reads_only_its_months(spark, tmp_path):
    star = from_events(spark, "/root/testdata/sf0.001")
    write_snapshot(star, str(tmp_path / "snap"))
    again = read_snapshot(spark, str(tmp_path / "snap"))
    query = AnalyticsQuery(("click",), (3, 7), dt.date(2024, 1, 5), dt.date(2024, 1, 20))
    assert sorted(map(tuple, analytics.time_series(star, query).collect())) == sorted(map(tuple, analytics.time_series(again, query).collect()))
    later = analytics.time_series(again, AnalyticsQuery(date_from=dt.date(2024, 2, 1)))
    assert "PartitionFilters: [isnotnull(month" in later._jdf.queryExecution().toString() and later.count() == 0
