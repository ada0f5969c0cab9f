import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tellal.operators import analytics, highlight, listing, signals
from tellal.plans.query import AnalyticsQuery, IncidentQuery, NotFound, Page, ProvinceGrouping
from tellal.sources.store import Store, validated
from tellal.streaming import ingest, refresh

TEXTS = [
    "20.04.2020 tarihinde Ankara'da 15 yeni vaka tespit edildi.",
    "21.04.2020 tarihinde Ankara'da 5 yeni vaka tespit edildi.",
    "20.04.2020 tarihinde Bursa'da 8, Kocaeli'nde 6 trafik kazası meydana geldi. Bursa'da 1, Kocaeli'nde ise 2 kişi kazalarda hayatını kaybetti. "
    "Her iki ilde toplam 10 kişi yaralı olarak hastaneye kaldırıldı.",
]
EARLY, LATE = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    (folder / "in").mkdir()
    lines = [*TEXTS, TEXTS[0], "  ", "x" * 10_001]
    (folder / "in" / "a.json").write_text("".join(json.dumps({"raw_text": t, "submitted_at": "2020-06-15T10:00:00.123456Z"}) + "\n" for t in lines))
    s = Store(spark, str(folder / "store"))
    ingest.ingest(ingest.submissions(spark, str(folder / "in")), s, str(folder / "cp"), clock=lambda: EARLY).awaitTermination()
    return s


def test_what_the_stream_stored(store):
    assert store.read("raw_report").count() == 3 and store.read("signal").count() == 3
    assert [r.n for r in store.star().violations().collect()] == [0, 0, 0, 0]
    assert store.unanalysed().count() == 0


def test_what_the_stream_refused(store):
    refused = store.read("refused").collect()
    assert sorted((r.error_code, len(r.raw_text), r.detail) for r in refused) == [("report.text.blank", 2, None), ("report.text.too-long", 10_001, None)]
    assert all(r.refused_at == EARLY for r in refused)


LINES = {
    '{"raw_text": "a", "submitted_at": "2020-01-01T00:00:00Z"}': ("a", None), '{"raw_text": "a", "submitted_at": null, "bogus": 1}': (None, "unknown field: bogus"),
    '{"Raw_Text": "a", "x": 1}': (None, "unknown field: Raw_Text, x"), '{"raw_text": 5}': (None, "wrong type: raw_text"), '{"raw_text": {"a": 1}}': (None, "wrong type: raw_text"),
    '{"raw_text": "a", "submitted_at": "later"}': (None, "wrong type: submitted_at"), '{"raw_text": "a", "submitted_at": 17}': (None, "wrong type: submitted_at"),
    '{"raw_text": "a"': (None, "not a JSON object"), '["a"]': (None, "not a JSON object"), "null": (None, "not a JSON object"), '{"raw_text": "a", "raw_text": "b"}': (None, "not a JSON object"),
    "{}": (None, None), '{"raw_text": null}': (None, None), '{"raw_text": "5"}': ("5", None), f'{{"raw_text": "{"ş" * 200_000}"}}': ("ş" * 200_000, None),
}


def test_lines_are_read_strictly(spark):
    rows = spark.createDataFrame([(line, 7) for line in [*LINES, "", " \t", None]], "value string, raw_text int")
    read = {r.line: r for r in ingest.read_lines(rows).collect()}
    assert {k: (r.raw_text, r.detail) for k, r in read.items()} == LINES
    assert all((r.error_code == ingest.UNREADABLE) == (r.detail is not None) and (r.submitted_at is None) == (r.detail is not None) for r in read.values())
    assert not ingest.read_lines(rows.limit(0)).collect()


def test_a_bad_line_stops_nothing_and_a_batch_run_again_refuses_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(['{"raw_text": "iyi"}', '{"raw_text": "iyi"', '{"raw_text": "iyi", "bogus": 1}', '{"raw_text": " "}']))
    own = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest.ingest(ingest.submissions(spark, str(tmp_path / "in")), own, str(tmp_path / "cp"), clock=lambda: EARLY).awaitTermination()
        # the batch was done but not committed when the process died
        (tmp_path / "cp" / "commits" / "0").unlink()
        for crc in (tmp_path / "cp" / "commits").glob(".*.crc"):
            crc.unlink()
    assert own.read("raw_report").count() == 1 and own.read("signal").count() == 1
    assert sorted((r.error_code, r.detail or "") for r in own.read("refused").collect()) == [("report.text.blank", ""), (ingest.UNREADABLE, "not a JSON object"), (ingest.UNREADABLE, "unknown field: bogus")]


def test_series_and_summary(store):
    star = store.star()
    rows = analytics.in_order(analytics.time_series(star, AnalyticsQuery(("TRAFFIC_ACCIDENT",)), ProvinceGrouping.PROVINCE)).collect()
    assert [(r.metric_type, r.province_code, r.value) for r in rows] == [("ACCIDENT_COUNT", 16, 8), ("ACCIDENT_COUNT", 41, 6), ("DEATH", 16, 1), ("DEATH", 41, 2), ("INJURED", None, 10)]
    running = analytics.time_series(star, AnalyticsQuery(("EPIDEMIC",)), cumulative=True).orderBy("occurred_on").collect()
    assert [r.value for r in running] == [15, 20]
    summary = analytics.summary_in_order(analytics.summary(star)).collect()
    assert (summary[-1].level, summary[-1].incident_count, summary[-1].metrics) == ("TOTAL", 5, {"ACCIDENT_COUNT": 14, "DEATH": 3, "INJURED": 10, "NEW_CASE": 20})
    order = store.spark.createDataFrame([("TRAFFIC_ACCIDENT", "INJURED", 0), ("TRAFFIC_ACCIDENT", "DEATH", 1)], "event_type string, metric_type string, metric_ord int")
    block = analytics.summary_blocks(analytics.summary(star), order).where("event_type = 'TRAFFIC_ACCIDENT'").first()
    assert block["columns"] == ["INJURED", "DEATH", "ACCIDENT_COUNT"] and block["metrics"]["INJURED"] == 10 and len(block["rows"]) == 3
    assert analytics.total_metric_keys(analytics.summary(star)).first()[0] == ["ACCIDENT_COUNT", "DEATH", "INJURED", "NEW_CASE"]


def test_listing(store):
    star = store.star()
    assert listing.incidents(star, IncidentQuery(keyword="TRAFİK")).count() == 3
    assert listing.incidents(star, IncidentQuery(provinces=(16,))).count() == 2
    page = listing.incidents(star, page=Page(1, 3)).collect()
    assert len(page) == 2
    with pytest.raises(NotFound):
        listing.by_id(star, -1)


def test_submitting_again_gives_the_stored_report(store, spark):
    again = spark.createDataFrame([(TEXTS[0], EARLY), (None, EARLY), ("yeni metin", EARLY)], "raw_text string, submitted_at timestamp")
    receipts = {r.raw_text: r for r in store.submit(again).collect()}
    assert not receipts[TEXTS[0]].newly_stored and receipts["yeni metin"].newly_stored and receipts[None].error_code == "report.text.blank"
    assert receipts[TEXTS[0]].submitted_at == dt.datetime(2020, 6, 15, 10, 0, 0, 123000)


def test_equal_texts_of_one_batch_have_one_new_receipt_and_a_batch_reads_its_own_folders(spark, tmp_path, monkeypatch):
    own = Store(spark, str(tmp_path / "s"))
    schema = "raw_text string, submitted_at timestamp"
    texts = [f"metin {k}" for k in range(60)]
    first = own.submit(spark.createDataFrame([(t, LATE) for t in texts] + [(t, EARLY) for t in texts[:5]] * 3, schema)).collect()
    assert len(first) == 75 and sum(r.newly_stored for r in first) == 60
    assert all(r.submitted_at == (EARLY if texts.index(r.raw_text) < 5 else LATE) for r in first)
    assert own.read("raw_report").count() == 60 and len(own.pending()) == 1 and own.unanalysed().count() == 60
    read = []
    monkeypatch.setattr(Store, "_raw", lambda self, *paths, raw=Store._raw: (read.append(len([p for p in paths if self._files(p)])), raw(self, *paths))[1])
    again = own.submit(spark.createDataFrame([(texts[0], EARLY), ("yeni", EARLY), ("yeni", EARLY), ("yeni", LATE)], schema)).collect()
    assert sorted((r.raw_text, r.newly_stored) for r in again) == [(texts[0], False), ("yeni", False), ("yeni", False), ("yeni", True)]
    assert max(read) <= 2 and own.read("raw_report").count() == 61


def test_a_broken_off_analysis_is_taken_up_and_finished_reports_are_left(spark, tmp_path):
    folder = str(tmp_path / "s")
    began = Store(spark, folder)
    began.submit(spark.createDataFrame([(t, EARLY) for t in TEXTS], "raw_text string, submitted_at timestamp")).collect()
    # of three reports one had its outcome written when the process died
    done = began.read("raw_report").first().raw_report_id
    began.analyse(began.read("raw_report").where(F.col("raw_report_id") == done), EARLY)
    later = Store(spark, folder)
    assert len(later.pending()) == 1 and later.unanalysed().count() == 2
    later.analyse_pending(LATE)
    assert not later.pending() and later.unanalysed().count() == 0 and later.read("analysis_result").count() == 3 and later.read("signal").count() == 3
    later.analyse_pending(LATE)
    assert later.read("analysis_result").count() == 3


@pytest.mark.parametrize("broken", ["signal", "analysis_result"])
def test_every_report_is_announced_once_wherever_the_process_ends(spark, tmp_path, monkeypatch, broken):
    folder = str(tmp_path / "s")
    began = Store(spark, folder)
    began.submit(spark.createDataFrame([(t, EARLY) for t in TEXTS], "raw_text string, submitted_at timestamp")).collect()

    def append(self, table, rows, name=None, own=Store.append):
        if table == broken:
            raise RuntimeError("the process ends")
        return own(self, table, rows, name)

    with monkeypatch.context() as m:
        m.setattr(Store, "append", append)
        with pytest.raises(RuntimeError):
            began.analyse_pending(EARLY)
    for _ in range(2):
        Store(spark, folder).analyse_pending(LATE)
    later = Store(spark, folder)
    assert not later.pending() and later.read("analysis_result").count() == 3
    told = later.read("signal").collect()
    assert len(told) == 3 and {r.raw_report_id for r in told} == {r.raw_report_id for r in later.read("raw_report").collect()}
    assert {r.run_ts for r in told} == {EARLY if broken == "signal" else LATE}
    # what is announced late is what the records say
    rows = {r.raw_report_id: r.incidents for r in signals.signals(later.star()).collect()}
    assert all([x.asDict() for x in r.incidents] == [x.asDict() for x in rows[r.raw_report_id]] for r in told)


def test_one_report_that_fails_does_not_stop_the_others_and_sums_beyond_an_int_are_kept(spark, tmp_path):
    own = Store(spark, str(tmp_path / "s"))
    large = "Ankara'da 2.000.000.000 yeni vaka tespit edildi. Ankara'da 2.000.000.000 yeni vaka tespit edildi."
    reports = spark.createDataFrame([("a", None, "h", EARLY), ("b", large, "h", EARLY), ("c", "Hiçbir şey yok.", "h", EARLY)], "raw_report_id string, raw_text string, text_hash string, submitted_at timestamp")
    own.analyse(reports, EARLY)
    out = {r.raw_report_id: r for r in own.star().result.collect()}
    assert {k: r.status for k, r in out.items()} == {"a": "FAILED", "b": "ANALYZED", "c": "ANALYZED"}
    assert out["a"].failure_reason == "ValueError: text must not be null" and out["a"].warnings == [] and len(out["c"].warnings) == 2
    assert [r.metric_value for r in own.star().metric.collect()] == [4_000_000_000]
    assert sorted(r.raw_report_id for r in own.read("signal").collect()) == ["b", "c"]


def plain_refreshes(times, window):
    """Refreshes of one view by walking its signals: (at, signals covered, waited)."""
    out, pending = [], None
    for t in sorted(times):
        if pending and t > pending[0]:
            out.append(tuple(pending))
            pending = None
        if pending:
            pending[1] += 1
        elif not out or t >= out[-1][0] + window:
            out.append((t, 1, False)) if not out or t > out[-1][0] else None
        elif t == out[-1][0]:
            out[-1] = (t, out[-1][1] + 1, out[-1][2])
        else:
            pending = [out[-1][0] + window, 1, True]
    return out + ([tuple(pending)] if pending else [])


def test_ten_signals_are_two_refreshes_and_a_replay_in_pieces_gives_the_same(spark, tmp_path):
    import random

    draw = random.Random(5)
    times = {"burst": [50_000 + 10 * k for k in range(10)], "trickle": [700 * k for k in range(60)], "twice": [1000, 1000, 1000, 2000, 2000, 2001, 3000]}
    times["any"] = [draw.randrange(120_000) for _ in range(150)]
    times = {v: [t + 1 for t in ts] for v, ts in times.items()}
    signals = sorted((t, v) for v, ts in times.items() for t in ts)
    # a piece begins where time goes on: what is as old as the watermark is late
    cuts, folder = [0, *(next(c for c in range(k, len(signals)) if signals[c][0] > signals[c - 1][0]) for k in (40, 130)), len(signals)], tmp_path / "in"
    folder.mkdir()
    schema = "view string, at timestamp, n_signals int"
    parts = [[*((v, t) for t, v in signals[a:b]), (None, 5), ("none", None)] for a, b in zip(cuts, cuts[1:])] + [[("last", 10_000_000)]]
    told = refresh.refreshes(spark.readStream.schema(schema).parquet(str(folder)), "1 second", "0 seconds")
    for k, part in enumerate(parts):
        rows = spark.createDataFrame([(v, t) for v, t in part], "view string, ms long").select("view", F.timestamp_millis("ms").alias("at"), F.lit(9).alias("n_signals"))
        rows.coalesce(1).write.mode("append").parquet(str(folder))
        # started anew for each piece, so the state comes from the checkpoint
        refresh.start(told, lambda rows, k: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/{k}"), str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    shown = spark.read.parquet(f"{tmp_path}/out/*").where("view <> 'last'").select("view", F.unix_millis("refreshed_at").alias("at"), "n_signals", "waited").collect()
    assert sorted((r.view, r["at"], r.n_signals, r.waited) for r in shown) == sorted((v, *x) for v, ts in times.items() for x in plain_refreshes(ts, 1000))
    assert len([r for r in shown if r.view == "burst"]) == 2 and sum(r.n_signals for r in shown) == len(signals)


def test_live_refreshes_come_at_once_and_then_together(spark, tmp_path):
    """The first signal is shown at once, a burst that follows by one refresh at the window's end."""
    import time

    row = spark.createDataFrame([("r", EARLY, [])], "raw_report_id string, run_ts timestamp, incidents array<struct<id:bigint,occurred_on:date,event_type:string,province_codes:array<smallint>>>").coalesce(1)
    (tmp_path / "signal").mkdir()
    stale = refresh.stale_views(ingest.signal_stream(spark, Store(spark, str(tmp_path))), {"all": AnalyticsQuery(), "floods": AnalyticsQuery(("FLOOD",))})
    shown = []
    query = refresh.start(refresh.refreshes(stale, "15 seconds"), lambda rows, _: shown.extend(rows.collect()), str(tmp_path / "cp"))
    try:
        for k in range(5):
            row.write.mode("append").parquet(str(tmp_path / "signal"))
            deadline = time.time() + 60
            while k == 0 and not shown and time.time() < deadline:
                time.sleep(0.1)
        deadline = time.time() + 60
        while sum(r.n_signals for r in shown) < 5 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    assert [(r.view, r.n_signals, r.waited) for r in shown] == [("all", 1, False), ("all", 4, True)]
    assert shown[1].refreshed_at - shown[0].refreshed_at == dt.timedelta(seconds=15)


def test_a_rerun_replaces_and_a_failed_one_does_not(store):
    star = store.star()
    report = star.incident.where("event_type = 'EPIDEMIC'").first().raw_report_id
    before = {r.id for r in star.incident.where(F.col("raw_report_id") == report).collect()}
    store.reprocess([report], LATE)
    after = {r.id for r in store.star().incident.where(F.col("raw_report_id") == report).collect()}
    assert len(after) == len(before) and not after & before
    # only province 34 is known now: the run fails, the records stay, the outcome shows the failure
    store.reprocess([report], LATE + dt.timedelta(days=1), provinces={34: "İstanbul"})
    store.append("analysis_result", store.spark.createDataFrame([(report, LATE + dt.timedelta(days=2), "FAILED", LATE, 0, "ValueError: boom", [])], "raw_report_id string, run_ts timestamp, status string, analyzed_at timestamp, incident_count int, failure_reason string, warnings array<string>"))
    star = store.star()
    assert star.incident.where(F.col("raw_report_id") == report).count() == 1
    assert star.result.where(F.col("raw_report_id") == report).first().status == "FAILED"


def test_signals_matter_or_not(spark):
    rows = spark.sql("select 'r' as raw_report_id, array(named_struct('id', 1L, 'occurred_on', date '2024-01-05', 'event_type', 'FIRE', 'province_codes', array(16S))) as incidents")

    def matters(query, shown=()):
        return rows.select(signals.matters(F.struct("raw_report_id", "incidents"), query, list(shown))).first()[0]

    assert matters(AnalyticsQuery()) and matters(AnalyticsQuery(("FLOOD",), keyword="x")) and matters(AnalyticsQuery(("FIRE",), (16,)))
    assert not matters(AnalyticsQuery(("FLOOD",))) and not matters(AnalyticsQuery(provinces=(6,))) and matters(AnalyticsQuery(("FLOOD",)), ["r"])
    broken = spark.sql("select '{' as payload").select(signals.from_json("payload").alias("s"))
    assert broken.select(signals.matters(F.col("s"), AnalyticsQuery(("FLOOD",)))).first()[0]


def test_pieces_make_up_the_text(spark):
    rows = spark.sql("select 1L as id, 'abc def' as raw_text, array(named_struct('role', 'DATE', 'char_start', 0, 'char_end', 3), named_struct('role', 'DATE', 'char_start', 3, 'char_end', 5), named_struct('role', 'X', 'char_start', 5, 'char_end', 5)) as keywords union all select 2L, 'xy', array() union all select 3L, '🙂 kaza 🙂', array(named_struct('role', 'M', 'char_start', 3, 'char_end', 7))")
    out = highlight.segments(rows).orderBy("id", "begin").collect()
    assert [(r.id, r.text, r.roles) for r in out] == [(1, "abc d", ["DATE"]), (1, "ef", []), (2, "xy", []), (3, "🙂 ", []), (3, "kaza", ["M"]), (3, " 🙂", [])]


def test_texts_are_validated_by_their_utf16_units_and_lines_without_rewriting_them(spark):
    texts = ["", " \t\u00a0\u2003\x1c", "\u200b", " a", "x" * 10, "x" * 11, "ş" * 10, "ş" * 11, "\U0001F600" * 5, "\U0001F600" * 5 + "x", None]
    rows = validated(spark.createDataFrame([(t,) for t in texts], "raw_text string"), 10)
    codes = ["report.text.blank"] * 2 + [None] * 3 + ["report.text.too-long", None, "report.text.too-long", None, "report.text.too-long", "report.text.blank"]
    assert [r.error_code for r in rows.collect()] == codes
    # a whole text is written anew only where its units must be counted
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 1
    lines = spark.createDataFrame([(x,) for x in ("", " \x00\x1f\t", None, "\u00a0")], "value string")
    read = ingest.read_lines(lines)
    assert [r.line for r in read.collect()] == ["\u00a0"] and "regexp_replace" not in read._jdf.queryExecution().optimizedPlan().toString()
