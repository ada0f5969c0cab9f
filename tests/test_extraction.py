"""How the extraction runs: what it holds at once, and what Spark makes of its expressions."""

import datetime as dt
import gc
import re

import pyarrow as pa
import pytest

from tellal.functions.scan import LETTER, SHARED_MARKER, Scanner
from tellal.operators import extraction, highlight
from tellal.plans.notices import dealt
from tellal.sources.catalog import load_catalog
from tellal.sources.reference_data import PROVINCES


def test_records_are_not_computed_twice_by_an_inferred_filter(spark):
    reports = spark.createDataFrame([("1", "Dün Ankara'da 3 kişi yaralandı; kaza sürüyor.", None)], "raw_report_id string, raw_text string, ref_date date")
    found, _ = extraction.extract(reports)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") <= 5
    assert [r["event_type"] for r in found.collect()] == ["TRAFFIC_ACCIDENT"]


def test_long_texts_are_held_in_small_pieces():
    batch = pa.RecordBatch.from_pydict({"raw_text": ["x" * 20_000] * 2000})
    sizes = [p.num_rows for p in extraction.pieces(batch)]
    assert sum(sizes) == 2000 and max(sizes) <= 60
    short = pa.RecordBatch.from_pydict({"raw_text": [None, ""] * 700})
    assert [p.num_rows for p in extraction.pieces(short)] == [500, 500, 400]


def test_absent_texts_and_texts_without_anything(spark):
    rows = spark.createDataFrame([("1", None, None), ("2", "", None), ("3", "3 kişi.", None)], "raw_report_id string, raw_text string, ref_date date")
    found = {r["raw_report_id"]: r for r in extraction.scan(rows).collect()}
    assert found["1"]["hits"] is None and found["1"]["sentences"] is None and found["1"]["failure_reason"]
    assert found["2"]["hits"] == [] and found["2"]["numbers"] == []
    assert [n["value"] for n in found["3"]["numbers"]] == [3]


def test_pieces_of_a_text_are_not_shuffled(spark):
    texts = spark.sql("""select explode(array(
        named_struct('id', 1L, 'raw_text', 'abcdef', 'keywords', array(named_struct('role', 'A', 'char_start', 1, 'char_end', 3), named_struct('role', 'A', 'char_start', 3, 'char_end', 4), named_struct('role', 'B', 'char_start', 5, 'char_end', 6))),
        named_struct('id', 1L, 'raw_text', 'xy', 'keywords', cast(array() as array<struct<role:string,char_start:int,char_end:int>>)),
        named_struct('id', 2L, 'raw_text', '', 'keywords', array(named_struct('role', 'A', 'char_start', 0, 'char_end', 1))))) as r""").select("r.*")
    found = highlight.segments(texts)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r["id"], r["begin"], r["end"], r["text"], ",".join(r["roles"])) for r in found.collect())
    assert rows == [(1, 0, 1, "a", ""), (1, 0, 2, "xy", ""), (1, 1, 4, "bcd", "A"), (1, 4, 5, "e", ""), (1, 5, 6, "f", "B")]


ODD = [
    "Dün Ankara'da 3 kişi yaralandı; kaza sürüyor.", "", None, "9" * 5000 + " kişi öldü", "a.\0b iki\0üç yüz.", "yüz", "bin kişi. Dr.", "Bursa'da", "ilçesinde 5 kişi öldü. Deprem.", "son", "24 saatte kaza", "3", "Mayıs'ta 12",
    "İki ilde  toplam 4 kişi yaralandı. Sel!", "\U0001F600 kaza: 5 ölü", "iki", "ilde",
]


def test_texts_searched_together_are_read_as_alone():
    scanner = Scanner(load_catalog(), dict(enumerate(PROVINCES, 1)))
    alone = [extraction.read_texts(scanner, [t]) for t in ODD]
    values, rows, failures = extraction.read_texts(scanner, ODD)
    assert values.to_pylist() == [v[0].as_py() for v, _, _ in alone] and rows == [r[0] for _, r, _ in alone] and failures == [f[0] for _, _, f in alone]
    assert [k for k, f in enumerate(failures) if f] == [2, 3] and "ValueError" in failures[3]


def test_patterns_go_over_a_piece_at_once(monkeypatch):
    scanner, searched = Scanner(load_catalog(), dict(enumerate(PROVINCES, 1))), []
    for name in ("numbers", "normalise"):
        inner = getattr(extraction, name)
        monkeypatch.setattr(extraction, name, lambda text, name=name, inner=inner: searched.append(name) or inner(text))
    text = " Dün Ankara'da 3 kişi yaralandı; kaza sürüyor. "
    _, rows, _ = extraction.read_texts(scanner, [text] * 300)
    assert searched == ["numbers"] and len(rows) == 300 and all(r == rows[0] for r in rows)
    assert [(h[6], h[7], h[8]) for h in rows[0][2] if h[3] in ("DATE", "PROVINCE")] == [("Dün", 1, 4), ("Ankara'da", 5, 14)]


def test_look_ups_next_to_numbers():
    scanner = Scanner(load_catalog(), dict(enumerate(PROVINCES, 1)))
    text = "Bursa'da 8, Kocaeli'nde 6 trafik kazası. Her iki ilde toplam 10 kişi yaralandı. 7 kişi."
    value, [(sent, num, hits)], _ = extraction.read_texts(scanner, [text])
    types = extraction.ranked_types(hits)
    found = [(x[0], x[1], x[2], x[4], x[5]) for x in extraction.links_of(len(text), sent, num, hits, types)]
    assert types == ["TRAFFIC_ACCIDENT"]
    assert found == [("TRAFFIC_ACCIDENT", False, 16, 8, "ACCIDENT_COUNT"), ("TRAFFIC_ACCIDENT", False, 41, 6, "ACCIDENT_COUNT"), ("TRAFFIC_ACCIDENT", True, None, 10, "INJURED")]


def test_figures_in_dates_that_the_calendar_lacks_are_counts(spark):
    rows = spark.sql("""select * from values ('1', '31 Şubat 2021 kaza. Son 24 saatte 5 ölü, kaza.', date'2024-03-01'), ('2', '3 Mayıs 2021 kaza.', date'2024-03-01'), ('3', 'Son 24 saatte kaza.', null) as t(raw_report_id, raw_text, ref_date)""")
    found, _ = extraction.extract(rows)
    assert {r["raw_report_id"]: [(m["metric_type"], m["metric_value"]) for m in r["metrics"]] for r in found.collect()} == {"1": [("ACCIDENT_COUNT", 2052), ("DEATH", 5)], "2": [], "3": [("ACCIDENT_COUNT", 24)]}


def test_evidence_is_not_made_where_it_is_not_read(spark):
    reports = spark.createDataFrame([("1", "Dün Ankara'da 3 kişi yaralandı; kaza sürüyor.", None)], "raw_report_id string, raw_text string, ref_date date")
    found, _ = extraction.extract(reports)
    assert "keyword" not in found.select("raw_report_id", "metrics")._jdf.queryExecution().optimizedPlan().toString()
    assert len(found.first()["keywords"]) == 3


def test_records_without_evidence_are_the_same(spark):
    rows = [(str(k), t, dt.date(2024, 3, 1)) for k, t in enumerate(ODD)]
    reports = spark.createDataFrame(rows, "raw_report_id string, raw_text string, ref_date date")
    (found, _), (bare, _) = extraction.extract(reports), extraction.extract(reports, evidence=False)
    assert "keywords" not in bare.columns and sorted(map(str, bare.collect())) == sorted(map(str, found.drop("keywords").collect()))


def test_lines_are_dealt_out_as_finely_as_shuffles_are(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert dealt(spark.range(100), "id").rdd.getNumPartitions() == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_markers_are_found_by_their_first_characters():
    texts = ["her iki ilde", "iki ilde", "her 12 ilde", "3 ilde", "12 şehirde", "123 ilde", "x3 ilde", "iller", "şehirlerde", "biller", "altı ildeki", "her iki yolda", "üç  şehirden iller", "٣ ilde", "il", "dört il"]
    plain = re.compile(rf"\b(?:(?:her\s+)?(?:iki|üç|dört|beş|altı|\d{{1,2}})\s+(?:il|şehir){LETTER}*|(?:il|şehir)ler{LETTER}*)\b")
    found = [[m.span() for m in re.finditer(SHARED_MARKER, t)] for t in texts]
    assert found == [[m.span() for m in plain.finditer(t)] for t in texts] and sum(map(bool, found)) == 11


def test_cycles_are_looked_for_again_after_a_piece():
    with pytest.raises(ValueError), extraction.uncollected():
        assert not gc.isenabled()
        raise ValueError
    assert gc.isenabled()
