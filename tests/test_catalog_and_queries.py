import datetime as dt

import pytest

from tellal.plans.query import AnalyticsQuery, IncidentQuery, ProvinceGrouping, QueryError, UrlFilters
from tellal.sources.catalog import InvalidCatalog, load_catalog, parse_catalog


def test_the_default_catalog_is_valid_and_ordered():
    assert [e.key for e in load_catalog().event_types] == ["EPIDEMIC", "EARTHQUAKE", "TRAFFIC_ACCIDENT", "FLOOD", "FIRE"]


def test_every_problem_is_listed():
    bad = """
event-types:
- {key: a-b, label: "", keywords: [], metrics: []}
- {key: OTHER, label: x, keywords: [k, k, ""], metrics: [{key: M, label: one, keywords: [w]}, {key: M, label: two, keywords: [w]}]}
- {key: OTHER, label: x, keywords: [k], metrics: [{key: N, label: n, keywords: [w]}]}
"""
    with pytest.raises(InvalidCatalog) as e:
        parse_catalog(bad)
    said = str(e.value)
    for part in ("not of the form", "label is blank", "no keywords", "no metrics", "reserved", "k is repeated", "keyword is blank", "metric M is repeated", "another label", "event type OTHER is repeated"):
        assert part in said


@pytest.mark.parametrize("text", ["", "event-types: []", "[1", "x: 1"])
def test_no_catalog(text):
    with pytest.raises(InvalidCatalog):
        parse_catalog(text)


def test_missing_file():
    with pytest.raises(InvalidCatalog):
        load_catalog("/nowhere/catalog.yml")


def test_filters_are_checked():
    with pytest.raises(QueryError) as e:
        AnalyticsQuery(date_from=dt.date(2024, 2, 1), date_to=dt.date(2024, 1, 1))
    assert e.value.code == "query.date-range.invalid"
    assert IncidentQuery(keyword="  ", raw_report_id=" a ").keyword is None
    assert ProvinceGrouping.parse(" Province ") is ProvinceGrouping.PROVINCE and ProvinceGrouping.parse("") is ProvinceGrouping.NONE
    with pytest.raises(QueryError):
        ProvinceGrouping.parse("city")


def test_url_filters_leave_out_what_cannot_be_read():
    f = UrlFilters.parse({"province": ["41", "x", "16", "16"], "from": "2024-13-01", "to": "2024-01-02", "page": "3", "sort": "date-asc", "eventType": "FIRE"})
    assert f.query == AnalyticsQuery(("FIRE",), (16, 41), None, dt.date(2024, 1, 2)) and f.page.number == 2 and f.page.sort[0] == ("occurred_on", True)
    assert UrlFilters.parse({"page": "0"}).page.number == 0
