"""What a caller may ask: validated filters, groupings and pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum


class QueryError(ValueError):
    """A request that cannot be answered; ``code`` is stable."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class NotFound(LookupError):
    code = "resource.not-found"


class ProvinceGrouping(Enum):
    NONE = "none"
    PROVINCE = "province"

    @classmethod
    def parse(cls, text: str | None) -> ProvinceGrouping:
        word = (text or "").strip().lower() or "none"
        try:
            return cls(word)
        except ValueError:
            raise QueryError("analytics.group-by.unknown", f"unknown grouping: {text}") from None


def _present(text: str | None) -> str | None:
    return (text or "").strip() or None


@dataclass(frozen=True)
class AnalyticsQuery:
    event_types: tuple[str, ...] = ()
    provinces: tuple[int, ...] = ()
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    keyword: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "event_types", tuple(self.event_types or ()))
        object.__setattr__(self, "provinces", tuple(int(p) for p in self.provinces or ()))
        object.__setattr__(self, "keyword", _present(self.keyword))
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise QueryError("query.date-range.invalid", f"{self.date_from} is after {self.date_to}")


@dataclass(frozen=True)
class IncidentQuery(AnalyticsQuery):
    raw_report_id: str | None = None

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "raw_report_id", _present(self.raw_report_id))


@dataclass(frozen=True)
class Page:
    number: int = 0
    size: int = 20
    sort: tuple[tuple[str, bool], ...] = (("occurred_on", False), ("id", False))  # column, ascending


SORTS = {"date-desc": (("occurred_on", False), ("id", False)), "date-asc": (("occurred_on", True), ("id", True))}


@dataclass(frozen=True)
class UrlFilters:
    """Filters as a URL holds them; what cannot be read is left out."""

    query: AnalyticsQuery = field(default_factory=AnalyticsQuery)
    page: Page = field(default_factory=Page)

    @classmethod
    def parse(cls, params: Mapping[str, Sequence[str] | str]) -> UrlFilters:
        def many(name: str) -> list[str]:
            v = params.get(name, [])
            return [v] if isinstance(v, str) else list(v)

        def one(name: str) -> str:
            return next(iter(many(name)), "").strip()

        def day(name: str) -> dt.date | None:
            try:
                return dt.date.fromisoformat(one(name))
            except ValueError:
                return None

        codes = sorted({int(x) for x in many("province") if x.strip().isdigit()})
        shown = int(one("page")) if one("page").isdigit() and int(one("page")) > 0 else 1
        query = AnalyticsQuery(tuple(sorted({x.strip() for x in many("eventType")} - {""})), tuple(codes), day("from"), day("to"), one("keyword"))
        return cls(query, Page(shown - 1, sort=SORTS.get(one("sort"), SORTS["date-desc"])))


@dataclass(frozen=True)
class ChartOptions:
    """What a chart draws of the selected records, as a URL holds it; it narrows no filter and no total."""

    KEYS = ("chart", "metric", "breakdown", "cumulative")
    event_type: str | None = None
    metric: str | None = None
    by_province: bool = False
    cumulative: bool = False

    @classmethod
    def parse(cls, params: Mapping[str, str]) -> ChartOptions:
        return cls(_present(params.get("chart")), _present(params.get("metric")), params.get("breakdown") == "province", params.get("cumulative") == "true")

    def written(self, params: Mapping[str, str]) -> dict[str, str]:
        """The parameters with the chart's own keys written anew, defaults left out, and all others as they are."""
        own = {"chart": self.event_type, "metric": self.metric, "breakdown": "province" if self.by_province else None, "cumulative": "true" if self.cumulative else None}
        return {k: v for k, v in params.items() if k not in self.KEYS} | {k: v for k, v in own.items() if v}

    def drawn_type(self, filtered: Sequence[str], catalog: Sequence[str]) -> str | None:
        """The chosen type if the filters (or, without any, the catalog) allow it, else the first allowed one."""
        return _chosen(self.event_type, filtered or catalog)

    def drawn_metric(self, available: Sequence[str]) -> str | None:
        """The metric compared across provinces: the chosen one if the type has it, else its first."""
        return _chosen(self.metric, available)

    def grouping(self) -> ProvinceGrouping:
        return ProvinceGrouping.PROVINCE if self.by_province else ProvinceGrouping.NONE


def _chosen(wanted: str | None, allowed: Sequence[str]) -> str | None:
    return wanted if wanted in allowed else next(iter(allowed), None)
