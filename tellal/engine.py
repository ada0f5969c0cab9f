"""Everything a caller asks of the engine, over one store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analytics, listing, signals
from .operators.filters import selected
from .plans.query import AnalyticsQuery, ChartOptions, IncidentQuery, NotFound, Page, ProvinceGrouping
from .sources.catalog import Catalog, load_catalog
from .sources.reference_data import provinces
from .sources.star import Star, read_snapshot, write_snapshot
from .sources.store import SCHEMAS, Store

NEWEST = (("submitted_at", False), ("raw_report_id", False))


class Engine:
    def __init__(self, spark: SparkSession, path: str, catalog: Catalog | None = None):
        self.spark, self.store, self.catalog = spark, Store(spark, path), catalog or load_catalog()
        self.snapshot: str | None = None

    def submit(self, submissions: DataFrame, run_ts: dt.datetime) -> DataFrame:
        """Stores and analyses texts (raw_text, submitted_at); receipts with newly_stored."""
        receipts = self.store.submit(submissions)
        self.store.analyse_pending(run_ts, catalog=self.catalog)
        return receipts

    def reprocess(self, raw_report_ids: list[str], run_ts: dt.datetime) -> None:
        self.store.reprocess(raw_report_ids, run_ts, catalog=self.catalog)

    def star(self) -> Star:
        """The snapshot if one is in use, else the store as it now reads."""
        return read_snapshot(self.spark, self.snapshot) if self.snapshot else self.store.star()

    def use_snapshot(self, path: str) -> None:
        """Writes the star as it now reads, by month, and answers from it; later runs are not seen."""
        write_snapshot(self.store.star(), path)
        self.snapshot = path

    def raw_reports(self, number: int = 0, size: int = 20) -> DataFrame:
        """Stored reports, newest first, with total_elements and total_pages."""
        return listing.with_totals(self.store.read("raw_report"), Page(number, size, NEWEST))

    def raw_report(self, raw_report_id: str) -> DataFrame:
        found = self.store.read("raw_report").where(F.col("raw_report_id") == raw_report_id)
        if not found.take(1):
            raise NotFound(f"no report {raw_report_id}")
        return found

    def by_digest(self, text_hash: str) -> DataFrame:
        return self.store.reports_of(text_hash)

    def outcomes(self, status: str = "FAILED", number: int = 0, size: int = 20) -> DataFrame:
        """Reports by their latest outcome, with totals: what needs reprocessing."""
        return listing.with_totals(self.star().result.where(F.col("status") == status), Page(number, size, (("analyzed_at", False), ("raw_report_id", True))))

    def incidents(self, query: IncidentQuery = IncidentQuery(), page: Page = Page()) -> DataFrame:
        return listing.incidents(self.star(), query, page)

    def incident_totals(self, query: IncidentQuery = IncidentQuery(), size: int = 20) -> DataFrame:
        return listing.page_totals(selected(self.star(), query), size)

    def incident(self, record_id: int) -> DataFrame:
        return listing.by_id(self.star(), record_id)

    def of_report(self, raw_report_id: str, page: Page = Page()) -> tuple[DataFrame, DataFrame]:
        """A report's records and its latest outcome with warnings; the reason of a failure is not told."""
        star = self.star()
        return listing.incidents(star, IncidentQuery(raw_report_id=raw_report_id), page), listing.latest_outcome(star, raw_report_id)

    def time_series(self, query: AnalyticsQuery = AnalyticsQuery(), group_by: str | None = None, cumulative: bool = False) -> DataFrame:
        return analytics.in_order(analytics.time_series(self.star(), query, ProvinceGrouping.parse(group_by), cumulative))

    def chart(self, options: ChartOptions, query: AnalyticsQuery = AnalyticsQuery()) -> DataFrame:
        """The points that a chart with these options draws."""
        drawn = options.drawn_type(query.event_types, [e.key for e in self.catalog.event_types])
        metrics = [m.key for e in self.catalog.event_types if e.key == drawn for m in e.metrics]
        points = analytics.time_series(self.star(), query, options.grouping(), options.cumulative)
        return analytics.in_order(analytics.chart_lines(points, drawn, options.drawn_metric(metrics)))

    def summary(self, query: AnalyticsQuery = AnalyticsQuery()) -> DataFrame:
        return analytics.summary_in_order(analytics.summary(self.star(), query))

    def metadata(self) -> tuple[DataFrame, DataFrame]:
        """Event types with metrics in catalog order, and provinces by code."""
        return self.catalog.metadata(self.spark), provinces(self.spark).orderBy("code")

    def signals(self) -> DataFrame:
        return signals.as_json(self.store.read("signal").drop("run_ts"))

    def register_views(self) -> None:
        """Temporary views, so that SQL can read the store: raw_report, incident, incident_metric, ..."""
        star = self.star()
        current = {"incident": star.incident, "incident_metric": star.metric, "incident_shared_province": star.shared, "incident_keyword": star.keyword, "analysis_result": star.result, "province": star.province}
        for name in SCHEMAS:
            current.get(name, self.store.read(name)).createOrReplaceTempView(name)
        star.province.createOrReplaceTempView("province")
