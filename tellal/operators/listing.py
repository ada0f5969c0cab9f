"""Paged listings: the page's records first, then what belongs to them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.query import IncidentQuery, NotFound, Page, QueryError
from ..sources.star import Star
from .filters import selected


def sorted_page(rows: DataFrame, page: Page) -> DataFrame:
    """The rows of a page; a top-k, not a sort of everything. Far pages are better asked for by ``after``."""
    unknown = [c for c, _ in page.sort if c not in rows.columns]
    if unknown:
        raise QueryError("query.sort.unknown", f"no such column to sort by: {', '.join(unknown)}")
    return rows.orderBy(*_order(page)).offset(page.number * page.size).limit(page.size)


def _order(page: Page) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in page.sort]


def after(rows: DataFrame, last: Mapping[str, Any], page: Page = Page()) -> DataFrame:
    """The page that follows the row ``last`` (a value for each sort column, none null): a filter and a
    top-k of one page, however far down it is."""
    beyond, equal = F.lit(False), F.lit(True)
    for c, up in page.sort:
        value = F.lit(last[c])
        further = (F.col(c) > value) if up else (F.col(c) < value)
        beyond = beyond | (equal & (further | F.col(c).isNull()))
        equal = equal & (F.col(c) == value)
    return sorted_page(rows.where(beyond), Page(0, page.size, page.sort))


def page_totals(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total_elements")).withColumn("total_pages", F.ceil(F.col("total_elements") / size).cast("long"))


def with_totals(rows: DataFrame, page: Page) -> DataFrame:
    """A page's rows with the totals of all rows beside each; no rows, no totals."""
    every = rows.agg(F.count("*")).scalar()
    return sorted_page(rows, page).withColumn("total_elements", every).withColumn("total_pages", F.ceil(F.col("total_elements") / page.size).cast("long"))


def detailed(rows: DataFrame, star: Star) -> DataFrame:
    """Records with province name, shared provinces by code, metrics by type and evidence in place order."""
    own = rows.select("id")

    def gathered(child: DataFrame, value: str, name: str) -> DataFrame:
        few = child.join(own, child["incident_id"] == own["id"], "left_semi")
        return few.groupBy(F.col("incident_id").alias("id")).agg(F.array_sort(F.collect_list(F.expr(value))).alias(name))

    names = star.province.select(F.col("code").alias("province_code"), F.col("name").alias("province_name"))
    shared = star.shared.join(names, "province_code", "left")
    out = rows.join(names, "province_code", "left")
    for child, value, name in (
        (shared, "struct(province_code as code, province_name as name)", "shared_across"),
        (star.metric, "struct(metric_type, metric_value)", "metrics"),
        (star.keyword, "struct(char_start, char_end, keyword, keyword_role)", "keywords"),
    ):
        out = out.join(gathered(child, value, name), "id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def incidents(star: Star, query: IncidentQuery = IncidentQuery(), page: Page = Page()) -> DataFrame:
    return detailed(sorted_page(selected(star, query), page), star)


def latest_outcome(star: Star, raw_report_id: str) -> DataFrame:
    """What is shown beside the listing of one report; the reason of a failure is not."""
    return star.result.where(F.col("raw_report_id") == raw_report_id).select("raw_report_id", "status", "analyzed_at", "incident_count", "warnings")


def by_id(star: Star, record_id: int) -> DataFrame:
    found = star.incident.where(F.col("id") == record_id)
    if not found.take(1):
        raise NotFound(f"no record {record_id}")
    return detailed(found, star)


def of_report(star: Star) -> DataFrame:
    """Records with the outcome of the report they come from."""
    return star.incident.join(star.result.select("raw_report_id", "status", "incident_count"), "raw_report_id")
