"""The five filters that listings and analytics share; each record is kept at most once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import turkish
from ..plans.query import AnalyticsQuery
from ..sources.star import Star


def selected(star: Star, query: AnalyticsQuery) -> DataFrame:
    """The star's records that a query asks for. Absent filters add nothing to the plan."""
    rows = star.incident
    if getattr(query, "raw_report_id", None):
        rows = rows.where(F.col("raw_report_id") == query.raw_report_id)
    if query.event_types:
        rows = rows.where(F.col("event_type").isin(*query.event_types))
    by_month = "month" in rows.columns
    if query.date_from:
        rows = rows.where(F.col("occurred_on") >= F.lit(query.date_from))
        rows = rows.where(F.col("month") >= F.lit(query.date_from.replace(day=1))) if by_month else rows
    if query.date_to:
        rows = rows.where(F.col("occurred_on") <= F.lit(query.date_to))
        rows = rows.where(F.col("month") <= F.lit(query.date_to)) if by_month else rows
    if query.provinces:
        codes = ", ".join(f"{int(p)}S" for p in query.provinces)
        rows = rows.sparkSession.sql(
            f"SELECT * FROM {{i}} AS i WHERE province_code IN ({codes}) OR EXISTS (SELECT 1 FROM {{s}} AS s WHERE s.incident_id = i.id AND s.province_code IN ({codes}))", i=rows, s=star.shared
        )
    if query.keyword:
        # % and _ stay wildcards; a backslash stands for itself
        pattern = "%" + query.keyword.replace("İ", "i").replace("I", "ı").lower().replace("\\", "\\\\") + "%"
        hits = star.keyword.where(turkish.lower("keyword").like(pattern)).select(F.col("incident_id").alias("id"))
        rows = rows.join(hits, "id", "left_semi")
    return rows
