"""Signals that a report produced records, and whether they matter to a set of filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.query import AnalyticsQuery
from ..sources.star import Star

SIGNAL = "raw_report_id string, incidents array<struct<id:bigint,occurred_on:date,event_type:string,province_codes:array<smallint>>>"


def signals(star: Star) -> DataFrame:
    """One per analysed report, also when it has no records, none for a failed one. Codes are sorted:
    the record's own, all shared ones, or none."""
    shared = star.shared.groupBy(F.col("incident_id").alias("id")).agg(F.array_sort(F.collect_set("province_code")).alias("shared_codes"))
    codes = F.when(F.col("province_scope") == "SINGLE", F.array("province_code")).when(F.col("province_scope") == "SHARED", F.coalesce("shared_codes", F.array().cast("array<smallint>"))).otherwise(F.array().cast("array<smallint>"))
    each = star.incident.join(shared, "id", "left").select("raw_report_id", F.struct("id", "occurred_on", "event_type", codes.alias("province_codes")).alias("s"))
    grouped = each.groupBy("raw_report_id").agg(F.array_sort(F.collect_list("s")).alias("incidents"))
    analysed = star.result.where("status = 'ANALYZED'").select("raw_report_id", "analyzed_at")
    return analysed.join(grouped, "raw_report_id", "left").withColumn("incidents", F.coalesce("incidents", F.array()))


def as_json(rows: DataFrame) -> DataFrame:
    """The wire form, without nulls."""
    return rows.select("raw_report_id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("payload"))


def from_json(payload: Column | str) -> Column:
    """A signal read back; null if it cannot be read."""
    parsed = F.from_json(payload, SIGNAL, {"mode": "PERMISSIVE"})
    return F.when(parsed["raw_report_id"].isNotNull() & parsed["incidents"].isNotNull(), parsed)


def matters(signal: Column, query: AnalyticsQuery, shown_reports: list[str] = ()) -> Column:
    """Whether a view under these filters should refresh: always if the signal is unreadable, its report
    is on screen, or a keyword or no filter is set; else if a record of it would be listed."""
    if query.keyword or not (query.event_types or query.provinces or query.date_from or query.date_to):
        return F.lit(True)

    def listed(x: Column) -> Column:
        ok = F.lit(True)
        if query.event_types:
            ok = ok & x["event_type"].isin(*query.event_types)
        if query.provinces:
            ok = ok & F.arrays_overlap(x["province_codes"], F.array(*[F.lit(p).cast("short") for p in query.provinces]))
        if query.date_from:
            ok = ok & (x["occurred_on"] >= F.lit(query.date_from))
        if query.date_to:
            ok = ok & (x["occurred_on"] <= F.lit(query.date_to))
        return ok

    on_screen = signal["raw_report_id"].isin(*shown_reports) if shown_reports else F.lit(False)
    return signal.isNull() | on_screen | F.coalesce(F.exists(signal["incidents"], listed), F.lit(False))
