"""Time series and summaries over the selected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import AnalyticsQuery, ProvinceGrouping
from ..sources.star import Star
from .filters import selected

PLACE = ["province_scope", "province_code", "province_name"]


def scope_order(scope: str = "province_scope") -> Column:
    return F.when(F.col(scope) == "SINGLE", 0).when(F.col(scope) == "SHARED", 1).otherwise(2)


def named(rows: DataFrame, star: Star) -> DataFrame:
    """With the province's name."""
    names = star.province.select(F.col("code").alias("province_code"), F.col("name").alias("province_name"))
    return rows.join(names, "province_code", "left")


def with_metrics(rows: DataFrame, star: Star) -> DataFrame:
    return rows.join(star.metric, F.col("id") == F.col("incident_id"))


def time_series(star: Star, query: AnalyticsQuery = AnalyticsQuery(), grouping: ProvinceGrouping = ProvinceGrouping.NONE, cumulative: bool = False) -> DataFrame:
    """occurred_on, event_type, metric_type[, province...] and value: daily sums, or running ones.
    A shared figure is a series of its own and counts once."""
    keys = ["event_type", "metric_type", *(PLACE if grouping is ProvinceGrouping.PROVINCE else [])]
    place = ["province_scope", "province_code"] if grouping is ProvinceGrouping.PROVINCE else []
    rows = with_metrics(selected(star, query).select("id", "occurred_on", "event_type", *place), star)
    daily = rows.groupBy("occurred_on", "event_type", "metric_type", *place).agg(F.sum("metric_value").cast("long").alias("value"))
    if cumulative:
        so_far = Window.partitionBy("event_type", "metric_type", *place).orderBy("occurred_on").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        daily = daily.withColumn("value", F.sum("value").over(so_far).cast("long"))
    if place:
        daily = named(daily, star)
    return daily.select("occurred_on", *keys, "value")


def by_name(name: str = "province_name") -> Column:
    return F.expr(f"collate({name}, 'tr')").asc_nulls_last()


def point_order(points: DataFrame) -> list[Column | str]:
    place = [scope_order(), by_name(), "province_code"] if "province_scope" in points.columns else []
    return ["event_type", "metric_type", *place, "occurred_on"]


def in_order(points: DataFrame) -> DataFrame:
    """Points in the order in which they are shown."""
    return points.orderBy(*point_order(points))


def _levels(rows: DataFrame, bottom: list[str], sets: list[list[str]], measure: Column, name: str) -> DataFrame:
    level = F.when(F.grouping("event_type") == 1, "TOTAL").when(F.grouping("province_scope") == 1, "EVENT_TYPE").otherwise("BREAKDOWN")
    return rows.groupingSets(sets, *bottom).agg(level.alias("level"), measure.cast("long").alias(name)).select("level", *bottom, name)


def summary_metrics(star: Star, query: AnalyticsQuery = AnalyticsQuery()) -> DataFrame:
    """Metric totals per place, per event type and over all, from one scan."""
    place = ["event_type", "province_scope", "province_code"]
    rows = with_metrics(selected(star, query).select("id", *place), star)
    daily = rows.groupBy(*place, "metric_type").agg(F.sum("metric_value").alias("v"))
    cols = ["event_type", *PLACE, "metric_type"]
    return _levels(named(daily, star), cols, [cols, ["event_type", "metric_type"], ["metric_type"]], F.sum("v"), "value")


def summary_counts(star: Star, query: AnalyticsQuery = AnalyticsQuery()) -> DataFrame:
    """Record counts per place, per event type and over all. The total is there even for no records,
    so it is counted by itself: grouping sets over nothing give nothing."""
    place = ["event_type", "province_scope", "province_code"]
    counted = selected(star, query).groupBy(*place).agg(F.count("*").alias("n"))
    cols = ["event_type", *PLACE]
    levels = _levels(named(counted, star), cols, [cols, ["event_type"]], F.sum("n"), "incident_count")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("incident_count"))
    empty = [F.lit(None).cast(levels.schema[c].dataType).alias(c) for c in cols]
    return levels.unionByName(total.select(F.lit("TOTAL").alias("level"), *empty, "incident_count"))


def summary(star: Star, query: AnalyticsQuery = AnalyticsQuery()) -> DataFrame:
    """Counts with a map of metric totals, empty where there are none."""
    keys = ["level", "event_type", "province_scope", "province_code"]
    totals = summary_metrics(star, query).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_type", "value")))).alias("metrics"))
    totals = totals.select(*[F.col(k).alias(f"m_{k}") for k in keys], "metrics")
    same = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]
    return summary_counts(star, query).join(totals, same, "left").select(*keys, "province_name", "incident_count", F.coalesce("metrics", F.create_map().cast("map<string,bigint>")).alias("metrics"))


def summary_order() -> list[Column]:
    return [F.when(F.col("level") == "TOTAL", 1).otherwise(0), F.col("event_type").asc_nulls_last(), F.when(F.col("level") == "BREAKDOWN", 0).otherwise(1), scope_order(), by_name(), F.col("province_code")]


def summary_in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*summary_order())


def numbered(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """Aggregated rows, which are few, with their position from 1."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def nested_series(points: DataFrame) -> DataFrame:
    """One row per series with its points by date."""
    keys = [c for c in points.columns if c not in ("occurred_on", "value")]
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("occurred_on", "value"))).alias("points"))


def line_key() -> Column:
    bucket = F.when(F.col("province_scope") == "SINGLE", F.col("province_code").cast("string")).otherwise(F.col("province_scope"))
    return F.concat_ws("|", "event_type", "metric_type", bucket)


def pivoted(points: DataFrame, lines: list[str], key: Column | str) -> DataFrame:
    """One row per date, one column per line; a day without a figure stays null, never 0."""
    return points.withColumn("line", key if isinstance(key, Column) else F.col(key)).groupBy("occurred_on").pivot("line", lines).agg(F.first("value"))


def chart_lines(points: DataFrame, event_type: str, metric_type: str | None = None) -> DataFrame:
    """A chart's points: all metrics of a type, or one metric where provinces are apart."""
    rows = points.where(F.col("event_type") == event_type)
    return rows.where(F.col("metric_type") == metric_type) if "province_scope" in points.columns and metric_type else rows


def summary_blocks(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per event type: its own total (never the sum of its rows), its rows, and its metric
    keys in catalog order, unknown ones after them by name. catalog: event_type, metric_type, metric_ord."""
    parts = rows.where("level = 'BREAKDOWN'").groupBy("event_type").agg(
        F.array_sort(F.collect_list(F.struct(scope_order().alias("o"), F.col("province_name").isNull().alias("nameless"), F.expr("collate(province_name, 'tr')").alias("name"), "province_code", "province_scope", "incident_count", "province_name"))).alias("rows"),
        F.array_distinct(F.flatten(F.collect_list(F.map_keys("metrics")))).alias("keys"),
    )
    ranked = (
        parts.select("event_type", F.explode("keys").alias("metric_type")).join(catalog, ["event_type", "metric_type"], "left")
        .groupBy("event_type").agg(F.expr("transform(array_sort(collect_list(struct(coalesce(metric_ord, 2147483647) as o, metric_type))), x -> x.metric_type)").alias("columns"))
    )
    totals = rows.where("level = 'EVENT_TYPE'").select("event_type", "incident_count", "metrics")
    return totals.join(parts.drop("keys"), "event_type").join(ranked, "event_type", "left")


def unattributed(rows: DataFrame) -> DataFrame:
    """Breakdown rows that belong to no single province."""
    return rows.where("level = 'BREAKDOWN' and province_scope <> 'SINGLE'")


def total_metric_keys(rows: DataFrame) -> DataFrame:
    """Every metric of the event types' totals once."""
    return rows.where("level = 'EVENT_TYPE'").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("metrics"))))).alias("metric_types"))


def province_label(scope: str = "province_scope", name: str = "province_name") -> Column:
    return F.when(F.col(scope) == "SINGLE", F.coalesce(name, F.lit("unknown"))).when(F.col(scope) == "SHARED", "shared").otherwise("unknown")


def province_line(shared: str = "shared_across") -> Column:
    """Who a record belongs to, in a line: its province, or that it is shared and among which."""
    note = F.concat(F.lit("not split among "), F.array_join(F.transform(shared, lambda p: p["name"]), ", "))
    return F.concat_ws(" - ", province_label(), F.when(F.col("province_scope") == "SHARED", note))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """event_label and metric_label from the catalog: the type's own, else any type's, else the key."""
    own = labels.select("event_type", "metric_type", "event_label", F.col("metric_label").alias("own_label"))
    any_ = labels.groupBy("metric_type").agg(F.min_by("metric_label", F.struct("event_ord", "metric_ord")).alias("any_label"))
    types = labels.groupBy("event_type").agg(F.first("event_label").alias("type_label"))
    out = rows.join(own.drop("event_label"), ["event_type", "metric_type"], "left").join(any_, "metric_type", "left").join(types, "event_type", "left")
    return out.withColumns({"event_label": F.coalesce("type_label", "event_type"), "metric_label": F.coalesce("own_label", "any_label", "metric_type")}).drop("own_label", "any_label", "type_label")
