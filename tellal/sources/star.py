"""The tables that queries read: a star of records with metrics, shared provinces and evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extraction import DATE_ASSUMED, NOT_RECOGNISED


@dataclass
class Star:
    incident: DataFrame
    metric: DataFrame
    shared: DataFrame
    keyword: DataFrame
    province: DataFrame
    result: DataFrame

    def violations(self) -> DataFrame:
        """rule and how many rows break it."""
        i, r = self.incident, self.result
        twice = self.metric.groupBy("incident_id", "metric_type").count().where("count > 1")
        rules = {
            "a province code if and only if the scope is SINGLE": i.where("(province_scope = 'SINGLE') <> (province_code is not null)"),
            "one value per record and metric": twice,
            "a failure reason if and only if FAILED": r.where("(status = 'FAILED') <> (failure_reason is not null)"),
            "a shared record has two provinces or more": i.where("province_scope = 'SHARED'").join(self.shared.groupBy("incident_id").count().where("count > 1"), F.col("id") == F.col("incident_id"), "left_anti"),
        }
        out = None
        for rule, rows in rules.items():
            one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
            out = one if out is None else out.unionByName(one)
        return out


TABLES = {"incident": "incident", "metric": "incident_metric", "shared": "incident_shared_province", "keyword": "incident_keyword", "province": "province", "result": "analysis_result"}


def write_snapshot(star: Star, path: str) -> None:
    """The star as it now reads, for queries that need not see later runs: records by month, so that
    a range of days reads only its months, and no join to find out which run counts."""
    month = F.date_trunc("month", "occurred_on").cast("date")
    for field, name in TABLES.items():
        rows = getattr(star, field)
        if field == "incident":
            rows.withColumn("month", month).repartition("month", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("month").parquet(f"{path}/{name}")
        else:
            rows.write.parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str) -> Star:
    return Star(**{field: spark.read.parquet(f"{path}/{name}") for field, name in TABLES.items()})


def from_events(spark: SparkSession, sf_dir: str) -> Star:
    """A star derived from the tables ``events`` and ``nation``: every event is a record."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, u, ten = F.col("event_id"), F.col("user_id"), F.col("event_id") % 10
    other = k % 11 == 0
    report = F.lpad((k - k % 3).cast("string"), 24, "0")
    code = (u % 81 + 1).cast("short")
    incident = e.select(
        k.alias("id"), report.alias("raw_report_id"), F.to_date("ts").alias("occurred_on"),
        F.when(k % 3 == 0, "EXPLICIT").when(k % 3 == 1, "RELATIVE").otherwise("DEFAULTED").alias("date_source"),
        F.when(ten < 7, "SINGLE").when(ten < 9, "SHARED").otherwise("UNKNOWN").alias("province_scope"),
        F.when(ten < 7, code).alias("province_code"), F.when(other, "OTHER").otherwise(F.col("event_type")).alias("event_type"),
        F.when(other, "UNCLASSIFIED").otherwise("CLASSIFIED").alias("classification"), F.col("ts").alias("created_at"),
    )
    first = e.where((k % 4 != 3) & ~other).select(k.alias("incident_id"), F.lit("M_A").alias("metric_type"), F.floor("value").cast("int").alias("metric_value"))
    second = e.where((k % 4).isin(0, 1) & ~other).select(k.alias("incident_id"), F.lit("M_B").alias("metric_type"), (k % 17).cast("int").alias("metric_value"))
    both = e.where(ten.isin(7, 8))
    shared = both.select(k.alias("incident_id"), code.alias("province_code")).unionByName(both.select(k.alias("incident_id"), ((u + 7) % 81 + 1).cast("short").alias("province_code")))
    tag = (u % 10).cast("string")
    keyword = (
        e.where(~other).select(k.alias("incident_id"), F.col("event_type").alias("keyword"), F.lit("EVENT_TYPE").alias("keyword_role"), F.lit(0).alias("char_start"), F.length("event_type").alias("char_end"))
        .unionByName(e.select(k.alias("incident_id"), F.concat(F.lit("Tag"), tag).alias("keyword"), F.lit("METRIC").alias("keyword_role"), F.lit(20).alias("char_start"), F.lit(24).alias("char_end")))
        .unionByName(e.where(k % 2 == 0).select(k.alias("incident_id"), F.concat(F.lit("tag"), tag, F.lit("x")).alias("keyword"), F.lit("METRIC").alias("keyword_role"), F.lit(30).alias("char_start"), F.lit(35).alias("char_end")))
    )
    province = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 1).cast("short").alias("code"), F.col("n_name").alias("name"))
    failed = F.min("event_id") % 21 == 0
    result = e.groupBy(report.alias("raw_report_id")).agg(
        F.when(failed, "FAILED").otherwise("ANALYZED").alias("status"), F.max("ts").alias("analyzed_at"),
        F.when(failed, 0).otherwise(F.count("*")).cast("int").alias("incident_count"), F.when(failed, "java.lang.IllegalStateException: boom").alias("failure_reason"),
        F.filter(F.array(F.when(~failed & F.bool_or(k % 3 == 2), DATE_ASSUMED), F.when(~failed & F.bool_or(other), NOT_RECOGNISED)), lambda w: w.isNotNull()).alias("warnings"),
    )
    return Star(incident, first.unionByName(second), shared, keyword, province, result)
