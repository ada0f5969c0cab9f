"""The registered queries of the analytics engine, each with SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import turkish
from ..operators import analytics, extraction, highlight, listing, signals
from ..operators.filters import selected
from ..sources import catalog as catalogs
from ..sources.reference_data import PROVINCES
from ..sources.star import from_events
from ..sources.store import Store, first_of_each, hashed, latest, validated, work_folder
from ..streaming import ingest, refresh
from .notices import NOTICE_QUERIES, dealt
from .query import AnalyticsQuery, ChartOptions, IncidentQuery, Page, ProvinceGrouping

BY_PROVINCE = ProvinceGrouping.PROVINCE
FROM, TO = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
COMBINED = AnalyticsQuery(("click", "view"), (3, 7, 16), FROM, TO, "TAG3")

STAR = """with incident as (
  select event_id as id, lpad(cast(event_id - event_id % 3 as varchar), 24, '0') as raw_report_id, cast(ts as date) as occurred_on,
         case event_id % 3 when 0 then 'EXPLICIT' when 1 then 'RELATIVE' else 'DEFAULTED' end as date_source,
         case when event_id % 10 < 7 then 'SINGLE' when event_id % 10 < 9 then 'SHARED' else 'UNKNOWN' end as province_scope,
         case when event_id % 10 < 7 then cast(user_id % 81 + 1 as smallint) end as province_code,
         case when event_id % 11 = 0 then 'OTHER' else event_type end as event_type,
         case when event_id % 11 = 0 then 'UNCLASSIFIED' else 'CLASSIFIED' end as classification, ts as created_at from events),
incident_metric as (
  select event_id as incident_id, 'M_A' as metric_type, cast(floor(value) as int) as metric_value from events where event_id % 4 <> 3 and event_id % 11 <> 0
  union all select event_id, 'M_B', cast(event_id % 17 as int) from events where event_id % 4 in (0, 1) and event_id % 11 <> 0),
shared as (
  select event_id as incident_id, cast(user_id % 81 + 1 as smallint) as province_code from events where event_id % 10 in (7, 8)
  union all select event_id, cast((user_id + 7) % 81 + 1 as smallint) from events where event_id % 10 in (7, 8)),
kw as (
  select event_id as incident_id, event_type as keyword, 'EVENT_TYPE' as keyword_role, 0 as char_start, cast(length(event_type) as int) as char_end from events where event_id % 11 <> 0
  union all select event_id, 'Tag' || cast(user_id % 10 as varchar), 'METRIC', 20, 24 from events
  union all select event_id, 'tag' || cast(user_id % 10 as varchar) || 'x', 'METRIC', 30, 35 from events where event_id % 2 = 0),
province as (select cast(n_nationkey + 1 as smallint) as code, n_name as name from nation),
result as (
  select lpad(cast(event_id - event_id % 3 as varchar), 24, '0') as raw_report_id, case when min(event_id) % 21 = 0 then 'FAILED' else 'ANALYZED' end as status,
         max(ts) as analyzed_at, cast(case when min(event_id) % 21 = 0 then 0 else count(*) end as int) as incident_count,
         case when min(event_id) % 21 = 0 then 'java.lang.IllegalStateException: boom' end as failure_reason,
         case when min(event_id) % 21 = 0 then '' else concat_ws('|', case when bool_or(event_id % 3 = 2) then 'No date was found in the text; the submission date was used.' end,
           case when bool_or(event_id % 11 = 0) then 'No known event type matched this text. It was stored as OTHER and can be reprocessed once the catalog recognises it.' end) end as warnings
  from events group by 1),
"""
ALL = "i as (select * from incident)\n"


def picked(where: str) -> str:
    return f"i as (select * from incident where {where})\n"


IN_PLACES = "(province_code in (3, 7, 16) or exists (select 1 from shared s where s.incident_id = id and s.province_code in (3, 7, 16)))"
IN_DAYS = f"occurred_on between date '{FROM}' and date '{TO}'"
TAGGED = "exists (select 1 from kw where kw.incident_id = id and lower(keyword) like '%tag3%')"
EVERY = f"event_type in ('click', 'view') and {IN_PLACES} and {IN_DAYS} and {TAGGED}"


def series_sql(where: str = "true", place: bool = False, cumulative: bool = False) -> str:
    keys = "event_type, metric_type" + ", province_scope, province_code" * place
    value = f"sum(sum(metric_value)) over (partition by {keys} order by occurred_on rows between unbounded preceding and current row)" if cumulative else "sum(metric_value)"
    inner = f"select occurred_on, {keys}, cast({value} as bigint) as value from i join incident_metric m on m.incident_id = i.id group by occurred_on, {keys}"
    if place:
        return STAR + picked(where) + f"select occurred_on, event_type, metric_type, province_scope, province_code, name as province_name, value from ({inner}) left join province on code = province_code"
    return STAR + picked(where) + inner


def counts_sql(where: str = "true") -> str:
    return STAR + picked(where) + """, n as (select i.*, name as province_name from i left join province on code = province_code)
select case when grouping(event_type) = 1 then 'TOTAL' when grouping(province_scope) = 1 then 'EVENT_TYPE' else 'BREAKDOWN' end as level,
       event_type, province_scope, province_code, province_name, count(*) as incident_count
from n group by grouping sets ((event_type, province_scope, province_code, province_name), (event_type))
union all select 'TOTAL', null, null, null, null, count(*) from n"""


def metrics_sql(where: str = "true") -> str:
    return STAR + picked(where) + """, n as (select i.*, name as province_name, metric_type, metric_value from i join incident_metric m on m.incident_id = i.id left join province on code = province_code)
select case when grouping(event_type) = 1 then 'TOTAL' when grouping(province_scope) = 1 then 'EVENT_TYPE' else 'BREAKDOWN' end as level,
       event_type, province_scope, province_code, province_name, metric_type, cast(sum(metric_value) as bigint) as value
from n group by grouping sets ((event_type, province_scope, province_code, province_name, metric_type), (event_type, metric_type), (metric_type))"""


def _page_columns(rows: DataFrame) -> DataFrame:
    return rows.select("id", "raw_report_id", "occurred_on", "event_type", "province_scope", "province_code")


def _flat_detail(rows: DataFrame) -> DataFrame:
    """Nested columns as text."""
    return rows.select(
        "id", "event_type", "province_name",
        F.expr("array_join(transform(shared_across, x -> cast(x.code as string)), ',')").alias("shared"),
        F.expr("array_join(transform(metrics, x -> concat(x.metric_type, '=', x.metric_value)), ',')").alias("metrics"),
        F.expr("array_join(transform(keywords, x -> concat(x.keyword, '@', x.char_start)), ',')").alias("keywords"),
    )


def _warned(rows: DataFrame) -> DataFrame:
    """Warnings as text."""
    return rows.withColumn("warnings", F.array_join("warnings", "|"))


LABELS = [(0, "view", "Views", 0, "M_A", "A of views"), (1, "click", "Clicks", 0, "M_A", "A of clicks"), (1, "click", "Clicks", 1, "M_C", "C")]
PAGE_SQL = "select id, raw_report_id, occurred_on, event_type, province_scope, province_code from i order by occurred_on desc, id desc limit 20"
DETAIL_SQL = """select id, event_type, name as province_name,
  coalesce((select string_agg(cast(province_code as varchar), ',' order by s.province_code) from shared s where s.incident_id = i.id), '') as shared,
  coalesce((select string_agg(metric_type || '=' || metric_value, ',' order by metric_type) from incident_metric m where m.incident_id = i.id), '') as metrics,
  coalesce((select string_agg(keyword || '@' || char_start, ',' order by char_start) from kw where kw.incident_id = i.id), '') as keywords
from (select * from i order by occurred_on desc, id desc limit 20) i left join province on code = province_code"""

STAR_QUERIES = {
    "ts_daily_by_province": (lambda s: analytics.time_series(s, grouping=BY_PROVINCE), series_sql(place=True)),
    "ts_daily": (lambda s: analytics.time_series(s), series_sql()),
    "ts_cumulative": (lambda s: analytics.time_series(s, cumulative=True), series_sql(cumulative=True)),
    "ts_cumulative_by_province": (lambda s: analytics.time_series(s, grouping=BY_PROVINCE, cumulative=True), series_sql(place=True, cumulative=True)),
    "ts_date_range": (lambda s: analytics.time_series(s, AnalyticsQuery(date_from=FROM, date_to=TO)), series_sql(IN_DAYS)),
    "ts_event_type_in": (lambda s: analytics.time_series(s, AnalyticsQuery(("click", "error"))), series_sql("event_type in ('click', 'error')")),
    "filter_province_shared_once": (lambda s: analytics.time_series(s, AnalyticsQuery(provinces=(3, 7, 16)), BY_PROVINCE), series_sql(IN_PLACES, place=True)),
    "filter_keyword_exists": (lambda s: analytics.time_series(s, AnalyticsQuery(keyword="TAG3")), series_sql(TAGGED)),
    "filters_combined": (lambda s: analytics.time_series(s, COMBINED), series_sql(EVERY)),
    "summary_metrics_grouping_sets": (lambda s: analytics.summary_metrics(s), metrics_sql()),
    "summary_metrics_filtered": (lambda s: analytics.summary_metrics(s, COMBINED), metrics_sql(EVERY)),
    "summary_counts_repaired": (lambda s: analytics.summary_counts(s), counts_sql()),
    "summary_counts_empty": (lambda s: analytics.summary_counts(s, AnalyticsQuery(("NO_SUCH_TYPE",))), counts_sql("event_type = 'NO_SUCH_TYPE'")),
    "summary_with_metrics": (
        lambda s: analytics.summary(s).select("level", "event_type", "province_scope", "province_code", "incident_count", F.expr("array_join(transform(array_sort(map_entries(metrics)), x -> concat(x.key, '=', x.value)), ',')").alias("metrics")),
        STAR + ALL + """, c as (select case when grouping(event_type) = 1 then 'TOTAL' when grouping(province_scope) = 1 then 'EVENT_TYPE' else 'BREAKDOWN' end as level, event_type, province_scope, province_code, count(*) as incident_count from i group by grouping sets ((event_type, province_scope, province_code), (event_type), ())),
m as (select case when grouping(event_type) = 1 then 'TOTAL' when grouping(province_scope) = 1 then 'EVENT_TYPE' else 'BREAKDOWN' end as level, event_type, province_scope, province_code, metric_type, cast(sum(metric_value) as bigint) as v
  from i join incident_metric on incident_id = id group by grouping sets ((event_type, province_scope, province_code, metric_type), (event_type, metric_type), (metric_type)))
select c.level, c.event_type, c.province_scope, c.province_code, c.incident_count, coalesce(string_agg(m.metric_type || '=' || m.v, ',' order by m.metric_type), '') as metrics
from c left join m on c.level = m.level and c.event_type is not distinct from m.event_type and c.province_scope is not distinct from m.province_scope and c.province_code is not distinct from m.province_code group by 1, 2, 3, 4, 5""",
    ),
    "series_pivot": (
        lambda s: analytics.pivoted(analytics.time_series(s, AnalyticsQuery(("click",))), ["M_A", "M_B"], "metric_type"),
        STAR + picked("event_type = 'click'") + "select occurred_on, cast(sum(metric_value) filter (metric_type = 'M_A') as bigint) as M_A, cast(sum(metric_value) filter (metric_type = 'M_B') as bigint) as M_B from i join incident_metric on incident_id = id group by occurred_on",
    ),
    "series_line_keys": (
        lambda s: analytics.time_series(s, grouping=BY_PROVINCE).select("occurred_on", analytics.line_key().alias("line"), analytics.province_label().alias("label"), "value"),
        STAR + ALL + "select occurred_on, event_type || '|' || metric_type || '|' || coalesce(cast(province_code as varchar), province_scope) as line, case province_scope when 'SINGLE' then coalesce(name, 'unknown') when 'SHARED' then 'shared' else 'unknown' end as label, cast(sum(metric_value) as bigint) as value from i join incident_metric on incident_id = id left join province on code = province_code group by occurred_on, event_type, metric_type, province_code, province_scope, name",
    ),
    "series_nested": (
        lambda s: analytics.nested_series(analytics.time_series(s)).select("event_type", "metric_type", F.size("points").cast("long").alias("n_points"), F.expr("points[0].occurred_on").alias("first_day"), F.expr("points[0].value").alias("first_value")),
        STAR + ALL + "select event_type, metric_type, count(*) as n_points, min(d) as first_day, arg_min(v, d) as first_value from (select event_type, metric_type, occurred_on as d, cast(sum(metric_value) as bigint) as v from i join incident_metric on incident_id = id group by 1, 2, 3) group by 1, 2",
    ),
    "summary_unattributed": (
        lambda s: analytics.unattributed(analytics.summary_counts(s)).select("event_type", "province_scope", "incident_count"),
        STAR + ALL + "select event_type, province_scope, count(*) as incident_count from i where province_scope <> 'SINGLE' group by 1, 2",
    ),
    "scope_reconciliation": (
        lambda s: s.incident.groupBy("event_type", "province_scope").agg(F.count("*").alias("n")).withColumn("of_type", F.expr("sum(n) over (partition by event_type)")),
        STAR + ALL + "select event_type, province_scope, count(*) as n, cast(sum(count(*)) over (partition by event_type) as bigint) as of_type from i group by 1, 2",
    ),
    "list_page_default_sort": (lambda s: _page_columns(listing.sorted_page(s.incident, Page())), STAR + ALL + PAGE_SQL),
    "list_page_2": (lambda s: _page_columns(listing.sorted_page(s.incident, Page(1))), STAR + ALL + PAGE_SQL + " offset 20"),
    "list_page_filtered": (lambda s: _page_columns(listing.sorted_page(selected(s, COMBINED), Page())), STAR + picked(EVERY) + PAGE_SQL),
    "list_total_pages": (lambda s: listing.page_totals(selected(s, COMBINED), 20), STAR + picked(EVERY) + "select count(*) as total_elements, cast(ceil(count(*) / 20.0) as bigint) as total_pages from i"),
    "incident_detail_nested": (lambda s: _flat_detail(listing.incidents(s)), STAR + ALL + DETAIL_SQL),
    "incident_by_raw_report": (lambda s: _page_columns(selected(s, IncidentQuery(raw_report_id=" 000000000000000000000030 "))), STAR + picked("raw_report_id = '000000000000000000000030'") + "select id, raw_report_id, occurred_on, event_type, province_scope, province_code from i"),
    "report_outcome": (lambda s: _warned(listing.latest_outcome(s, "000000000000000000000027")), STAR + ALL + "select raw_report_id, status, analyzed_at, incident_count, warnings from result where raw_report_id = '000000000000000000000027'"),
    "report_warnings": (lambda s: _warned(s.result).groupBy("status", "warnings").agg(F.count("*").alias("n")), STAR + ALL + "select status, warnings, count(*) as n from result group by 1, 2"),
    "outcomes_page": (
        lambda s: listing.with_totals(s.result.where("status = 'FAILED'"), Page(1, 10, (("analyzed_at", False), ("raw_report_id", True)))).select("raw_report_id", "analyzed_at", "total_elements", "total_pages"),
        STAR + ALL + "select raw_report_id, analyzed_at, count(*) over () as total_elements, cast(ceil(count(*) over () / 10.0) as bigint) as total_pages from result where status = 'FAILED' order by analyzed_at desc, raw_report_id limit 10 offset 10",
    ),
    "series_in_order": (
        lambda s: (lambda p: analytics.numbered(p, analytics.point_order(p)))(analytics.time_series(s, AnalyticsQuery(date_to=TO), BY_PROVINCE)),
        f"select *, row_number() over (order by event_type, metric_type, case province_scope when 'SINGLE' then 0 when 'SHARED' then 1 else 2 end, province_name nulls last, province_code, occurred_on)::int as position from ({series_sql(f"occurred_on <= date '{TO}'", place=True)})",
    ),
    "summary_in_order": (
        lambda s: analytics.numbered(analytics.summary_counts(s), analytics.summary_order()),
        f"select *, row_number() over (order by level = 'TOTAL', event_type nulls last, level <> 'BREAKDOWN', case province_scope when 'SINGLE' then 0 when 'SHARED' then 1 else 2 end, province_name nulls last, province_code)::int as position from ({counts_sql()})",
    ),
    "summary_blocks": (
        lambda s: analytics.summary_blocks(analytics.summary(s, AnalyticsQuery(date_to=TO)), s.incident.select("event_type").distinct().select("event_type", F.lit("M_B").alias("metric_type"), F.lit(0).alias("metric_ord"))).select(
            "event_type", "incident_count", F.array_join("columns", ",").alias("columns"), F.expr("array_join(transform(array_sort(map_entries(metrics)), x -> concat(x.key, '=', x.value)), ',')").alias("metrics"),
            F.expr("array_join(transform(rows, x -> concat(coalesce(cast(x.province_code as string), x.province_scope), '=', x.incident_count)), ',')").alias("rows"),
        ),
        STAR + picked(f"occurred_on <= date '{TO}'") + """, n as (select event_type, province_scope, province_code, name, count(*) as n from i left join province on code = province_code group by all),
m as (select event_type, metric_type, sum(metric_value) as v from i join incident_metric on incident_id = id group by all)
select event_type, cast(sum(n) as bigint) as incident_count,
  (select string_agg(metric_type, ',' order by case metric_type when 'M_B' then 0 else 1 end, metric_type) from m where m.event_type = n.event_type) as columns,
  coalesce((select string_agg(metric_type || '=' || v, ',' order by metric_type) from m where m.event_type = n.event_type), '') as metrics,
  string_agg(coalesce(cast(province_code as varchar), province_scope) || '=' || n, ',' order by case province_scope when 'SINGLE' then 0 when 'SHARED' then 1 else 2 end, name nulls last, province_code) as rows
from n group by event_type""",
    ),
    "summary_total_metrics": (
        lambda s: analytics.total_metric_keys(analytics.summary(s)).select(F.array_join("metric_types", ",").alias("metric_types")),
        STAR + ALL + "select string_agg(metric_type, ',' order by metric_type) as metric_types from (select distinct metric_type from i join incident_metric on incident_id = id)",
    ),
    "chart_lines_by_province": (
        lambda s: analytics.chart_lines(analytics.time_series(s, grouping=ChartOptions("click", "M_B", True).grouping()), "click", ChartOptions("click", "M_B", True).drawn_metric(["M_A", "M_B"])),
        f"select * from ({series_sql(place=True)}) where event_type = 'click' and metric_type = 'M_B'",
    ),
    "chart_lines_of_a_type": (
        lambda s: analytics.chart_lines(analytics.time_series(s, cumulative=True), ChartOptions("none", cumulative=True).drawn_type((), ["view", "click"]), "M_B"),
        f"select * from ({series_sql(cumulative=True)}) where event_type = 'view'",
    ),
    "labels_with_fallbacks": (
        lambda s: analytics.labelled(analytics.with_metrics(s.incident, s).select("event_type", "metric_type").distinct(), s.incident.sparkSession.createDataFrame(LABELS, "event_ord int, event_type string, event_label string, metric_ord int, metric_type string, metric_label string")),
        STAR + ALL + f""", l as (select * from (values {', '.join(map(str, LABELS))}) as l(event_ord, event_type, event_label, metric_ord, metric_type, metric_label))
select event_type, metric_type, coalesce((select max(event_label) from l where l.event_type = p.event_type), event_type) as event_label,
  coalesce((select max(metric_label) from l where l.event_type = p.event_type and l.metric_type = p.metric_type), (select arg_min(metric_label, event_ord * 100 + metric_ord) from l where l.metric_type = p.metric_type), metric_type) as metric_label
from (select distinct event_type, metric_type from i join incident_metric on incident_id = id) p""",
    ),
    "province_lines": (
        lambda s: listing.incidents(s).select("id", analytics.province_line().alias("line")),
        STAR + ALL + """select id, case province_scope when 'SINGLE' then coalesce(name, 'unknown') when 'UNKNOWN' then 'unknown'
  else 'shared - not split among ' || coalesce((select string_agg(p.name, ', ' order by s.province_code) from shared s join province p on p.code = s.province_code where s.incident_id = i.id), '') end as line
from (select * from i order by occurred_on desc, id desc limit 20) i left join province on code = province_code""",
    ),
    "incident_by_id": (lambda s: _flat_detail(listing.by_id(s, 37)), STAR + ALL + DETAIL_SQL.replace("order by occurred_on desc, id desc limit 20", "where id = 37")),
    "list_after_key": (
        lambda s: _page_columns(listing.after(s.incident, {"occurred_on": TO, "id": 500})),
        STAR + picked(f"occurred_on < date '{TO}' or occurred_on = date '{TO}' and id < 500") + PAGE_SQL,
    ),
    "latest_runs": (
        lambda s: latest(s.incident.select("raw_report_id", F.timestamp_seconds("id").alias("run_ts"), F.when(F.col("id") % 2 == 0, "ANALYZED").otherwise("FAILED").alias("status"))).select("raw_report_id", "run_ts", "status"),
        STAR + ALL + "select raw_report_id, make_timestamp(max(id) * 1000000) as run_ts, case when max(id) % 2 = 0 then 'ANALYZED' else 'FAILED' end as status from i group by 1",
    ),
    "records_with_outcome": (lambda s: listing.of_report(s).groupBy("status", "event_type").agg(F.count("*").alias("n")), STAR + ALL + "select status, event_type, count(*) as n from i join result using (raw_report_id) group by 1, 2"),
    "unclassified_gap_report": (lambda s: s.incident.where("classification = 'UNCLASSIFIED'").groupBy("occurred_on").agg(F.count("*").alias("n")), STAR + picked("classification = 'UNCLASSIFIED'") + "select occurred_on, count(*) as n from i group by 1"),
    "join_inner_metric": (lambda s: analytics.with_metrics(s.incident, s).groupBy("event_type", "metric_type").agg(F.count("*").alias("n")), STAR + ALL + "select event_type, metric_type, count(*) as n from i join incident_metric on incident_id = id group by 1, 2"),
    "join_left_province": (lambda s: analytics.named(s.incident, s).groupBy("province_name").agg(F.count("*").alias("n")), STAR + ALL + "select name as province_name, count(*) as n from i left join province on code = province_code group by 1"),
    "analysis_result_failed": (lambda s: s.result.where("status = 'FAILED'").select("raw_report_id", "analyzed_at", "failure_reason"), STAR + ALL + "select raw_report_id, analyzed_at, failure_reason from result where status = 'FAILED'"),
    "unknown_province_codes": (lambda s: s.incident.where("province_code is not null").join(s.province, F.col("province_code") == F.col("code"), "left_anti").groupBy("province_code").agg(F.count("*").alias("n")), STAR + ALL + "select province_code, count(*) as n from i where province_code is not null and not exists (select 1 from province where code = province_code) group by 1"),
    "invariants": (lambda s: s.violations(), "select unnest(['a province code if and only if the scope is SINGLE', 'one value per record and metric', 'a failure reason if and only if FAILED', 'a shared record has two provinces or more']) as rule, cast(0 as bigint) as n"),
    "signals_per_report": (
        lambda s: signals.signals(s).select("raw_report_id", F.size("incidents").cast("long").alias("n"), F.expr("array_join(transform(incidents, x -> concat(x.id, ':', array_join(transform(x.province_codes, c -> cast(c as string)), '+'))), ',')").alias("covered")),
        STAR + ALL + """, c as (select id, raw_report_id, case province_scope when 'SINGLE' then cast(province_code as varchar) when 'SHARED' then (select string_agg(distinct cast(s.province_code as varchar), '+' order by lpad(cast(s.province_code as varchar), 3, '0')) from shared s where s.incident_id = i.id) else '' end as codes from i)
select r.raw_report_id, count(id) as n, coalesce(string_agg(id || ':' || codes, ',' order by id), '') as covered from result r left join c using (raw_report_id) where status = 'ANALYZED' group by 1""".replace("distinct cast(s.province_code as varchar), '+' order by lpad(cast(s.province_code as varchar), 3, '0')", "cast(s.province_code as varchar), '+' order by s.province_code"),
    ),
    "signal_relevance": (
        lambda s: (lambda x: x.where(signals.matters(F.struct("raw_report_id", "incidents"), AnalyticsQuery(("click",), (3, 7, 16), FROM, TO))).select("raw_report_id"))(signals.signals(s)),
        STAR + picked(f"event_type = 'click' and {IN_PLACES} and {IN_DAYS}") + "select distinct raw_report_id from i join result using (raw_report_id) where status = 'ANALYZED'",
    ),
    "signal_json_round_trip": (
        lambda s: signals.as_json(signals.signals(s)).select("raw_report_id", signals.from_json("payload").alias("s")).select("raw_report_id", F.size("s.incidents").cast("long").alias("n")),
        STAR + ALL + "select raw_report_id, count(id) as n from result left join i using (raw_report_id) where status = 'ANALYZED' group by 1",
    ),
}

REF = "2020-06-15"
GOLDEN = [
    ["20.04.2020 tarihinde Ankara'da 15 yeni vaka tespit edildi.", "1 kişi hayatını kaybetti.", "5 kişi ise iyileşerek taburcu edildi."],
    ["3 Mayıs 2020 günü İzmir'de meydana gelen depremde on iki bina hasar gördü.", "İki kişi hayatını kaybederken, dokuz kişi enkazdan sağ olarak kurtarıldı.", "Ayrıca 40 kişi hafif yaralı olarak tedavi altına alındı."],
    ["Son 24 saatte Bursa'da 8, Kocaeli'nde 6 trafik kazası meydana geldi.", "Bursa'da 1, Kocaeli'nde ise 2 kişi kazalarda hayatını kaybetti.", "Her iki ilde toplam 10 kişi yaralı olarak hastaneye kaldırıldı."],
]
GOLDEN_TEXTS = [(f"{n + 1}-{''.join(map(str, order))}", " ".join(parts[k] for k in order), REF) for n, parts in enumerate(GOLDEN) for order in itertools.permutations(range(3))]
GOLDEN_RECORDS = [
    (1, "EPIDEMIC", "2020-04-20", "EXPLICIT", "SINGLE", "6", "DEATH=1,NEW_CASE=15,RECOVERED=5"),
    (2, "EARTHQUAKE", "2020-05-03", "EXPLICIT", "SINGLE", "35", "DAMAGED_BUILDING=12,DEATH=2,INJURED=40,RESCUED=9"),
    (3, "TRAFFIC_ACCIDENT", "2020-06-15", "RELATIVE", "SINGLE", "16", "ACCIDENT_COUNT=8,DEATH=1"),
    (3, "TRAFFIC_ACCIDENT", "2020-06-15", "RELATIVE", "SINGLE", "41", "ACCIDENT_COUNT=6,DEATH=2"),
    (3, "TRAFFIC_ACCIDENT", "2020-06-15", "RELATIVE", "SHARED", "16+41", "INJURED=10"),
]
NUMBER_TEXTS = {
    "on iki": "12", "kırk beş": "45", "yüz kırk beş": "145", "bin beş yüz": "1500", "iki bin üç yüz kırk beş": "2345", "iki milyon üç yüz bin": "2300000", "bir milyar": "1000000000", "sıfır": "0",
    "1.500": "1500", "1.234.567": "1234567", "15 bin": "15000", "2 bin 500": "2500", "12 bin 345": "12345", "onlarca kişi yaralandı": "", "birkaç kişi hafif yaralandı": "", "hasar 2,5 milyar lira": "",
    "E-80 karayolunda kaza oldu": "", "12345678901234567890123": "", "bir iki kişi": "1,2", "beş üç": "5,3", "on 15": "10,15", "iki bin milyon": "2000,1000000", "D-100 karayolunda 3 kişi yaralandı": "3", "dokuz milyar": "9000000000",
}
DATE_TEXTS = {
    "20.04.2020": "2020-04-20 EXPLICIT", "2020-04-20": "2020-04-20 EXPLICIT", "20.04.20": "2020-04-20 EXPLICIT", "3 Mayıs 2020": "2020-05-03 EXPLICIT", "9 Eylül 2019'da": "2019-09-09 EXPLICIT", "3 Aralık'ta": "2019-12-03 EXPLICIT",
    "son 24 saatte": "2020-06-15 RELATIVE", "son bir haftada": "2020-06-15 RELATIVE", "bugün": "2020-06-15 RELATIVE", "dün": "2020-06-14 RELATIVE", "önceki gün": "2020-06-13 RELATIVE", "geçen hafta": "2020-06-08 RELATIVE", "geçen ay": "2020-05-15 RELATIVE",
    "dün kaza oldu, 20.04.2020": "2020-04-20 EXPLICIT", "dünya": "2020-06-15 DEFAULTED", "31.02.2020": "2020-06-15 DEFAULTED", "31 Nisan'da": "2020-06-15 DEFAULTED", "son günlerde artış var": "2020-06-15 DEFAULTED",
}
PLACE_TEXTS = {
    "Ankara'da": "6", "İzmir'de": "35", "Kocaeli'nde": "41", "İstanbul'un": "34", "Kahramanmaraş'ta": "46", "Ankarada": "6", "Vanlı": "65", "Iğdır'da": "76", "vanilya": "", "ordular": "", "mersinlik": "",
    "İstanbul'un Aksaray semtinde": "34", "Aksaray ilçesinde": "", "Bursa'da ve Bursa'da": "16,16",
}
TYPE_TEXTS = {
    "Sel nedeniyle 200 kişi tahliye edildi": "FLOOD", "İtfaiye ekipleri alevlere müdahale etti": "FIRE", "Zincirleme çarpışmada 4 araç hasar gördü": "TRAFFIC_ACCIDENT,EARTHQUAKE",
    "Depremin ardından çıkan yangında 3 bina kül oldu.": "EARTHQUAKE,FIRE", "Ankara'da belediye park çalışmalarını tamamladı.": "", "selam kazan testere": "",
}
SENTENCE_TEXTS = {"Dr. Ahmet geldi. 1 kişi öldü.": "dr. ahmet geldi.|1 kişi öldü.", "2,5 lira. tamam": "2,5 lira.|tamam", "...": "", "www.ornek.gov sitesi": "www.ornek.gov sitesi", "Devam… etti? !": "devam…|etti?"}
NORMAL_TEXTS = {"İZMİR": "izmir", "IZMIR": "ızmır", "İzmir’de": "izmir'de", "sel\n\n  var ": "sel var", "a​b­c": "abc", "İ ü": "i ü"}


def _literals(spark: SparkSession, texts: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(texts, "raw_report_id string, raw_text string, d string").withColumn("ref_date", F.to_date("d")).drop("d")


def _understood(spark: SparkSession, texts: dict[str, str], value: str) -> DataFrame:
    rows = extraction.understood(extraction.scan(_literals(spark, [(str(k), t, REF) for k, t in enumerate(texts)])))
    return rows.select(F.col("raw_report_id").cast("int").alias("k"), F.expr(value).alias("found"))


def _values(rows: list[tuple], columns: str) -> str:
    quoted = [", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) for r in rows]
    return f"select * from (values {', '.join(f'({q})' for q in quoted)}) t({columns})"


def _expected(texts: dict[str, str]) -> str:
    return _values([(k, v) for k, v in enumerate(texts.values())], "k, found")


def golden(spark: SparkSession) -> DataFrame:
    found, _ = extraction.extract(_literals(spark, GOLDEN_TEXTS))
    return found.select(
        "raw_report_id", "event_type", F.col("occurred_on").cast("string").alias("occurred_on"), "date_source", "province_scope",
        F.expr("if(province_scope = 'SHARED', array_join(transform(shared_province_codes, c -> cast(c as string)), '+'), cast(province_code as string))").alias("place"),
        F.expr("array_join(array_sort(transform(metrics, m -> concat(m.metric_type, '=', m.metric_value))), ',')").alias("metrics"),
    )


GOLDEN_SQL = _values([(t[0], *r[1:]) for t in GOLDEN_TEXTS for r in GOLDEN_RECORDS if t[0].startswith(f"{r[0]}-")], "raw_report_id, event_type, occurred_on, date_source, province_scope, place, metrics")
EVIDENCE = "array_join(array_sort(transform(keywords, x -> concat(x.role, ':', x.keyword, '@', x.char_start, '-', x.char_end))), ',')"
EVIDENCE_TEXT = "Dün  ANKARA’da 3 kişi yaralandı; kaza sürüyor."


def evidence_offsets(spark: SparkSession) -> DataFrame:
    found, _ = extraction.extract(_literals(spark, [("1", EVIDENCE_TEXT, REF)]))
    return found.select("event_type", F.expr(EVIDENCE).alias("evidence"))


def highlight_segments(spark: SparkSession) -> DataFrame:
    texts = spark.sql("select 1L as id, 'Bursa da kaza var' as raw_text, array(named_struct('role', 'PROVINCE', 'char_start', 0, 'char_end', 5), named_struct('role', 'METRIC', 'char_start', 9, 'char_end', 13), named_struct('role', 'EVENT_TYPE', 'char_start', 9, 'char_end', 13), named_struct('role', 'DATE', 'char_start', 12, 'char_end', 99)) as keywords")
    return highlight.segments(texts).select("id", "begin", "end", "text", F.array_join("roles", ",").alias("roles"))


ODD_TEXTS = {
    "1": (None, "FAILED", "ValueError: text must not be null", ""), "2": ("20.04.2020 tarihinde Ankara'da 15 yeni vaka tespit edildi.", "ANALYZED", None, ""),
    "3": ("Ankara'da 15 yeni vaka tespit edildi.", "ANALYZED", None, extraction.DATE_ASSUMED), "4": ("Hiçbir şey yok.", "ANALYZED", None, f"{extraction.DATE_ASSUMED}|{extraction.NOT_RECOGNISED}"),
    "5": ("3 Mayıs 2020 günü toplantı yapıldı.", "ANALYZED", None, extraction.NOT_RECOGNISED),
}


def outcomes_isolated(spark: SparkSession) -> DataFrame:
    """One report that cannot be read among others."""
    _, found = extraction.extract(_literals(spark, [(k, v[0], REF) for k, v in ODD_TEXTS.items()]))
    return _warned(found)


LITERAL_QUERIES = {
    "outcomes_isolated": (outcomes_isolated, _values([(k, *("null::varchar" if x is None else x for x in v[1:])) for k, v in ODD_TEXTS.items()], "raw_report_id, status, failure_reason, warnings").replace("'null::varchar'", "null::varchar")),
    "golden_permutations": (golden, GOLDEN_SQL),
    "number_words": (lambda s: _understood(s, NUMBER_TEXTS, "array_join(transform(numbers, n -> cast(n.value as string)), ',')"), _expected(NUMBER_TEXTS)),
    "date_resolution": (lambda s: _understood(s, DATE_TEXTS, "concat(coalesce(day.date, ref_date), ' ', coalesce(day.source, 'DEFAULTED'))"), _expected(DATE_TEXTS)),
    "province_mentions": (lambda s: _understood(s, PLACE_TEXTS, "array_join(transform(provs, p -> p.detail), ',')"), _expected(PLACE_TEXTS)),
    "classify_rank": (lambda s: _understood(s, TYPE_TEXTS, "array_join(types, ',')"), _expected(TYPE_TEXTS)),
    "sentence_split": (lambda s: _understood(s, SENTENCE_TEXTS, "array_join(transform(sentences, x -> substring(value, x.begin + 1, x.end - x.begin)), '|')"), _expected(SENTENCE_TEXTS)),
    "normalisation": (lambda s: _understood(s, NORMAL_TEXTS, "value"), _expected(NORMAL_TEXTS)),
    "evidence_offsets": (evidence_offsets, _values([("TRAFFIC_ACCIDENT", "DATE:Dün@0-3,EVENT_TYPE:kaza@33-37,METRIC:yaralandı@22-31,PROVINCE:ANKARA’da@5-14")], "event_type, evidence")),
    "highlight_segments": (highlight_segments, _values([(1, 0, 5, "Bursa", "PROVINCE"), (1, 5, 9, " da ", ""), (1, 9, 13, "kaza", "EVENT_TYPE,METRIC"), (1, 13, 17, " var", "")], "id, \"begin\", \"end\", text, roles").replace("(1, ", "(cast(1 as bigint), ")),
    "metadata_event_types": (
        lambda s: catalogs.load_catalog().metadata(s),
        _values([(k, e.key, e.label, n, m.key, m.label) for k, e in enumerate(catalogs.load_catalog().event_types) for n, m in enumerate(e.metrics)], "event_ord, event_type, event_label, metric_ord, metric_type, metric_label"),
    ),
    "metadata_provinces": (lambda s: s.createDataFrame(list(enumerate(PROVINCES, 1)), "code int, name string").orderBy("code"), _values(list(enumerate(PROVINCES, 1)), "code, name")),
}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.lpad(F.col("doc_id").cast("string"), 24, "0").alias("raw_report_id"), F.col("text").alias("raw_text"), F.timestamp_seconds("doc_id").alias("submitted_at"))


ERROR_SQL = "case when trim(text) = '' then 'report.text.blank' when length(text) + length(text) - length(regexp_replace(text, '[\\x{10000}-\\x{10FFFF}]', '', 'g')) > 10000 then 'report.text.too-long' end"


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text submitted twice in one batch, then all once more: how the submissions are answered."""
    store, texts = Store(spark, work_folder(spark)), _submitted(spark, sf_dir).drop("raw_report_id")
    first, again = store.submit(texts.unionByName(texts)), store.submit(texts)
    answered = first.withColumn("batch", F.lit(1)).unionByName(again.withColumn("batch", F.lit(2)))
    return answered.groupBy("batch", F.coalesce("error_code", F.when(F.col("newly_stored"), "new").otherwise("known")).alias("answer")).agg(F.count("*").alias("n"))


RECEIPTS_SQL = f"""with d as (select text, {ERROR_SQL} as e from documents), n as (select count(*) as n, count(distinct text) as m from d where e is null)
select * from (
  select 1::int as batch, e as answer, 2 * count(*) as n from d where e is not null group by e union all select 2, e, count(*) from d where e is not null group by e
  union all select 1, 'new', m from n union all select 1, 'known', 2 * n - m from n union all select 2, 'known', n from n) where n > 0"""


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that arrive as JSON lines, stored, analysed and announced by a stream: what each left behind."""
    folder = work_folder(spark)
    _submitted(spark, sf_dir).select("raw_text", "submitted_at").write.json(f"{folder}/arriving")
    store = Store(spark, f"{folder}/store")
    ingest.ingest(ingest.submissions(spark, f"{folder}/arriving"), store, f"{folder}/checkpoint", clock=lambda: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)).awaitTermination()
    announced = store.read("signal").groupBy("raw_report_id").agg(F.count("*").alias("n_signals"))
    return store.read("raw_report").join(store.star().result, "raw_report_id").join(announced, "raw_report_id", "left").select("text_hash", "submitted_at", "status", "analyzed_at", "n_signals")


STREAM_SQL = f"select sha256(text) as text_hash, make_timestamp(min(doc_id) * 1000000) as submitted_at, 'ANALYZED' as status, timestamp '2024-01-01' as analyzed_at, 1::bigint as n_signals from documents where {ERROR_SQL} is null group by text"


def stream_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that arrive as JSON lines, of which three in five cannot be read: what became of each. Refused
    lines carry their number; of stored texts, the time is the number of the first."""
    folder = work_folder(spark)
    docs = _documents(spark, sf_dir)
    plain = F.struct(F.col("text").alias("raw_text"), F.timestamp_seconds("doc_id").alias("submitted_at"))
    kind = F.col("doc_id") % 5
    line = (
        F.when(kind == 1, F.to_json(F.struct(plain["raw_text"].alias("raw_text"), plain["submitted_at"].alias("submitted_at"), "doc_id")))
        .when(kind == 2, F.to_json(F.struct(F.struct("doc_id", "text").alias("raw_text"), plain["submitted_at"].alias("submitted_at"))))
        .when(kind == 3, F.regexp_replace(F.to_json(F.struct("doc_id", F.col("text").alias("raw_text"))), r"..$", ""))
        .otherwise(F.to_json(plain))
    )
    docs.select(line.alias("value")).write.text(f"{folder}/arriving")
    store = Store(spark, f"{folder}/store")
    ingest.ingest(ingest.submissions(spark, f"{folder}/arriving"), store, f"{folder}/checkpoint", clock=lambda: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)).awaitTermination()
    number = F.coalesce(F.regexp_extract("line", '"doc_id":([0-9]+)', 1).try_cast("long"), F.unix_seconds("submitted_at"))
    refused = store.read("refused").select(number.alias("doc_id"), F.col("error_code").alias("outcome"), F.regexp_replace("detail", ":.*", "").alias("detail"))
    stored = store.read("raw_report").select(F.unix_seconds("submitted_at").alias("doc_id"), F.lit("stored").alias("outcome"), F.lit(None).cast("string").alias("detail"))
    return stored.unionByName(refused)


REFUSALS_SQL = f"""with d as (select doc_id, text, {ERROR_SQL} as e from documents)
select min(doc_id) as doc_id, 'stored' as outcome, null::varchar as detail from d where doc_id % 5 in (0, 4) and e is null group by text
union all select doc_id, e, null from d where doc_id % 5 in (0, 4) and e is not null
union all select doc_id, 'request.bad-request', case doc_id % 5 when 1 then 'unknown field' when 2 then 'wrong type' else 'not a JSON object' end from d where doc_id % 5 in (1, 2, 3)"""


def stream_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals, each user's a view's, replayed at their own times: when each view is refreshed, at
    most once in six hours. A last signal a day later brings the watermark past all others."""
    folder = work_folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("view"), F.col("ts").alias("at"))
    last = events.agg((F.max("at") + F.expr("interval 1 day")).alias("at")).select(F.lit("last").alias("view"), "at")
    events.unionByName(last).write.parquet(f"{folder}/arriving")
    told = refresh.refreshes(spark.readStream.schema("view string, at timestamp").parquet(f"{folder}/arriving"), "6 hours", "0 seconds")
    refresh.start(told, lambda rows, k: rows.write.mode("overwrite").parquet(f"{folder}/shown/{k}"), f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    return spark.read.schema("view string, refreshed_at timestamp, n_signals long, waited boolean").parquet(f"{folder}/shown/*").where("view <> 'last'")


REFRESHES_SQL = """with recursive s as (select cast(user_id as varchar) as view, epoch_us(ts) // 1000 as ms from events),
r as (
  select view, min(ms) as ms, false as waited from s group by view
  union all select r.view, greatest(min(s.ms), r.ms + 21600000), min(s.ms) < r.ms + 21600000 from r join s on s.view = r.view and s.ms > r.ms group by r.view, r.ms)
select view, make_timestamp(due * 1000) as refreshed_at, count(*) as n_signals, waited from (select s.view, r.ms as due, r.waited from s asof join r on s.view = r.view and s.ms <= r.ms) group by all"""


def records_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a report, whose record follows from the order's columns; figures beyond an int are no counts."""
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate"))
    place = F.element_at(F.array(*map(F.lit, PROVINCES)), (F.col("o_custkey") % 81 + 1).cast("int"))
    text = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" tarihinde "), place, F.lit("'da "), (F.col("o_orderkey") * 100_000).cast("string"), F.lit(" yeni vaka tespit edildi."))
    found, _ = extraction.extract(orders.select(F.col("o_orderkey").cast("string").alias("raw_report_id"), text.alias("raw_text"), F.lit(REF).cast("date").alias("ref_date")))
    metric = F.expr("array_join(transform(metrics, m -> concat(m.metric_type, '=', m.metric_value)), ',')")
    return found.select(F.col("raw_report_id").cast("long").alias("order_key"), "ordinal", "occurred_on", "date_source", "province_scope", F.col("province_code").cast("int").alias("province_code"), "event_type", metric.alias("metrics"), F.size("keywords").alias("n_keywords"))


RECORDS_SQL = """select cast(o_orderkey as bigint) as order_key, 0 as ordinal, cast(o_orderdate as date) as occurred_on, 'EXPLICIT' as date_source, 'SINGLE' as province_scope, cast(o_custkey % 81 + 1 as int) as province_code, 'EPIDEMIC' as event_type,
  case when o_orderkey * 100000 <= 2147483647 then 'NEW_CASE=' || (o_orderkey * 100000) else '' end as metrics, case when o_orderkey * 100000 <= 2147483647 then 4 else 3 end as n_keywords from orders"""


def records_of_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a report of two sentences a line, each with a place and a figure of its own: what its
    records hold follows from the lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    places = F.array(*map(F.lit, PROVINCES))
    place = [F.element_at(places, (F.col(c) % 81 + 1).cast("int")) for c in ("l_suppkey", "l_linenumber")]
    first = F.concat(place[0], F.lit("'da "), F.col("q").cast("string"), F.lit(" yeni vaka tespit edildi. "))
    second = F.concat(place[1], F.lit("'da "), (F.col("l_linenumber") * 3).cast("string"), F.lit(" kişi hayatını kaybetti. "))
    both = lines.select("l_orderkey", "l_linenumber", F.concat(first, second).alias("t"))
    keyed = dealt(both.withColumn("id", F.col("l_orderkey").cast("string")), "id")
    texts = keyed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))), lambda x: x["t"]), "").alias("raw_text"))
    found, _ = extraction.extract(texts.select(F.col("id").alias("raw_report_id"), "raw_text", F.lit(REF).cast("date").alias("ref_date")), evidence=False)
    metric = F.expr("array_join(transform(array_sort(metrics), m -> concat(m.metric_type, '=', m.metric_value)), ',')")
    return found.select("raw_report_id", "event_type", "date_source", "province_scope", F.col("province_code").cast("int").alias("province_code"), metric.alias("metrics"))


SHIPMENTS_SQL = """with l as (select cast(l_orderkey as varchar) as id, * from lineitem),
f as (
  select id, l_suppkey % 81 + 1 as code, 'NEW_CASE' as metric, cast(l_quantity as int) as v from l
  union all select id, l_linenumber % 81 + 1, 'DEATH', l_linenumber * 3 from l),
s as (select id, code, metric, sum(v) as v from f group by all)
select id as raw_report_id, 'EPIDEMIC' as event_type, 'DEFAULTED' as date_source, 'SINGLE' as province_scope, cast(code as int) as province_code, string_agg(metric || '=' || v, ',' order by metric) as metrics from s group by id, code"""
DIGITS = r"[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+(?:,[0-9]+)?"
TEXT_QUERIES = {
    "receipts": (receipts, RECEIPTS_SQL),
    "stream_ingest": (stream_ingest, STREAM_SQL),
    "stream_refreshes": (stream_refreshes, REFRESHES_SQL),
    "stream_refusals": (stream_refusals, REFUSALS_SQL),
    "records_of_orders": (records_of_orders, RECORDS_SQL),
    "records_of_shipments": (records_of_shipments, SHIPMENTS_SQL),
    "raw_reports_page": (
        lambda s, d: listing.with_totals(first_of_each(hashed(_submitted(s, d))), Page(2, 20, (("submitted_at", False), ("raw_report_id", False)))).select("raw_report_id", "submitted_at", "total_elements", "total_pages"),
        "select lpad(cast(doc_id as varchar), 24, '0') as raw_report_id, make_timestamp(doc_id * 1000000) as submitted_at, count(*) over () as total_elements, cast(ceil(count(*) over () / 20.0) as bigint) as total_pages from (select min(doc_id) as doc_id from documents group by text) order by submitted_at desc limit 20 offset 40",
    ),
    "dedup_sha256": (
        lambda s, d: first_of_each(hashed(_submitted(s, d))).select("raw_report_id", "text_hash"),
        "select min(lpad(cast(doc_id as varchar), 24, '0')) as raw_report_id, sha256(text) as text_hash from documents group by 2",
    ),
    "text_validation": (
        lambda s, d: validated(_submitted(s, d)).groupBy("error_code").agg(F.count("*").alias("n")),
        "select case when trim(text) = '' then 'report.text.blank' when length(text) + length(text) - length(regexp_replace(text, '[\\x{10000}-\\x{10FFFF}]', '', 'g')) > 10000 then 'report.text.too-long' end as error_code, count(*) as n from documents group by 1",
    ),
    "normalize_value": (
        lambda s, d: _documents(s, d).select("doc_id", F.sha2(turkish.normalised("text"), 256).alias("digest")),
        f"select doc_id, sha256(trim(regexp_replace(translate(lower(translate(text, 'İI', 'iı')), '{turkish.APOSTROPHES + turkish.INVISIBLE}', ''''''''''''''), '[\\s\\p{{Z}}\\x1c-\\x1f]+', ' ', 'g'))) as digest from documents",
    ),
    "digit_numbers": (
        lambda s, d: _documents(s, d).select("doc_id", F.explode(turkish.digit_numbers("text")).alias("figure")).groupBy("doc_id", "figure").agg(F.count("*").alias("n")),
        f"select doc_id, figure, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '{DIGITS}')) as figure from documents) group by 1, 2",
    ),
    "numeric_dates": (
        lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("t")).withColumn("day", F.explode(turkish.numeric_dates("t"))).groupBy("day").agg(F.count("*").alias("n")),
        "select cast(o_orderdate as date) as day, count(*) as n from orders group by 1",
    ),
    "reporting_day": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy(turkish.reporting_day("ts").alias("day")).agg(F.count("*").alias("n")),
        "select cast(ts + interval 3 hour as date) as day, count(*) as n from events group by 1",
    ),
    "documents_numbers": (
        lambda s, d: extraction.scan(_submitted(s, d).withColumn("ref_date", F.lit(REF).cast("date"))).agg(F.sum(F.size("sentences")).alias("n_sentences"), F.sum(F.size("numbers")).alias("n_numbers"), F.sum(F.size("hits")).alias("n_hits")),
        None,
    ),
}


def queries() -> dict:
    out = {name: (lambda spark, sf_dir, f=f: f(from_events(spark, sf_dir))) for name, (f, _) in STAR_QUERIES.items()}
    out |= {name: (lambda spark, sf_dir, f=f: f(spark)) for name, (f, _) in LITERAL_QUERIES.items()}
    return out | {name: f for name, (f, _) in (TEXT_QUERIES | NOTICE_QUERIES).items()}


def oracles() -> dict[str, str]:
    return {name: sql for part in (STAR_QUERIES, LITERAL_QUERIES, TEXT_QUERIES, NOTICE_QUERIES) for name, (_, sql) in part.items() if sql}
