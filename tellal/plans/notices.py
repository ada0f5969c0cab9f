"""Queries that compose notices from the columns of orders, read them back, and know from the same
columns what must come out."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import MONTHS
from ..operators import extraction, highlight
from ..sources.reference_data import PROVINCES, provinces

# The number words, in order, and endings of place names.
ONES = ["", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"]
TENS = ["", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan"]
ENDINGS = ["'da", "'de", "'nde", "'un", "'ta"]

NAMES_SQL = f"p as (select unnest(range(1, {len(PROVINCES) + 1})) as code, unnest([{', '.join(repr(x) for x in PROVINCES)}]) as name)"


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """The rows that texts are made of, dealt out first, if need be by columns: reading a text costs far more than moving its row."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"), F.col("o_orderdate").cast("date").alias("d"))
    return dealt(rows)


def _one_of(values: list[str], index: Column | str) -> Column:
    """The value of an index from 0."""
    return F.get(F.array(*map(F.lit, values)), F.expr(index).cast("int") if isinstance(index, str) else index.cast("int"))


def _understood(rows: DataFrame, text: Column, day: Column | str, *parts: str) -> DataFrame:
    """k and what is understood of the text, read on a day, from parts of the scan."""
    reports = rows.select(F.col("k").cast("string").alias("raw_report_id"), text.alias("raw_text"), F.expr(day).alias("ref_date") if isinstance(day, str) else day.alias("ref_date"))
    return extraction.understood(extraction.scan(reports, parts=parts)).withColumn("k", F.col("raw_report_id").cast("long"))


def in_words(n: Column) -> Column:
    """A number from 1 to 999,999,999 in words."""

    def below_thousand(m: Column) -> Column:
        hundreds = F.floor(m / 100)
        return F.concat_ws(" ", F.when(hundreds == 1, "yüz").when(hundreds > 1, F.concat(_one_of(ONES, hundreds), F.lit(" yüz"))), F.nullif(_one_of(TENS, F.floor(m / 10) % 10), F.lit("")), F.nullif(_one_of(ONES, m % 10), F.lit("")))

    millions, thousands = F.floor(n / 1_000_000), F.floor(n / 1000) % 1000
    return F.concat_ws(
        " ", F.when(millions > 0, F.concat(below_thousand(millions), F.lit(" milyon"))),
        F.when(thousands == 1, "bin").when(thousands > 1, F.concat(below_thousand(thousands), F.lit(" bin"))),
        F.nullif(below_thousand(n % 1000), F.lit("")),
    )


def number_words_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number in words, one in digits with points, and one that is not a count."""
    n = (F.col("k") * 7919 + F.col("c") * 104_729) % 999_999_999 + 1
    grouped = F.replace(F.format_number("k", 0), F.lit(","), F.lit("."))
    text = F.concat(in_words(n), F.lit(" kişi yaralandı. Onlarca kişi ve "), grouped, F.lit(" araç E-80 karayolunda kaldı."))
    return _understood(_orders(spark, sf_dir), text, "d", "numbers").select("k", F.expr("array_join(transform(numbers, x -> cast(x.value as string)), ',')").alias("figures"))


NUMBER_WORDS_SQL = "select cast(o_orderkey as bigint) as k, ((o_orderkey * 7919 + o_custkey * 104729) % 999999999 + 1) || ',' || o_orderkey as figures from orders"


def dates_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order's day written in ten ways, read up to two years later."""
    month = _one_of(list(MONTHS), "month(d) - 1")
    ways = [
        F.date_format("d", "yyyy-MM-dd"), F.date_format("d", "dd.MM.yyyy"), F.concat_ws(" ", F.dayofmonth("d"), month, F.year("d")), F.concat(F.dayofmonth("d"), F.lit(" "), month, F.lit("'da")),
        *map(F.lit, ("dün", "önceki gün", "geçen hafta", "geçen ay", "bugün", "henüz")),
    ]
    text = F.concat(F.get(F.array(*ways), (F.col("k") % 10).cast("int")), F.lit(" Ankara'da kaza oldu."))
    read = _understood(_orders(spark, sf_dir), text, "date_add(d, cast((k * 31 + c) % 700 as int))", "hits")
    return read.select("k", F.expr("coalesce(day.date, ref_date)").alias("day"), F.expr("coalesce(day.source, 'DEFAULTED')").alias("source"))


DATES_SQL = """with o as (select cast(o_orderkey as bigint) as k, cast(o_orderdate as date) as d, cast(cast(o_orderdate as date) + cast((o_orderkey * 31 + o_custkey) % 700 as int) as date) as r from orders),
y as (select *, try_cast(year(r) || strftime(d, '-%m-%d') as date) as this_year, try_cast((year(r) - 1) || strftime(d, '-%m-%d') as date) as last_year from o),
f as (select *, case when k % 10 < 3 then d when k % 10 = 3 then case when this_year > r then last_year else this_year end when k % 10 = 4 then r - 1 when k % 10 = 5 then r - 2 when k % 10 = 6 then r - 7
  when k % 10 = 7 then cast(r - interval 1 month as date) when k % 10 = 8 then r end as found from y)
select k, coalesce(found, r) as day, case when found is null then 'DEFAULTED' when k % 10 < 4 then 'EXPLICIT' else 'RELATIVE' end as source from f"""


def places_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two places with endings, and a district of the name of a province, which is none."""
    first, second = _one_of(PROVINCES, "c % 81"), _one_of(PROVINCES, "(c + k) % 81")
    text = F.concat(first, _one_of(ENDINGS, "k % 5"), F.lit(" ve "), second, _one_of(ENDINGS, "c % 5"), F.lit(" kaza oldu. Aksaray ilçesinde yol kapandı."))
    return _understood(_orders(spark, sf_dir), text, "d", "hits").select("k", F.expr("array_join(transform(provs, p -> p.detail), ',')").alias("places"))


PLACES_SQL = "select cast(o_orderkey as bigint) as k, (o_custkey % 81 + 1) || ',' || ((o_custkey + o_orderkey) % 81 + 1) as places from orders"


def shared_records_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sentences in each of their six orders: two places with two figures each, and one they share."""
    rows = _orders(spark, sf_dir)
    first, second = _one_of(PROVINCES, "c % 81"), _one_of(PROVINCES, "(c + 1 + k % 80) % 81")
    figure = [F.expr(f"cast(2 + ({x}) % {m} as string)") for x, m in (("k", 50), ("c", 40), ("k + c", 30), ("k * 3", 20), ("c * 7", 90))]
    parts = [
        F.concat(F.lit("Son 24 saatte "), first, F.lit("'da "), figure[0], F.lit(", "), second, F.lit("'nde "), figure[1], F.lit(" trafik kazası meydana geldi.")),
        F.concat(first, F.lit("'da "), figure[2], F.lit(", "), second, F.lit("'nde ise "), figure[3], F.lit(" kişi kazalarda hayatını kaybetti.")),
        F.concat(F.lit("Her iki ilde toplam "), figure[4], F.lit(" kişi yaralı olarak hastaneye kaldırıldı.")),
    ]
    orders = [F.concat_ws(" ", *(parts[i] for i in order)) for order in permutations(range(3))]
    found, _ = extraction.extract(rows.select(F.col("k").cast("string").alias("raw_report_id"), F.get(F.array(*orders), (F.col("k") % 6).cast("int")).alias("raw_text"), F.col("d").alias("ref_date")), evidence=False)
    place = F.expr("if(province_scope = 'SHARED', array_join(transform(array_sort(shared_province_codes), x -> cast(x as string)), '+'), cast(province_code as string))")
    metric = F.expr("array_join(array_sort(transform(metrics, m -> concat(m.metric_type, '=', m.metric_value))), ',')")
    return found.select(F.col("raw_report_id").cast("long").alias("k"), "event_type", "occurred_on", "date_source", "province_scope", place.alias("place"), metric.alias("metrics"))


SHARED_RECORDS_SQL = """with o as (select cast(o_orderkey as bigint) as k, cast(o_custkey as bigint) as c, cast(o_orderdate as date) as d, o_custkey % 81 + 1 as p, (o_custkey + 1 + o_orderkey % 80) % 81 + 1 as q from orders),
r as (
  select k, d, 'SINGLE' as s, cast(p as varchar) as place, 'ACCIDENT_COUNT=' || (2 + k % 50) || ',DEATH=' || (2 + (k + c) % 30) as m from o
  union all select k, d, 'SINGLE', cast(q as varchar), 'ACCIDENT_COUNT=' || (2 + c % 40) || ',DEATH=' || (2 + (k * 3) % 20) from o
  union all select k, d, 'SHARED', least(p, q) || '+' || greatest(p, q), 'INJURED=' || (2 + (c * 7) % 90) from o)
select k, 'TRAFFIC_ACCIDENT' as event_type, d as occurred_on, 'RELATIVE' as date_source, s as province_scope, place, m as metrics from r"""


def _accident(rows: DataFrame) -> DataFrame:
    """One sentence with every kind of evidence; the double space and the curly apostrophe move what follows."""
    text = F.concat(F.lit("Dün  "), _one_of(PROVINCES, "c % 81"), F.lit("’da "), F.expr("cast(2 + k % 900 as string)"), F.lit(" kişi yaralandı; kaza sürüyor."))
    return rows.select(F.col("k").cast("string").alias("raw_report_id"), text.alias("raw_text"), F.col("d").alias("ref_date"))


def evidence_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the evidence of each order's record stands in its text."""
    found, _ = extraction.extract(_accident(_orders(spark, sf_dir)))
    shown = F.expr("array_join(array_sort(transform(keywords, x -> concat(x.role, ':', x.keyword, '@', x.char_start, '-', x.char_end))), ',')")
    return found.select(F.col("raw_report_id").cast("long").alias("k"), shown.alias("evidence"))


ACCIDENT_SQL = f"""with {NAMES_SQL},
t as (select cast(o_orderkey as bigint) as k, name || '’da' as place, 'Dün  ' || name || '’da ' || (2 + o_orderkey % 900) || ' kişi yaralandı; kaza sürüyor.' as text from orders join p on code = o_custkey % 81 + 1)
"""
EVIDENCE_SQL = ACCIDENT_SQL + """, e as (select *, strpos(text, 'kaza sürüyor') - 1 as x, strpos(text, 'yaralandı') - 1 as y from t)
select k, 'DATE:Dün@0-3,EVENT_TYPE:kaza@' || x || '-' || (x + 4) || ',METRIC:yaralandı@' || y || '-' || (y + 9) || ',PROVINCE:' || place || '@5-' || (5 + length(place)) as evidence from e"""


def highlights_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the evidence cuts each order's text into."""
    reports = _accident(_orders(spark, sf_dir))
    found, _ = extraction.extract(reports)
    spans = found.select("raw_report_id", F.transform("keywords", lambda x: F.struct(x["role"].alias("role"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end"))).alias("keywords"))
    texts = reports.join(spans, "raw_report_id").select(F.col("raw_report_id").cast("long").alias("id"), "raw_text", "keywords")
    return highlight.segments(texts).select("id", F.col("begin").cast("int").alias("starts"), "text", F.array_join("roles", ",").alias("roles"))


HIGHLIGHTS_SQL = ACCIDENT_SQL + """, w as (select k, ['Dün', '  ', place, text[6 + length(place) : strpos(text, 'yaralandı') - 1], 'yaralandı', '; ', 'kaza', ' sürüyor.'] as pieces from t),
n as (select k, pieces, unnest(range(1, 9)) as i from w)
select k as id, cast(length(array_to_string(pieces[1 : i - 1], '')) as int) as starts, pieces[i] as text, ['DATE', '', 'PROVINCE', '', 'METRIC', '', 'EVENT_TYPE', ''][i] as roles from n"""


def outcomes_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with and without a date and a known type, and absent ones: what each comes to."""
    day = F.when(F.expr("k % 2 = 0"), F.concat(F.date_format("d", "dd.MM.yyyy"), F.lit(" tarihinde ")))
    what = F.when(F.expr("k % 3 = 0"), "toplantı yapıldı.").otherwise("Ankara'da 15 yeni vaka tespit edildi.")
    text = F.when(F.expr("k % 7 > 0"), F.concat(F.coalesce(day, F.lit("")), what))
    _, outcome = extraction.extract(_orders(spark, sf_dir).select(F.col("k").cast("string").alias("raw_report_id"), text.alias("raw_text"), F.col("d").alias("ref_date")))
    return outcome.select(F.col("raw_report_id").cast("long").alias("k"), "status", "failure_reason", F.array_join("warnings", "|").alias("warnings"))


OUTCOMES_SQL = f"""select cast(o_orderkey as bigint) as k, case when o_orderkey % 7 = 0 then 'FAILED' else 'ANALYZED' end as status, case when o_orderkey % 7 = 0 then 'ValueError: text must not be null' end as failure_reason,
  case when o_orderkey % 7 = 0 then '' else concat_ws('|', case when o_orderkey % 2 = 1 then '{extraction.DATE_ASSUMED}' end, case when o_orderkey % 3 = 0 then '{extraction.NOT_RECOGNISED}' end) end as warnings from orders"""


def sentences_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with abbreviations, decimals and addresses, which end none."""
    text = F.expr("concat('Dr. ', c, ' geldi. Tutar ', k, ',5 lira! Bkz. www.ornek', k, '.gov… ', 'son ', d, '?')")
    return _understood(_orders(spark, sf_dir), text, "d", "sentences").select("k", F.expr("array_join(transform(sentences, x -> substring(value, x.begin + 1, x.end - x.begin)), '|')").alias("parts"))


SENTENCES_SQL = "select cast(o_orderkey as bigint) as k, 'dr. ' || o_custkey || ' geldi.|tutar ' || o_orderkey || ',5 lira!|bkz. www.ornek' || o_orderkey || '.gov…|son ' || cast(o_orderdate as date) || '?' as parts from orders"


def provinces_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every province of the library by code, with the customers that live there."""
    live = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy((F.col("c_custkey") % 81 + 1).cast("int").alias("code")).agg(F.count("*").alias("n"))
    return provinces(spark).select(F.col("code").cast("int").alias("code"), "name").join(live, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))


PROVINCES_SQL = f"with {NAMES_SQL}, c as (select c_custkey % 81 + 1 as code, count(*) as n from customer group by 1) select cast(code as int) as code, name, coalesce(n, 0) as n from p left join c using (code)"

NOTICE_QUERIES = {
    "number_words_of_orders": (number_words_of_orders, NUMBER_WORDS_SQL),
    "dates_of_orders": (dates_of_orders, DATES_SQL),
    "places_of_orders": (places_of_orders, PLACES_SQL),
    "shared_records_of_orders": (shared_records_of_orders, SHARED_RECORDS_SQL),
    "evidence_of_orders": (evidence_of_orders, EVIDENCE_SQL),
    "highlights_of_orders": (highlights_of_orders, HIGHLIGHTS_SQL),
    "outcomes_of_orders": (outcomes_of_orders, OUTCOMES_SQL),
    "sentences_of_orders": (sentences_of_orders, SENTENCES_SQL),
    "provinces_of_customers": (provinces_of_customers, PROVINCES_SQL),
}
