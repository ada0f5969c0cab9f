"""From raw texts to records: one scan in Python, what it implies in column expressions.

A report's hits stay in its row as arrays, so dates and the assembly of records need no shuffle, and nothing is
copied for each number of a text. What stands nearest to a number is looked up where the sorted spans are, in the scan.
"""

from __future__ import annotations

import gc
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Collection, Iterator
from contextlib import contextmanager
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import BETWEEN, MONTHS, NUMBER_HINT, Scanner, Together, moved, normalise, normalised, numbers, sentences
from ..sources.catalog import OTHER, Catalog, load_catalog
from ..sources.reference_data import PROVINCES

DATE_ASSUMED = "No date was found in the text; the submission date was used."
NOT_RECOGNISED = "No known event type matched this text. It was stored as OTHER and can be reprocessed once the catalog recognises it."
LONGEST_REASON = 1024
#: Characters of two UTF-16 units.
WIDE = re.compile("[\U00010000-\U0010ffff]")
SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
NUMBER = pa.struct([("value", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("notation", pa.string())])
HIT = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("ord", pa.int32()), ("kind", pa.string()), ("key", pa.string()), ("detail", pa.string()), ("raw", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())])
#: What a number counts: the event type, whether provinces share it, else the province, the metric and its evidence;
#: dated: whether the number lies in a relative date (1) or one of the calendar (2).
LINK = pa.struct([
    ("type", pa.string()), ("shared", pa.bool_()), ("code", pa.int16()), ("fits", pa.bool_()), ("value", pa.int64()), ("metric", pa.string()), ("raw", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()),
    ("begin", pa.int32()), ("end", pa.int32()), ("dated", pa.int32()),
])
#: Rows and bytes of text, about, that are held as Python objects at once: Spark's batches may hold 10,000 long texts.
PIECE_ROWS, PIECE_BYTES = 500, 1 << 20
#: How many pieces are searched without a hint that left nearly all texts of the last one.
PIECES_WITHOUT_HINT = 50
#: What a scan looks for.
PARTS = ("sentences", "numbers", "hits")
SCANNED = (
    "raw_report_id string, ref_date date, value string, sentences array<struct<begin:int,end:int>>, numbers array<struct<value:bigint,begin:int,end:int,notation:string>>, "
    "hits array<struct<begin:int,end:int,ord:int,kind:string,key:string,detail:string,raw:string,char_start:int,char_end:int>>, failure_reason string, types array<string>, "
    "links array<struct<type:string,shared:boolean,code:smallint,fits:boolean,value:bigint,metric:string,raw:string,char_start:int,char_end:int,begin:int,end:int,dated:int>>"
)
CALENDAR = ("ISO", "NUMERIC", "NAMED")
#: Hits that records are made of; those of metrics and markers are in the links.
SHOWN = ("DATE", "PROVINCE", "EVENT_TYPE")


def sourced(raw: str, value: str, hits: list[tuple]) -> list[tuple]:
    """The hits with what stands there in the source and where (UTF-16 units)."""
    by = moved(raw, value)
    _, begin, end = normalise(raw) if by is None else (None, None, None)
    wide = [m.start() for m in WIDE.finditer(raw)] if WIDE.search(raw) else None
    out = []
    for h in hits:
        a, b = (h[0] + by, h[1] + by) if by is not None else (begin[h[0]], end[h[1] - 1])
        out.append((*h, raw[a:b], a + bisect_left(wide, a), b + bisect_left(wide, b)) if wide else (*h, raw[a:b], a, b))
    return out


def read_together(scanner: Scanner, texts: list[str], values: list[str], parts: Collection[str], all_metrics: bool) -> list[tuple[list[tuple], list[tuple], list[tuple]]]:
    """The fields of each text's sentences, numbers and hits; the patterns go over all texts at once. Hints leave
    texts out of the search; where a hit stands in the source is looked up for hits alone."""
    array, every = pa.array(values, pa.string()), range(len(values))

    def left(kind: str, hint: str) -> list[int]:
        """The texts that a hint leaves. One that left nearly all is not asked for the next pieces."""
        if scanner.idle.get(kind, 0) > 0:
            scanner.idle[kind] -= 1
            return list(every)
        some = [k for k, there in zip(every, pc.match_substring_regex(array, hint).to_pylist()) if there]
        scanner.idle[kind] = PIECES_WITHOUT_HINT if len(some) > 0.9 * len(values) > 9 else 0
        return some

    found, counted = {}, defaultdict(list)
    if "hits" in parts:
        asked = {kind: some for kind, hint in scanner.hints.items() if (some := left(kind, hint))}
        found = scanner.hits_of(values, asked, all_metrics) if asked else {}
        found = {k: sourced(texts[k], values[k], hits) for k, hits in found.items()}
    if "numbers" in parts and (some := left("NUMBER", NUMBER_HINT)):
        together = Together([values[k] for k in some], some)
        for n, a, b, notation in numbers(together.text):
            k = bisect_right(together.starts, a) - 1
            counted[some[k]].append((n, a - together.starts[k], b - together.starts[k], notation))
    return [(sentences(value) if "sentences" in parts else [], counted.get(k, []), found.get(k, [])) for k, value in enumerate(values)]


def read_texts(scanner: Scanner, texts: list[str | None], parts: Collection[str] = PARTS, all_metrics: bool = True) -> tuple[pa.Array, list[tuple], list[str | None]]:
    """The normalised texts, the sentences, numbers and hits of each, and why a text could not be read."""
    values, rows, failures = [None] * len(texts), [(None, None, None)] * len(texts), [None] * len(texts)

    def failed(k: int, e: Exception) -> None:
        values[k], failures[k] = None, f"{type(e).__name__}: {e}"[:LONGEST_REASON]

    for k, raw in enumerate(texts):
        try:  # one report's failure must not stop the others
            if raw is None:
                raise ValueError("text must not be null")
            values[k] = normalised(raw)
        except Exception as e:
            failed(k, e)
    whole = [k for k, value in enumerate(values) if value is not None]
    groups = [[k for k in whole if BETWEEN not in values[k]], *([k] for k in whole if BETWEEN in values[k])]
    while groups:
        group = groups.pop()
        try:
            for k, row in zip(group, read_together(scanner, [texts[k] for k in group], [values[k] for k in group], parts, all_metrics) if group else ()):
                rows[k] = row
        except Exception as e:
            if len(group) == 1:
                failed(group[0], e)
            else:  # some text among them cannot be read: each by itself
                groups += ([k] for k in group)
    return pa.array(values, pa.string()), rows, failures


def ranked_types(hits: list[tuple]) -> list[str]:
    """Event types with a trigger in the text: most triggers, then longest evidence, then catalog order."""
    triggers, length = defaultdict(set), defaultdict(int)
    for h in hits:
        if h[3] == "EVENT_TYPE":
            triggers[h[2], h[4]].add(h[5])
            length[h[2], h[4]] += len(h[6])
    return [key for _, key in sorted(triggers, key=lambda t: (-len(triggers[t]), -length[t], t[0]))]


class Spans:
    """Sorted spans, and whether one of them overlaps another span."""

    def __init__(self, hits: list[tuple]):
        self.begin, self.end = sorted(h[0] for h in hits), sorted(h[1] for h in hits)

    def overlap(self, begin: int, end: int) -> bool:
        return bisect_left(self.begin, end) != bisect_right(self.end, begin)


def links_of(length: int, ends: list[tuple], counts: list[tuple], hits: list[tuple], types: list[str]) -> list[tuple]:
    """What each number counts: as-of look-ups of what stands next to it in its sentence, on sorted spans. Numbers in
    markers count nothing."""
    if not counts or not types:
        return []
    kinds, metrics = defaultdict(list), {t: {} for t in types}
    for h in hits:
        if h[3] != "METRIC":
            kinds[h[3] if h[3] != "DATE" else "CALENDAR" if h[4] in CALENDAR else "RELATIVE"].append(h)
        elif (own := metrics.get(h[4])) is not None and (h[0] not in own or own[h[0]][2] > h[2]):
            own[h[0]] = h  # of those that begin at one place, the first of the catalog
    listed = [(t, own, sorted(own)) for t, own in metrics.items() if own]
    if not listed:
        return []
    places, markers = sorted(kinds["PROVINCE"]), sorted(kinds["MARKER"])
    place_begins, marker_begins, sentence_begins = [p[0] for p in places], [m[0] for m in markers], [s[0] for s in ends]
    codes = {p[5] for p in places}
    sole = int(next(iter(codes))) if len(codes) == 1 else None
    marked, relative, calendar = (Spans(kinds[kind]) if kind in kinds else None for kind in ("MARKER", "RELATIVE", "CALENDAR"))
    out = []
    for value, a, b, _ in counts:
        if marked and marked.overlap(a, b):
            continue
        k = bisect_right(sentence_begins, a)
        begin, end = ends[k - 1] if k and a < ends[k - 1][1] else (0, max(1, length))
        for event, own, begins in listed:
            if (k := bisect_left(begins, b)) < len(begins) and begins[k] < end:
                hit = own[begins[k]]
                break
            if (k := bisect_left(begins, a)) and begins[k - 1] >= begin:
                hit = own[begins[k - 1]]
                break
        else:
            continue
        k = bisect_left(marker_begins, begin)
        shared = len(codes) > 1 and k < len(markers) and markers[k][1] <= end
        k = bisect_left(place_begins, a)
        if shared:
            code = None
        elif k and place_begins[k - 1] >= begin:
            code = int(places[k - 1][5])
        elif k < len(places) and place_begins[k] < end:
            code = int(places[k][5])
        else:
            code = sole
        dated = 2 if calendar and calendar.overlap(a, b) else 1 if relative and relative.overlap(a, b) else 0
        out.append((event, shared, code, -(2**31) <= value < 2**31, value, hit[5], hit[6], hit[7], hit[8], a, b, dated))
    return out


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, min(PIECE_ROWS, batch.num_rows * PIECE_BYTES // max(1, batch.column("raw_text").nbytes)))
    return (batch.slice(k, step) for k in range(0, batch.num_rows, step))


def listed(rows: tuple[list[tuple] | None, ...], kind: pa.StructType) -> pa.Array:
    """Each row's tuples as structs, made column by column."""
    flat = [x for row in rows if row for x in row]
    columns = zip(*flat) if flat else [()] * kind.num_fields
    held = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
    ends = accumulate((len(row or ()) for row in rows), initial=0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held, mask=pa.array([row is None for row in rows], pa.bool_()))


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for cycles: a piece makes many tuples and no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def scan(reports: DataFrame, catalog: Catalog | None = None, provinces: dict[int, str] | None = None, parts: Collection[str] = PARTS, brief: bool = False, evidence: bool = True) -> DataFrame:
    """reports: raw_report_id, raw_text, ref_date. One row per report with what its text holds; a text
    that cannot be read has a failure_reason and nothing else. Of sentences, numbers and hits only the parts asked
    for are looked for; the others are empty, and links, which need all of them, too. brief: hands on only what records
    and outcomes are made of; without evidence, not where it stands either."""
    catalog, provinces = catalog or load_catalog(), provinces or dict(enumerate(PROVINCES, 1))
    Scanner(catalog, provinces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(catalog, provinces)
        for batch in (piece for whole in batches for piece in pieces(whole)):
            with uncollected():
                value, rows, failures = read_texts(scanner, batch.column("raw_text").to_pylist(), parts, not brief)
                lengths = pc.utf8_length(value).to_pylist()
                types = [None if hits is None else ranked_types(hits) for _, _, hits in rows]
                links = [None if hits is None else links_of(n, sent, num, hits, of) for n, (sent, num, hits), of in zip(lengths, rows, types)]
                if brief:
                    value = pa.nulls(len(rows), pa.string())
                    shown = SHOWN if evidence else ("DATE", "PROVINCE")
                    rows = [row if row[2] is None else ([], [], [h for h in row[2] if h[3] in shown]) for row in rows]
                if not evidence:  # as narrow as it can be
                    rows = [row if row[2] is None else (*row[:2], [(*h[:6], None, None, None) for h in row[2]]) for row in rows]
                    links = [row and [(*x[:6], None, None, None, *x[9:]) for x in row] for row in links]
                sent, num, hits = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("raw_report_id"), batch.column("ref_date"), value, listed(sent, SPAN), listed(num, NUMBER), listed(hits, HIT), pa.array(failures, pa.string()), pa.array(types, pa.list_(pa.string())), listed(links, LINK)],
                ["raw_report_id", "ref_date", "value", "sentences", "numbers", "hits", "failure_reason", "types", "links"],
            )

    return reports.select("raw_report_id", "raw_text", "ref_date").mapInArrow(run, SCANNED)


def of_kind(kind: str) -> Column:
    return F.expr(f"filter(hits, h -> h.kind = '{kind}')")


def _day(year: str, month: str, day: str) -> str:
    return f"try_to_date(format_string('%04d-%02d-%02d', {year}, {month}, {day}), 'yyyy-MM-dd')"


def date_mentions() -> Column:
    """Dates named in the text, by position; days that the calendar does not have are none."""
    part = [f"try_cast(split(h.detail, '[|]')[{k}] as int)" for k in range(3)]
    months = ", ".join(f"'{m}'" for m in MONTHS)
    month = f"cast(array_position(array({months}), split(h.detail, '[|]')[1]) as int)"
    named = f"coalesce({part[2]}, year(ref_date))"
    this_year = _day(named, month, part[0])
    date = f"""CASE h.key
        WHEN 'ISO' THEN {_day(*part)}
        WHEN 'NUMERIC' THEN {_day(f"if({part[2]} < 100, 2000 + {part[2]}, {part[2]})", part[1], part[0])}
        WHEN 'NAMED' THEN if({part[2]} is null and {this_year} > ref_date, {_day("year(ref_date) - 1", month, part[0])}, {this_year})
        WHEN '-2d' THEN date_add(ref_date, -2) WHEN '-7d' THEN date_add(ref_date, -7)
        WHEN '-1d' THEN date_add(ref_date, -1) WHEN '-1m' THEN add_months(ref_date, -1) ELSE ref_date END"""
    mention = f"named_struct('begin', h.begin, 'ord', h.ord, 'end', h.end, 'date', {date}, 'source', if(h.key in ('ISO', 'NUMERIC', 'NAMED'), 'EXPLICIT', 'RELATIVE'), 'raw', h.raw, 'char_start', h.char_start, 'char_end', h.char_end)"
    return F.expr(f"array_sort(filter(transform(filter(hits, h -> h.kind = 'DATE'), h -> {mention}), d -> d.date is not null))")


def rank(keys: str, points: str, equal: bool = False) -> str:
    """SQL for how many of the points are less than (or equal to) each of the ascending keys: both are
    sorted together, and a key's place there, less the keys before it, is its rank."""
    key, point = (1, 0) if equal else (0, 1)
    both = f"sort_array(concat(transform({keys}, (a, i) -> named_struct('at', a, 'side', {key}, 'i', i)), transform({points}, a -> named_struct('at', a, 'side', {point}, 'i', -1))))"
    return f"transform(filter(transform({both}, (y, j) -> named_struct('i', y.i, 'j', j)), y -> y.i >= 0), (y, i) -> y.j - i)"


def given_once(values: dict[str, str], body: str, name: str = "w") -> str:
    """SQL for the body, in which name.x is the value of x. Each is evaluated once a row, also where the body
    looks into it from a lambda; a column would be put in its place there and evaluated once an element."""
    struct = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"element_at(transform(array(named_struct({struct})), {name} -> {body}), 1)"


def understood(scanned: DataFrame) -> DataFrame:
    """Adds the date, provinces and what the countable numbers are given to (type, place, metric) to scanned rows."""
    rows = scanned.withColumn("dates", date_mentions()).withColumn("provs", of_kind("PROVINCE"))
    rows = rows.withColumn("day", F.expr("coalesce(try_element_at(filter(dates, d -> d.source = 'EXPLICIT'), 1), try_element_at(dates, 1))"))
    rows = rows.withColumn("codes", F.expr("array_distinct(transform(provs, p -> cast(p.detail as smallint)))"))
    # whether a figure is part of a date is open where the calendar may not have the day
    free = given_once({"opened": rank("transform(v.l, n -> n.end)", "transform(v.d, s -> s.begin)"), "closed": rank("transform(v.l, n -> n.begin)", "transform(v.d, s -> s.end)", equal=True)}, "filter(v.l, (n, k) -> w.opened[k] = w.closed[k])")
    counted = "filter(links, l -> l.dated <> 1 or ref_date is null)"
    rows = rows.withColumn("links", F.expr(f"if(exists(links, l -> l.dated > 0), {counted}, links)"))
    rows = rows.withColumn("links", F.expr(f"if(exists(links, l -> l.dated > 0), {given_once({'l': 'links', 'd': 'dates'}, free, 'v')}, links)"))
    sole = "if(size(codes) = 1, codes[0], cast(null as smallint))"
    given = "named_struct('type', l.type, 'shared', l.shared, 'code', l.code, 'fits', l.fits, 'value', l.value, 'metric', l.metric, 'raw', l.raw, 'char_start', l.char_start, 'char_end', l.char_end)"
    bare = f"named_struct('type', t, 'shared', false, 'code', {sole}, 'fits', false, 'value', 0L, 'metric', cast(null as string), 'raw', cast(null as string), 'char_start', cast(null as int), 'char_end', cast(null as int))"
    silent = f"transform(if(size(types) = 0, array('{OTHER}'), array_except(types, transform(links, l -> l.type))), t -> {bare})"
    return rows.withColumn("given", F.expr(f"concat(transform(links, l -> {given}), {silent})"))


KEYWORD = "struct<keyword:string,role:string,char_start:int,char_end:int>"


def records(rows: DataFrame) -> DataFrame:
    """One row per record of each report: its date, scope, type, metrics and evidence, by ordinal. A
    record is one event type in one place; its attributions are picked out within the report's row."""
    key = "named_struct('type', x.type, 'shared', x.shared, 'code', x.code)"
    same = "x.type = k.type and x.shared = k.shared and x.code <=> k.code"
    counted = "filter(given, x -> %s and x.fits and x.metric is not null)" % same
    metrics = "transform(array_distinct(transform(w.c, x -> x.metric)), m -> named_struct('metric_type', m, 'metric_value', aggregate(filter(w.c, x -> x.metric = m), 0L, (n, x) -> n + x.value)))"
    word = "named_struct('keyword', {x}.raw, 'role', '{r}', 'char_start', {x}.char_start, 'char_end', {x}.char_end)"
    evidence = [
        f"transform(w.c, x -> {word.format(x='x', r='METRIC')})",
        f"if(day is null, cast(array() as array<{KEYWORD}>), array({word.format(x='day', r='DATE')}))",
        f"transform(filter(provs, p -> k.shared or cast(p.detail as smallint) = k.code), p -> {word.format(x='p', r='PROVINCE')})",
        f"transform(filter(hits, h -> h.kind = 'EVENT_TYPE' and h.key = k.type), h -> {word.format(x='h', r='EVENT_TYPE')})",
    ]
    body = given_once({"c": counted}, f"named_struct('ordinal', i, 'k', k, 'metrics', {metrics})")
    few = rows.where("failure_reason is null").select("*", F.size("types").alias("n_types"), F.expr(f"array_distinct(transform(given, x -> {key}))").alias("keys"))
    words = given_once({"c": counted}, f"concat({', '.join(evidence)})")
    few = few.select("raw_report_id", "ref_date", "day", "codes", "n_types", F.expr(f"transform(keys, (k, i) -> {body})").alias("made"), F.expr(f"transform(keys, k -> {words})").alias("words"))
    # the evidence is a column by itself, which is not made where it is not read;
    # a plain explode would have the optimiser test the size of the whole expression beforehand, spelled out on the
    # scanned columns, where every step that is used twice is computed twice; no report is without a record
    each = few.select("raw_report_id", "ref_date", "day", "codes", "n_types", "words", F.explode_outer("made").alias("r"))
    return each.select(
        "raw_report_id", F.col("r.ordinal").cast("int").alias("ordinal"), F.coalesce("day.date", "ref_date").alias("occurred_on"), F.coalesce("day.source", F.lit("DEFAULTED")).alias("date_source"),
        F.expr("CASE WHEN r.k.shared THEN 'SHARED' WHEN r.k.code is null THEN 'UNKNOWN' ELSE 'SINGLE' END").alias("province_scope"), F.col("r.k.code").alias("province_code"),
        F.expr("if(r.k.shared, array_sort(codes), cast(array() as array<smallint>))").alias("shared_province_codes"), F.col("r.k.type").alias("event_type"),
        F.when(F.col("n_types") == 0, "UNCLASSIFIED").otherwise("CLASSIFIED").alias("classification"), F.col("r.metrics").alias("metrics"), F.expr("words[r.ordinal]").alias("keywords"),
    )


def outcomes(rows: DataFrame) -> DataFrame:
    """One row per report: its status, failure reason and warnings."""
    warned = F.filter(F.array(F.when(F.col("day").isNull(), DATE_ASSUMED), F.when(F.size("types") == 0, NOT_RECOGNISED)), lambda w: w.isNotNull())
    failed = F.col("failure_reason").isNotNull()
    return rows.select("raw_report_id", F.when(failed, "FAILED").otherwise("ANALYZED").alias("status"), "failure_reason", F.when(failed, F.array().cast("array<string>")).otherwise(warned).alias("warnings"))


def extract(reports: DataFrame, catalog: Catalog | None = None, provinces: dict[int, str] | None = None, evidence: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, outcomes) of reports: raw_report_id, raw_text, ref_date. Without evidence, records have no keywords."""
    rows = understood(scan(reports, catalog, provinces, brief=True, evidence=evidence))
    found = records(rows)
    return found if evidence else found.drop("keywords"), outcomes(rows)
