"""Turkish text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Apostrophe look-alikes, and invisible characters that are deleted.
APOSTROPHES = "\u2018\u2019\u02bc\u00b4\u2032\u0060"
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad"
SPACES = r"[\s\p{Z}\x1c-\x1f]+"


def lower(text: Column | str) -> Column:
    """Lower case with dotted and dotless i kept apart."""
    c = F.col(text) if isinstance(text, str) else text
    return F.lower(F.translate(c, "İI", "iı"))


def normalised(text: Column | str) -> Column:
    """Folded, lower-cased, with single spaces; for text that is composed (NFC) already."""
    folded = F.translate(lower(text), APOSTROPHES + INVISIBLE, "'" * len(APOSTROPHES))
    return F.trim(F.regexp_replace(folded, SPACES, " "))


def reporting_day(at: Column | str, zone: str = "Europe/Istanbul") -> Column:
    """The day, in a zone, on which an instant of a UTC session falls."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def digit_numbers(text: Column | str) -> Column:
    """Figures as written: digits with thousands dots, or digits with a decimal comma."""
    return F.regexp_extract_all(text, F.lit(r"[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+(?:,[0-9]+)?"), F.lit(0))


def numeric_dates(text: Column | str) -> Column:
    """Day-first and ISO dates as written that are days of the calendar."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}"), F.lit(0))

    def day(x: Column) -> Column:
        p = F.split(x, "[./-]")
        iso = F.length(p[0]) == 4
        parts = [F.when(iso, p[k]).otherwise(p[2 - k]).cast("int") for k in range(3)]
        return F.try_to_date(F.format_string("%04d-%02d-%02d", *parts), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.try_to_timestamp(F.format_string("%04d-%02d-%02d", *parts), F.lit("yyyy-MM-dd")).cast("date")

    return F.filter(F.transform(found, day), lambda d: d.isNotNull())
