"""Date expressions.

Free-text dates are read by an ordered list of formats.  Missing parts are
filled from ``as_of``, which is always an explicit argument.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from . import vocab as V
from .text import contains_any, let, strip, text

MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
RANGE = r"[\s\p{Z}]+[-–—][\s\p{Z}]+|[\s\p{Z}]+to[\s\p{Z}]+|[–—]"

# (pattern, group of year, group of month, group of day); 0 = fill from as_of.
FORMATS = [
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", 1, 2, 3),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", 1, 2, 3),
    (rf"(?:^|[^a-z]){MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})", 3, 1, 2),
    (rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+{MONTH},?\s+(\d{{4}})", 3, 2, 1),
    (r"(?:^|[^\d])(\d{1,2})/(\d{1,2})/(\d{4})", 3, 1, 2),
    (rf"(?:^|[^a-z]){MONTH},?\s+(\d{{4}})", 2, 1, 0),
    (rf"(?:^|[^a-z]){MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:[^\d]|$)", 0, 1, 2),
    (rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+{MONTH}(?:[^a-z]|$)", 0, 2, 1),
]


# A text that is nothing but a date.
WHOLE_DATE = (r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
              r"|\d+(?:st|nd|rd|th)?|am|pm|utc|gmt|[tz]|[\s,.:/+-]+)+$")


def as_date(as_of: str | date) -> date:
    return as_of if isinstance(as_of, date) else date.fromisoformat(as_of)


def build_date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def lenient_date(c: Column, as_of: str | date) -> Column:
    """A date somewhere in the text; the first format that matches decides."""
    now = as_date(as_of)

    def spell(low: Column) -> Column:
        found = []
        for pattern, gy, gm, gd in FORMATS:
            to = f"{f'${gy}' if gy else now.year}-${gm}-{f'${gd}' if gd else now.day}"
            found.append(F.nullif(F.regexp_replace(F.regexp_extract(low, pattern, 0), pattern, to), F.lit("")))
        return F.split(F.regexp_replace(F.coalesce(*found), r"\A[^\da-z]+", ""), "-")

    def read(parts: Column) -> Column:
        month = F.get(parts, F.lit(1))
        named = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), month) + 2) / 3
        number = F.when(month.rlike("^[a-z]"), named.cast("int").cast("string")).otherwise(month)
        return build_date(F.get(parts, F.lit(0)), number, F.get(parts, F.lit(2)))

    return let(let(F.lower(c), spell), read)


def range_end(c: Column) -> Column:
    """The text after the last range separator; hyphens inside dates do not split."""
    return strip(F.element_at(F.split(c, RANGE), -1))


def iso_date(c: Column) -> Column:
    p = r"\A\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*\z"
    return build_date(F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2), F.regexp_extract(c, p, 3))


def parse_claimed_date(c: Column | str, as_of: str | date) -> Column:
    """Date claimed by a source; null for words such as 'rolling'."""
    def read(s: Column) -> Column:
        free = F.coalesce(lenient_date(range_end(s), as_of), lenient_date(s, as_of))
        return (F.when((s == "") | contains_any(F.lower(s), V.CLAIM_NON_DATE), F.lit(None).cast("date"))
                .when(s.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), iso_date(s))
                .otherwise(free))

    return let(strip(text(c)), read)


def parse_published_date(c: Column | str, as_of: str | date) -> Column:
    """Date given by a publisher: ISO prefix, else a whole date text."""
    return let(strip(text(c)), lambda s: (
        F.when(s.rlike(r"\A\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
        .when(s.rlike(WHOLE_DATE), lenient_date(s, as_of))))


def latest_year(c: Column, pattern: str) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda y: y.cast("int")))


def is_past(c: Column | str, as_of: str | date) -> Column:
    """Whether a deadline text says that the thing is over."""
    now = as_date(as_of)

    def read(raw: Column) -> Column:
        s, trimmed = F.lower(raw), strip(raw)
        when = F.when(trimmed.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), iso_date(trimmed)).otherwise(lenient_date(range_end(raw), as_of))
        return (F.when((raw == "") | contains_any(s, V.NEVER_PAST), F.lit(False))
                .when(latest_year(s, r"\b(202[0-9])\b") < now.year, F.lit(True))
                .when(contains_any(s, V.PAST_WORDS), F.lit(True))
                .otherwise(F.coalesce(when < F.lit(now), F.lit(False))))

    return let(text(c), read)


def day(c: Column) -> Column:
    """ISO text of a date, '' when missing."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
