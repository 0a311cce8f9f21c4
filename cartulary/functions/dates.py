"""Date columns: a cascade of layouts, dates near labels, and chronological repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and abbreviations in two languages, and forms with a digit read for a letter.
MONTHS = {
    "ENERO": 1, "FEBRERO": 2, "MARZO": 3, "ABRIL": 4, "MAYO": 5, "JUNIO": 6,
    "JULIO": 7, "AGOSTO": 8, "SEPTIEMBRE": 9, "OCTUBRE": 10, "NOVIEMBRE": 11, "DICIEMBRE": 12,
    "ENE": 1, "FEB": 2, "MAR": 3, "ABR": 4, "MAY": 5, "JUN": 6,
    "JUL": 7, "AGO": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DIC": 12,
    "JAN": 1, "APR": 4, "AUG": 8, "DEC": 12,
    "ENER0": 1, "FEBRER0": 2, "MARZ0": 3, "ABR1L": 4, "AGOST0": 8, "0CTUBRE": 10,
}


def month_number(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair]), name)


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _by(text: Column, pattern: str, year: int, month: int, day: int, named: bool) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i)
    m = month_number(part(month)) if named else part(month)
    return F.when(text.rlike(pattern) & m.isNotNull(), calendar_date(part(year), m, part(day)))


def parse_date(value: Column) -> Column:
    """A date by the first layout that gives a day of the calendar.

    Year-month-day and day-month-year in digits as the whole text; then anywhere in it day month-name year
    with separators, the same run together, month-name day year, and day DE month DE year.
    """
    text = F.upper(F.trim(value))
    # fixed values: the six layouts, in their order
    layouts = [
        (r"^([0-9]{4})[/\-.]([0-9]{1,2})[/\-.]([0-9]{1,2})$", 1, 2, 3, False),
        (r"^([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{4})$", 3, 2, 1, False),
        (r"\b([0-9]{1,2})[\s/\-.]([A-Z]{3,4})[\s/\-.]([0-9]{4})\b", 3, 2, 1, True),
        (r"\b([0-9]{1,2})([A-Z]{3,4})([0-9]{4})\b", 3, 2, 1, True),
        (r"\b([A-Z]{3,4})[\s/\-.]([0-9]{1,2})[\s/\-.]([0-9]{4})\b", 3, 1, 2, True),
        (r"([0-9]{1,2})\s+DE\s+([A-Z0-9ÁÉÍÓÚ]+)\s+DE\s+([0-9]{4})", 3, 2, 1, True),
    ]
    return F.coalesce(*[_by(text, *layout) for layout in layouts])


def compact_date(value: Column) -> Column:
    """A date at the start of a text such as 05 MAY 1987 or 5MAY1987; full stops and commas don't count."""
    return _by(F.upper(F.trim(F.translate(value, ".,", ""))), r"^([0-9]{1,2})\s*([A-Z]{3})[A-Z]*\s*([0-9]{4})", 3, 2, 1, True)


def plausible(date: Column, first_year: int = 1930, last_year: int = 2026) -> Column:
    return F.when(F.year(date).between(first_year, last_year), date)


def rescued_month(value: Column) -> Column:
    """A date whose month can't be read, as 24-???-2001, in January."""
    pattern = r"^([0-9]{1,2})-[^0-9A-Z]{3}-([0-9]{4})$"
    return F.when(value.rlike(pattern), calendar_date(F.regexp_extract(value, pattern, 2), F.lit("01"), F.regexp_extract(value, pattern, 1)))


def in_order(birth: Column, issue: Column) -> Column:
    """struct<birth_date, issue_date>: swapped where birth follows issue."""
    wrong = birth.isNotNull() & issue.isNotNull() & (birth > issue)
    return F.struct(F.when(wrong, issue).otherwise(birth).alias("birth_date"), F.when(wrong, birth).otherwise(issue).alias("issue_date"))


def from_all_dates(dates: Column, pivot_year: int = 2010) -> Column:
    """struct<birth_date, issue_date> of all dates on a document.

    Two or more: the first and the last. A single one is a birth up to the pivot year, else an issue.
    """

    def assigned(known: Column) -> Column:
        first, last, n = F.get(known, 0), F.get(known, F.size(known) - 1), F.size(known)
        early = F.year(first) <= pivot_year
        return F.struct(F.when((n > 1) | early, first).alias("birth_date"), F.when(n > 1, last).when(~early, first).alias("issue_date"))

    # in an array of one, so that the dates are made once
    return F.transform(F.array(F.array_sort(F.array_distinct(F.filter(dates, lambda d: d.isNotNull())))), assigned)[0]


def dates_of(text: Column) -> Column:
    """All dates in a text, in any layout that the cascade finds within a line."""
    pattern = r"([0-9]{4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,2}|[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{4}|[0-9]{1,2}[ /\-.]?[A-Z]{3,4}[ /\-.]?[0-9]{4}|[A-Z]{3,4}[ /\-.][0-9]{1,2}[ /\-.][0-9]{4})"
    return F.filter(F.transform(F.regexp_extract_all(F.upper(text), F.lit(pattern), F.lit(1)), parse_date), lambda d: d.isNotNull())


def date_near(lines: Column, keywords: Sequence[str], ahead: int = 2) -> Column:
    """The date on the line of a keyword, or on one of the next lines; the first keyword counts first."""

    def after(keyword: str) -> Column:
        hits = F.transform(lines, lambda line, i: F.when(F.upper(line).contains(keyword), i))
        at = F.get(F.filter(hits, lambda i: i.isNotNull()), 0)
        return F.when(at.isNotNull(), F.get(F.flatten(F.transform(F.slice(lines, F.coalesce(at, F.lit(0)) + 1, ahead + 1), dates_of)), 0))

    return F.coalesce(*[after(k) for k in keywords])
