"""Partial ISO dates ("1942", "1942-06", "1942-06-04") as column expressions.

They are compared as strings and a padded month ends on day 31: never cast them before a filter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The window that the graph covers, and the length an ISO prefix is cut to by precision.
SCOPE = ("1938", "1948")
PRECISION_LENGTH = {"year": 4, "month": 7, "9": 4, "10": 7}


def present(c: Column) -> Column:
    """An empty string counts as null."""
    return F.when(c != "", c)


def pad(date: Column, end: bool) -> Column:
    """First or last day that a partial date may mean."""
    d = present(date)
    parts = F.size(F.split(d, "-"))
    year, month = ("-12-31", "-31") if end else ("-01-01", "-01")
    return F.when(parts == 1, F.concat(d, F.lit(year))).when(parts == 2, F.concat(d, F.lit(month))).otherwise(d)


def effective(start: Column, end: Column, point: Column) -> tuple[Column, Column]:
    """An interval wins over a point date; a point is an interval of its own."""
    open_ = present(start).isNull() & present(end).isNull()
    return F.when(open_, present(point)).otherwise(present(start)), F.when(open_, present(point)).otherwise(present(end))


def candidate_span(candidates: Column) -> tuple[Column, Column]:
    """Earliest and latest of several unselected point dates."""
    kept = F.filter(candidates, lambda c: c.isNotNull() & (c != ""))
    return F.array_min(kept), F.array_max(kept)


def overlaps(start: Column, end: Column, low: str | None, high: str | None) -> Column:
    """Interval overlap with open ends. Undated rows match only where no filter is set."""
    if not low and not high:
        return F.lit(True)
    s, e = present(start), present(end)
    first, last = pad(F.coalesce(s, e), end=False), pad(F.coalesce(e, s), end=True)
    upto = pad(F.lit(high), end=True) if high else F.lit("9999")
    since = pad(F.lit(low), end=False) if low else F.lit("0000")
    return F.coalesce((first <= upto) & (last >= since), F.lit(False))


def outside_scope(start: Column, end: Column, scope: tuple[str, str] = SCOPE) -> Column:
    """Entirely before or after the window; undated and open-ended rows stay."""
    before = F.substring(present(end), 1, 4) < scope[0]
    after = F.substring(present(start), 1, 4) > scope[1]
    return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))


def iso(value: Column, precision: Column | None = None) -> Column:
    """DD/MM/YYYY and "+1942-06-00T..." as a partial ISO date, cut to the precision."""
    dmy = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    wiki = r"^\+?(\d{1,4})-(\d{2})-(\d{2})(T.*)?$"
    day = F.lpad(F.regexp_extract(value, dmy, 1), 2, "0")
    from_dmy = F.concat_ws("-", F.regexp_extract(value, dmy, 3), F.lpad(F.regexp_extract(value, dmy, 2), 2, "0"), day)
    year, month, dom = (F.regexp_extract(value, wiki, i) for i in (1, 2, 3))
    year = F.lpad(year, 4, "0")
    from_wiki = F.when(month == "00", year).when(dom == "00", F.concat_ws("-", year, month)).otherwise(F.concat_ws("-", year, month, dom))
    out = F.when(value.rlike(dmy), from_dmy).when(value.rlike(wiki) & (value.startswith("+") | value.contains("T")), from_wiki).otherwise(value)
    if precision is None:
        return out
    length = F.lit(None).cast("int")
    for name, n in PRECISION_LENGTH.items():
        length = F.when(F.lower(precision.cast("string")) == name, n).otherwise(length)
    return F.when(length.isNotNull(), F.substring(out, F.lit(1), length)).otherwise(out)


def precision_of(date: Column) -> Column:
    return F.when(F.length(date) == 4, "year").when(F.length(date) == 7, "month").when(F.length(date) >= 10, "day")


def bounds(year: Column, month: Column, day: Column, precision: Column) -> tuple[Column, Column]:
    """Least and greatest (y, m, d) that a model date of a precision from 6 (millennium) to 11 (day) may mean."""
    width = F.when(precision == 6, 1000).when(precision == 7, 100).when(precision == 8, 10).otherwise(1)
    first = F.when(precision <= 8, F.floor((year - F.when(precision == 8, 0).otherwise(1)) / width) * width + F.when(precision == 8, 0).otherwise(1)).otherwise(year).cast("int")
    low = F.struct(first.alias("y"), F.when(precision >= 10, month).otherwise(1).cast("int").alias("m"), F.when(precision >= 11, day).otherwise(1).cast("int").alias("d"))
    high = F.struct((first + width - 1).cast("int").alias("y"), F.when(precision >= 10, month).otherwise(12).cast("int").alias("m"), F.when(precision >= 11, day).otherwise(31).cast("int").alias("d"))
    return low, high


def year_span(year: Column, width: int, offset: int = 0) -> tuple[Column, Column]:
    """First and last year of the decade or century that holds a year."""
    first = (F.floor((year - offset) / width) * width + offset).cast("int")
    return first, (first + width - 1).cast("int")


def days(start: Column, end: Column) -> Column:
    """Days of an interval, both ends counted."""
    return F.datediff(F.to_date(end), F.to_date(start)) + 1


def time_status(low: Column, high: Column, point: Column, several: Column) -> Column:
    """CONFLICT, MULTIPLE, DIRECT, PARTIAL or NONE."""
    full = r"^\+?\d{4}-\d{2}-\d{2}"
    day = lambda c: F.regexp_extract(c, r"^\+?(\d{4}-\d{2}-\d{2})", 1)
    lo, hi, p = (F.coalesce(c, F.lit("")) for c in (low, high, point))
    wrong = lo.rlike(full) & hi.rlike(full) & (day(lo) > day(hi))
    direct = (p != "") | ((lo != "") & (hi != ""))
    return F.when(wrong, "CONFLICT").when(several, "MULTIPLE").when(direct, "DIRECT").when((lo != "") | (hi != ""), "PARTIAL").otherwise("NONE")


#: Names of months.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def short(date: Column) -> Column:
    """1942-08-07 as 7 Aug 1942, 1943-01 as Jan 1943, a year alone, or whatever else, as it is."""
    part = lambda i: F.regexp_extract(date, r"^(\d{4})-(0[1-9]|1[0-2])(?:-(\d{2}))?$", i)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.when(part(2) != "", part(2).cast("int")))
    day = F.when(part(3) != "", F.concat(part(3).cast("int").cast("string"), F.lit(" "))).otherwise("")
    return F.when(part(1) == "", date).otherwise(F.concat(day, month, F.lit(" "), part(1)))


def span_text(start: Column, end: Column) -> Column:
    """Aug 1942–Jun 1945 from two partial dates, by month; one where they are the same."""
    a, b = short(F.substring(start, 1, 7)), short(F.substring(end, 1, 7))
    return F.when(start.isNull() | end.isNull(), "no dates").when(a == b, a).otherwise(F.concat(a, F.lit("–"), b))
