"""Month arithmetic.  A month is the DATE of its first day."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import as_column

# Portuguese month abbreviations used in sheet headers.
PT_MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def first_of_month(year, month) -> Column:
    return F.make_date(as_column(year).cast("int"), as_column(month).cast("int"), F.lit(1))


def yyyymm(year, month) -> Column:
    return as_column(year).cast("int") * 100 + as_column(month).cast("int")


def month_index(period) -> Column:
    """Months since year 0, so that differences are month counts."""
    c = as_column(period)
    return F.year(c) * 12 + F.month(c) - 1


def shift(period, n) -> Column:
    return F.add_months(as_column(period), n)


def months_between_incl(first, last) -> Column:
    """Array of month starts from first to last."""
    return F.sequence(as_column(first), as_column(last), F.expr("interval 1 month"))


def parse_pt_month(label) -> Column:
    """'jan/27' -> 2027-01-01; NULL if the label is not a month."""
    c = F.lower(F.trim(as_column(label)))
    month = F.array_position(F.array(*[F.lit(m) for m in PT_MONTHS]), F.substring(c, 1, 3))
    year = F.regexp_extract(c, r"^[a-z]{3}/(\d{2})$", 1).try_cast("int")
    ok = year.isNotNull() & (month > 0)
    return F.when(ok, F.make_date(year + 2000, month.cast("int"), F.lit(1)))


def parse_period(text) -> Column:
    """AAAAMM, ISO date or ISO timestamp text -> first of month."""
    c = F.trim(as_column(text).cast("string"))
    six = F.when(c.rlike(r"^\d{6}$"), F.try_to_date(F.concat(c, F.lit("01")), "yyyyMMdd"))
    iso = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    return F.trunc(F.coalesce(six, iso), "month")


def folder_month(name) -> Column:
    """Year and month in a folder name such as '2026-08' or '202608'."""
    c = as_column(name)
    pat = r"(20\d{2})\D?(0[1-9]|1[0-2])(?!\d)"
    y, m = F.regexp_extract(c, pat, 1).try_cast("int"), F.regexp_extract(c, pat, 2).try_cast("int")
    return F.when(y.isNotNull() & m.isNotNull(), F.make_date(y, m, F.lit(1)))
