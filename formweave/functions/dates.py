"""Dates kept as text. Every clock read is a parameter; the year pivots differ on purpose and are parameters too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_US = r"^\s*([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2}|[0-9]{4})\s*$"
_ISO = r"^\s*([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\s*$"


def full_year(year: Column, pivot: Column | int) -> Column:
    """Two digits above the pivot are 19xx, others 20xx; four stay."""
    y = year.try_cast("int")
    return F.when(F.length(year) > 2, y).when(y > pivot, 1900 + y).otherwise(2000 + y)


def parse_date(c: Column, pivot: Column | int, iso: bool = True) -> Column:
    """M/D/Y as a date; day and month change places only if the month is impossible. Null if it is no date."""
    a, b = (F.regexp_extract(c, _US, k).try_cast("int") for k in (1, 2))
    swap = (a > 12) & (b <= 12)
    day, month = F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)
    made = F.try_to_date(F.concat_ws("-", full_year(F.regexp_extract(c, _US, 3), pivot).cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")
    out = F.when(c.rlike(_US), made)
    if iso:
        parts = [F.lpad(F.regexp_extract(c, _ISO, k), n, "0") for k, n in ((1, 4), (2, 2), (3, 2))]
        out = out.when(c.rlike(_ISO), F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))
    return out


def age(born: Column, as_of: Column) -> Column:
    """Full years; null unless 0 to 149."""
    n = F.floor(F.months_between(as_of, born) / 12).cast("int")
    return F.when((n >= 0) & (n < 150), n)


def date_format_hint(hint: Column) -> Column:
    """The format that a hint asks for, by the order of its d, m and y runs; month first without one."""
    h = F.lower(hint)
    return F.when(h.rlike("yyyy[^a-z]*mm[^a-z]*dd"), "yyyy-MM-dd").when(h.rlike("dd?[^a-z]*mmm[^a-z]*yy"), "dd MMM yyyy").when(h.rlike("dd?[^a-z]*mm[^a-z]*yy"), "dd/MM/yyyy").otherwise("MM/dd/yyyy")


def format_date(d: Column, fmt: Column) -> Column:
    kinds = ("yyyy-MM-dd", "dd MMM yyyy", "dd/MM/yyyy", "MM/dd/yyyy")
    return F.coalesce(*(F.when(fmt == k, F.date_format(d, k)) for k in kinds))


def day_first(c: Column) -> Column:
    """MM/DD/YYYY as DD/MM/YYYY; other texts stay."""
    return F.regexp_replace(c, "^([0-9]{2})/([0-9]{2})/([0-9]{4})$", "$2/$1/$3")


def year_class(d: Column, as_of: Column) -> Column:
    """'future', 'birth' (14 years ago or more), else 'recent'."""
    years = F.year(as_of) - F.year(d)
    return F.when(d > as_of, "future").when(years >= 14, "birth").otherwise("recent")
