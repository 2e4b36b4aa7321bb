"""Numbers and dates out of text, as column expressions; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorfisc.functions import dims

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _double(text: Column) -> Column:
    plain = F.trim(text)
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def display_number(text: Column) -> Column:
    """A number as people write it: the last separator is the decimal one, a lone one before three digits is not."""
    t = F.trim(text)
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    none = lambda s: F.replace(t, F.lit(s), F.lit(""))
    both = F.when(t.rlike(r",[^.,]*$"), F.replace(none("."), F.lit(","), F.lit("."))).otherwise(none(","))
    lone = lambda s: t.rlike(rf"^[^{s}]*{s}[^{s}]{{3}}$")
    plain = F.when(comma & dot, both).when(comma, F.when(lone(","), none(",")).otherwise(F.replace(t, F.lit(","), F.lit(".")))).when(dot, F.when(lone("."), none(".")).otherwise(t)).otherwise(t)
    return _double(plain)


def sheet_number(text: Column) -> Column:
    """A sheet cell's number: footnote stars dropped, a comma read as decimal point."""
    return _double(F.replace(F.trim(F.regexp_replace(F.trim(text), r"\*+$", "")), F.lit(","), F.lit(".")))


def power(text: Column) -> tuple[Column, Column]:
    """Base and boost of a power cell such as 380+16."""
    boosted = F.contains(text, F.lit("+"))
    return sheet_number(F.split_part(text, F.lit("+"), F.lit(1))), F.when(boosted, sheet_number(F.regexp_replace(text, r"^[^+]*\+", "")))


def kw_in_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*kw\b", 1), F.lit(""))


def numeric_like(text: Column) -> Column:
    return F.translate(F.trim(text), "., ", "").rlike("^[0-9]+$")


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("da", "yes", "true", "1", "x"), F.lit(False))


def eur_of_hrk(price: Column) -> Column:
    return F.round(price.cast("decimal(18,4)") / F.lit(dims.HRK_PER_EUR).cast("decimal(8,5)"), 2).cast("double")


def bare_mileage(text: Column) -> Column:
    """All digits of a mileage, whatever separates them."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("int")


def ramp(diff: Column, tolerance: float, gap: float, bonus: float, penalty: float) -> Column:
    """Bonus up to the tolerance, minus the penalty from the gap on, a straight line between."""
    return F.when(diff <= tolerance, F.lit(bonus)).when(diff >= gap, F.lit(-penalty)).otherwise(bonus - (diff - tolerance) / (gap - tolerance) * (bonus + penalty))


def fade(diff: Column, exact: float, zero: float, points: float) -> Column:
    return F.when(diff <= exact, F.lit(points)).when(diff >= zero, F.lit(0.0)).otherwise(points * (zero - diff) / (zero - exact))


def rounded(x: Column, places: int) -> Column:
    """As ``F.round`` of numbers up to 100,000 or so, but only those next to a tie are written out as decimals, which takes longer than all else of a pair."""
    scaled = x * 10.0**places
    return F.when(F.abs(scaled - F.floor(scaled) - 0.5) < 1e-3, F.round(x, places)).otherwise(F.rint(scaled) / 10.0**places)


def co2_of(single: Column, low: Column, high: Column, policy: str = "max") -> Column:
    """One emission figure of a single column or of a pair."""
    pair = {"max": F.coalesce(high, low), "min": F.coalesce(low, high), "average": F.coalesce((low + high) / 2, high, low)}[policy]
    return F.coalesce(pair, single)


def day(year: Column, month: Column, dom: Column) -> Column:
    """A date of three texts, or null if there is no such day."""
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(dom, 2, "0")).try_cast("date")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def listing_date(text: Column) -> Column:
    """A listing's date in one of eight shapes, tried in order."""
    t = F.trim(text)
    n = F.regexp_replace(t, r"\s*([./])\s*", "$1")
    iso = F.when(F.left(t, F.lit(10)).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), day(_part(t, r"^(\d{4})-", 1), _part(t, r"^\d{4}-(\d{1,2})", 1), _part(F.left(t, F.lit(10)), r"-(\d{1,2})$", 1)))
    tried = [iso]
    for pattern, order in ((r"^(\d{1,2})\.(\d{1,2})\.(\d{4})\.?$", (3, 2, 1)), (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 2, 1)), (r"^(\d{1,2})[./](\d{4})$", (2, 1, 0)), (r"^(\d{4})-(\d{1,2})$", (1, 2, 0)), (r"^(\d{4})$", (1, 0, 0))):
        y, m, d = (_part(n, pattern, g) if g else F.lit("1") for g in order)
        tried.append(F.when(n.rlike(pattern), day(y, m, d)))
    return F.coalesce(*tried)


def sheet_date(text: Column) -> Column:
    """D.M.Y with or without a last dot, years from 2000 to 2035, two digits as 20YY."""
    t = F.regexp_replace(F.trim(text), r"\.+$", "")
    shape = r"^\s*(\d+)\s*\.\s*(\d+)\s*\.\s*(\d+)\s*$"
    year = _part(t, shape, 3).try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    ok = t.rlike(shape) & year.between(2000, 2035) & (F.length(_part(t, shape, 1)) <= 2) & (F.length(_part(t, shape, 2)) <= 2)
    return F.when(ok, day(year.cast("string"), _part(t, shape, 2), _part(t, shape, 1)))


def file_date(name: Column, folder_year: Column) -> Column:
    """Start of validity out of a file's name: the first pattern that gives a day between 2013 and 2030."""
    stem = F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
    none = F.lit(None).cast("date")

    def tried(pattern: str, y: int | Column, m: int, d: int, century: str = "") -> Column:
        got = lambda g: _part(stem, pattern, g) if isinstance(g, int) else g
        year = F.concat(F.lit(century), got(y)) if century else got(y)
        found = day(year, got(m), got(d) if d else F.lit("01"))
        return F.when(stem.rlike(pattern) & year.try_cast("int").between(2013, 2030), found).otherwise(none)

    return F.coalesce(
        tried(r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})", 3, 2, 1),
        tried(r"([0-9]{4})[^0-9]+?([0-9]{1,2})\.([0-9]{1,2})([^0-9]|$)", 1, 3, 2),
        tried(r"(^|[^0-9])([0-9]{4})([0-9]{2})([0-9]{2})([^0-9]|$)", 2, 3, 4),
        tried(r"([0-9]{4})\s([0-9]{2})([0-9]{2})([^0-9]|$)", 1, 2, 3),
        tried(r"([0-9]{4})\s([0-9]{2})([0-9]{2})([^0-9]|$)", 1, 3, 2),
        tried(r"(^|[^0-9])([0-9]{4})_([0-9]{2})([0-9]{2})([^0-9]|$)", 2, 3, 4),
        tried(r"([0-9]{4})\s([0-9]{2})([^0-9]|$)", 1, 2, 0),
        tried(r"(^|[^0-9])([0-9]{4})-([0-9]{2})-([0-9]{2})([^0-9]|$)", 2, 3, 4),
        tried(r"(^|[^0-9])([0-9]{1,2})[._]([0-9]{1,2})[._]([0-9]{2})([^0-9]|$)", 4, 3, 2, "20"),
        tried(r"(^|[^0-9])([0-9]{2})([0-9]{2})([0-9]{4})([^0-9]|$)", 4, 3, 2),
        tried(r"(^|[^0-9])([0-9]{1,2})\.([0-9]{1,2})\.", folder_year.cast("string"), 3, 2),
    )


def period_months(period: Column) -> Column:
    """Months since year 0 of YYYY or YYYY-MM; a missing month is January."""
    shape = r"^(\d{4})(?:-(\d{2}))?$"
    month = F.coalesce(F.nullif(_part(period, shape, 2), F.lit("")), F.lit("01")).try_cast("int")
    return F.when(period.rlike(shape) & month.between(1, 12), _part(period, shape, 1).try_cast("int") * 12 + month - 1)
