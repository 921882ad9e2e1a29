"""Functions with the source's meaning where Spark's own of that name differs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format specifiers of the source and Spark's patterns for them.
DATE_SPECIFIERS = {
    "%a": "EEE", "%b": "MMM", "%c": "M", "%d": "dd", "%e": "d", "%f": "SSSSSS", "%H": "HH", "%h": "hh", "%I": "hh", "%i": "mm",
    "%j": "DDD", "%k": "H", "%l": "h", "%M": "MMMM", "%m": "MM", "%p": "a", "%r": "hh:mm:ss a", "%S": "ss", "%s": "ss",
    "%T": "HH:mm:ss", "%W": "EEEE", "%Y": "yyyy", "%y": "yy", "%%": "'%'",
}


class Refused(ValueError):
    """A statement or value that can't be answered as the source would."""


def date_format(c: Column, fmt: str) -> Column:
    """DATE_FORMAT; specifiers whose numbering differs (%D %U %u %V %v %X %x %w) are refused."""
    out, at = "", 0
    while at < len(fmt):
        if fmt[at] == "%":
            spec = fmt[at : at + 2]
            if spec not in DATE_SPECIFIERS:
                raise Refused(f"DATE_FORMAT specifier {spec}")
            out, at = out + DATE_SPECIFIERS[spec], at + 2
        else:
            out, at = out + (f"'{fmt[at]}'" if fmt[at].isalpha() else fmt[at].replace("'", "''")), at + 1
    return F.date_format(c, out.replace("''", "") if "''" in out and "'" not in fmt else out)


def datediff(a: Column, b: Column) -> Column:
    return F.datediff(a.cast("date"), b.cast("date"))


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    """Whole units from a to b, toward zero; a month is whole only when day and time of day are reached again."""
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    per = {"MICROSECOND": 1, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6, "WEEK": 7 * 86400 * 10**6}
    if unit in per:
        return (F.signum(micros.cast("double")).cast("bigint")) * F.floor(F.abs(micros) / F.lit(per[unit]).cast("decimal(20,0)")).cast("bigint")
    months = (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))
    within = lambda t: F.struct(F.dayofmonth(t), F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.date_trunc("day", t).cast("timestamp")))
    whole = F.when((b >= a) & (within(b) < within(a)), months - 1).when((b < a) & (within(b) > within(a)), months + 1).otherwise(months)
    parts = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}
    if unit not in parts:
        raise Refused(f"TIMESTAMPDIFF unit {unit}")
    return (F.signum(whole.cast("double")) * F.floor(F.abs(whole) / parts[unit])).cast("bigint")


def date_add_months(c: Column, months: int) -> Column:
    """Calendar months, clipped to the month's end; results outside the years 1 to 9999 are null."""
    out = c + F.make_interval(F.lit(0), F.lit(months))
    return F.when(F.year(out).between(1, 9999), out)


def exact_average(c: Column, scale: int = 4, distinct: bool = False) -> Column:
    """AVG of integers, exact to scale decimals, half away from zero; null over nothing."""
    number = c.cast("decimal(30,0)")
    total = F.sum_distinct(number) if distinct else F.sum(number)
    count = F.count_distinct(c) if distinct else F.count(c)
    return ratio(total, count, scale)


def ratio(num: Column, den: Column, scale: int) -> Column:
    """num / den rounded half away from zero to scale decimals, in integers throughout."""
    n, d = num.cast("decimal(30,0)"), den.cast("decimal(18,0)")
    twice = F.abs(n) * F.lit(2 * 10**scale).cast("decimal(8,0)") + F.abs(d)
    units = F.call_function("div", twice, F.abs(d) * F.lit(2).cast("decimal(1,0)"))
    signed = F.when((n < 0) != (d < 0), -units).otherwise(units)
    return F.when(d != 0, (signed.cast("decimal(30,0)") * F.lit(10**-scale).cast(f"decimal(18,{scale})")).cast(f"decimal(30,{scale})"))


def unix_timestamp(c: Column) -> Column:
    """Whole seconds in 1970 to 2038; anything else is null."""
    s = F.unix_seconds(c.cast("timestamp"))
    return F.when(s.between(0, 2**31 - 1), s)


def from_unixtime(c: Column) -> Column:
    return F.when(c.between(0, 2**31 - 1), F.timestamp_seconds(c).cast("timestamp_ntz"))


def statement_time() -> Column:
    return F.date_trunc("second", F.current_timestamp())


def least(*cols: Column) -> Column:
    """LEAST that is null as soon as one argument is."""
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), F.least(*cols))


def greatest(*cols: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), F.greatest(*cols))


def like(c: Column, pattern: str) -> Column:
    """LIKE without regard to case."""
    return c.ilike(pattern)


def substring(c: Column, start: int, length: int | None = None) -> Column:
    """SUBSTRING from a position of 1 or more; positions of 0 and below are refused."""
    if start < 1:
        raise Refused("SUBSTRING position below 1")
    return F.substring(c, start, length if length is not None else 2**31 - 1)
