"""Key text: components joined by |, with | and the backslash escaped; numeric keys; hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(component: Column) -> Column:
    return F.replace(F.replace(component, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def join(*components: Column) -> Column:
    """The key text of these components, in key order."""
    return F.concat_ws("|", *[F.coalesce(escape(c.cast("string")), F.lit("")) for c in components])


def split(pk: Column) -> Column:
    """The components of a key text; the inverse of join, empty components included."""
    raw = F.regexp_extract_all(F.concat(pk, F.lit("|")), F.lit(r"((?:[^|\\]|\\.)*)\|"), F.lit(1))
    return F.transform(raw, lambda c: F.regexp_replace(c, r"\\(.)", "$1"))


def pk_hash(pk: Column) -> Column:
    return F.sha2(pk, 256)


def is_canonical_integer(text: Column) -> Column:
    """Whether a text is a decimal integer as the source itself would print it: no sign +, leading zero, point or exponent."""
    return F.coalesce(text.rlike(r"^(0|-?[1-9][0-9]{0,19})$"), F.lit(False))


def in_range(pk: Column, low: int | None = None, high: int | None = None) -> Column:
    """Inclusive numeric range over single integer keys; texts that aren't canonical integers never match."""
    number = F.when(is_canonical_integer(pk), pk.try_cast("decimal(20,0)"))
    cond = number.isNotNull()
    if low is not None:
        cond &= number >= F.lit(str(low)).cast("decimal(20,0)")
    if high is not None:
        cond &= number <= F.lit(str(high)).cast("decimal(20,0)")
    return F.coalesce(cond, F.lit(False))


def spelled(raw: Column) -> Column:
    """A binary component as text: itself where it is UTF-8, else 0x and upper-case hex."""
    text = F.try_validate_utf8(raw.cast("string"))
    return F.coalesce(text, F.concat(F.lit("0x"), F.hex(raw)))


def grouping_key(pk: Column, event_id: Column) -> Column:
    """What per-key limits group by: the key, or the row itself where the key is empty or unknown."""
    return F.coalesce(F.concat(F.lit("k:"), F.nullif(pk, F.lit(""))), F.concat(F.lit("row:"), event_id.cast("string")))
