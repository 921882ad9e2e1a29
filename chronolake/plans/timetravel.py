"""Time travel as statement text: AS OF, BETWEEN, the hint form, and relative times."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.functions import images
from chronolake.operators import fold

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_NAME = r"`?([A-Za-z_][A-Za-z0-9_]*)`?"
_WHERE = r"(?:\s+WHERE\s+`?(?P<column>[A-Za-z_][A-Za-z0-9_]*)`?\s*=\s*(?P<value>'(?:[^']|'')*'|-?\d+))?"
_LIMIT = r"(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$"
_AS_OF = re.compile(rf"\s*SELECT\s+(?P<columns>.+?)\s+FROM\s+_(?P<kind>flashback|snapshot)\.{_NAME}\s+AS\s+OF\s+(?P<at>'[^']*'){_WHERE}{_LIMIT}", re.I | re.S)
_TRAILING = re.compile(rf"\s*SELECT\s+(?P<columns>.+?)\s+FROM\s+_(?P<kind>flashback|snapshot)\.{_NAME}{_WHERE}\s+AS\s+OF\s+(?P<at>'[^']*'){_LIMIT}", re.I | re.S)
_DIFF = re.compile(rf"\s*SELECT\s+(?P<columns>.+?)\s+FROM\s+_(?P<kind>diff)\.{_NAME}\s+BETWEEN\s+(?P<since>'[^']*')\s+AND\s+(?P<at>'[^']*'){_WHERE}{_LIMIT}", re.I | re.S)
_HINT = re.compile(rf"\s*SELECT\s*/\*\+\s*(?:[A-Z]+_)?AT\s*=\s*(?P<at>'[^']*')\s*\*/\s*(?P<columns>.+?)\s+FROM\s+{_NAME}{_WHERE}{_LIMIT}", re.I | re.S)


@dataclass(frozen=True)
class Travel:
    kind: str  # flashback, snapshot or diff
    table: str
    at: datetime
    since: datetime | None = None
    key: str | None = None
    columns: tuple[str, ...] = ()
    limit: int | None = None
    column: str | None = field(default=None, compare=False)  # what the WHERE is about


def instant(text: str, now: datetime) -> datetime:
    """An absolute time, 'now', or '<n> <unit>s ago'."""
    text = text.strip().strip("'").strip()
    if text.lower() == "now":
        return now.replace(microsecond=0)
    if m := re.fullmatch(r"(\d+)\s+(second|minute|hour|day|week)s?\s+ago", text, re.I):
        return now.replace(microsecond=0) - timedelta(seconds=int(m[1]) * _UNITS[m[2].lower()])
    at = datetime.fromisoformat(text.replace("Z", ""))
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


def parse(statement: str, now: datetime) -> Travel | None:
    """What a time-travel statement asks for; None for any other statement."""
    for form in (_AS_OF, _TRAILING, _DIFF, _HINT):
        if m := form.match(statement):
            g = m.groupdict()
            table = next(x for x in m.groups() if x and re.search(rf"(?:\.|FROM\s+)`?{re.escape(x)}`?(?:\s|;|$)", statement, re.I) and x not in (g["columns"], g.get("kind")))
            columns = () if g["columns"].strip() == "*" else tuple(c.strip().strip("`") for c in g["columns"].split(","))
            key = g["value"][1:-1].replace("''", "'") if g.get("value", None) and g["value"].startswith("'") else g.get("value")
            since = instant(g["since"], now) if g.get("since") else None
            return Travel((g.get("kind") or "snapshot").lower(), table, instant(g["at"], now), since, key, columns, int(g["limit"]) if g.get("limit") else None, g.get("column"))
    return None


def run(travel: Travel, changes: DataFrame, baseline: DataFrame | None = None, key_column: str = "id") -> DataFrame:
    """The rows of a parsed statement over one table's changes (and its baseline, for a snapshot).

    A condition on key_column is one on the key. One on any other column is about the rows as of the instant, for a diff about
    either image of a change.
    """
    by_key = travel.key is not None and travel.column in (None, key_column)
    own = changes.where(F.col("pk_values") == travel.key) if by_key else changes
    if travel.kind == "diff":
        out = fold.diff(own, travel.since, travel.at)
    elif travel.kind == "snapshot" and baseline is not None:
        out = fold.snapshot_at(baseline.where(F.col("pk_values") == travel.key) if by_key else baseline, own, travel.at)
    else:
        out = fold.state_at(own, travel.at)
    if travel.key is not None and not by_key:
        before = F.col("row_before") if travel.kind == "diff" else F.col("row_after")
        out = out.where(images.column_equals(before, F.col("row_after"), travel.column, travel.key))
    if travel.columns:
        out = out.select(*travel.columns)
    return out.limit(travel.limit) if travel.limit is not None else out
