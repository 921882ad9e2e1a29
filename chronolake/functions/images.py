"""Row images: JSON null, absent and value kept apart; numbers exact."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The one key of the object that stands for a value that the source did not send.
UNCHANGED = "__unchanged__"
_NAME = re.compile(r"[A-Za-z0-9_]+")


def field(image: Column, name: str) -> Column:
    """The value as VARIANT; SQL NULL where the field is absent."""
    return F.try_variant_get(F.try_parse_json(image), f"$.{checked(name)}", "variant")


def text(image: Column, name: str) -> Column:
    return F.try_variant_get(F.try_parse_json(image), f"$.{checked(name)}", "string")


def checked(name: str) -> str:
    """The name, if it is a plain column name; anything else is refused."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a column name: {name!r}")
    return name


def is_json_null(image: Column, name: str) -> Column:
    return F.coalesce(F.is_variant_null(field(image, name)), F.lit(False))


def typed(image: Column, schema: T.StructType) -> Column:
    """An image by its epoch's schema; decimals stay exact."""
    return F.from_json(image, schema)


def column_equals(before: Column, after: Column, name: str, value: str) -> Column:
    """Whether either image has the field with this text; the value NULL asks for a JSON null."""
    if value == "NULL":
        return is_json_null(before, name) | is_json_null(after, name)
    return F.coalesce(text(before, name) == value, F.lit(False)) | F.coalesce(text(after, name) == value, F.lit(False))


def is_unchanged_marker(image: Column, name: str, marker: str = UNCHANGED) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(image), f"$.{checked(name)}.{checked(marker)}", "boolean"), F.lit(False))


def canonical(image: Column, absent: str = "{}") -> Column:
    """An image as text whose fields are in the order of their names; a null image is an empty one or absent, no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(image)), image, F.lit(absent))


def has_marker(image: Column, marker: str = UNCHANGED) -> Column:
    """Whether any value of the image was not sent; such an image can't be applied as a whole row.

    The marker is the key of an object that is a field's value; text that only contains it is no marker.
    """
    fields = F.map_values(F.from_json(image, "map<string,variant>"))
    return F.coalesce(F.exists(fields, lambda v: F.coalesce(F.try_variant_get(v, f"$.{checked(marker)}", "boolean"), F.lit(False))), F.lit(False))


def redacted(image: Column, columns: list[str]) -> Column:
    """The image with these fields set to null; the others keep their kind and every digit."""
    fields = F.from_json(image, "map<string,variant>")
    hidden = F.array(*[F.lit(checked(c)) for c in columns])
    shown = F.transform_values(fields, lambda k, v: F.when(~F.array_contains(hidden, k), v))
    return F.to_json(shown, {"ignoreNullFields": "false"})
