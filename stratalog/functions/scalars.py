"""Scalar functions: coercion, merging, timestamps, JSON and rule helpers."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
DECIMAL_TEXT = r"^\s*[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _number_text(col: Column) -> Column:
    """Text that reads as an integer, or as a decimal when it holds a dot."""
    ok = F.when(F.contains(col, F.lit(".")), col.rlike(DECIMAL_TEXT)).otherwise(col.rlike(INTEGER_TEXT))
    return F.when(ok, F.replace(F.trim(col), F.lit("_"), F.lit("")))


def coerce_number(col: Column, dtype: str) -> Column:
    """Numbers pass, text parses ('.' makes a double), anything else is NULL.

    A Spark column has one type, so the result is DOUBLE throughout.
    """
    if dtype == "string":
        return _number_text(col).try_cast("double")
    if dtype == "boolean" or T._parse_datatype_string(dtype).__class__ in NUMERIC:
        return col.cast("double")
    return F.lit(None).cast("double")


NUMERIC = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)


def coerce_boolean(col: Column, dtype: str) -> Column:
    if dtype == "boolean":
        return col
    if dtype == "string":
        low = F.lower(col)
        return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))
    if T._parse_datatype_string(dtype).__class__ in NUMERIC:
        return col != 0
    return F.lit(None).cast("boolean")


def coerce_string(col: Column, dtype: str) -> Column:
    if dtype == "string":
        return col
    if dtype == "boolean":
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    if T._parse_datatype_string(dtype).__class__ in NUMERIC:
        return col.cast("string")
    return F.lit(None).cast("string")


def _type_name(dtype: str) -> str:
    if dtype in ("string", "boolean"):
        return dtype
    if T._parse_datatype_string(dtype).__class__ in NUMERIC:
        return "number"
    return "array" if dtype.startswith("array") else "object"


def coerce_with_warning(col: Column, dtype: str, target: str) -> Column:
    """``struct(value, warning)``: value as the target type's text form, and a
    note when the type changed. A value that cannot be read stays as it was."""
    source = _type_name(dtype)
    text = coerce_string(col, dtype)
    none = F.lit(None).cast("string")
    if source == target:
        return F.struct(text.alias("value"), none.alias("warning"))
    if target == "number":
        if dtype == "string":
            # The cleaned text keeps the integer / decimal distinction.
            done = F.when(coerce_number(col, dtype).isNotNull(), _number_text(col))
        else:
            done = coerce_number(col, dtype).cast("string")
        note = F.concat(F.lit(f"{source} '"), text, F.lit("' read as number "), done)
    elif target == "boolean":
        done = coerce_string(coerce_boolean(col, dtype), "boolean")
        note = F.concat(F.lit(f"{source} '"), text, F.lit("' read as boolean "), done)
    else:
        done = text
        note = F.concat(F.lit(f"{source} written as text '"), text, F.lit("'"))
    return F.struct(
        F.coalesce(done, text).alias("value"),
        F.when(done.isNotNull(), note).alias("warning"),
    )


def merge_precedence(columns: list[Column], struct: T.DataType) -> Column:
    """Merge values left to right: the last present scalar wins, structs merge deep."""
    if not isinstance(struct, T.StructType):
        return F.coalesce(*reversed(columns))
    return F.struct(
        *[
            merge_precedence([c.getField(f.name) for c in columns], f.dataType).alias(f.name)
            for f in struct.fields
        ]
    )


def merge_maps(columns: list[Column]) -> Column:
    """Merge map columns, last wins per key."""
    out = columns[0]
    for nxt in columns[1:]:
        out = F.map_zip_with(out, nxt, lambda k, a, b: F.coalesce(b, a))
    return out


def iso_to_utc(value: Any) -> dt.datetime | None:
    """ISO-8601 literal with Z, offset or nothing (UTC) as a naive UTC datetime."""
    if isinstance(value, dt.datetime):
        stamp = value
    else:
        try:
            stamp = dt.datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        except ValueError:
            return None
    if stamp.tzinfo is not None:
        stamp = stamp.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return stamp


ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def parse_iso_utc(col: Column) -> Column:
    """The column form of :func:`iso_to_utc`; unreadable text gives NULL.

    The local part is read as it stands and the offset is subtracted, so the
    answer does not depend on the session's time zone.
    """
    text = F.when(col.rlike(ISO_SHAPE), col)
    local = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    # A bare date ends in -dd-dd too; only text with a time part carries an offset.
    has_time = F.length(F.regexp_extract(text, r"[T ](\d{2}:\d{2})", 1)) > 0
    local = F.when(has_time, local).otherwise(F.substring(text, 1, 10))
    sign = F.when(F.regexp_extract(text, r"([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
    hours = F.regexp_extract(text, r"[+-](\d{2}):?\d{2}$", 1).try_cast("int")
    minutes = F.regexp_extract(text, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("int")
    offset = F.when(has_time, F.coalesce(sign * (hours * 60 + minutes), F.lit(0))).otherwise(F.lit(0))
    stamp = F.replace(local, F.lit("T"), F.lit(" ")).try_cast(T.TimestampNTZType())
    return stamp - F.make_dt_interval(mins=offset)


def json_extract(col: Column, path: str, dtype: str = "string") -> Column:
    text = F.get_json_object(col, path)
    return text if dtype == "string" else text.try_cast(dtype)


# Rule helpers: the function names rules may use, as Column builders.
RULE_STRING_FUNCTIONS = {
    "contains": lambda c, x: F.contains(c, F.lit(x)),
    "startsWith": lambda c, x: F.startswith(c, F.lit(x)),
    "endsWith": lambda c, x: F.endswith(c, F.lit(x)),
    "matches": lambda c, x: c.rlike(x),
    "size": lambda c: F.length(c),
}

RULE_LIST_FUNCTIONS = {
    "in": lambda x, c: F.array_contains(c, x),
    "all": lambda c, f: F.forall(c, f),
    "exists": lambda c, f: F.exists(c, f),
    "filter": lambda c, f: F.filter(c, f),
    "map": lambda c, f: F.transform(c, f),
    "size": lambda c: F.size(c),
}

RULE_TYPE_FUNCTIONS = {
    "has": lambda c: c.isNotNull(),
    "key": lambda c, k: c.getItem(k),
    "int": lambda c: c.try_cast("bigint"),
    "double": lambda c: c.try_cast("double"),
    "string": lambda c: c.cast("string"),
    "bool": lambda c: c.try_cast("boolean"),
    "is_null": lambda c: c.isNull(),
    "ternary": lambda t, a, b: F.when(t, a).otherwise(b),
}


def matches_type(entity_type: Column, schema, name: str) -> Column:
    """The entity's class is ``name`` or inherits from it."""
    return entity_type.isin(schema.descendants(name))
