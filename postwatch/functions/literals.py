"""Values stored as Python literals in text files (never evaluated as code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"}


def parse_list_literal(c: Column | str) -> Column:
    """``"['a', 'b']"`` -> array of strings; null if it is not a list."""
    return F.from_json(c, "array<string>", _OPTIONS)


def parse_object_literal(c: Column | str, schema: T.StructType) -> Column:
    """``"{'id': 5, 'location': None}"`` -> struct; null if it is not an object.

    The three bare words are rewritten where they stand as a value: after ``: ``, before ``,`` or ``}``.
    """
    c = F.col(c) if isinstance(c, str) else c
    for word, json_word in (("None", "null"), ("True", "true"), ("False", "false")):
        c = F.regexp_replace(c, rf": {word}(?=[,}}])", f": {json_word}")
    return or_null(F.from_json(c, schema, _OPTIONS), schema)


def or_null(parsed: Column, schema: T.StructType) -> Column:
    """A struct without any value counts as unreadable."""
    filled = F.coalesce(*[parsed[f.name].cast("string") for f in schema.fields])
    return F.when(filled.isNotNull(), parsed)


def unreadable(raw: Column | str, parsed: Column | str) -> Column:
    """The raw text where parsing failed, else null (a quarantine column)."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    parsed = F.col(parsed) if isinstance(parsed, str) else parsed
    return F.when(raw.isNotNull() & parsed.isNull(), raw)
