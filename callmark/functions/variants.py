"""JSON by VARIANT: objects edited and merged with their types kept, records told from malformed elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "map<string,variant>"


def fields(blob: Column) -> Column:
    """A JSON object's fields; null for what is no object or no JSON."""
    return F.try_variant_get(F.try_parse_json(blob), "$", FIELDS)


def shown(of: Column) -> Column:
    """Fields as a JSON object in order of keys."""
    return F.to_json(F.to_variant_object(of))


def merged(left: Column, right: Column) -> Column:
    """Fields of both; right's where both have a key. A null side has none."""
    none = F.create_map().cast(FIELDS)
    right = F.coalesce(right, none)
    return F.map_concat(F.map_filter(F.coalesce(left, none), lambda k, _: ~F.map_contains_key(right, k)), right)


def set_key(blob: Column, key: str, value: Column) -> Column:
    """A JSON object with one key set to a value of any type, all others as they were; null counts as the empty object. JSON that is no
    object, and text that is no JSON, has no keys to set and stays as it is."""
    none = F.create_map().cast(FIELDS)
    own = F.when(blob.isNull(), none).otherwise(fields(blob))
    one = F.create_map(F.lit(key), F.coalesce(value.cast("variant"), F.parse_json(F.lit("null"))))
    return F.when(own.isNull(), blob).otherwise(shown(merged(own, one)))


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", FIELDS).isNotNull()


def records(blob: Column, path: str) -> Column:
    """array<variant> of the objects in the array at path, in order; strings, numbers, nulls and arrays among them are passed over, one by one.
    Null where there is no array (or no JSON)."""
    return F.filter(F.try_variant_get(F.try_parse_json(blob), path, "array<variant>"), is_object)


def text_of(value: Column, path: str) -> Column:
    """The text, number or truth at path as text; null where there is none, or an object or array."""
    return F.try_variant_get(value, path, "string")
