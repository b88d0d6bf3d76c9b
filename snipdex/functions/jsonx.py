"""JSON-path expressions over text columns.

Stored documents carry their keys in more than one case, so field reads ignore case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"


def extract(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def entries(doc: Column) -> Column:
    """Top-level members as key / raw-text pairs; NULL for anything but an object."""
    return F.from_json(doc, MAP)


def field(doc: Column, name: str) -> Column:
    """Top-level member by name, ignoring case; an exact match wins."""
    return lookup(entries(doc), name)


def array_length(doc: Column, path: str) -> Column:
    return F.json_array_length(F.get_json_object(doc, path))



def _as_object(members: Column) -> Column:
    return F.to_json(F.map_from_entries(members))


def _typed(doc: Column) -> Column:
    """Members as key / VARIANT pairs, so numbers and nested values keep their type."""
    return F.map_entries(F.from_json(doc, "map<string,variant>"))


def is_object(doc: Column) -> Column:
    """Whether the edits below can change the text: an object, or NULL, which counts as an empty one."""
    return _typed(F.coalesce(doc, F.lit("{}"))).isNotNull()


def _without(doc: Column, key: str) -> Column:
    """Members but the one of that name in any case, as reads find it in any case."""
    return F.filter(_typed(F.coalesce(doc, F.lit("{}"))), lambda e: F.lower(e["key"]) != key.lower())


def set_key(doc: Column, key: str, value: Column) -> Column:
    """Insert or replace one top-level key, in any case; `value` is JSON text.

    NULL is an empty object; a text that is no object is kept as it is (`is_object` tells them).
    """
    new = F.array(F.struct(F.lit(key).alias("key"), F.parse_json(value).alias("value")))
    return F.when(is_object(doc), _as_object(F.concat(_without(doc, key), new))).otherwise(doc)


def insert_key(doc: Column, key: str, value: Column) -> Column:
    """Insert one top-level key unless it is there, in any case."""
    there = F.exists(F.map_keys(entries(doc)), lambda k: F.lower(k) == key.lower())
    return F.when(F.coalesce(there, F.lit(False)), doc).otherwise(set_key(doc, key, value))


def remove_key(doc: Column, key: str) -> Column:
    """Remove one top-level key, in any case; NULL and texts that are no object stay as they are."""
    return F.when(doc.isNotNull() & is_object(doc), _as_object(_without(doc, key))).otherwise(doc)


def is_valid(doc: Column) -> Column:
    """Exactly one JSON value.

    The parser stops after the first value and ignores what follows.  Inside an array and
    inside an object the rest of the text would break the wrapper or add a second element.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), doc, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), doc, F.lit("}")))
    one = F.try_variant_get(in_array, "$[0]", "variant").isNotNull()
    more = F.try_variant_get(in_array, "$[1]", "variant").isNotNull()
    return F.coalesce(one & ~more & in_object.isNotNull(), F.lit(False))


def type_at(doc: Column, path: str = "$") -> Column:
    """integer, real, text, true, false, null, array or object; NULL where absent."""
    node = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    shape = F.schema_of_variant(node)
    return (
        F.when(node.isNull(), F.lit(None).cast("string"))
        .when(F.is_variant_null(node), F.lit("null"))
        .when(shape.startswith("OBJECT"), F.lit("object"))
        .when(shape.startswith("ARRAY"), F.lit("array"))
        .when(shape == "BIGINT", F.lit("integer"))
        .when(shape == "STRING", F.lit("text"))
        .when(shape == "BOOLEAN", F.try_variant_get(node, "$", "string"))
        .otherwise(F.lit("real"))
    )


def contains_text(doc: Column, path: str, part: str) -> Column:
    return F.coalesce(F.get_json_object(doc, path).contains(part), F.lit(False))


def array_has(doc: Column, path: str, value: str) -> Column:
    items = F.from_json(F.get_json_object(doc, path), "array<string>")
    return F.coalesce(F.array_contains(items, value), F.lit(False))


def depth(doc: Column) -> Column:
    """Nesting depth: 0 for a scalar or an empty container, 1 for a flat object.

    Strings become a placeholder, then only brackets remain; the depth is the highest
    running sum over them.
    """
    bare = F.regexp_replace(doc, '"(?:[^"\\\\]|\\\\.)*"', "s")
    bare = F.regexp_replace(bare, "\\s+", "")
    bare = F.regexp_replace(bare, "\\{\\}|\\[\\]", "s")
    brackets = F.regexp_replace(bare, "[^\\[\\]{}]", "")
    marks = F.filter(F.split(brackets, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("top"))

    def step(acc: Column, mark: Column) -> Column:
        level = acc["level"] + F.when(mark.isin("{", "["), 1).otherwise(-1)
        return F.struct(level.alias("level"), F.greatest(acc["top"], level).alias("top"))

    return F.aggregate(marks, start, step, lambda acc: acc["top"])


def lookup(members: Column, name: str) -> Column:
    """Value of a map by key, ignoring case; an exact match wins."""
    loose = F.filter(F.map_entries(members), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.try_element_at(members, F.lit(name)), F.get(loose, F.lit(0))["value"])
