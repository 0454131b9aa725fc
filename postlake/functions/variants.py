"""Reading loosely typed JSON held in VARIANT columns.

A value counts as missing when it is absent, null, "", 0, false, [] or {}: the payloads mix those
freely, and a missing value lets the next alias step in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.sqltext import bind, let_sql, q

_BLANK = "('null', '\"\"', '0', '0.0', 'false', '[]', '{}')"


def path(*keys: str) -> str:
    return "$" + "".join(f"['{key}']" for key in keys)


def sub_sql(v: str, *keys: str) -> str:
    return f"try_variant_get({v}, {q(path(*keys))}, 'variant')"


def text_sql(v: str, *keys: str) -> str:
    """Only short texts and zeros can be missing values; JSON, which is slow to write, is written for these alone."""
    where = q(path(*keys))
    text = f"try_variant_get({v}, {where}, 'string')"
    present = f"to_json(try_variant_get({v}, {where}, 'variant')) not in {_BLANK}"
    return f"if((length({text}) > 5 and not startswith({text}, '0')) or {present}, {text}, null)"


def object_sql(v: str) -> str:
    """Whether a value is an object: nothing else can be read as one, of however few fields."""
    return f"(try_variant_get({v}, '$', 'struct<>') is not null)"


def sub(v: Column | str, *keys: str) -> Column:
    """Nested value as VARIANT; NULL when any step is absent."""
    return bind(v, lambda x: sub_sql(x, *keys))


def _starts(v: Column | str, mark: str) -> Column:
    return bind(v, lambda x: f"coalesce(startswith(to_json({x}), {q(mark)}), false)")


def truthy(v: Column | str) -> Column:
    return bind(v, lambda x: f"coalesce(to_json({x}) not in {_BLANK}, false)")


def is_object(v: Column | str) -> Column:
    return bind(v, object_sql)


def is_array(v: Column | str) -> Column:
    return _starts(v, "[")


def is_string(v: Column | str) -> Column:
    return _starts(v, '"')


def scalar(v: Column | str) -> Column:
    """Text of a value, NULL when it counts as missing."""
    return bind(v, text_sql)


def text(v: Column | str, *keys: str) -> Column:
    """Text of a nested value, NULL when it counts as missing."""
    return bind(v, lambda x: text_sql(x, *keys))


def first_text_sql(v: str, *names: str) -> str:
    return "coalesce(" + ", ".join(text_sql(v, name) for name in names) + ")"


def first_text(v: Column | str, *names: str) -> Column:
    """First present alias among sibling keys."""
    return bind(v, lambda x: first_text_sql(x, *names))


def raw_text(v: Column | str, *keys: str) -> Column:
    """Text of a nested value as it is, an empty one included."""
    return bind(v, lambda x: f"try_variant_get({x}, {q(path(*keys))}, 'string')")


def items_sql(v: str, *keys: str) -> str:
    return f"try_variant_get({v}, {q(path(*keys))}, 'array<variant>')"


def items(v: Column | str, *keys: str) -> Column:
    """Nested list as ARRAY<VARIANT>; NULL when it is no list."""
    return bind(v, lambda x: items_sql(x, *keys))


def objects(values: Column | str) -> Column:
    """Only the object elements of an ARRAY<VARIANT>."""
    return bind(values, lambda x: f"filter({x}, e -> {object_sql('e')})")


def as_map(v: Column | str) -> Column:
    """Object as MAP<STRING, VARIANT>; NULL when it is no object."""
    return bind(v, lambda x: f"try_variant_get({x}, '$', 'map<string,variant>')")


def overlay(base: Column, top: Column) -> Column:
    """Both maps merged; a key present in `top` wins even when its value is null."""
    merged = F.map_zip_with(
        base, top, lambda k, a, b: F.when(F.map_contains_key(top, k), b).otherwise(a)
    )
    return F.when(top.isNull(), base).otherwise(merged)


def entry(m: Column | str, key: str) -> Column:
    """VARIANT under `key` of a MAP<STRING, VARIANT>."""
    return bind(m, lambda x: f"element_at({x}, {q(key)})")


def entry_text(m: Column | str, *names: str) -> Column:
    """First present alias of a MAP<STRING, VARIANT>."""

    def one(x: str, name: str) -> str:
        return let_sql(f"element_at({x}, {q(name)})", text_sql)

    return bind(m, lambda x: "coalesce(" + ", ".join(one(x, n) for n in names) + ")")
