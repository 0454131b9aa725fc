"""HTML character references resolved inside the JVM."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5, name2codepoint

from pyspark.sql import Column

from postlake.functions.sqltext import bind, each_sql, let_sql, q

_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@lru_cache(maxsize=1)
def _names() -> tuple[str, str, str]:
    """Common names as a map, the rest as one searchable text, and a longest-first pattern of the
    names that are valid without `;`."""
    bare = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)
    common = {"amp;": "&", "nbsp;": "\xa0", "lt;": "<", "gt;": ">", "quot;": '"', "apos;": "'"}
    common.update({f"{name};": chr(point) for name, point in name2codepoint.items()})
    common.update({f"{name};": html5[name] for name in bare})
    rare = "".join(
        f"\x01{name}\x02{char}"
        for name, char in html5.items()
        if name.endswith(";") and name not in common
    )
    table = f"from_json({q(json.dumps(common, ensure_ascii=False))}, 'map<string,string>')"
    return table, q(rare + "\x01"), "^(" + "|".join(bare) + ")"


@lru_cache(maxsize=1)
def _windows_1252() -> str:
    """Numbers 128-159 mean Windows-1252 characters where that code page defines one."""
    chars = []
    for number in range(0x80, 0xA0):
        try:
            chars.append(bytes([number]).decode("cp1252"))
        except UnicodeDecodeError:
            chars.append(chr(number))
    return q("".join(chars))


def _numbered_sql(ref: str) -> str:
    digits = f"ltrim('0', regexp_extract({ref}, '^&#[xX]?([0-9a-fA-F]+)', 1))"
    number = let_sql(
        digits,
        lambda d: f"if({d} = '', '0', if({ref} rlike '^&#[xX]', if(length({d}) > 8, null, conv({d}, 16, 10)), {d}))",
    )

    def resolve(n: str) -> str:
        return (
            f"case when {n} is null or {n} > 1114111 or {n} = 0 or {n} between 55296 and 57343 then '\ufffd'"
            f" when {n} = 13 then '\\r'"
            f" when {n} between 128 and 159 then substr({_windows_1252()}, cast({n} - 127 as int), 1)"
            f" when {n} between 1 and 8 or {n} = 11 or {n} between 14 and 31 or {n} = 127"
            f" or {n} between 64976 and 65007 or ({n} & 65534) = 65534 then ''"
            f" else decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') end"
        )

    return let_sql(f"try_cast({number} as bigint)", resolve)


def _named_sql(ref: str) -> str:
    table, rare, bare = _names()

    def look_up(names: str) -> str:
        name = f"substr({ref}, 2)"
        marked = f"concat('\x01', {name}, '\x02')"
        in_rare = let_sql(
            rare,
            lambda text: f"if(contains({text}, {marked}), substring_index(substring_index({text}, {marked}, -1), '\x01', 1), null)",
        )
        shortened = let_sql(
            f"regexp_extract({name}, {q(bare)}, 1)",
            lambda p: f"if({p} <> '', concat(element_at({names}, concat({p}, ';')), substr({name}, length({p}) + 1)), null)",
        )
        return f"coalesce(element_at({names}, {name}), {in_rare}, {shortened}, {ref})"

    return let_sql(table, look_up)


def unescape_sql(x: str) -> str:
    """Resolve named and numeric references; text without `&` is passed through untouched."""

    def rebuild(text: str) -> str:
        resolved = each_sql(
            f"regexp_extract_all({text}, {q(_REFERENCE)}, 0)",
            lambda ref: f"case when {ref} = '&amp;' then '&' when startswith({ref}, '&#') then {_numbered_sql(ref)}"
            f" else {_named_sql(ref)} end",
        )
        pieces = f"split({text}, {q(_REFERENCE)}, -1)"
        woven = f"zip_with({pieces}, {resolved}, (piece, char) -> concat(piece, coalesce(char, '')))"
        return f"if(contains({text}, '&'), array_join({woven}, ''), {text})"

    return let_sql(x, rebuild)


def unescape(c: Column | str) -> Column:
    return bind(c, unescape_sql)
