"""URL canonical form, relative links and hashes."""

from __future__ import annotations

from urllib.parse import uses_netloc

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.sqltext import bind, each_sql, keep_sql, let_sql, q
from postlake.functions.text import col, strip_sql

# Query parameters that only track where a visitor came from.
TRACKING_PARAMS = ["gh_src", "lever-source", "source", "ref", "referrer"]
TRACKING_PREFIX = "utm_"

_URI = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
_PARTS = ["scheme", "authority", "path", "query", "fragment"]
_AUTHORITY_SCHEMES = ", ".join(q(s) for s in sorted(uses_netloc) if s)


def split_url_sql(x: str) -> str:
    clean = f"regexp_replace({x}, {q(r'^[\x00-\x20]+|[\t\r\n]')}, '')"
    return let_sql(
        clean,
        lambda u: "named_struct("
        + ", ".join(
            f"'{part}', regexp_extract({u}, {q(_URI)}, {i})" for i, part in enumerate(_PARTS, 1)
        )
        + ")",
    )


def split_url(c: Column | str) -> Column:
    """STRUCT of the RFC 3986 components; `authority`, `query` and `fragment` keep their marker."""
    return bind(c, split_url_sql)


def _unquote_sql(x: str) -> str:
    # A percent sign that starts no escape stays as it is.
    return f"url_decode(regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"


def quote_sql(x: str) -> str:
    return f"replace(replace(url_encode({x}), '%7E', '~'), '*', '%2A')"


def query_pairs_sql(query: str) -> str:
    chunks = f"filter(split({query}, '&'), part -> part <> '')"
    return each_sql(
        chunks,
        lambda part: f"named_struct('key', {_unquote_sql(f'''regexp_extract({part}, '(?s)^([^=]*)', 1)''')},"
        f" 'value', {_unquote_sql(f'''regexp_extract({part}, '(?s)^[^=]*=(.*)$', 1)''')})",
    )


def query_pairs(query: Column | str) -> Column:
    """ARRAY<STRUCT<key, value>> of a query string without its question mark, blanks kept."""
    return bind(query, query_pairs_sql)


def is_tracking_sql(key: str) -> str:
    params = ", ".join(q(p) for p in TRACKING_PARAMS)
    return f"(lower({key}) in ({params}) or startswith(lower({key}), {q(TRACKING_PREFIX)}))"


def drop_tracking_sql(pairs: str) -> str:
    return keep_sql(pairs, lambda p: f"not {is_tracking_sql(f'{p}.key')}")


def drop_tracking(pairs: Column | str) -> Column:
    return bind(pairs, drop_tracking_sql)


def encode_pairs_sql(pairs: str) -> str:
    encoded = each_sql(
        f"array_sort({pairs})", lambda p: f"concat({quote_sql(f'{p}.key')}, '=', {quote_sql(f'{p}.value')})"
    )
    return f"array_join({encoded}, '&')"


def encode_pairs(pairs: Column | str) -> Column:
    """Pairs sorted by key then value and encoded as a query string."""
    return bind(pairs, encode_pairs_sql)


def query_param_sql(url: str, name: str) -> str:
    pairs = query_pairs_sql(f"substr({split_url_sql(url)}.query, 2)")
    return f"try_element_at({keep_sql(pairs, lambda p: f'{p}.key = {q(name)}')}, -1).value"


def query_param(url: Column | str, name: str) -> Column:
    """Last value of one query parameter, NULL when absent."""
    return bind(url, lambda u: query_param_sql(u, name))


def norm_url_sql(x: str) -> str:
    def build(p: str) -> str:
        path = f"regexp_replace(regexp_replace({p}.path, '/+', '/'), '/$', '')"
        query = encode_pairs_sql(drop_tracking_sql(query_pairs_sql(f"substr({p}.query, 2)")))
        parts = (
            f"named_struct('s', lower(if({p}.scheme = '', 'https', {p}.scheme)),"
            f" 'a', lower({p}.authority), 'p', {path}, 'q', {query})"
        )
        return let_sql(
            parts,
            lambda u: f"concat({u}.s, ':', case when length({u}.a) > 2 then {u}.a"
            f" when {u}.s in ({_AUTHORITY_SCHEMES}) and ({u}.p = '' or startswith({u}.p, '/')) then '//' else '' end,"
            f" {u}.p, if({u}.q = '', '', concat('?', {u}.q)))",
        )

    return f"if(coalesce({x}, '') = '', '', {let_sql(split_url_sql(strip_sql(x)), build)})"


def norm_url(c: Column | str) -> Column:
    """Canonical URL: lower-case scheme and host, clean path, sorted query without tracking."""
    return bind(c, norm_url_sql)


def short_hash(c: Column | str) -> Column:
    return F.left(F.sha2(col(c), 256), F.lit(16))


def url_host(c: Column | str) -> Column:
    return bind(c, lambda x: f"lower(substr({split_url_sql(x)}.authority, 3))")


def _remove_dots_sql(segments: str) -> str:
    """Segments with `.` and `..` applied; a trailing dot segment leaves a directory."""
    kept = (
        f"aggregate({segments}, cast(array() as array<string>), (acc, s) -> case when s = '.' then acc"
        f" when s = '..' then slice(acc, 1, greatest(size(acc) - 1, 1)) else concat(acc, array(s)) end)"
    )
    return f"if(element_at({segments}, -1) in ('.', '..'), concat({kept}, array('')), {kept})"


def resolve_url_sql(base: str, href: str) -> str:
    """Absolute form of `href` on the page `base`, by the reference resolution of RFC 3986."""

    def merged_path(p: str) -> str:
        folder = let_sql(
            f"regexp_replace({p}.b.path, '[^/]*$', '')", lambda f: f"if({f} = '', '/', {f})"
        )
        target = (
            f"if(startswith({p}.r.path, '/'), {p}.r.path,"
            f" regexp_replace(concat({folder}, {p}.r.path), '/+', '/'))"
        )
        joined = f"array_join({let_sql(f'''split({target}, '/', -1)''', _remove_dots_sql)}, '/')"
        return let_sql(joined, lambda j: f"if({j} = '', '/', {j})")

    def choose(p: str) -> str:
        other_scheme = f"({p}.r.scheme <> '' and lower({p}.r.scheme) <> lower({p}.b.scheme))"
        same_page = f"{p}.r.path = ''"
        path = f"if({same_page}, {p}.b.path, {merged_path(p)})"
        query = f"if({same_page} and {p}.r.query = '', {p}.b.query, {p}.r.query)"
        inherited = f"concat({p}.b.scheme, ':', {p}.b.authority, {path}, {query}, {p}.r.fragment)"
        with_host = (
            f"concat(if({p}.r.scheme = '', {p}.b.scheme, {p}.r.scheme), ':',"
            f" {p}.r.authority, {p}.r.path, {p}.r.query, {p}.r.fragment)"
        )
        return (
            f"case when {p}.href is null or {p}.href = '' then {p}.base when {other_scheme} or {p}.b.scheme = '' then {p}.href"
            f" when length({p}.r.authority) <= 2 then {inherited} else {with_host} end"
        )

    pair = (
        f"named_struct('base', {base}, 'href', {href}, 'b', {split_url_sql(base)}, 'r', {split_url_sql(href)})"
    )
    return let_sql(pair, choose)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of `href` found on the page `base`."""
    pair = F.struct(col(base).alias("x"), col(href).alias("y"))
    return bind(pair, lambda p: resolve_url_sql(f"{p}.x", f"{p}.y"))
