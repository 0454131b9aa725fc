"""SQL fragments shared by the check queries. Independent of the Column expressions they check."""

from __future__ import annotations

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm(x: str) -> str:
    plain = f"regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(lower({plain}), '[^a-z0-9]+', ' ', 'g'))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def unescape(x: str) -> str:
    """The references that occur in the test tables."""
    out = x
    for name, char in [
        ("nbsp", "chr(160)"), ("copy", "chr(169)"), ("middot", "chr(183)"),
        ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"),
    ]:
        out = f"replace({out}, '&{name};', {char})"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


def strip_html(x: str, drop_scripts: bool = False) -> str:
    out = x
    if drop_scripts:
        out = f"regexp_replace({out}, '(?is)<script\\b.*?</script>', ' ', 'g')"
        out = f"regexp_replace({out}, '(?is)<style\\b.*?</style>', ' ', 'g')"
    return squeeze(unescape(f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"))


def norm_url(u: str) -> str:
    """For absolute URLs, as all URLs of the test tables are."""
    scheme = f"lower(regexp_extract({u}, '^([^:]+):', 1))"
    host = f"lower(regexp_extract({u}, '^[^:]+://([^/?#]*)', 1))"
    path = f"regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1)"
    path = f"regexp_replace(regexp_replace({path}, '/+', '/', 'g'), '/$', '')"
    query = f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
    pairs = f"list_filter(string_split({query}, '&'), lambda p: p <> '')"
    key = "lower(regexp_extract(p, '^([^=]*)', 1))"
    kept = (
        f"list_filter({pairs}, lambda p: {key} not in ('gh_src','lever-source','source','ref','referrer')"
        f" and not starts_with({key}, 'utm_'))"
    )
    joined = f"array_to_string(list_sort({kept}), '&')"
    return (
        f"({scheme} || '://' || {host} || {path} || case when {joined} <> '' then '?' || {joined} else '' end)"
    )


def sha16(x: str) -> str:
    return f"left(sha256({x}), 16)"
