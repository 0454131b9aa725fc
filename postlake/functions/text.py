"""Text normalisation inside the JVM; no Python runs per row."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.sqltext import bind, each_sql, let_sql, q

# Every character that counts as white space when text is split or stripped.
WHITESPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Token and whole-text replacements of the normal forms.
TITLE_TOKENS = {"sr": "senior", "swe": "software engineer"}
LOCATION_ALIASES = {"u s": "us", "u s a": "usa", "united states of america": "united states"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.transform(F.array(value), body)[0]


def nonempty(c: Column | str) -> Column:
    """NULL for the empty string."""
    return F.nullif(col(c), F.lit(""))


def first_nonempty(*cols: Column | str) -> Column:
    return F.coalesce(*[nonempty(c) for c in cols])


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{WHITESPACE}]+|[{WHITESPACE}]+$')}, '')"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(f'[{WHITESPACE}]+')}, ' '))"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def _char_class(points: Iterable[int]) -> str:
    spans: list[list[int]] = []
    for point in sorted(points):
        if spans and point == spans[-1][1] + 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition restricted to ASCII, read off the Unicode tables.

    Dropping what is not ASCII leaves a plain per-character map: some characters fold to exactly one
    ASCII character (one `translate`), a few to several.
    """
    single_from: list[str] = []
    single_to: list[str] = []
    several: dict[str, str] = {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if not unicodedata.decomposition(char):
            continue
        folded = "".join(p for p in unicodedata.normalize("NFKD", char) if p < "\x80")
        if len(folded) == 1:
            single_from.append(char)
            single_to.append(folded)
        elif folded:
            several[char] = folded
    return "".join(single_from), "".join(single_to), several


def fold_sql(x: str) -> str:
    """Accents and compatibility forms reduced to ASCII; everything else outside ASCII is dropped."""
    single_from, single_to, several = _fold_tables()
    pairs = "\x02".join(f"{k}\x01{v}" for k, v in several.items())
    table = f"str_to_map({q(pairs)}, '\x02', '\x01')"
    spelled = each_sql(
        f"regexp_extract_all({x}, '(?s).', 0)",
        lambda ch: f"if(ascii({ch}) < 128, {ch}, coalesce(element_at({table}, {ch}), {ch}))",
    )
    several_class = q(_char_class(map(ord, several)))
    widened = f"if({x} rlike {several_class}, array_join({spelled}, ''), {x})"
    other = q(r"[^\x00-\x7F]")
    folded = f"regexp_replace(translate({widened}, {q(single_from)}, {q(single_to)}), {other}, '')"
    # As many bytes as characters: ASCII, found without a pattern. Broken UTF-8 is not, whatever its count.
    return f"if(octet_length({x}) = char_length({x}) and is_valid_utf8({x}), {x}, {folded})"


#: ASCII but lower-case letters and digits, each by itself: a bit set to `java.util.regex`, which ranges and complements are not.
_NO_WORD = "[" + "".join(f"\\x{point:02x}" for point in range(0x80) if not (chr(point).isdigit() or chr(point).islower())) + "]"


def norm_sql(x: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({fold_sql(x)}), {q(_NO_WORD + '+')}, ' ')), '')"


def norm_text(c: Column | str) -> Column:
    """Lower-case ASCII words separated by one space; NULL gives the empty string."""
    return bind(c, norm_sql)


def _cases(x: str, replacements: dict[str, str]) -> str:
    whens = " ".join(f"when {q(k)} then {q(v)}" for k, v in replacements.items())
    return f"case {x} {whens} else {x} end"


def title_from_norm(normed: Column | str) -> Column:
    """Title form of an already normalised text."""
    return bind(
        normed,
        lambda x: "array_join("
        + each_sql(f"split({x}, ' ')", lambda token: _cases(token, TITLE_TOKENS))
        + ", ' ')",
    )


def location_from_norm(normed: Column | str) -> Column:
    """Location form of an already normalised text."""
    return bind(normed, lambda x: _cases(x, LOCATION_ALIASES))


def norm_title(c: Column | str) -> Column:
    return title_from_norm(norm_text(c))


def norm_location(c: Column | str) -> Column:
    return bind(c, lambda x: let_sql(norm_sql(x), lambda n: _cases(n, LOCATION_ALIASES)))


def title_case_words(c: Column | str) -> Column:
    """`FULL_TIME` becomes `Full-Time`: underscores to hyphens, then every letter run capitalised."""
    return bind(
        c,
        lambda x: "array_join("
        + each_sql(
            f"regexp_extract_all(replace({x}, '_', '-'), {q(r'\p{L}+|\P{L}+')}, 0)",
            lambda run: f"initcap({run})",
        )
        + ", '')",
    )
