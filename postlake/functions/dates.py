"""Dates from the notations career sites use. Invalid values give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.sqltext import bind, let_sql, q
from postlake.functions.text import col, squeeze_sql, strip_sql

# Wordings of relative dates.
TODAY_WORDS = ["posted today", "today", "just posted"]
YESTERDAY_WORDS = ["posted yesterday", "yesterday"]
DAYS_AGO = r"^posted (\d+)\+? days? ago$"
MONTH_AGO_WORDS = ["posted 30+ days ago", "posted more than 30 days ago"]

_DASHED = r"^\d{4}-\d{2}-\d{2}$"
_COMPACT = r"^\d{8}(?:..)?$"
_WEEK = r"^\d{4}(?:W\d{2}(?:[1-7](?:..)?)?|-W\d{2}(?:-[1-7])?)$"
_US = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"
_RFC = (
    r"(?i)^(?:[a-z]+,\s*)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*[\s-]+(\d{2,4})"
    r"\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s.*)?$"
)


def _part(x: str, pattern: str, group: int = 1) -> str:
    return f"try_cast(regexp_extract({x}, {q(pattern)}, {group}) as int)"


def _date_sql(year: str, month: str, day: str) -> str:
    return f"try_to_date(format_string('%04d-%02d-%02d', {year}, {month}, {day}), 'yyyy-MM-dd')"


def iso_sql(x: str) -> str:
    """First ten characters as a calendar date, compact date or week date.

    After a compact date two more characters may follow, as in a compact timestamp cut to ten.
    """

    def week(h: str) -> str:
        # Week 1 holds 4 January; a week number is valid when its Thursday lies in the same year.
        year, number = _part(h, r"^(\d{4})"), _part(h, r"W(\d{2})")
        day = f"coalesce({_part(h, r'W\d{2}-?([1-7])')}, 1)"
        monday = let_sql(
            _date_sql(year, "1", "4"), lambda j: f"date_add({j}, ({number} - 1) * 7 - weekday({j}))"
        )
        return let_sql(
            monday,
            lambda m: f"if({number} > 0 and year(date_add({m}, 3)) = {year}, date_add({m}, {day} - 1), null)",
        )

    def read(h: str) -> str:
        return (
            f"case when startswith({h}, '0000') then null"
            f" when {h} rlike {q(_DASHED)} then try_to_date({h}, 'yyyy-MM-dd')"
            f" when {h} rlike {q(_COMPACT)} then try_to_date(left({h}, 8), 'yyyyMMdd')"
            f" when {h} rlike {q(_WEEK)} then {week(h)} end"
        )

    return let_sql(f"left({x}, 10)", read)


def iso_date(c: Column | str) -> Column:
    return bind(c, iso_sql)


def epoch_ms_date(c: Column | str) -> Column:
    return bind(c, lambda x: f"to_date(timestamp_millis(try_cast({x} as bigint)))")


def epoch_s_date(c: Column | str) -> Column:
    """Seconds since 1970 in UTC; zero counts as missing."""
    return bind(c, lambda x: f"to_date(timestamp_seconds(nullif(try_cast({x} as bigint), 0)))")


def us_sql(x: str) -> str:
    """`m/d/yy` or `m/d/yyyy`; years below 100 belong to this century."""
    year = let_sql(_part(x, _US, 3), lambda y: f"if({y} < 100, {y} + 2000, {y})")
    return f"if({x} rlike {q(_US)}, {_date_sql(year, _part(x, _US, 1), _part(x, _US, 2))}, null)"


def us_date(c: Column | str) -> Column:
    return bind(c, us_sql)


def rfc_sql(x: str) -> str:
    """Mail-style date; the calendar day as written, whatever the offset."""
    year = let_sql(
        _part(x, _RFC, 3), lambda y: f"case when {y} < 69 then {y} + 2000 when {y} < 100 then {y} + 1900 else {y} end"
    )
    months = "'jan feb mar apr may jun jul aug sep oct nov dec'"
    month = f"cast((position(lower(regexp_extract({x}, {q(_RFC)}, 2)), {months}) + 3) / 4 as int)"
    return f"if({x} rlike {q(_RFC)}, {_date_sql(year, month, _part(x, _RFC, 1))}, null)"


def rfc_date(c: Column | str) -> Column:
    return bind(c, lambda x: let_sql(strip_sql(x), rfc_sql))


def any_date(c: Column | str) -> Column:
    """ISO, then US short, then mail-style."""
    return bind(
        c,
        lambda x: let_sql(strip_sql(x), lambda v: f"coalesce({iso_sql(v)}, {us_sql(v)}, {rfc_sql(v)})"),
    )


def _listed(words: list[str]) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def relative_date(c: Column | str, anchor: Column | str) -> Column:
    """Wordings such as "Posted 3 Days Ago" counted back from `anchor`, else an ISO prefix."""

    def read(p: str) -> str:
        return let_sql(
            f"lower({squeeze_sql(f'{p}.x')})",
            lambda w: f"case when {w} in {_listed(TODAY_WORDS)} then {p}.today"
            f" when {w} in {_listed(YESTERDAY_WORDS)} then date_sub({p}.today, 1)"
            f" when {w} rlike {q(DAYS_AGO)} then date_sub({p}.today, {_part(w, DAYS_AGO)})"
            f" when {w} in {_listed(MONTH_AGO_WORDS)} then date_sub({p}.today, 30)"
            f" else {iso_sql(f'{p}.x')} end",
        )

    return bind(F.struct(col(c).alias("x"), col(anchor).alias("today")), read)


def date_notation(c: Column | str) -> Column:
    """Which notation a text date uses; NULL when none is recognised."""

    def classify(v: str) -> str:
        words = f"lower({squeeze_sql(v)})"
        relative = f"{words} in {_listed(TODAY_WORDS + YESTERDAY_WORDS + MONTH_AGO_WORDS)} or {words} rlike {q(DAYS_AGO)}"
        # Runs of nine digits and more are epochs; a compact date has eight.
        return (
            f"case when {relative} then 'relative' when {v} rlike {q(r'^\d{12,}$')} then 'epoch_ms'"
            f" when {v} rlike {q(r'^\d{9,11}$')} then 'epoch_s' when {iso_sql(v)} is not null then 'iso'"
            f" when {us_sql(v)} is not null then 'us' when {rfc_sql(v)} is not null then 'rfc' end"
        )

    return bind(c, lambda x: let_sql(strip_sql(x), classify))
