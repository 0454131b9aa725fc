"""Building blocks for expressions written as SQL text.

A long expression is cheaper to hand to Spark as one parsed text than as hundreds of Column calls.
Functions named `*_sql` take and return SQL text; `bind` turns them into a Column over any input.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_fresh = count()


def q(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let_sql(value: str, body: Callable[[str], str]) -> str:
    """Evaluate `value` once and use it several times in `body`."""
    name = f"v{next(_fresh)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def each_sql(values: str, body: Callable[[str], str]) -> str:
    """Array with `body` applied to every element."""
    name = f"v{next(_fresh)}"
    return f"transform({values}, {name} -> {body(name)})"


def keep_sql(values: str, test: Callable[[str], str]) -> str:
    """Array elements for which `test` holds."""
    name = f"v{next(_fresh)}"
    return f"filter({values}, {name} -> {test(name)})"


def bind(c: Column | str, body: Callable[[str], str]) -> Column:
    """Column of a SQL text over `c`: in place for a column name, bound once for an expression."""
    if isinstance(c, str):
        return F.expr(body(c))
    name = f"v{next(_fresh)}"
    return F.call_function("transform", F.array(c), F.expr(f"{name} -> {body(name)}"))[0]
