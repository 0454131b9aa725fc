"""XML feeds: records at any depth and their fields by alias, kept as text.

Documents are parsed whole by the standard library's parser in Arrow batches: Spark's own `from_xml` ends the job at a
broken document and would turn a reference number such as 00123 into 123.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions.batches import pieces
from postlake.functions.sqltext import bind, q
from postlake.functions.text import WHITESPACE, nonempty

# Element names that hold one record, and what marks a document as XML.
RECORD_TAGS = ["job", "item", "entry", "jobposting", "job_listing"]
XML_START = r"^(?:<\?xml|<(?:jobs|job|rss|feed)\b)"

def is_xml(body: Column | str) -> Column:
    """Format sniff on the start of the document."""
    return bind(
        body, lambda b: f"regexp_replace({b}, {q(f'^[{WHITESPACE}]+')}, '') rlike {q(XML_START)}"
    )


_FIELD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
_FEED = T.StructType([T.StructField("error", T.StringType()), T.StructField("records", T.ArrayType(T.ArrayType(_FIELD)))])


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _text(element: ElementTree.Element) -> str:
    return html.unescape(" ".join(t for t in map(str.strip, element.itertext()) if t)).strip()


def _fields(record: ElementTree.Element) -> list[dict[str, str]]:
    described = (e for e in record.iter() if e is not record or _name(e.tag) not in RECORD_TAGS)
    pairs = ((re.sub("[^a-z0-9]+", "", _name(e.tag)), _text(e)) for e in described)
    return [{"key": key, "value": value} for key, value in pairs if key and value]


def _parsed(bodies: pd.Series) -> pd.DataFrame:
    found: dict[str, list] = {"error": [], "records": []}
    for body in bodies:
        error, records = None, []
        try:
            root = ElementTree.fromstring((body or "").strip())
        except ElementTree.ParseError as broken:
            error = str(broken)
        else:
            chosen = [e for e in root.iter() if _name(e.tag) in RECORD_TAGS]
            children = list(root)
            if not chosen and children and all(len(c) for c in children):
                chosen = children
            records = [_fields(e) for e in chosen]
        found["error"].append(error)
        found["records"].append(records)
    return pd.DataFrame(found)


@F.pandas_udf(_FEED)
def xml_feed(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """STRUCT<error, records> of each document: its records' fields, or why it cannot be read.

    A record is an element of a record name at any depth, records within records too; without any, the root's children
    if all of them nest. Its fields are all elements below it, at any depth and in document order, with their whole
    text; blank ones are left out. Keys are lower-case element names without prefix or punctuation.

    The fields of a few documents are held at a time, not those of a whole Arrow batch.
    """
    return (_parsed(piece) for batch in bodies for piece in pieces(batch))


def _values_sql(fields: str, key: str) -> str:
    return f"transform(filter({fields}, e -> e.key = {q(key)}), e -> e.value)"


def field_values(fields: Column | str, key: str) -> Column:
    return bind(fields, lambda f: _values_sql(f, key))


def first_field(fields: Column | str, *aliases: str) -> Column:
    """First value of the first alias that occurs."""
    return bind(
        fields,
        lambda f: "coalesce(" + ", ".join(f"try_element_at({_values_sql(f, a)}, 1)" for a in aliases) + ", null)",
    )


def xml_location(fields: Column | str) -> Column:
    """Distinct locations joined, else city, state or region, country."""
    listed = nonempty(F.array_join(F.array_distinct(field_values(fields, "location")), "; "))
    composed = nonempty(
        F.concat_ws(
            ", ",
            first_field(fields, "city"),
            first_field(fields, "state", "region"),
            first_field(fields, "country"),
        )
    )
    return F.coalesce(listed, composed)
