"""Small inline captures and rules."""

from __future__ import annotations

import json
from datetime import datetime

from postlake.schema import CAPTURES, RULES

FETCHED = datetime(2026, 7, 20, 6, 0)


def capture(source, body, *, company="Acme", kind="list", page_no=0, detail_key=None, url=None, run_id="r1", status=200, board=None):
    text = body if isinstance(body, str) else json.dumps(body)
    return (run_id, company, source, kind, page_no, detail_key, url or f"https://{company.lower()}.example.com/jobs", status, text, FETCHED, board)


def detail(source, key, body, **kw):
    return capture(source, body, kind="detail", detail_key=key, page_no=None, **kw)


def rule(source, *, company="Acme", ord_=0, **fields):
    row = {name: None for name in RULES.fieldNames()}
    row.update(company=company, company_ord=ord_, source_type=source, enabled=True, extra={})
    row.update(fields)
    return tuple(row[name] for name in RULES.fieldNames())


def captures(spark, *rows):
    return spark.createDataFrame(list(rows), CAPTURES)


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), RULES)
