"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_LIST = T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One row per landed document: a list page or a detail page, JSON, XML or HTML text in `body`. `board` tells
# several sites of one type and company apart (see sources/boards.py).
CAPTURES = _struct(
    ("run_id", _S),
    ("company", _S),
    ("source_type", _S),
    ("kind", _S),
    ("page_no", T.IntegerType()),
    ("detail_key", _S),
    ("url", _S),
    ("status", T.IntegerType()),
    ("body", _S),
    ("fetched_at", T.TimestampType()),
    ("board", _S),
)

# One row per monitored company.
RULES = _struct(
    ("company_ord", T.LongType()),
    ("company", _S),
    ("slug", _S),
    ("enabled", T.BooleanType()),
    ("source_type", _S),
    ("ats_identifier", _S),
    ("careers_url", _S),
    ("api_endpoint", _S),
    ("location_filters", _LIST),
    ("title_keywords_include", _LIST),
    ("title_keywords_exclude", _LIST),
    ("description_keywords_include", _LIST),
    ("employment_types", _LIST),
    ("extra", T.MapType(T.StringType(), T.StringType())),
)

# What every source parser returns.
POSTINGS = _struct(
    ("run_id", _S),
    ("company", _S),
    ("company_ord", T.LongType()),
    ("page_no", T.IntegerType()),
    ("pos", T.IntegerType()),
    ("stable_job_id", _S),
    ("title", _S),
    ("location", _S),
    ("employment_type", _S),
    ("department", _S),
    ("description", _S),
    ("posting_url", _S),
    ("application_url", _S),
    ("source", _S),
    ("source_job_id", _S),
    ("date_posted", T.DateType()),
    ("fetched_at", T.TimestampType()),
)

POSTING_COLUMNS = [field.name for field in POSTINGS.fields]

# The header rows of the two output tables.
JOB_HEADERS = [
    "Company",
    "Title",
    "Location",
    "Department",
    "Employment Type",
    "Date Posted",
    "First Seen",
    "Match Reason",
    "Posting URL",
    "Application URL",
    "Source",
    "Source Job ID",
    "Deduplication Key",
    "Status",
    "Notes",
]
RUN_LOG_HEADERS = [
    "Run Timestamp",
    "Companies Checked",
    "Jobs Fetched",
    "Jobs Matched",
    "New Jobs Inserted",
    "Duplicates Skipped",
    "Failures",
    "Execution Duration Seconds",
]


def column_name(header: str) -> str:
    """Parquet-friendly column name of an output header."""
    return header.lower().replace(" ", "_")


JOBS = T.StructType([T.StructField(column_name(h), _S) for h in JOB_HEADERS])
KEYS = _struct(("dedup_key", _S), ("batch", _S))
SIGHTINGS = _struct(
    ("dedup_key", _S), ("first_seen", T.TimestampType()), ("last_seen", T.TimestampType()), ("n_seen", T.LongType())
)
FAILURES = _struct(("company_ord", T.LongType()), ("company", _S), ("message", _S))
RUN_LOG = T.StructType(
    [
        T.StructField("run_timestamp", _S),
        T.StructField("companies_checked", T.LongType()),
        T.StructField("jobs_fetched", T.LongType()),
        T.StructField("jobs_matched", T.LongType()),
        T.StructField("new_jobs_inserted", T.LongType()),
        T.StructField("duplicates_skipped", T.LongType()),
        T.StructField("failures", T.LongType()),
        T.StructField("failure_texts", _S),
        T.StructField("execution_duration_seconds", T.DoubleType()),
    ]
)
