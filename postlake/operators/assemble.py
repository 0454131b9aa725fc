"""Putting list pages and detail pages together: page stop rules, first-wins, detail joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import html as H
from postlake.functions import urls as U
from postlake.functions.entities import unescape_sql
from postlake.functions.sqltext import bind, each_sql, keep_sql, let_sql, q
from postlake.functions.text import col
from postlake.session import materialize

_SITE = ["run_id", "company"]


def _site(df: DataFrame) -> list[str]:
    """Columns that name a site's run; with `company_ord`, two boards of one company are two sites."""
    return [*_SITE, "company_ord"] if "company_ord" in df.columns else _SITE


#: Pages whose running total is one window; a company's pages are cut into such blocks.
BLOCK_PAGES = 1_000


def with_running_total(
    pages: DataFrame, value: str, out: str, keys: list[str] | None = None
) -> DataFrame:
    """Cumulative sum of `value` along the pages of one company, by `page_no`.

    Pages are summed inside blocks, and the blocks' totals along the company, so a company with very
    many pages is not one task's work.
    """
    site = keys or _SITE
    blocked = pages.withColumn("_block", F.floor(F.col("page_no") / BLOCK_PAGES))
    before = Window.partitionBy(*site).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocked.groupBy(*site, "_block")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    within = Window.partitionBy(*site, "_block").orderBy("page_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inner = blocked.withColumn("_within", F.sum(value).over(within))
    return (
        inner.join(blocks, [*site, "_block"])
        .withColumn(out, F.col("_before") + F.col("_within"))
        .drop("_block", "_before", "_within")
    )


def page_report(
    pages: DataFrame,
    page_size: int,
    counted: str = "n_objects",
    length: str = "n_objects",
    total: str = "total",
    keys: list[str] | None = None,
) -> DataFrame:
    """The paging rule of list APIs as a report: `so_far`, and `stop` where no further page is needed.

    A page is the last one once the rows so far reach the reported total or the page is shorter than
    `page_size`. A missing total counts as "rows so far", so such a page is the last. `counted` are
    the rows that add up, `length` is the page length that is compared with `page_size`. The rule
    says what to fetch next; every landed page is parsed.
    """
    summed = with_running_total(pages, counted, "so_far", keys)
    reached = F.col("so_far") >= F.coalesce(F.col(total), F.col("so_far"))
    return summed.withColumn("stop", reached | (F.col(length) < page_size))


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key.

    The rank filter is planned as a group limit on both sides of the exchange, so a hot key sends one
    row per map task, not all of its rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def first_by_id(summaries: DataFrame, id_column: str = "source_job_id") -> DataFrame:
    return first_wins(summaries, [*_site(summaries), id_column], ["page_no", "pos"])


def attach_details(rows: DataFrame, details: DataFrame, key: str = "detail_key") -> DataFrame:
    """Left join of list rows to detail documents by run, site and detail key.

    Rows without a key take a unique one that matches nothing: they spread over all partitions
    instead of meeting in the one for NULL.
    """
    lonely = F.concat(F.lit("\x00"), F.col("page_no"), F.lit(":"), F.col("pos"))
    keyed = rows.withColumn(key, F.coalesce(F.col(key), lonely))
    shared = [c for c in _site(rows) if c in details.columns]
    return keyed.join(details, [*shared, key], "left")


def has_more_icims(body: Column | str, page_no: Column | str) -> Column:
    """Whether a page mentions the next page number; a substring test, so `pr=2` also fits `pr=20`."""
    following = (col(page_no) + 1).cast("string")
    text = col(body)
    return F.contains(text, F.concat(F.lit("pr="), following)) | F.contains(
        text, F.concat(F.lit("pr%3D"), following)
    )


def page_markers(body: Column | str) -> Column:
    """Every offset marker on a page, so that the body need not travel to the offset test."""
    return F.array_distinct(
        F.regexp_extract_all(
            col(body), F.lit(r"(?:jobOffset|folderOffset)(?:=|%3D)[0-9]+"), F.lit(0)
        )
    )


def has_more_offset(markers: Column | str, next_offset: Column | str) -> Column:
    """Whether any marker starts with the next offset, as a substring test on the page would find."""
    offset = col(next_offset).cast("string")
    return F.exists(
        col(markers),
        lambda m: F.startswith(F.regexp_extract(m, "([0-9]+)$", 1), offset),
    )


def offset_param(kinds: Column | str, page_no: Column | str) -> Column:
    """Offset parameter of a site: `folderOffset` when its first page links any folder."""
    window = Window.partitionBy(*_SITE)
    folder = F.max(
        F.coalesce((col(page_no) == 0) & F.array_contains(col(kinds), "FolderDetail"), F.lit(False))
    ).over(window)
    return F.when(folder, F.lit("folderOffset")).otherwise(F.lit("jobOffset"))


_NEXT_LINK = r"""(?is)<a\b([^>]*href=["'][^"']*startrow=\d+[^"']*["'][^>]*)>"""


def next_page(body: Column | str, url: Column | str) -> Column:
    """URL of the smallest start row beyond the current one among the links of a page."""

    def start_row(u: str) -> str:
        return f"coalesce(try_cast({U.query_param_sql(u, 'startrow')} as int), 0)"

    def pick(p: str) -> str:
        targets = each_sql(
            f"regexp_extract_all({p}.body, {q(_NEXT_LINK)}, 1)",
            lambda a: U.resolve_url_sql(f"{p}.url", unescape_sql(H.quoted_attribute_sql(a, "href"))),
        )
        found = each_sql(
            f"filter({targets}, t -> t is not null)",
            lambda t: f"named_struct('startrow', {start_row(t)}, 'url', {t})",
        )
        later = let_sql(
            start_row(f"{p}.url"), lambda current: keep_sql(found, lambda f: f"{f}.startrow > {current}")
        )
        return f"array_min({later}).url"

    return bind(F.struct(col(body).alias("body"), col(url).alias("url")), pick)


def drop_requisition_repeats(rows: DataFrame, url_id: str, requisition: str) -> DataFrame:
    """Skip a summary whose URL id is the requisition id of an earlier kept posting of the company.

    Two URL ids with one requisition id both stay. URL ids are unique within a run and company. The
    rows are written once; only the slim ids of claiming and claimed postings are joined to settle
    who is skipped.
    """
    held = materialize(rows, "requisitions")
    site = _site(rows)
    gone = _skipped(held.select(*site, "page_no", "pos", url_id, requisition), url_id, requisition)
    return held.join(gone.withColumnRenamed("id", url_id), [*site, url_id], "left_anti").select(
        *rows.columns
    )


def _skipped(rows: DataFrame, url_id: str, requisition: str) -> DataFrame:
    """Ids of skipped postings. A claimed posting is skipped if one of its claimers is kept.

    A posting claims at most one other, so claims form trees. Each round settles postings whose
    claimers are settled; one with a single open claimer is the opposite of it and points there, and
    pointers double. Chains of any length take a logarithmic number of rounds.
    """
    site = _site(rows)
    place = F.struct("page_no", "pos")
    slim = rows.select(*site, F.col(url_id).alias("id"), place.alias("place"), F.col(requisition).alias("to"))
    claims = slim.where("to is not null and id <> to").select(*site, F.col("id").alias("by"), "to", F.col("place").alias("by_place"))
    claimed = slim.select(*site, F.col("id").alias("to"), "place")
    edges = claims.join(claimed, [*site, "to"]).where("by_place < place").select(*site, "by", "to")
    edges = materialize(edges, "claims")
    targets = edges.select(*site, F.col("to").alias("id")).distinct()
    state = materialize(
        targets.select(
            *site, "id", F.lit(None).cast("boolean").alias("kept"),
            F.lit(None).cast("string").alias("ptr"), F.lit(False).alias("same"),
        ),
        "state",
    )
    while not state.where("kept is null").isEmpty():
        # Claimers that nobody claims are kept.
        by = state.select(*site, F.col("id").alias("by"), "kept", F.lit(True).alias("is_target"))
        told = edges.join(by, [*site, "by"], "left").withColumn(
            "kept", F.when(F.col("is_target"), F.col("kept")).otherwise(F.lit(True))
        )
        votes = told.groupBy(*site, F.col("to").alias("id")).agg(
            F.max("kept").alias("any_kept"),
            F.count(F.when(F.col("kept").isNull(), 1)).alias("n_open"),
            F.max(F.when(F.col("kept").isNull(), F.col("by"))).alias("open_by"),
        )
        voted = state.join(votes, [*site, "id"]).withColumns(
            {
                "kept": F.coalesce(
                    "kept",
                    F.when(F.coalesce("any_kept", F.lit(False)), F.lit(False)).when(F.col("n_open") == 0, F.lit(True)),
                ),
                "same": F.when(F.col("ptr").isNull(), F.lit(False)).otherwise(F.col("same")),
                "ptr": F.coalesce("ptr", F.when(F.col("n_open") == 1, F.col("open_by"))),
            }
        )
        ahead = state.select(
            *site, F.col("id").alias("ptr"), F.col("kept").alias("p_kept"), F.col("ptr").alias("p_ptr"), F.col("same").alias("p_same")
        )
        jumped = voted.join(ahead, [*site, "ptr"], "left")
        follow = F.col("p_ptr").isNotNull()
        state = materialize(
            jumped.select(
                *site, "id",
                F.coalesce("kept", F.col("p_kept") == F.col("same")).alias("kept"),
                F.when(follow, F.col("p_ptr")).otherwise(F.col("ptr")).alias("ptr"),
                F.when(follow, F.col("same") == F.col("p_same")).otherwise(F.col("same")).alias("same"),
            ),
            "state",
        )
    return state.where("not kept").select(*site, "id")


def location_pushdown(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep rows of the configured country, region and city, before any detail is joined.

    The country defaults to `us` when the company's location filters name the United States. `df`
    holds `country`, `region` and `city` next to `company`; an unset filter lets every row pass.
    """
    filters = F.transform("location_filters", lambda f: F.lower(F.trim(f)))
    names_us = F.arrays_overlap(filters, F.array(*map(F.lit, ["united states", "us", "usa"])))
    wanted = rules.select(
        "company",
        F.coalesce(
            F.nullif(F.col("extra")["country"], F.lit("")), F.when(names_us, F.lit("us"))
        ).alias("_country"),
        F.nullif(F.col("extra")["region"], F.lit("")).alias("_region"),
        F.nullif(F.col("extra")["city"], F.lit("")).alias("_city"),
    )
    joined = df.join(wanted, "company")
    for name in ["country", "region", "city"]:
        joined = joined.where(
            F.col(f"_{name}").isNull() | (F.lower(name) == F.lower(f"_{name}"))
        )
    return joined.drop("_country", "_region", "_city")
