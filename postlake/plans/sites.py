"""Captures that Spark packs from the test tables, one builder per source type.

JSON sites come from `orders` (20 rows per list page, 12 pages per company), HTML and XML sites from
`part` (10 rows per page, 8 pages per company). Page groups are bounded by construction, and the
number of companies grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.plans.registry import table
from postlake.schema import CAPTURES, RULES

JSON_PAGE, JSON_PAGES = 20, 12
HTML_PAGE, HTML_PAGES = 10, 8

# The same page arithmetic in SQL.
ORDERS_SQL = """
  select o_orderkey as n, o_orderkey // 240 as c, 'Company ' || (o_orderkey // 240) as company,
         cast(o_orderkey // 20 % 12 as bigint) as page_no, cast(o_orderkey % 20 as bigint) as pos,
         o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate
  from orders"""
PARTS_SQL = """
  select p_partkey as n, p_partkey // 80 as c, 'Firm ' || (p_partkey // 80) as company,
         cast(p_partkey // 10 % 8 as bigint) as page_no, cast(p_partkey % 10 as bigint) as pos,
         p_name, p_brand, p_type, p_size
  from part"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        n.alias("n"),
        F.floor(n / 240).alias("c"),
        F.concat(F.lit("Company "), F.floor(n / 240).cast("string")).alias("company"),
        (F.floor(n / 20) % 12).cast("int").alias("page_no"),
        (n % 20).cast("int").alias("pos"),
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        n.alias("n"),
        F.floor(n / 80).alias("c"),
        F.concat(F.lit("Firm "), F.floor(n / 80).cast("string")).alias("company"),
        (F.floor(n / 10) % 8).cast("int").alias("page_no"),
        (n % 10).cast("int").alias("pos"),
        "p_name",
        "p_brand",
        "p_type",
        "p_size",
    )


#: Rows of a task that builds and parses pages.
TASK_ROWS = 10_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt by page to as many tasks as their number asks for.

    A table is small next to the pages built from it, so its files give few tasks; pages are packed and parsed without
    another exchange.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks, "c", "company", "page_no")


def rules_for(rows: DataFrame, source: str, **fields: Column) -> DataFrame:
    """One enabled rule row per company of `rows`."""
    companies = rows.select("c", "company").distinct()
    chosen = []
    defaults = {
        "company_ord": F.col("c"),
        "company": F.col("company"),
        "slug": F.concat(F.lit("c-"), F.col("c").cast("string")),
        "enabled": F.lit(True),
        "source_type": F.lit(source),
        "careers_url": F.concat(F.lit("https://c"), F.col("c").cast("string"), F.lit(".example.com/jobs/")),
        "ats_identifier": F.concat(F.lit("ats "), F.col("c").cast("string")),
    }
    for f in RULES.fields:
        value = fields.get(f.name, defaults.get(f.name, F.lit(None)))
        chosen.append(value.cast(f.dataType).alias(f.name))
    return companies.select(*chosen)


def as_captures(df: DataFrame, source: str, kind: str, **fields: Column) -> DataFrame:
    defaults = {
        "run_id": F.lit("r1"),
        "company": F.col("company"),
        "source_type": F.lit(source),
        "kind": F.lit(kind),
        "status": F.lit(200),
        "fetched_at": F.lit("2026-07-20 06:00:00"),
    }
    chosen = []
    for f in CAPTURES.fields:
        value = fields.get(f.name, defaults.get(f.name, F.lit(None)))
        chosen.append(value.cast(f.dataType).alias(f.name))
    return df.select(*chosen)


def packed(rows: DataFrame, item: Column, separator: str) -> DataFrame:
    """One row per company page with its items joined in order; at most one page size of rows each."""
    items = rows.select("c", "company", "page_no", F.struct("pos", item.alias("item")).alias("x"))
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]), separator
    )
    return items.groupBy("c", "company", "page_no").agg(joined.alias("items"))


def text(c: Column | str) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _host() -> Column:
    return F.concat(F.lit("https://c"), text("c"), F.lit(".example.com"))


def every(k: int, value: Column, other: Column | None = None) -> Column:
    """`value` on rows whose number is divisible by k, else `other`."""
    return F.when(F.col("n") % k == 0, value).otherwise(F.lit(None) if other is None else other)


# -- JSON ---------------------------------------------------------------------------------------


def greenhouse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = orders(spark, sf_dir)
    url = F.concat(_host(), F.lit("/jobs/"), text("n"), F.lit("?gh_src=x"))
    item = F.to_json(
        F.struct(
            F.col("n").alias("id"),
            every(11, F.lit(""), F.col("o_orderpriority")).alias("title"),
            F.when(F.col("n") % 9 != 4, url).alias("absolute_url"),
            F.when(F.col("n") % 5 != 0, F.struct(F.concat(F.lit("City "), text(F.col("o_custkey") % 7)).alias("name"))).alias("location"),
            F.when(F.col("n") % 3 != 0, F.array(F.struct(F.concat(F.lit("Dept "), F.col("o_orderstatus")).alias("name")))).otherwise(
                F.array().cast("array<struct<name:string>>")
            ).alias("departments"),
            every(4, F.lit(""), F.concat(F.lit("<p>"), F.col("o_orderstatus"), F.lit(" &amp; more</p>"))).alias("content"),
            every(13, F.lit("soon"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:00:00Z"))).alias("updated_at"),
            every(2, F.struct(F.lit("Full-time").alias("employment_type"))).alias("metadata"),
        )
    )
    docs = packed(rows, item, ",")
    body = F.concat(F.lit('{"jobs":['), F.col("items"), F.lit(',"note",5,null],"meta":{"total":1}}'))
    return as_captures(docs, "greenhouse", "list", page_no=F.col("page_no"), body=body, url=_host()), rules_for(rows, "greenhouse")


def lever(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = orders(spark, sf_dir)
    section = F.struct(F.concat(F.lit("<li>"), F.col("o_orderpriority"), F.lit("</li>")).alias("content"))
    blank = F.struct(F.lit("").alias("content"))
    hosted = F.concat(_host(), F.lit("/"), text("n"))
    item = F.to_json(
        F.struct(
            F.concat(F.lit("L"), text("n")).alias("id"),
            F.when(F.col("n") % 7 != 0, F.col("o_orderpriority")).alias("text"),
            every(2, hosted).alias("hostedUrl"),
            F.when(F.col("n") % 2 == 1, hosted).alias("hosted_url"),
            every(3, F.concat(hosted, F.lit("/apply"))).alias("applyUrl"),
            F.unix_millis("o_orderdate").alias("createdAt"),
            F.struct(
                F.concat(F.lit("Team "), F.col("o_orderstatus")).alias("team"),
                every(4, F.lit(None).cast("string"), F.lit("Berlin")).alias("location"),
                F.lit("Full-time").alias("commitment"),
            ).alias("categories"),
            every(5, F.lit(""), F.lit("Plain text.")).alias("descriptionPlain"),
            every(10, F.lit("Other text.")).alias("description"),
            F.array(section, blank, section).alias("lists"),
        )
    )
    docs = packed(rows, item, ",")
    array = F.concat(F.lit("["), F.col("items"), F.lit(",7]"))
    wrapped = F.concat(F.lit('{"postings":'), array, F.lit("}"))
    body = F.when(F.col("page_no") % 2 == 0, array).otherwise(wrapped)
    return as_captures(docs, "lever", "list", page_no=F.col("page_no"), body=body, url=_host()), rules_for(rows, "lever")


def ashby(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = orders(spark, sf_dir)
    city = F.concat(F.lit("City "), text(F.col("o_custkey") % 7))
    base = F.struct(
        F.concat(F.lit("A"), text("n")).alias("id"),
        F.when(F.col("n") % 6 != 0, F.col("o_orderpriority")).alias("title"),
        every(3, F.concat(_host(), F.lit("/"), text("n"))).alias("jobUrl"),
        F.when(F.col("n") % 3 == 1, F.concat(_host(), F.lit("/x/"), text("n"))).alias("externalLink"),
        every(5, F.lit("FullTime")).alias("employmentType"),
        F.when(F.col("n") % 5 == 1, F.lit("PartTime")).alias("employment_type"),
        every(4, F.lit("Plain.")).alias("descriptionPlain"),
        F.lit("<p>Html.</p>").alias("descriptionHtml"),
        every(2, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("publishedDate"),
        F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
    )
    # The location is an object on even rows and plain text on odd ones; so is the department.
    place = F.when(F.col("n") % 2 == 0, F.to_json(F.struct(city.alias("name")))).otherwise(
        F.concat(F.lit('"'), city, F.lit('"'))
    )
    unit = F.when(F.col("n") % 3 == 0, F.to_json(F.struct(F.col("o_orderstatus").alias("name")))).otherwise(F.lit('""'))
    head = F.regexp_replace(F.to_json(base), r"\}$", "")
    item = F.concat(head, F.lit(',"location":'), place, F.lit(',"department":'), unit, F.lit("}"))
    docs = packed(rows, item, ",")
    body = F.concat(F.lit('{"jobs":['), F.col("items"), F.lit("]}"))
    return as_captures(docs, "ashby", "list", page_no=F.col("page_no"), body=body, url=_host()), rules_for(rows, "ashby")


def _paged_total() -> Column:
    """Reported total as a JSON member: 100 for every third company, missing on one page of another."""
    return (
        F.when(F.col("c") % 3 == 0, F.lit('"TOTAL":100,'))
        .when((F.col("c") % 3 == 1) & (F.col("page_no") == 4), F.lit(""))
        .otherwise(F.lit('"TOTAL":10000,'))
    )


def _gaps(item: Column) -> Column:
    """Some elements of page 7 of every third company are no objects."""
    gap = (F.col("c") % 3 == 2) & (F.col("page_no") == 7) & (F.col("pos") >= 15)
    return F.when(gap, F.lit('"gap"')).otherwise(item)


# Kept pages of paged JSON sites at page size 20 and a cap of 10 pages, in SQL.
def listed_orders_sql() -> str:
    """Orders that are objects on their page."""
    return f"""
  site as ({ORDERS_SQL}),
  kept as (select * from site where not (c % 3 = 2 and page_no = 7 and pos >= 15))"""


def page_report_sql(raw_length: bool) -> str:
    """Rows so far and stop flag of every order page."""
    length = "count(*)" if raw_length else "count(*) filter (not (c % 3 = 2 and page_no = 7 and pos >= 15))"
    return f"""
  site as ({ORDERS_SQL}),
  page as (select c, company, page_no, {length} as len,
                  count(*) filter (not (c % 3 = 2 and page_no = 7 and pos >= 15)) as objs
           from site group by all),
  total as (select *, cast(sum(objs) over (partition by c order by page_no) as bigint) as so_far from page)
  select c, page_no, so_far, cast(so_far >= case when c % 3 = 0 then 100 when c % 3 = 1 and page_no = 4 then so_far
                                            else 10000 end or len < 20 as bigint) as stop from total"""


def workday(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = orders(spark, sf_dir)
    relative = F.array(*[F.lit(x) for x in ["Posted Today", "Posted Yesterday", "Posted 10 Days Ago", "Posted 30+ Days Ago"]])
    posted = F.when(F.col("n") % 5 < 4, F.get(relative, (F.col("n") % 5).cast("int"))).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    fields = F.array(
        F.struct(F.lit("Grade").alias("label"), F.lit("7").alias("text")),
        F.struct(F.lit("Time Type").alias("label"), every(4, F.lit(""), F.lit("Full time")).alias("text")),
        F.struct(F.lit("Employment").alias("label"), F.lit("Other").alias("text")),
    )
    item = F.to_json(
        F.struct(
            F.when(F.col("n") % 8 != 0, F.col("o_orderpriority")).alias("title"),
            every(3, F.concat(F.lit("https://abs.example.com/"), text("n")), F.concat(F.lit("/job/"), text("n"))).alias("externalPath"),
            F.when(F.col("n") % 2 == 0, F.concat(F.lit("US, City "), text(F.col("o_custkey") % 7))).alias("locationsText"),
            F.lit("Elsewhere").alias("location"),
            posted.alias("postedOn"),
            F.array(every(7, F.lit(""), F.concat(F.lit(" JR"), text("n")))).alias("bulletFields"),
            F.col("n").alias("id"),
            every(2, F.lit("Family")).alias("jobFamily"),
            every(5, F.lit("Dept")).alias("department"),
            every(2, F.struct(fields.alias("jobDescriptionFields"))).alias("jobPostingInfo"),
        )
    )
    docs = packed(rows, _gaps(item), ",")
    body = F.concat(F.lit("{"), F.replace(_paged_total(), F.lit("TOTAL"), F.lit("total")), F.lit('"jobPostings":['), F.col("items"), F.lit("]}"))
    return as_captures(docs, "workday", "list", page_no=F.col("page_no"), body=body, url=_host()), rules_for(rows, "workday")


def smartrecruiters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = orders(spark, sf_dir)
    endpoint = F.concat(F.lit("https://api.example.com/"), text("c"), F.lit("/postings"))
    place = F.struct(
        F.concat(F.lit("City "), text(F.col("o_custkey") % 7)).alias("city"),
        every(4, F.lit(""), F.lit("BY")).alias("region"),
        F.lit("de").alias("country"),
        (F.col("n") % 3 == 0).alias("remote"),
    )
    base = F.to_json(
        F.struct(
            F.concat(F.lit("S"), text("n")).alias("id"),
            every(2, F.concat(F.lit("u-"), text("n"))).alias("uuid"),
            F.concat(F.col("o_orderpriority"), F.lit(" (m/w)")).alias("name"),
            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00.000Z")).alias("releasedDate"),
            place.alias("location"),
            F.struct(F.lit("Unit").alias("label")).alias("department"),
            every(5, F.concat(F.lit("https://jobs.smartrecruiters.com/X/"), text("n"))).alias("jobAdUrl"),
            F.when(F.col("n") % 5 == 1, F.lit("https://careers.smartrecruiters.com/X")).alias("postingUrl"),
            F.lit("List text").alias("description"),
        )
    )
    ref = F.concat(endpoint, F.lit("/ref/"), text("n"))
    with_ref = (
        F.when(F.col("n") % 3 == 0, F.concat(F.lit(',"ref":"'), ref, F.lit('"}')))
        .when(F.col("n") % 3 == 1, F.concat(F.lit(',"ref":{"url":"'), ref, F.lit('"}}')))
        .otherwise(F.lit("}"))
    )
    item = F.concat(F.regexp_replace(base, r"\}$", ""), with_ref)
    docs = packed(rows, _gaps(item), ",")
    body = F.concat(F.lit("{"), F.replace(_paged_total(), F.lit("TOTAL"), F.lit("totalFound")), F.lit('"content":['), F.col("items"), F.lit("]}"))
    lists = as_captures(docs, "smartrecruiters", "list", page_no=F.col("page_no"), body=body, url=F.concat(endpoint, F.lit("?limit=20&offset="), text(F.col("page_no") * 20)))
    by_id = F.concat(endpoint, F.lit("/"), every(2, F.concat(F.lit("u-"), text("n")), F.concat(F.lit("S"), text("n"))))
    # Four rows in five have a detail; the department is present there, but null.
    detail = F.to_json(
        F.struct(
            F.struct(
                F.lit("About us &amp; you").alias("companyDescription"),
                F.concat(F.lit("<p>"), F.col("o_orderstatus"), F.lit("</p>")).alias("jobDescription"),
                F.lit("").alias("qualifications"),
            ).alias("jobAd"),
            F.struct(F.lit("Permanent").alias("label")).alias("typeOfEmployment"),
            every(6, F.concat(F.lit("https://apply.example.com/"), text("n"))).alias("applyUrl"),
        )
    )
    detail = F.concat(F.regexp_replace(detail, r"\}$", ""), F.lit(',"department":null}'))
    found = rows.where(F.col("n") % 5 != 4)
    details = as_captures(
        found, "smartrecruiters", "detail", body=detail,
        detail_key=F.when(F.col("n") % 3 == 2, by_id).otherwise(ref),
    )
    extra = F.create_map(F.lit("fetch_details"), F.when(F.col("c") % 4 == 3, F.lit("false")).otherwise(F.lit("true")))
    return lists.unionByName(details), rules_for(rows, "smartrecruiters", extra=extra)


def eightfold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = orders(spark, sf_dir)
    city = F.concat(F.lit("City "), text(F.col("o_custkey") % 7))
    item = F.to_json(
        F.struct(
            (F.col("n") + 1).alias("id"),
            F.col("o_orderpriority").alias("name"),
            F.array(city, F.lit(""), F.lit("Oslo")).alias("locations"),
            every(2, F.array(F.concat(city, F.lit(", NO"))), F.array().cast("array<string>")).alias("standardizedLocations"),
            F.unix_seconds("o_orderdate").alias("postedTs"),
            F.lit("Dept").alias("department"),
            every(3, F.concat(F.lit("/careers/p/"), text("n"))).alias("positionUrl"),
            (F.col("n") % 4 == 0).alias("isFullTime"),
        )
    )
    docs = packed(rows, _gaps(item), ",")
    body = F.concat(F.lit('{"status":200,"data":{'), F.replace(_paged_total(), F.lit("TOTAL"), F.lit("count")), F.lit('"positions":['), F.col("items"), F.lit("]}}"))
    lists = as_captures(docs, "eightfold", "list", page_no=F.col("page_no"), body=body, url=_host())
    detail = F.to_json(
        F.struct(
            F.struct(
                F.concat(F.lit("<b>"), F.col("o_orderstatus"), F.lit("</b> &lt;x&gt;")).alias("jobDescription"),
                every(6, F.lit("Contract")).alias("employmentType"),
            ).alias("data")
        )
    )
    found = rows.where(F.col("n") % 5 != 4)
    details = as_captures(found, "eightfold", "detail", body=detail, detail_key=text(F.col("n") + 1))
    extra = F.create_map(F.lit("fetch_details"), F.when(F.col("c") % 4 == 3, F.lit("false")).otherwise(F.lit("true")))
    return lists.unionByName(details), rules_for(rows, "eightfold", extra=extra)


# -- HTML and XML -------------------------------------------------------------------------------


def _id() -> Column:
    """Posting id of a row: two rows per page repeat an earlier one."""
    return (
        F.when(F.col("pos") == 9, F.col("n") - 1)
        .when((F.col("pos") == 0) & (F.col("page_no") > 0), F.col("n") - 10)
        .otherwise(F.col("n"))
    )


ID_SQL = "case when pos = 9 then n - 1 when pos = 0 and page_no > 0 then n - 10 else n end"


def _html(items: Column, footer: Column) -> Column:
    return F.concat(
        F.lit('<!doctype html><html><body><a href="/careers/Login">Login</a> <a href="/jobs/login">in</a>\n<section>'),
        items,
        F.lit("</section>"),
        footer,
        F.lit("</body></html>"),
    )


def icims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    listed = parts(spark, sf_dir)
    rows = spread(listed)
    title = F.concat(F.lit(' title="'), F.col("p_name"), F.lit(' &amp; co"'))
    item = F.concat(
        F.lit('<a class="x"'), every(2, title, F.lit("")), F.lit(' href="/jobs/'), text(_id()),
        F.lit('/role/job?in_iframe=1&amp;k=1">\n <b>'), F.col("p_name"), F.lit("</b> </a>"),
    )
    docs = packed(rows, item, "\n")
    more = F.when((F.col("c") % 4 == 1) & (F.col("page_no") == 5), F.lit("")).otherwise(
        F.concat(F.lit('<a href="?pr='), text(F.col("page_no") + 1), F.lit('">next</a>'))
    )
    lists = as_captures(
        docs, "icims", "list", page_no=F.col("page_no"), body=_html(F.col("items"), more),
        url=F.concat(_host(), F.lit("/jobs/search?pr="), text("page_no")),
    )
    posting = F.to_json(
        F.struct(
            F.lit("JobPosting").alias("@type"),
            every(4, F.lit(None).cast("string"), F.initcap("p_name")).alias("title"),
            F.concat(F.lit("<p>"), F.col("p_brand"), F.lit(" makes</p>\n<p>things.</p>")).alias("description"),
            F.lit("FULL_TIME").alias("employmentType"),
            F.concat(F.lit("2026-07-"), F.lpad(text(F.col("p_size") % 28 + 1), 2, "0")).alias("datePosted"),
            F.struct(
                F.struct(
                    F.concat(F.lit("City "), text(F.col("p_size"))).alias("addressLocality"),
                    F.lit("CA").alias("addressRegion"),
                    F.struct(F.lit("US").alias("name")).alias("addressCountry"),
                ).alias("address")
            ).alias("jobLocation"),
        )
    )
    body = F.concat(
        F.lit('<html><head><script type="application/ld+json">{broken</script><script type="application/ld+json">\n{"@graph":[{"@type":"Place"},'),
        posting, F.lit("]}</script></head></html>"),
    )
    details = as_captures(
        rows, "icims", "detail", body=every(3, F.lit("<html></html>"), body),
        detail_key=F.concat(_host(), F.lit("/jobs/"), text("n"), F.lit("/role/job?in_iframe=1&k=1")),
    )
    return lists.unionByName(details), rules_for(listed, "icims")


def avature(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    listed = parts(spark, sf_dir)
    rows = spread(listed)
    path = every(
        4,
        F.concat(F.lit("/careers/JobDetail?jobId="), text(_id()), F.lit("&amp;source=x")),
        F.concat(F.lit("/careers/JobDetail/Role-"), F.col("p_size").cast("string"), F.lit("/"), text(_id())),
    )
    link = F.concat(F.lit('<a href="'), path, F.lit('">\n'), F.col("p_name"), F.lit("</a>"))
    article = F.concat(
        F.lit("<article>"), link,
        F.lit('<div class="article__content">Snippet '), F.col("p_brand"),
        F.lit('</div><div><p><span class="icon icon-tag"></span> '), F.col("p_type"),
        F.lit('</p><p><span class="icon icon-address"></span> Town '), text("p_size"), F.lit("</p></div></article>"),
    )
    # Every fifth link lies outside any article of its own.
    item = every(5, link, article)
    docs = packed(rows, item, "\n")
    offset = (F.col("page_no") + 1) * HTML_PAGE - (F.col("page_no") + 1)
    more = F.when((F.col("c") % 4 == 1) & (F.col("page_no") == 5), F.lit("")).otherwise(
        F.concat(F.lit('<a href="/careers/SearchJobs?jobOffset='), text(offset), F.lit('">Next</a>'))
    )
    lists = as_captures(
        docs, "avature", "list", page_no=F.col("page_no"), body=_html(F.col("items"), more),
        url=F.concat(_host(), F.lit("/careers/SearchJobs")),
    )
    key = F.concat(
        _host(),
        every(
            4,
            F.concat(F.lit("/careers/JobDetail?jobId="), text("n"), F.lit("&source=x")),
            F.concat(F.lit("/careers/JobDetail/Role-"), F.col("p_size").cast("string"), F.lit("/"), text("n")),
        ),
    )
    details = as_captures(rows, "avature", "detail", body=avature_detail(), detail_key=key)
    return lists.unionByName(details), rules_for(listed, "avature")


def avature_detail() -> Column:
    """Detail page of a row; the fallbacks differ by its number modulo 4."""
    posting = F.to_json(
        F.struct(
            F.array(F.lit("JobPosting"), F.lit("Thing")).alias("@type"),
            F.struct(F.concat(F.lit("REQ-"), text("n")).alias("value")).alias("identifier"),
            F.concat(F.lit("<i>"), F.initcap("p_name"), F.lit("</i>")).alias("title"),
            F.concat(F.lit("<p>Build "), F.col("p_brand"), F.lit("</p>")).alias("description"),
            F.array(F.lit("FULL_TIME"), F.lit("INTERN")).alias("employmentType"),
            F.array(
                F.struct(F.struct(F.lit("Ulm").alias("addressLocality")).alias("address")),
                F.struct(F.struct(F.lit("Bonn").alias("addressLocality")).alias("address")),
            ).alias("jobLocation"),
        )
    )
    m = F.col("n") % 4
    ld = F.concat(F.lit('<html><head><script type="application/ld+json">'), posting, F.lit("</script></head><body></body></html>"))
    terms = F.concat(
        F.lit('<html><head><meta name="description" content="About '), F.col("p_brand"), F.lit(' &amp; more"></head><body><h1>'),
        F.col("p_name"), F.lit("</h1><dl><dt>Location</dt> <dd>Site "), text("p_size"),
        F.lit("</dd><dt>Work Type</dt><dd>Full-time</dd><dt>Team</dt><dd>Research</dd></dl></body></html>"),
    )
    divs = F.concat(
        F.lit('<html><body><script>var a = 1;</script><div class="article__content__view__field__label">Location</div>\n<div class="article__content__view__field__value">Area '),
        text("p_size"),
        F.lit('</div><div class="article__content__view__field__label">Business Area</div><div class="article__content__view__field__value">'),
        F.col("p_type"), F.lit("</div></body></html>"),
    )
    listed = F.concat(
        F.lit('<html><body><header><a>Same job available in 2 locations</a><p class="paragraph">Rome, '), F.col("p_type"),
        F.lit('</p><p class="paragraph">Turin</p></header><p>Employment Type: Regular | Department: '), F.col("p_brand"),
        F.lit(" • end</p></body></html>"),
    )
    return F.when(m == 0, ld).when(m == 1, terms).when(m == 2, divs).otherwise(listed)


def successfactors_xml(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    listed = parts(spark, sf_dir)
    rows = spread(listed)
    number = F.lpad(text("n"), 8, "0")
    item = F.concat(
        F.lit("<job><title>"), F.col("p_name"), F.lit(" &amp;amp; co</title><ReferenceNumber>"), number, F.lit("</ReferenceNumber><ID>x"), text("n"),
        F.lit("</ID><g:url>https://f.example.com/?a=1&amp;id="), text("n"), F.lit("</g:url><city>City "), text("p_size"), F.lit("</city><state>"),
        every(3, F.lit(""), F.lit("CA")), F.lit("</state><country>US</country>"),
        every(4, F.concat(F.lit("<location>A"), text("p_size"), F.lit("</location><location>B</location><location>B</location>")), F.lit("")),
        F.lit("<description><![CDATA[<p>Make "), F.col("p_brand"), F.lit("</p> & sell]]></description><job-type>"), F.col("p_type"), F.lit("</job-type>"),
        F.lit("<info><division>Div "), F.col("p_brand"), F.lit("</division></info><date>"),
        F.when(F.col("n") % 3 == 0, F.lit("Fri, 17 Jul 2026 23:00:00 -0700")).when(F.col("n") % 3 == 1, F.lit("2026-07-18")).otherwise(F.lit("07/19/26")),
        F.lit("</date></job>"),
    )
    docs = packed(rows, item, "\n")
    body = F.concat(F.lit('\n<?xml version="1.0"?><!-- feed --><jobs xmlns:g="urn:feed">'), F.col("items"), F.lit("</jobs>"))
    return as_captures(docs, "successfactors", "list", page_no=F.col("page_no"), body=body, url=_host()), rules_for(listed, "successfactors")


def successfactors_html(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    listed = parts(spark, sf_dir)
    rows = spread(listed)
    item = F.concat(
        F.lit('<tr class="data-row"><td><a href="/job/Role-'), text("p_size"), F.lit("/"), text(_id()), F.lit('/" class="jobTitle-link">'), F.col("p_name"),
        F.lit('</a></td><td class="colLocation x"><span> Town '), text("p_size"), F.lit("</span></td></tr>"),
    )
    docs = packed(rows, item, "\n")
    start = (F.col("page_no") + 1) * HTML_PAGE
    more = F.when((F.col("c") % 4 == 1) & (F.col("page_no") == 5), F.lit('<a href="?startrow=0">first</a>')).otherwise(
        F.concat(
            F.lit('<a href="?q=1&amp;startrow='), text(start + HTML_PAGE), F.lit('">later</a><a href="?q=1&amp;startrow='), text(start),
            F.lit('">next</a><a href="?startrow=0">first</a>'),
        )
    )
    url = F.concat(_host(), F.lit("/search/?startrow="), text(F.col("page_no") * HTML_PAGE))
    lists = as_captures(docs, "successfactors", "list", page_no=F.col("page_no"), body=_html(F.col("items"), more), url=url)
    details = as_captures(
        rows, "successfactors", "detail", body=rmk_detail(),
        detail_key=F.concat(_host(), F.lit("/job/Role-"), text("p_size"), F.lit("/"), text("n"), F.lit("/")),
    )
    extra = F.create_map(F.lit("fetch_details"), F.when(F.col("c") % 5 == 4, F.lit("false")).otherwise(F.lit("true")))
    return lists.unionByName(details), rules_for(listed, "successfactors", extra=extra)


# Requisition ids: the row three places on (a later URL id) for every seventh row, else R + number.
REQ_SQL = "case when n % 7 = 0 then cast(n + 3 as varchar) when n % 7 = 1 then null else 'R' || n end"


def rmk_detail() -> Column:
    requisition = every(
        7,
        F.concat(F.lit("Requisition ID: "), text(F.col("n") + 3)),
        F.when(F.col("n") % 7 == 1, F.lit("Grade: 7")).otherwise(F.concat(F.lit("Requisition ID: R"), text("n"))),
    )
    return F.concat(
        F.lit('<html><body><span itemprop="title">'), every(6, F.lit(""), F.initcap("p_name")),
        F.lit('</span><span itemprop="description"><span class="jobdescription">\n<p><strong>'), requisition,
        F.lit("<br>Work Area: "), F.col("p_brand"), F.lit("<br/>Employment Type: Regular &amp; Full Time</strong></p><p> </p>\n<p>Original Posting Date: 07/17/26</p>"),
        every(4, F.lit(""), F.concat(F.lit("<li>Location: San "), text("p_size"), F.lit("</li>"))),
        F.lit("<p>Make  things.</p></span></span></body></html>"),
    )


BUILDERS = {
    "greenhouse": greenhouse,
    "lever": lever,
    "ashby": ashby,
    "workday": workday,
    "smartrecruiters": smartrecruiters,
    "eightfold": eightfold,
    "icims": icims,
    "avature": avature,
}
