"""Queries B01-B10, B12, E06, W01, W04: paging, flattening and detail joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import urls as U
from postlake.functions import variants as V
from postlake.operators import assemble as A
from postlake.plans import sites
from postlake.plans.q_sources import SF_HTML_CTES
from postlake.plans.registry import query, table
from postlake.sources import avature, common, smartrecruiters, successfactors, workday

ORDER_ROWS = f"with site as ({sites.ORDERS_SQL})"
PART_ROWS = f"with site as ({sites.PARTS_SQL})"


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# -- events packed into user pages --------------------------------------------------------------

EVENT_PAGES = """
  numbered as (select *, cast(event_id // 5000 as bigint) as block, cast(event_id % 5000 // 20 as bigint) as page_no, cast(event_id % 20 as bigint) as pos from events)"""


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event captures: 20 rows per page, 250 pages per site, every seventh element no object."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.floor(F.col("event_id") / 5000).alias("c"),
        F.concat(F.lit("site "), F.floor(F.col("event_id") / 5000).cast("string")).alias("company"),
        F.floor(F.col("event_id") % 5000 / 20).cast("int").alias("page_no"),
        (F.col("event_id") % 20).cast("int").alias("pos"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('"'), "event_type", F.lit('"')))
        .otherwise(F.to_json(F.struct("event_id", "user_id", "event_type", F.parse_json("props").alias("props"))))
        .alias("item"),
    )
    docs = sites.packed(rows, F.col("item"), ",")
    return docs.select("company", "page_no", F.concat(F.lit('{"rows":['), "items", F.lit("]}")).alias("body"))


@query("B01_flatten_objects", f"""
  with {EVENT_PAGES}
  select 'site ' || block as company, page_no, pos, event_id, user_id, event_type, cast(json_extract(props, '$.k') as bigint) as k
  from numbered where event_id % 7 <> 0""")
def b01(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = event_pages(spark, sf_dir).select("company", "page_no", F.from_json("body", "struct<rows:array<variant>>")["rows"].alias("rows"))
    rows = common.explode_objects(pages, "rows")
    return rows.select(
        "company", F.col("page_no").cast("bigint").alias("page_no"), F.col("pos").cast("bigint").alias("pos"),
        F.try_variant_get("v", "$.event_id", "bigint").alias("event_id"), F.try_variant_get("v", "$.user_id", "bigint").alias("user_id"),
        V.text("v", "event_type").alias("event_type"), F.try_variant_get("v", "$.props.k", "bigint").alias("k"),
    )


def _page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order pages with their reported total and object count."""
    rows = sites.orders(spark, sf_dir)
    gap = (F.col("c") % 3 == 2) & (F.col("page_no") == 7) & (F.col("pos") >= 15)
    total = (
        F.when(F.col("c") % 3 == 0, 100)
        .when((F.col("c") % 3 == 1) & (F.col("page_no") == 4), F.lit(None))
        .otherwise(10000)
    )
    return rows.groupBy("c", "company", "page_no").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count(F.when(~gap, 1)).alias("n_objects")
    ).withColumn("total", total)


def _report(spark: SparkSession, sf_dir: str, length: str) -> DataFrame:
    found = A.page_report(_page_sizes(spark, sf_dir), workday.PAGE_SIZE, length=length, keys=["company"])
    return _long(found.select("c", "page_no", "so_far", "stop"), "page_no", "so_far", "stop")


@query("B02_page_report", f"with {sites.page_report_sql(raw_length=False)}")
def b02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "n_objects")


@query("B02_page_report_raw_length", f"with {sites.page_report_sql(raw_length=True)}")
def b02_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "n_raw")


@query("B03_first_by_id", """
  select user_id as id, event_type as company, min(event_id) as first_event from events group by all""")
def b03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.lit("r1").alias("run_id"), F.col("event_type").alias("company"), F.col("user_id").alias("id"), "event_id",
        F.floor(F.col("event_id") / 20).alias("page_no"), (F.col("event_id") % 20).alias("pos"),
    )
    return A.first_by_id(rows, "id").select("id", "company", F.col("event_id").alias("first_event"))


@query("B04_detail_overlay", f"""{ORDER_ROWS}
  select n, case when n % 2 = 0 then 'D' || o_custkey else 'L' || n end as a, case when n % 2 = 0 then null else 'list' end as b,
         'kept' as c, case when n % 2 = 0 then 'new' end as d from site""")
def b04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sites.orders(spark, sf_dir)
    key = F.col("n").cast("string")
    base = F.concat(F.lit('{"a":"L'), key, F.lit('","b":"list","c":"kept"}'))
    top = F.when(F.col("n") % 2 == 0, F.concat(F.lit('{"a":"D'), F.col("o_custkey").cast("string"), F.lit('","b":null,"d":"new"}')))
    maps = rows.select("n", V.as_map(F.parse_json(base)).alias("base"), V.as_map(F.try_parse_json(top)).alias("top"))
    merged = maps.select("n", V.overlay(F.col("base"), F.col("top")).alias("m"))
    return merged.select("n", *[V.entry_text("m", name).alias(name) for name in "abcd"])


@query("B05_details_off", f"""
  with {sites.listed_orders_sql()}
  select company, count(*) as n, count(*) filter (n % 5 <> 4 and c % 4 <> 3) as n_with_detail from kept group by 1""")
def b05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = smartrecruiters.parse_smartrecruiters(*sites.smartrecruiters(spark, sf_dir))
    return rows.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.count("employment_type").alias("n_with_detail"))


@query("B06_detail_key", f"""{ORDER_ROWS}
  select n, 'https://api.example.com/' || c || '/postings/' || case when n % 3 < 2 then 'ref/' || n when n % 2 = 0 then 'u-' || n else 'S' || n end as key from site
  where not (c % 3 = 2 and page_no = 7 and pos >= 15)""")
def b06(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, _ = sites.smartrecruiters(spark, sf_dir)
    pages = captures.where("kind = 'list'").select(
        F.substring_index("url", "?", 1).alias("endpoint"), F.from_json("body", "struct<content:array<variant>>")["content"].alias("rows")
    )
    rows = common.explode_objects(pages, "rows")
    number = F.regexp_extract(V.text("v", "id"), r"(\d+)", 1).cast("bigint")
    return rows.select(number.alias("n"), smartrecruiters.detail_reference(F.col("v"), F.col("endpoint")).alias("key"))


@query("B07_next_page", f"""{PART_ROWS}, page as (select distinct company, c, page_no from site)
  select company, page_no, case when not (c % 4 = 1 and page_no = 5)
         then 'https://c' || c || '.example.com/search/?q=1&startrow=' || (page_no + 1) * 10 end as next_url from page""")
def b07(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, _ = sites.successfactors_html(spark, sf_dir)
    pages = captures.where("kind = 'list'")
    return _long(pages.select("company", "page_no", A.next_page("body", "url").alias("next_url")), "page_no")


@query("B08_has_more", f"""{PART_ROWS}, page as (select distinct company, c, page_no from site)
  select company, page_no, cast(not (c % 4 = 1 and page_no = 5) as bigint) as by_number,
         cast(not (c % 4 = 1 and page_no = 5) as bigint) as by_offset from page""")
def b08(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered, _ = sites.icims(spark, sf_dir)
    offset, _ = sites.avature(spark, sf_dir)
    by_number = numbered.where("kind = 'list'").select("company", "page_no", A.has_more_icims("body", "page_no").cast("bigint").alias("by_number"))
    pages = offset.where("kind = 'list'").select(
        "run_id", "company", "page_no", A.page_markers("body").alias("markers"),
        F.size(F.array_distinct(F.transform(avature.posting_links("body"), lambda a: a["id"]))).alias("n"),
    )
    counted = A.with_running_total(pages, "n", "offset")
    by_offset = counted.select("company", "page_no", A.has_more_offset("markers", "offset").cast("bigint").alias("by_offset"))
    return _long(by_number.join(by_offset, ["company", "page_no"]), "page_no")


@query("B09_offset_param", f"""{PART_ROWS}, page as (select distinct company, c, page_no from site)
  select company, page_no, case when c % 2 = 0 then 'folderOffset' else 'jobOffset' end as param from page""")
def b09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder links on the first page decide; on later pages they do not."""
    captures, _ = sites.avature(spark, sf_dir)
    even = F.regexp_extract("company", r"(\d+)", 1).cast("bigint") % 2 == 0
    folders = F.replace("body", F.lit("/JobDetail"), F.lit("/FolderDetail"))
    body = F.when(even == (F.col("page_no") == 0), folders).otherwise(F.col("body"))
    pages = captures.where("kind = 'list'").withColumn("body", body).select(
        "run_id", "company", "page_no", F.transform(avature.posting_links("body"), lambda a: a["kind"]).alias("kinds")
    )
    return _long(pages.select("company", "page_no", A.offset_param("kinds", "page_no").alias("param")), "page_no")


@query("B10_requisition_repeats", f"""
  with {SF_HTML_CTES} select company, page_no, pos, id, req from left_over""")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, rules = sites.successfactors_html(spark, sf_dir)
    rows = successfactors.parse_successfactors_html(captures, rules)
    requisition = F.when(F.col("source_job_id") != F.col("stable_job_id"), F.col("source_job_id"))
    return _long(rows.select("company", "page_no", "pos", F.col("stable_job_id").cast("bigint").alias("id"), requisition.alias("req")), "page_no", "pos")


@query("B12_location_pushdown", """
  select l_orderkey, l_linenumber, l_partkey, l_quantity, s_name as company, n_name as country, r_name as region
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where case s_suppkey % 4 when 0 then n_name = 'NATION_3' when 1 then n_name = 'US' when 2 then r_name = 'ASIA' else true end""")
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sellers = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 4
    none = F.array().cast("array<string>")
    rules = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("company"),
        F.when(k == 1, F.array(F.lit("Remote"), F.lit(" USA "))).otherwise(none).alias("location_filters"),
        F.when(k == 0, F.create_map(F.lit("country"), F.lit("nation_3")))
        .when(k == 2, F.create_map(F.lit("region"), F.lit("Asia")))
        .otherwise(F.create_map(F.lit("other"), F.lit("x")))
        .alias("extra"),
    )
    rows = table(spark, sf_dir, "lineitem").join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("s_name").alias("company"), F.col("n_name").alias("country"),
        F.col("r_name").alias("region"), F.lit(None).cast("string").alias("city"),
    )
    return A.location_pushdown(rows, rules).drop("city")


@query("E06_detail_lookup", f"""
  with lines as (select l_orderkey as n, count(*) as n_lines from lineitem group by 1), site as ({sites.ORDERS_SQL})
  select site.n, company, page_no, pos, n_lines from site left join lines on lines.n = site.n and site.n % 5 <> 0""")
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as list rows, their line counts as details; rows without a key match nothing."""
    rows = sites.orders(spark, sf_dir).select(
        F.lit("r1").alias("run_id"), "company", "page_no", "pos", "n", F.when(F.col("n") % 5 != 0, F.col("n").cast("string")).alias("detail_key")
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    details = lines.select(
        F.lit("r1").alias("run_id"), F.concat(F.lit("Company "), F.floor(F.col("l_orderkey") / 240).cast("string")).alias("company"),
        F.col("l_orderkey").cast("string").alias("detail_key"), "n_lines",
    )
    return _long(A.attach_details(rows, details).select("n", "company", "page_no", "pos", "n_lines"), "page_no", "pos")


@query("W01_running_total", f"""
  with {EVENT_PAGES}, page as (select block, page_no, count(*) filter (event_id % 7 <> 0) as n from numbered group by all)
  select 'site ' || block as company, page_no, cast(sum(n) over (partition by block order by page_no) as bigint) as so_far from page""")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = event_pages(spark, sf_dir).select(
        F.lit("r1").alias("run_id"), "company", "page_no", F.from_json("body", "struct<rows:array<variant>>")["rows"].alias("rows")
    )
    counted = pages.select("run_id", "company", "page_no", F.size(V.objects("rows")).alias("n"))
    return _long(A.with_running_total(counted, "n", "so_far").select("company", "page_no", "so_far"), "page_no", "so_far")


@query("W04_smallest_later", """
  with p as (select page_id, cast(regexp_extract(url, '/(\\d+)', 1) as bigint) as start from pages)
  select page_id, (select min(k) from (select unnest([start + 30, start + 10, start - 5, start]) as k) where k > start) as next_start from p""")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).cast("bigint").alias("start"))
    link = "<a href=\"?startrow={}\">x</a>"
    offsets = [30, 10, -5, 0]
    body = F.concat(*[F.format_string(link.format("%d"), F.col("start") + o) for o in offsets])
    pages = rows.select("page_id", body.alias("body"), F.format_string("https://h.example.com/s?startrow=%d", "start").alias("url"))
    found = pages.select("page_id", A.next_page("body", "url").alias("u"))
    return found.select("page_id", U.query_param("u", "startrow").cast("bigint").alias("next_start"))
