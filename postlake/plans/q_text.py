"""Queries J01-J06, C01-C37, W02: text, URLs, HTML, dates and XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import dates as D
from postlake.functions import html as H
from postlake.functions import text as T
from postlake.functions import urls as U
from postlake.functions import variants as V
from postlake.functions import xml as X
from postlake.functions.entities import unescape
from postlake.operators import tables
from postlake.operators.dedup import split_valid
from postlake.plans import sites, views
from postlake.plans.oracle import norm, norm_url, sha16, squeeze, strip_html, unescape as unescape_sql
from postlake.plans.q_sources import INITCAP
from postlake.plans.registry import query, table
from postlake.sources import avature, icims, smartrecruiters, successfactors

PART_ROWS = f"with site as ({sites.PARTS_SQL})"
ORDER_ROWS = f"with site as ({sites.ORDERS_SQL})"


def _details(spark: SparkSession, sf_dir: str, body) -> DataFrame:
    """Detail pages built from `part`, one row each, in as many tasks as their number asks for."""
    return sites.spread(sites.parts(spark, sf_dir)).select("n", body.alias("body"))


# -- table jobs ---------------------------------------------------------------------------------

_TITLE_NORM = f"array_to_string(list_transform(string_split({norm('title')}, ' '), lambda w: case w when 'sr' then 'senior' when 'swe' then 'software engineer' else w end), ' ')"
_TEXT_NORM = f"trim({norm('title')} || ' ' || {norm('description')} || ' ' || {norm('location')})"


@query("J01_normalise_postings", f"""
  with d as ({views.DOCS_SQL})
  select doc_id, {norm('company')} as norm_company, {_TITLE_NORM} as norm_title, {norm('location')} as norm_location,
         sha256(regexp_replace({_TEXT_NORM}, ' +', ' ', 'g')) as text_hash from d""")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tables.normalise_postings(views.docs(spark, sf_dir))
    return done.select("doc_id", "norm_company", "norm_title", "norm_location", F.sha2("norm_text", 256).alias("text_hash"))


@query("J01_equal_forms", f"""
  with d as ({views.DOCS_SQL})
  select sha256(regexp_replace({_TEXT_NORM}, ' +', ' ', 'g')) as text_hash, count(*) as n from d group by 1""")
def j01_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.equal_forms(tables.normalise_postings(views.docs(spark, sf_dir)))


@query("J02_canonical_urls", f"""
  with u as (select {norm_url('url')} as canonical_url, url from pages)
  select canonical_url, {sha16('canonical_url')} as url_hash, count(distinct url) as n_variants, count(*) as n_rows from u group by all""")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.canonical_urls(table(spark, sf_dir, "pages")).withColumn("n_rows", F.col("n_rows").cast("bigint"))


_PLAIN = strip_html("html", True)
_H1 = strip_html("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)", True)
_TITLE = strip_html("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)", True)
_BODY_TEXT = strip_html("regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1)", True)
_BODY = f"case when regexp_matches(html, '(?is)<body[^>]*>.*?</body>') then {_BODY_TEXT} end"


@query("J03_page_fields", f"""
  select page_id, {_TITLE} as page_title, {_H1} as h1, cast(null as varchar) as meta_description, {_PLAIN} as plain,
         cast(null as varchar) as posting_title, nullif({_BODY}, '') as description from pages""")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tables.page_fields(table(spark, sf_dir, "pages").select("page_id", "html"))
    return done.select("page_id", "page_title", "h1", "meta_description", "plain", "posting_title", "description")


@query("J03_posting_pages", f"""{PART_ROWS}, p as (select *, n % 4 as m,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as capital from site)
  select n, cast(null as varchar) as page_title, case when m = 1 then p_name end as h1, case when m = 1 then 'About ' || p_brand || ' & more' end as meta_description,
         case when m = 0 then '<i>' || capital || '</i>' end as posting_title, case when m = 0 then 'REQ-' || n end as posting_id,
         case when m = 0 then 'Ulm; Bonn' end as posting_location,
         case m when 1 then 'Site ' || p_size when 2 then 'Area ' || p_size end as field_location,
         case m when 1 then 'Research' when 3 then p_brand end as field_department,
         case m when 0 then '' when 1 then p_name || ' Location Site ' || p_size || ' Work Type Full-time Team Research'
              when 2 then 'Location Area ' || p_size || ' Business Area ' || p_type
              else 'Same job available in 2 locations Rome, ' || p_type || ' Turin Employment Type: Regular | Department: ' || p_brand || ' • end' end as plain,
         case m when 0 then 'Build ' || p_brand when 1 then 'About ' || p_brand || ' & more' when 2 then 'Location Area ' || p_size || ' Business Area ' || p_type
              else 'Same job available in 2 locations Rome, ' || p_type || ' Turin Employment Type: Regular | Department: ' || p_brand || ' • end' end as description
  from p""")
def j03_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns, on pages with JSON-LD, meta elements, definition lists, labelled divisions and plain labels."""
    return tables.page_fields(_details(spark, sf_dir, sites.avature_detail()), "body")


_BASE = "regexp_extract(url, '^([^:]+://[^/?#]*)', 1)"


_JOB_LINKS = "'<a href=\"/jobs/' || page_id || '/x\">j</a><a href=\"?q=1&amp;startrow=' || (page_id + 5) || '\">n</a>'"


@query("J04_link_table", f"""
  with p as (select page_id, 'https://h.example.com/s?startrow=' || page_id as url, {_JOB_LINKS} || html as html from pages),
  m as (select page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?>.*?</a>')) as a,
                    generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*?>.*?</a>'), 1) as i from p),
  h as (select *, trim({unescape_sql("regexp_extract(a, 'href=.([^\"]*)', 1)")}) as href from m)
  select page_id, cast(i - 1 as bigint) as pos, {strip_html("regexp_extract(a, '(?is)<a\\b[^>]*?>(.*?)</a>', 1)")} as text,
         {_BASE} || case when starts_with(href, '?') then '/s' else '' end || href as link, nullif(regexp_extract(href, '/(\\d+)/?$', 1), '') as link_id,
         nullif(lower(regexp_extract(href, '(?i)/(jobdetail|folderdetail|jobs?)(?:/|$)', 1)), '') as kind,
         cast(starts_with(href, '?') as bigint) as is_next_page
  from h where href <> ''""")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting link and a link to the next page are put before each page's own links."""
    more = F.format_string('<a href="/jobs/%d/x">j</a><a href="?q=1&amp;startrow=%d">n</a>', "page_id", F.col("page_id") + 5)
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.format_string("https://h.example.com/s?startrow=%d", "page_id").alias("url"), F.concat(more, "html").alias("html")
    )
    done = tables.link_table(pages)
    return done.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "text", "link", "link_id", "kind",
        F.col("is_next_page").cast("bigint").alias("is_next_page"),
    )


def _written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in turn in every notation."""
    day = F.col("o_orderdate")
    n = F.col("n") % 6
    written = (
        F.when(n == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(n == 1, F.date_format(day, "yyyyMMdd"))
        .when(n == 2, F.date_format(day, "MM/dd/yyyy"))
        .when(n == 3, F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss '-0700'"))
        .when(n == 4, F.unix_millis(day).cast("string"))
        .otherwise(F.unix_seconds(day).cast("string"))
    )
    return sites.orders(spark, sf_dir).select("n", day.cast("date").alias("day"), written.alias("written"))


@query("J05_harmonise_dates", f"""
  {ORDER_ROWS}
  select n, strftime(o_orderdate, '%Y-%m-%d') as date,
         case n % 6 when 0 then 'iso' when 1 then 'iso' when 2 then 'us' when 3 then 'rfc' when 4 then 'epoch_ms' else 'epoch_s' end as notation
  from site""")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written_dates(spark, sf_dir)
    # Second counts of early dates have nine digits, compact dates eight.
    done = tables.harmonise_dates(rows, "written", F.lit("2026-07-20").cast("date"))
    return done.select("n", F.col("date").cast("string").alias("date"), "notation")


@query("J06_flatten_records", f"""
  with o as ({sites.ORDERS_SQL}), p as ({sites.PARTS_SQL})
  select company, page_no, pos, nullif(cast(n as varchar), '0') as id, case when n % 11 <> 0 then o_orderpriority end as title from o
  union all select company, page_no, pos, 'x' || n, p_name || ' & co' from p""")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    json_docs, _ = sites.greenhouse(spark, sf_dir)
    xml_docs, _ = sites.successfactors_xml(spark, sf_dir)
    both = json_docs.unionByName(xml_docs).select("company", "page_no", "body")
    rows, _ = tables.flatten_records(both, "jobs", {"id": ["id", "referenceNumber"], "title": ["title"]})
    return rows.select(
        "company", F.col("page_no").cast("bigint").alias("page_no"), F.col("pos").cast("bigint").alias("pos"), "id", "title"
    )


@query("J06_rejected_captures", """
  select page_id, 'unreadable' as reason from pages""")
def j06_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages are neither JSON nor XML records."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("body"))
    _, rejects = tables.flatten_records(pages, "jobs", {"id": ["id"]})
    return rejects


# -- normal forms -------------------------------------------------------------------------------


@query("C01_norm_text", f"select doc_id, {norm('text')} as norm from documents")
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_text("text").alias("norm"))


@query("C02_norm_title", """
  select p_partkey, 'senior ' || p_name || ' software engineer' as norm from part""")
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("Sr. "), "p_name", F.lit(" (SWE)"))
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("t")).select("p_partkey", T.norm_title("t").alias("norm"))


@query("C03_norm_location", f"""
  select c_custkey, case c_custkey % 4 when 0 then 'us' when 1 then 'usa' when 2 then 'united states' else {norm("c_mktsegment || ', US'")} end as norm from customer""")
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    place = F.when(k == 0, "U.S.").when(k == 1, "u-s-a").when(k == 2, "United States of America").otherwise(F.concat("c_mktsegment", F.lit(", US")))
    return table(spark, sf_dir, "customer").select("c_custkey", place.alias("p")).select("c_custkey", T.norm_location("p").alias("norm"))


@query("C04_norm_url", f"select page_id, {norm_url('url')} as norm from pages")
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.norm_url("url").alias("norm"))


@query("C05_drop_tracking", """
  with p as (select page_id, unnest(string_split(nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '&')) as pair from pages)
  select page_id, string_split(pair, '=')[1] as key, string_split(pair, '=')[2] as value from p
  where string_split(pair, '=')[1] not in ('gh_src', 'lever-source', 'source', 'ref', 'referrer') and pair not like 'utm_%'""")
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"))
    kept = pairs.select("page_id", F.explode(U.drop_tracking(U.query_pairs("query"))).alias("p"))
    return kept.select("page_id", "p.key", "p.value")


@query("C06_short_hash", "select doc_id, left(sha256(text), 16) as hash from documents")
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", U.short_hash("text").alias("hash"))


@query("W02_sorted_pairs", """
  with p as (select page_id, unnest(string_split(nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '&')) as pair from pages)
  select page_id, string_agg(pair, '&' order by pair) as query from p group by 1""")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"))
    return pairs.where("query <> ''").select("page_id", U.encode_pairs(U.query_pairs("query")).alias("query"))


# -- HTML ---------------------------------------------------------------------------------------


@query("C07_strip_html", f"select page_id, {strip_html('html')} as kept_scripts, {_PLAIN} as plain from pages")
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", H.strip_html("html").alias("kept_scripts"), H.strip_html("html", drop_scripts=True).alias("plain")
    )


_LINED = "regexp_replace(regexp_replace(regexp_replace(html, '(?i)<\\s*br\\s*/?\\s*>', chr(10), 'g'), '(?i)</\\s*(?:p|div|li|tr)\\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"


@query("C08_strip_html_lines", f"""
  select page_id, array_to_string(list_transform(list_filter(string_split({_LINED}, chr(10)), lambda l: {squeeze('l')} <> ''),
         lambda l: {squeeze(unescape_sql('l'))}), chr(10)) as lines from pages""")
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.strip_html_lines("html").alias("lines"))


@query("C09_unescape", f"select page_id, {unescape_sql('html')} as html from pages")
def c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", unescape("html").alias("html"))


@query("C10_links", f"""
  {PART_ROWS}, ids as (select *, {sites.ID_SQL} as id from site)
  select company, page_no, count(distinct id) as n_ids, count(*) as n_links, cast(sum(id) as bigint) as id_sum from ids group by all""")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified posting links of search pages; login and next-page links are left out."""
    captures, _ = sites.icims(spark, sf_dir)
    found = captures.where("kind = 'list'").select(
        "company", F.col("page_no").cast("bigint").alias("page_no"), F.explode(icims.posting_links("body")).alias("a")
    )
    return found.groupBy("company", "page_no").agg(
        F.countDistinct("a.id").alias("n_ids"), F.count(F.lit(1)).alias("n_links"), F.sum(F.col("a.id").cast("bigint")).alias("id_sum")
    )


@query("C11_json_ld", f"""
  {PART_ROWS} select n, case when n % 3 <> 0 and n % 4 <> 0 then {INITCAP.format('p_name')} end as title,
         case when n % 3 <> 0 then '<p>' || p_brand || ' makes</p>' || chr(10) || '<p>things.</p>' end as description from site""")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, _ = sites.icims(spark, sf_dir)
    found = captures.where("kind = 'detail'").select(
        F.regexp_extract("detail_key", r"/jobs/(\d+)/", 1).cast("bigint").alias("n"), H.json_ld_posting("body").alias("p")
    )
    return found.select("n", V.text("p", "title").alias("title"), V.text("p", "description").alias("description"))


@query("C12_meta_content", f"""
  {PART_ROWS} select n, case when n % 4 = 1 then 'About ' || p_brand || ' & more' end as content from site""")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _details(spark, sf_dir, sites.avature_detail()).select("n", H.meta_content("body", "description").alias("content"))


@query("C13_heading", f"select page_id, {_H1} as h1 from pages")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.heading("html").alias("h1"))


@query("C14_labelled_field", f"""
  {PART_ROWS} select n, case n % 4 when 1 then 'Site ' || p_size when 2 then 'Area ' || p_size end as location,
         case n % 4 when 1 then 'Research' when 2 then p_type when 3 then p_brand end as department,
         case n % 4 when 1 then 'Full-time' when 3 then 'Regular' end as employment from site""")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = avature.detail_fields(_details(spark, sf_dir, sites.avature_detail()))
    return staged.select(
        "n",
        H.labelled_field("dl", "divs", "plain", avature.LOCATION_LABELS).alias("location"),
        H.labelled_field("dl", "divs", "plain", avature.DEPARTMENT_LABELS).alias("department"),
        H.labelled_field("dl", "divs", "plain", avature.EMPLOYMENT_LABELS).alias("employment"),
    )


@query("C15_line_field", f"""
  {PART_ROWS} select n, {sites.REQ_SQL} as requisition, p_brand as area, case when n % 4 <> 0 then 'San ' || p_size end as location from site""")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _details(spark, sf_dir, sites.rmk_detail()).withColumn("lines", H.strip_html_lines(H.matched("body", H.DESCRIPTION_SPAN)))
    return rows.select(
        "n", H.line_field("lines", "Requisition ID").alias("requisition"), H.line_field("lines", "Work Area").alias("area"),
        H.line_field("lines", "Location").alias("location"),
    )


@query("C16_expanded_locations", f"""
  {PART_ROWS} select n, case when n % 4 = 3 then 'Rome, ' || p_type || '; Turin' end as location from site""")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _details(spark, sf_dir, sites.avature_detail()).select("n", H.expanded_locations("body").alias("location"))


@query("C17_enclosing_article", f"""
  {PART_ROWS}, s as (select *, {sites.ID_SQL} as id, n % 5 <> 0 as own from site),
  near as (select *, max(case when own then pos end) over (partition by c, page_no order by pos rows between unbounded preceding and 1 preceding) as before,
                  min(case when own then pos end) over (partition by c, page_no order by pos rows between 1 following and unbounded following) as after from s)
  select a.company, a.page_no, a.id as id,
         case when a.own then 'Town ' || a.p_size when a.before is not null and a.after is not null then 'Town ' || b.p_size end as location,
         case when a.own then a.p_type when a.before is not null and a.after is not null then b.p_type end as department,
         case when a.own then 'Snippet ' || a.p_brand when a.before is not null and a.after is not null then 'Snippet ' || b.p_brand end as description
  from near a left join site b on b.c = a.c and b.page_no = a.page_no and b.pos = a.before""")
def c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, _ = sites.avature(spark, sf_dir)
    found = captures.where("kind = 'list'").select("company", F.col("page_no").cast("bigint").alias("page_no"), F.explode(avature.posting_links("body")).alias("a"))
    return found.select("company", "page_no", F.col("a.id").cast("bigint").alias("id"), "a.location", "a.department", "a.description")


@query("C18_table_rows", f"""
  {PART_ROWS} select company, page_no, {sites.ID_SQL} as id, p_name as title, 'Town ' || p_size as location from site""")
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, _ = sites.successfactors_html(spark, sf_dir)
    found = captures.where("kind = 'list'").select("company", F.col("page_no").cast("bigint").alias("page_no"), F.explode(successfactors.table_rows("body")).alias("a"))
    return found.select("company", "page_no", F.col("a.id").cast("bigint").alias("id"), "a.title", "a.location")


@query("C19_id_from_url", """
  select page_id, nullif(regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '/(\\d+)/?$', 1), '') as url_id,
         p as icims_id, p as path_id, p as query_id
  from (select *, cast(page_id as varchar) as p from pages)""")
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.concat(F.lit("/jobs/"), key, F.lit("/role/job")).alias("i"),
        F.concat(F.lit("/careers/FolderDetail/Role/"), key, F.lit("/")).alias("p"),
        F.concat(F.lit("/careers/JobDetail?x=1&amp;jobId="), key).alias("q"),
    )
    return pages.select(
        "page_id", successfactors.url_id("url").alias("url_id"), F.regexp_extract("i", icims.ID_IN_URL, 1).alias("icims_id"),
        avature.detail_link("p")["id"].alias("path_id"), avature.detail_link("q")["id"].alias("query_id"),
    )


@query("C20_resolve_url", f"""
  select page_id, {_BASE} || '/a/b' as rooted, 'https://o.example.com/x' as absolute,
         regexp_extract(url, '^([^:]+):', 1) || '://o.example.com/y' as same_scheme,
         regexp_extract(url, '^([^?#]*/)[^/]*', 1) || 'z?k=1' as sibling,
         {_BASE} || '/up' as above from pages""")
def c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    def on(href: str):
        return U.resolve_url("url", F.lit(href))

    # Paths of the pages are at most two folders deep.
    return table(spark, sf_dir, "pages").select(
        "page_id", on("/a/./c/../b").alias("rooted"), on("https://o.example.com/x").alias("absolute"),
        on("//o.example.com/y").alias("same_scheme"), on("z?k=1").alias("sibling"), on("../../../up").alias("above"),
    )


@query("C21_spans", f"""
  {PART_ROWS} select n, case when n % 6 <> 0 then {INITCAP.format('p_name')} else '' end as title, cast(1 as bigint) as has_text from site""")
def c21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _details(spark, sf_dir, sites.rmk_detail())
    return rows.select(
        "n", H.strip_html(H.matched("body", H.TITLE_SPAN)).alias("title"),
        H.matched("body", H.DESCRIPTION_SPAN).contains("Make  things.").cast("bigint").alias("has_text"),
    )


# -- dates --------------------------------------------------------------------------------------

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _orders_as(spark: SparkSession, sf_dir: str, written, fn) -> DataFrame:
    rows = sites.orders(spark, sf_dir).select("n", written.alias("w"))
    return rows.select("n", fn("w").cast("string").alias("date"))


@query("C22_iso_date", f"{ORDER_ROWS} select n, case when n % 4 <> 3 then {_DAY} end as date from site")
def c22(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, n = F.col("o_orderdate"), F.col("n") % 4
    written = (
        F.when(n == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(n == 1, F.date_format(day, "yyyyMMdd"))
        .when(n == 2, F.concat(F.year(F.date_add(day, 3 - F.weekday(day))).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"), F.lit("-"), (F.weekday(day) + 1).cast("string")))
        .otherwise(F.date_format(day, "yyyy/MM/dd"))
    )
    return _orders_as(spark, sf_dir, written, D.iso_date)


@query("C23_epoch_ms_date", f"{ORDER_ROWS} select n, {_DAY} as date from site")
def c23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_as(spark, sf_dir, (F.unix_millis("o_orderdate") + 3_600_000).cast("string"), D.epoch_ms_date)


@query("C24_epoch_s_date", f"{ORDER_ROWS} select n, case when n % 5 <> 0 then {_DAY} end as date from site")
def c24(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.when(F.col("n") % 5 == 0, F.lit("0")).otherwise((F.unix_seconds("o_orderdate") + 60).cast("string"))
    return _orders_as(spark, sf_dir, seconds, D.epoch_s_date)


@query("C25_us_date", f"{ORDER_ROWS} select n, case when year(o_orderdate) < 2000 and n % 2 = 1 then strftime(o_orderdate + interval 100 year, '%Y-%m-%d') else {_DAY} end as date from site")
def c25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-digit years belong to this century, so 1997 written short reads as 2097."""
    short, full = F.date_format("o_orderdate", "M/d/yy"), F.date_format("o_orderdate", "M/d/yyyy")
    return _orders_as(spark, sf_dir, F.when(F.col("n") % 2 == 1, short).otherwise(full), D.us_date)


@query("C26_rfc_date", f"{ORDER_ROWS} select n, {_DAY} as date from site")
def c26(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.date_format("o_orderdate", "EEE, dd MMM yyyy '23:59:59 -0700'")
    short = F.date_format("o_orderdate", "d MMM yyyy '00:00 GMT'")
    return _orders_as(spark, sf_dir, F.when(F.col("n") % 2 == 0, full).otherwise(short), D.rfc_date)


@query("C27_any_date", f"{ORDER_ROWS} select n, case when n % 4 <> 3 then {_DAY} end as date from site")
def c27(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n") % 4
    written = (
        F.when(n == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(n == 1, F.date_format("o_orderdate", " MM/dd/yyyy "))
        .when(n == 2, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .otherwise(F.lit("soon"))
    )
    return _orders_as(spark, sf_dir, written, D.any_date)


@query("C28_relative_date", f"""{ORDER_ROWS}
  select n, strftime(case n % 6 when 0 then o_orderdate when 1 then o_orderdate - interval 1 day when 2 then o_orderdate - to_days(cast(o_custkey % 29 as int))
         when 3 then o_orderdate - interval 30 day when 4 then timestamp '2026-07-18' end, '%Y-%m-%d') as date from site""")
def c28(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n") % 6
    words = (
        F.when(n == 0, "Just  Posted")
        .when(n == 1, " posted YESTERDAY ")
        .when(n == 2, F.concat(F.lit("Posted "), (F.col("o_custkey") % 29).cast("string"), F.lit(" Days Ago")))
        .when(n == 3, "Posted 30+ Days Ago")
        .when(n == 4, "2026-07-18T00:00")
        .otherwise("not a date")
    )
    rows = sites.orders(spark, sf_dir).select("n", words.alias("w"), F.to_date("o_orderdate").alias("anchor"))
    return rows.select("n", D.relative_date("w", "anchor").cast("string").alias("date"))


# -- composed fields ----------------------------------------------------------------------------


@query("C29_location_text", f"""{ORDER_ROWS}
  select n, 'City ' || (o_custkey % 7) || case when n % 4 <> 0 then ', BY' else '' end || ', de' || case when n % 3 = 0 then ' (Remote)' else '' end as location,
         'A' || o_custkey || ', US; B' as listed from site""")
def c29(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.to_json(
        F.struct(
            F.concat(F.lit("City "), (F.col("o_custkey") % 7).cast("string")).alias("city"),
            F.when(F.col("n") % 4 == 0, F.lit("")).otherwise(F.lit("BY")).alias("region"),
            F.lit("de").alias("country"), (F.col("n") % 3 == 0).alias("remote"),
        )
    )
    listed = F.concat(
        F.lit('[{"address":{"addressLocality":"A'), F.col("o_custkey").cast("string"),
        F.lit('","addressCountry":{"name":"US"}}},{"address":{}},{"address":{"streetAddress":"B"}}]'),
    )
    rows = sites.spread(sites.orders(spark, sf_dir)).select("n", F.parse_json(place).alias("v"), F.parse_json(listed).alias("l"))
    return rows.select("n", smartrecruiters.location_text(F.col("v")).alias("location"), H.json_ld_location("l", street_fallback=True).alias("listed"))


@query("C30_employment_type", f"""
  select p_partkey, upper(p_type[1]) || lower(p_type[2:]) || '-Time' as single, p_type || ', OTHER' as listed from part""")
def c30(spark: SparkSession, sf_dir: str) -> DataFrame:
    single = F.to_variant_object(F.struct(F.concat("p_type", F.lit("_TIME")).alias("e")))
    listed = F.to_variant_object(F.struct(F.array("p_type", F.lit(""), F.lit("OTHER")).alias("e")))
    rows = table(spark, sf_dir, "part").select("p_partkey", V.sub(single, "e").alias("s"), V.sub(listed, "e").alias("l"))
    return rows.select("p_partkey", H.json_ld_employment("s").alias("single"), H.json_ld_employment("l").alias("listed"))


@query("C31_posting_url", f"""{PART_ROWS}
  select n, case when n % 3 = 0 then 'https://jobs.smartrecruiters.com/Co/' || n
         else 'https://jobs.smartrecruiters.com/A%26B%20~/' || n || '-' || replace(p_name, ' ', '-') || '-f-m' end as public,
         'https://app.eightfold.ai/careers/job/' || n || '?domain=d.com' as eightfold,
         case when n % 2 = 0 then 'http://abs.example.com/' || n else 'https://w.example.com/en/job/' || n end as workday from site""")
def c31(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlake.sources.eightfold import public_url as eightfold_url
    from postlake.sources.workday import workday_url

    key = F.col("n").cast("string")
    rows = sites.parts(spark, sf_dir).select(
        "n", key.alias("id"), F.concat("p_name", F.lit(" (f/m)")).alias("title"),
        F.when(F.col("n") % 3 == 0, F.concat(F.lit("https://jobs.smartrecruiters.com/Co/"), key)).otherwise(F.lit("https://jobs.smartrecruiters.com/Co")).alias("given"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("http://abs.example.com/"), key)).otherwise(F.concat(F.lit("//job/"), key)).alias("path"),
    )
    return rows.select(
        "n", smartrecruiters.public_url(F.col("given"), F.col("id"), F.col("title"), F.lit("/A&B ~/")).alias("public"),
        eightfold_url(F.lit(None).cast("string"), F.col("id"), F.lit("d.com")).alias("eightfold"),
        workday_url(F.lit("https://w.example.com/en//"), F.col("path")).alias("workday"),
    )


@query("C32_first_nonempty", f"""{PART_ROWS}
  select n, coalesce(case when n % 2 = 0 then p_name end, case when n % 3 = 0 then p_brand end, 'Untitled role') as title from site""")
def c32(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sites.parts(spark, sf_dir).select(
        "n", F.when(F.col("n") % 2 == 0, F.col("p_name")).otherwise("").alias("a"), F.when(F.col("n") % 3 == 0, F.col("p_brand")).alias("b")
    )
    return rows.select("n", T.first_nonempty("a", "b", F.lit("Untitled role")).alias("title"))


@query("C33_xml_records", f"""{PART_ROWS}
  select company, page_no, count(*) as n_named, count(*) as n_nested from site group by all""")
def c33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named records, and the same documents with unnamed records under the root."""
    captures, _ = sites.successfactors_xml(spark, sf_dir)
    rows = captures.select(
        "company", F.col("page_no").cast("bigint").alias("page_no"), X.xml_feed("body").alias("named"),
        X.xml_feed(F.regexp_replace(F.regexp_replace("body", "<(/?)jobs\\b", "<$1data"), "<(/?)job>", "<$1row>")).alias("nested"),
    )
    return rows.select(
        "company", "page_no", F.size("named.records").cast("bigint").alias("n_named"), F.size("nested.records").cast("bigint").alias("n_nested")
    )


@query("C34_xml_fields", f"""{PART_ROWS}
  select company, page_no, pos, lpad(cast(n as varchar), 8, '0') as reference, 'https://f.example.com/?a=1&id=' || n as url,
         'Div ' || p_brand as division, p_type as kind, case when n % 4 = 0 then 'A' || p_size || '|B|B' end as locations,
         '<p>Make ' || p_brand || '</p> & sell' as description from site""")
def c34(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, _ = sites.successfactors_xml(spark, sf_dir)
    fields = captures.select("company", F.col("page_no").cast("bigint").alias("page_no"), X.xml_feed("body").alias("feed")).select(
        "company", "page_no", F.posexplode("feed.records").alias("pos", "f")
    )
    return fields.select(
        "company", "page_no", F.col("pos").cast("bigint").alias("pos"), X.first_field("f", "reference", "referencenumber").alias("reference"),
        X.first_field("f", "url").alias("url"), X.first_field("f", "division").alias("division"), X.first_field("f", "jobtype").alias("kind"),
        F.nullif(F.array_join(X.field_values("f", "location"), "|"), F.lit("")).alias("locations"), X.first_field("f", "description").alias("description"),
    )


@query("C35_required_fields", f"""{PART_ROWS}
  select n, case n % 10 when 0 then 'title cannot be empty' when 1 then 'company cannot be empty, title cannot be empty' end as reason,
         case when n % 10 > 1 then p_name end as title from site""")
def c35(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n") % 10
    rows = sites.parts(spark, sf_dir).select(
        "n", F.when(k == 1, F.lit("  ")).otherwise(F.col("company")).alias("company"),
        F.when(k == 0, F.lit(" \t")).when(k == 1, F.lit(None)).otherwise(F.concat(F.lit("\n "), "p_name", F.lit(" "))).alias("title"), F.lit("x").alias("source"),
    )
    valid, rejects = split_valid(rows)
    return valid.select("n", F.lit(None).cast("string").alias("reason"), "title").unionByName(
        rejects.select("n", F.col("reject_reason").alias("reason"), F.lit(None).cast("string").alias("title"))
    )


@query("C36_identifier", f"""{PART_ROWS}
  select n, case n % 4 when 0 then 'T' || n when 1 then 'V' || n when 2 then 'N' || n end as id from site""")
def c36(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("n") % 4, F.col("n").cast("string")
    body = (
        F.when(k == 0, F.concat(F.lit('"T'), key, F.lit('"')))
        .when(k == 1, F.concat(F.lit('{"name":"x","value":"V'), key, F.lit('"}')))
        .when(k == 2, F.concat(F.lit('{"value":"","name":"N'), key, F.lit('"}')))
        .otherwise(F.lit('{"value":0}'))
    )
    rows = sites.parts(spark, sf_dir).select("n", F.parse_json(body).alias("v"))
    return rows.select("n", H.json_ld_identifier("v").alias("id"))


@query("C37_page_description", f"""
  select 'page ' || page_id as id, {_BODY} as description from pages
  union all select 'part ' || p_partkey, case when p_partkey % 4 = 1 then 'About ' || p_brand || ' & more'
    when p_partkey % 4 = 2 then 'Location Area ' || p_size || ' Business Area ' || p_type
    when p_partkey % 4 = 3 then 'Same job available in 2 locations Rome, ' || p_type || ' Turin Employment Type: Regular | Department: ' || p_brand || ' • end' else '' end from part""")
def c37(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("id"), "html")
    built = _details(spark, sf_dir, sites.avature_detail()).select(F.concat(F.lit("part "), F.col("n").cast("string")).alias("id"), F.col("body").alias("html"))
    return web.unionByName(built).select("id", H.page_description("html").alias("description"))
