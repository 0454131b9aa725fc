"""Queries S01-S14, S21, U01-U02: captures packed from the tables, parsed, and checked against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.xml import is_xml
from postlake.operators.dedup import unseen, with_dedup_key
from postlake.operators.rules import company_key, select_companies
from postlake.plans import sites, views
from postlake.plans.oracle import norm
from postlake.plans.pipeline import run
from postlake.plans.registry import query, table
from postlake.session import new_scratch
from postlake.sources import parse_all, registered_sources, unsupported
from postlake.sources.ashby import parse_ashby
from postlake.sources.avature import parse_avature
from postlake.sources.captures import read_captures, write_captures
from postlake.sources.eightfold import parse_eightfold
from postlake.sources.greenhouse import parse_greenhouse
from postlake.sources.icims import parse_icims
from postlake.sources.lever import parse_lever
from postlake.sources.smartrecruiters import parse_smartrecruiters
from postlake.sources.successfactors import (
    parse_successfactors_html,
    parse_successfactors_xml,
)
from postlake.sources.workday import parse_workday

SHOWN = [
    "company", "page_no", "pos", "stable_job_id", "source_job_id", "title", "location", "employment_type",
    "department", "description", "posting_url", "application_url", "source", "date_posted",
]


def shown(df: DataFrame) -> DataFrame:
    """Posting columns as text and whole numbers."""
    return df.select(
        *[
            F.col(c).cast("bigint").alias(c) if c in ("page_no", "pos")
            else F.col(c).cast("string").alias(c)
            for c in SHOWN
        ]
    )


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"

GREENHOUSE_SQL = f"""
  with site as ({sites.ORDERS_SQL})
  select company, page_no, pos, nullif(cast(n as varchar), '0') as stable_job_id, nullif(cast(n as varchar), '0') as source_job_id,
         case when n % 11 = 0 then 'Untitled role' else o_orderpriority end as title,
         case when n % 5 <> 0 then 'City ' || (o_custkey % 7) end as location,
         case when n % 2 = 0 then 'Full-time' end as employment_type,
         case when n % 3 <> 0 then 'Dept ' || o_orderstatus end as department,
         case when n % 4 <> 0 then '<p>' || o_orderstatus || ' &amp; more</p>' end as description,
         case when n % 9 <> 4 then 'https://c' || c || '.example.com/jobs/' || n || '?gh_src=x' end as posting_url,
         case when n % 9 <> 4 then 'https://c' || c || '.example.com/jobs/' || n || '?gh_src=x' end as application_url,
         'greenhouse' as source, case when n % 13 <> 0 then {_DAY} end as date_posted
  from site"""


@query("S01_read_captures", f"""
  with site as ({sites.ORDERS_SQL})
  select company, page_no, count(*) as n_items, cast(sum(o_custkey) as bigint) as sum_key from site group by all""")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, _ = sites.greenhouse(spark, sf_dir)
    keys = sites.packed(sites.orders(spark, sf_dir), sites.text("o_custkey"), ",")
    path = new_scratch(spark, "landing")
    write_captures(sites.as_captures(keys, "lever", "list", page_no=F.col("page_no"), body=F.concat(F.lit("["), "items", F.lit("]"))), path)
    landed = read_captures(spark, path).where(F.col("source_type") == "lever")
    numbers = F.from_json("body", "array<bigint>")
    return landed.select(
        "company", F.col("page_no").cast("bigint").alias("page_no"),
        F.size(numbers).cast("bigint").alias("n_items"),
        F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_key"),
    )


@query("S02_greenhouse", GREENHOUSE_SQL)
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parse_greenhouse(*sites.greenhouse(spark, sf_dir)))


LEVER_SQL = f"""
  with site as ({sites.ORDERS_SQL}), s as (select *, 'https://c' || c || '.example.com/' || n as hosted from site)
  select company, page_no, pos, 'L' || n as stable_job_id, 'L' || n as source_job_id,
         case when n % 7 = 0 then 'Untitled role' else o_orderpriority end as title,
         case when n % 4 <> 0 then 'Berlin' end as location, 'Full-time' as employment_type, 'Team ' || o_orderstatus as department,
         case when n % 10 = 0 then 'Other text.' || chr(10) when n % 5 = 0 then '' else 'Plain text.' || chr(10) end
           || '<li>' || o_orderpriority || '</li>' || chr(10) || '<li>' || o_orderpriority || '</li>' as description,
         hosted as posting_url, case when n % 3 = 0 then hosted || '/apply' else hosted end as application_url,
         'lever' as source, {_DAY} as date_posted
  from s"""


@query("S03_lever", LEVER_SQL)
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parse_lever(*sites.lever(spark, sf_dir)))


ASHBY_SQL = f"""
  with site as ({sites.ORDERS_SQL}), s as (select *, case n % 3 when 0 then 'https://c' || c || '.example.com/' || n
                                            when 1 then 'https://c' || c || '.example.com/x/' || n end as u from site)
  select company, page_no, pos, 'A' || n as stable_job_id, 'A' || n as source_job_id,
         case when n % 6 = 0 then 'Untitled role' else o_orderpriority end as title,
         'City ' || (o_custkey % 7) as location,
         case n % 5 when 0 then 'FullTime' when 1 then 'PartTime' end as employment_type,
         case when n % 3 = 0 then o_orderstatus end as department,
         case when n % 4 = 0 then 'Plain.' else '<p>Html.</p>' end as description,
         u as posting_url, u as application_url, 'ashby' as source,
         strftime(case when n % 2 = 0 then o_orderdate else o_orderdate + interval 1 day end, '%Y-%m-%d') as date_posted
  from s"""


@query("S04_ashby", ASHBY_SQL)
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parse_ashby(*sites.ashby(spark, sf_dir)))


@query("S05_workday", f"""
  with {sites.listed_orders_sql()},
  s as (select *, case when n % 3 = 0 then 'https://abs.example.com/' || n
                  else 'https://c' || c || '.example.com/jobs/job/' || n end as u from kept)
  select company, page_no, pos, nullif(case when n % 7 = 0 then cast(n as varchar) else 'JR' || n end, '0') as stable_job_id,
         nullif(case when n % 7 = 0 then cast(n as varchar) else 'JR' || n end, '0') as source_job_id,
         case when n % 8 = 0 then 'Untitled role' else o_orderpriority end as title,
         case when n % 2 = 0 then 'US, City ' || (o_custkey % 7) else 'Elsewhere' end as location,
         case when n % 2 = 0 and n % 4 <> 0 then 'Full time' end as employment_type,
         case when n % 2 = 0 then 'Family' when n % 5 = 0 then 'Dept' end as department,
         cast(null as varchar) as description, u as posting_url, u as application_url, 'workday' as source,
         strftime(case n % 5 when 0 then date '2026-07-20' when 1 then date '2026-07-19' when 2 then date '2026-07-10'
                  when 3 then date '2026-06-20' else cast(o_orderdate as date) end, '%Y-%m-%d') as date_posted
  from s""")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parse_workday(*sites.workday(spark, sf_dir)))


@query("S06_smartrecruiters", f"""
  with {sites.listed_orders_sql()},
  s as (select *, n % 5 <> 4 and c % 4 <> 3 as found,
               'https://jobs.smartrecruiters.com/ats%20' || c || '/S' || n || '-'
               || trim(regexp_replace(lower(o_orderpriority || ' (m/w)'), '[^a-z0-9]+', '-', 'g'), '-') as built from kept),
  t as (select *, case when n % 5 = 0 then 'https://jobs.smartrecruiters.com/X/' || n else built end as u from s)
  select company, page_no, pos, case when n % 2 = 0 then 'u-' || n else 'S' || n end as stable_job_id,
         case when n % 2 = 0 then 'u-' || n else 'S' || n end as source_job_id, o_orderpriority || ' (m/w)' as title,
         'City ' || (o_custkey % 7) || case when n % 4 <> 0 then ', BY' else '' end || ', de'
           || case when n % 3 = 0 then ' (Remote)' else '' end as location,
         case when found then 'Permanent' end as employment_type, case when not found then 'Unit' end as department,
         case when found then 'About us & you' || chr(10) || '<p>' || o_orderstatus || '</p>' else 'List text' end as description,
         u as posting_url, case when found and n % 6 = 0 then 'https://apply.example.com/' || n else u end as application_url,
         'smartrecruiters' as source, {_DAY} as date_posted
  from t""")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parse_smartrecruiters(*sites.smartrecruiters(spark, sf_dir)))


@query("S07_eightfold", f"""
  with {sites.listed_orders_sql()},
  s as (select *, n % 5 <> 4 and c % 4 <> 3 as found, 'https://app.eightfold.ai' || case when n % 3 = 0 then '/careers/p/' || n
               else '/careers/job/' || (n + 1) end || '?domain=ats ' || c as u from kept)
  select company, page_no, pos, cast(n + 1 as varchar) as stable_job_id, cast(n + 1 as varchar) as source_job_id,
         o_orderpriority as title,
         case when n % 2 = 0 then 'City ' || (o_custkey % 7) || ', NO' else 'City ' || (o_custkey % 7) || '; Oslo' end as location,
         case when found and n % 6 = 0 then 'Contract' when n % 4 = 0 then 'Full-time' end as employment_type,
         'Dept' as department, case when found then '<b>' || o_orderstatus || '</b> <x>' end as description,
         u as posting_url, u as application_url, 'eightfold' as source, {_DAY} as date_posted
  from s""")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parse_eightfold(*sites.eightfold(spark, sf_dir)))


def kept_parts_sql() -> str:
    """Rows of an HTML site, the first of each id."""
    return f"""
  site as ({sites.PARTS_SQL}),
  ids as (select *, {sites.ID_SQL} as id from site),
  firsts as (select * from (select *, row_number() over (partition by c, id order by page_no, pos) as rn from ids) where rn = 1)"""


ICIMS_SQL = f"""
  with {kept_parts_sql()},
  t as (select f.*, d.n as dn, d.p_name as d_name, d.p_brand as d_brand, d.p_size as d_size,
               'https://c' || f.c || '.example.com/jobs/' || f.id || '/role/job?in_iframe=1&k=1' as u
        from firsts f left join site d on d.n = f.id and d.n % 3 <> 0)
  select company, page_no, cast(row_pos as bigint) as pos, cast(id as varchar) as stable_job_id, cast(id as varchar) as source_job_id,
         coalesce(case when dn % 4 <> 0 then upper(d_name[1]) || regexp_replace(d_name[2:], ' (.).*$', '') || ' '
             || upper(string_split(d_name, ' ')[2][1]) || string_split(d_name, ' ')[2][2:] end,
                  case when n % 2 = 0 then p_name || ' & co' else p_name end) as title,
         case when dn is not null then 'City ' || d_size || ', CA, US' end as location,
         case when dn is not null then 'Full-Time' end as employment_type, cast(null as varchar) as department,
         case when dn is not null then d_brand || ' makes things.' end as description,
         u as posting_url, u as application_url, 'icims' as source,
         case when dn is not null then '2026-07-' || lpad(cast(d_size % 28 + 1 as varchar), 2, '0') end as date_posted
  from (select *, pos as row_pos from t)"""


@query("S08_icims", ICIMS_SQL)
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parse_icims(*sites.icims(spark, sf_dir)))


INITCAP = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"

AVATURE_SQL = f"""
  with {kept_parts_sql()},
  t as (select f.*, f.n % 5 = 0 as bare,
               'https://c' || f.c || '.example.com/careers/JobDetail' || case when f.n % 4 = 0 then '?jobId=' || f.id || '&source=x'
                    else '/Role-' || f.p_size || '/' || f.id end as u from firsts f),
  k as (select *, 'https://c' || c || '.example.com/careers/JobDetail' || case when n % 4 = 0 then '?jobId=' || n || '&source=x'
                    else '/Role-' || p_size || '/' || n end as key from site),
  d as (select t.*, k.n as dn, k.n % 4 as m, k.p_name as d_name, k.p_brand as d_brand, k.p_size as d_size, k.p_type as d_type
        from t left join k on k.key = t.u and k.c = t.c),
  own as (select *, n % 5 <> 0 as own from site),
  near as (select *, max(case when own then pos end) over (partition by c, page_no order by pos rows between unbounded preceding and 1 preceding) as before,
                  min(case when own then pos end) over (partition by c, page_no order by pos rows between 1 following and unbounded following) as after from own),
  around as (select a.c, a.page_no, a.pos, case when a.own then a.p_size when a.before is not null and a.after is not null then b.p_size end as a_size,
                    case when a.own then a.p_type when a.before is not null and a.after is not null then b.p_type end as a_type,
                    case when a.own then a.p_brand when a.before is not null and a.after is not null then b.p_brand end as a_brand
             from near a left join site b on b.c = a.c and b.page_no = a.page_no and b.pos = a.before)
  select company, page_no, pos,
         case when m = 0 then 'REQ-' || dn else cast(id as varchar) end as stable_job_id,
         case when m = 0 then 'REQ-' || dn else cast(id as varchar) end as source_job_id,
         case m when 0 then {INITCAP.format('d_name')} when 1 then d_name else p_name end as title,
         case m when 0 then 'Ulm; Bonn' when 1 then 'Site ' || d_size when 2 then 'Area ' || d_size when 3 then 'Rome, ' || d_type || '; Turin'
              else 'Town ' || a_size end as location,
         case m when 0 then 'FULL_TIME, INTERN' when 1 then 'Full-time' when 3 then 'Regular' end as employment_type,
         case m when 1 then 'Research' when 2 then d_type when 3 then d_brand else a_type end as department,
         case m when 0 then 'Build ' || d_brand when 1 then 'About ' || d_brand || ' & more'
              when 2 then 'Location Area ' || d_size || ' Business Area ' || d_type
              when 3 then 'Same job available in 2 locations Rome, ' || d_type || ' Turin Employment Type: Regular | Department: ' || d_brand || ' • end'
              else 'Snippet ' || a_brand end as description,
         u as posting_url, u as application_url, 'avature' as source, cast(null as varchar) as date_posted
  from d join around using (c, page_no, pos)"""


@query("S09_avature", AVATURE_SQL)
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parse_avature(*sites.avature(spark, sf_dir)))


SF_XML_SQL = f"""
  with site as ({sites.PARTS_SQL})
  select company, page_no, pos, lpad(cast(n as varchar), 8, '0') as stable_job_id, lpad(cast(n as varchar), 8, '0') as source_job_id,
         p_name || ' & co' as title,
         case when n % 4 = 0 then 'A' || p_size || '; B' else 'City ' || p_size || case when n % 3 = 0 then '' else ', CA' end || ', US' end as location,
         p_type as employment_type, 'Div ' || p_brand as department, 'Make ' || p_brand || ' & sell' as description,
         'https://f.example.com/?a=1&id=' || n as posting_url, 'https://f.example.com/?a=1&id=' || n as application_url,
         'successfactors' as source, '2026-07-' || (17 + n % 3) as date_posted
  from site"""


@query("S10_successfactors_xml", SF_XML_SQL)
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parse_successfactors_xml(*sites.successfactors_xml(spark, sf_dir)))


SF_HTML_CTES = f"""
  {kept_parts_sql()},
  t as (select f.*, d.n as dn, d.p_name as d_name, d.p_brand as d_brand, d.p_size as d_size,
               'https://c' || f.c || '.example.com/job/Role-' || f.p_size || '/' || f.id || '/' as u,
               (select {sites.REQ_SQL} from (select d.n as n) where d.n is not null) as req
        from firsts f left join site d on d.n = f.id and d.p_size = f.p_size and f.c % 5 <> 4),
  gone as (select distinct b.c, b.id from t a join t b on a.c = b.c and a.req = cast(b.id as varchar)
           and (a.page_no, a.pos) < (b.page_no, b.pos) and a.id <> b.id),
  left_over as (select t.* from t where not exists (select 1 from gone where gone.c = t.c and gone.id = t.id))"""


@query("S11_successfactors_html", f"""
  with {SF_HTML_CTES}
  select company, page_no, pos, cast(id as varchar) as stable_job_id, coalesce(req, cast(id as varchar)) as source_job_id,
         coalesce(case when dn % 6 <> 0 then {INITCAP.format('d_name')} end, p_name) as title,
         coalesce(case when dn % 4 <> 0 then 'San ' || d_size end, 'Town ' || p_size) as location,
         case when dn is not null then 'Regular & Full Time' end as employment_type, d_brand as department,
         case when dn is not null then
           case when dn % 7 = 0 then 'Requisition ID: ' || (dn + 3) when dn % 7 = 1 then 'Grade: 7' else 'Requisition ID: R' || dn end
           || chr(10) || 'Work Area: ' || d_brand || chr(10) || 'Employment Type: Regular & Full Time' || chr(10)
           || 'Original Posting Date: 07/17/26' || chr(10) || case when dn % 4 <> 0 then 'Location: San ' || d_size || chr(10) else '' end || 'Make things.' end as description,
         u as posting_url, u as application_url, 'successfactors' as source, case when dn is not null then '2026-07-17' end as date_posted
  from left_over""")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parse_successfactors_html(*sites.successfactors_html(spark, sf_dir)))


@query("S12_format_sniff", f"""
  with site as ({sites.PARTS_SQL}), page as (select distinct company, page_no from site)
  select company, page_no, cast(1 as bigint) as is_xml from page union all select company, page_no, 0 from page
  union all select 'page ' || page_id, 0, 0 from pages""")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds, _ = sites.successfactors_xml(spark, sf_dir)
    boards, _ = sites.successfactors_html(spark, sf_dir)
    web = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page "), sites.text("page_id")).alias("company"), F.lit(0).alias("page_no"), F.col("html").alias("body")
    )
    bodies = (
        feeds.select("company", "page_no", "body")
        .unionByName(boards.where("kind = 'list'").select("company", "page_no", "body"))
        .unionByName(web)
    )
    return bodies.select(
        "company", F.col("page_no").cast("bigint").alias("page_no"), is_xml("body").cast("bigint").alias("is_xml")
    )


def _many_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Greenhouse, Lever and Ashby sites together; the company names say which is which."""
    captures, rules = [], []
    for i, name in enumerate(["greenhouse", "lever", "ashby"]):
        c, r = sites.BUILDERS[name](spark, sf_dir)
        label = F.concat(F.lit(f"{name} "), "company")
        captures.append(c.withColumn("company", label))
        rules.append(r.withColumn("company", label).withColumn("company_ord", F.col("company_ord") * 3 + i))
    return (
        captures[0].unionByName(captures[1]).unionByName(captures[2]),
        rules[0].unionByName(rules[1]).unionByName(rules[2]),
    )


MANY_SQL = " union all ".join(
    f"select '{name} ' || company as company, page_no, pos, source_job_id, title, location, employment_type, department, description, posting_url, application_url, date_posted, source, stable_job_id from ({sql})"
    for name, sql in [("greenhouse", GREENHOUSE_SQL), ("lever", LEVER_SQL), ("ashby", ASHBY_SQL)]
)


@query("S13_parse_all", f"""
  select source, company, count(*) as n, count(location) as n_location, count(posting_url) as n_url,
         cast(sum(length(title)) as bigint) as title_chars from ({MANY_SQL}) group by all""")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_all(*_many_sites(spark, sf_dir)).groupBy("source", "company").agg(
        F.count(F.lit(1)).alias("n"), F.count("location").alias("n_location"), F.count("posting_url").alias("n_url"),
        F.sum(F.length("title")).cast("bigint").alias("title_chars"),
    )


@query("S14_select_companies", """
  select s_suppkey as company_ord, s_name as company,
         case when s_suppkey % 2 = 0 then 'sup-' || s_suppkey else replace(lower(s_name), ' ', '-') end as key,
         (select count(*) from lineitem where l_suppkey = s_suppkey) as n_rows
  from supplier where s_suppkey % 10 <> 9""")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select_companies(views.star_rules(spark, sf_dir))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("company_ord")).agg(F.count(F.lit(1)).alias("n"))
    return chosen.join(rows, "company_ord", "left").select(
        "company_ord", "company", company_key("slug", "company").alias("key"), F.coalesce("n", F.lit(0)).alias("n_rows")
    )


_STAR_KEY = f"'source:' || {norm('company')} || ':' || {norm('source_job_id')}"


@query("S21_store_in_memory", f"""
  with s as ({views.STAR_SQL}), k as (select *, {_STAR_KEY} as dedup_key from s)
  select dedup_key, count(*) as n from k
  where dedup_key not in (select dedup_key from k where l_orderkey % 2 = 0) group by 1""")
def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any DataFrame with the key column serves as the store."""
    keyed = with_dedup_key(views.star(spark, sf_dir))
    store = keyed.where(F.col("l_orderkey") % 2 == 0).select("dedup_key")
    return unseen(keyed, store).groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n"))


@query("U01_source_registry", f"""
  with site as ({sites.ORDERS_SQL}), c as (select distinct c, company from site)
  select case when c.c % 2 = 0 then 'parsed' else 'failed' end as outcome, company,
         case when c.c % 2 = 1 then company || ': NotImplementedError: custom is not supported' end as message,
         case when c.c % 2 = 0 then (select count(*) from site where site.c = c.c) end as n from c""")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, rules = sites.greenhouse(spark, sf_dir)
    kind = F.when(F.col("company_ord") % 2 == 0, F.lit("greenhouse")).otherwise(F.lit("custom"))
    mixed = rules.withColumn("source_type", kind)
    typed = captures.drop("source_type").join(mixed.select("company", "source_type"), "company")
    parsed = parse_all(typed, mixed, {"greenhouse": registered_sources()["greenhouse"]}).groupBy("company").agg(
        F.count(F.lit(1)).alias("n")
    )
    return parsed.select(
        F.lit("parsed").alias("outcome"), "company", F.lit(None).cast("string").alias("message"), "n"
    ).unionByName(
        unsupported(mixed).select(F.lit("failed").alias("outcome"), "company", "message", F.lit(None).cast("bigint").alias("n"))
    )


@query("U02_injected_run", f"""
  with s as ({views.STAR_SQL}), r as ({views.STAR_RULES_SQL}),
  d as (select s.*, {norm('title')} as t, {norm('location')} as l, {norm('employment_type')} as e, {norm('department')} as dep, r.* exclude (company, company_ord)
        from s join r using (company) where s.company_ord % 10 <> 9),
  m as (select *, {_STAR_KEY} as dedup_key from d
        where len(list_filter(excludes, lambda k: contains(t || ' ' || dep || ' ' || l || ' ' || e, lower(k)))) = 0
          and not contains(t, 'old')
          and len(list_filter(specific, lambda k: contains(l, {norm('k')}))) > 0
          and (len(types) = 0 or len(list_filter(types, lambda k: contains(e, lower(k)))) > 0)
          and len(list_filter(titles, lambda k: contains(t, lower(k)))) > 0)
  select dedup_key, count(*) as n from (select distinct dedup_key from m) group by 1""")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with an injected source: the posting view stands in for the parsers."""
    rules = views.star_rules(spark, sf_dir)

    def view(_captures: DataFrame, companies: DataFrame) -> DataFrame:
        rows = views.star(spark, sf_dir)
        return rows.drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").join(
            companies.select("company"), "company", "left_semi"
        )

    captures, _ = sites.greenhouse(spark, sf_dir)
    done = run(captures, rules, views.STAR_FILTERS, sources={"view": view})
    return done.new_jobs.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n"))
