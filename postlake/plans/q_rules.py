"""Queries D01-D14, E01-E05, E07-E09, F01-F05: decisions, deduplication and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.text import norm_text
from postlake.operators import dedup as E
from postlake.operators import report as P
from postlake.operators import rules as R
from postlake.plans import views
from postlake.plans.oracle import norm, norm_url, sha16
from postlake.plans.pipeline import decide
from postlake.plans.registry import query, table

# -- the ladder in SQL --------------------------------------------------------------------------

STAR_CTES = f"""
  s as ({views.STAR_SQL}), r as ({views.STAR_RULES_SQL}),
  n as (select s.*, r.* exclude (company, company_ord), {norm('title')} as t, {norm('location')} as l,
               {norm('employment_type')} as e, {norm('department')} as dep from s join r using (company)),
  h as (select *, list_filter(titles, lambda k: contains(t, lower(k))) as title_hits,
               list_filter(excludes, lambda k: contains(t || ' ' || dep || ' ' || l || ' ' || e, k)) as exclude_hits,
               list_filter(['old'], lambda k: contains(t, k)) as seniority_hits,
               list_filter(specific, lambda k: contains(l, {norm('k')})) as location_hits,
               list_filter(types, lambda k: contains(e, lower(k))) as type_hits from n),
  d as (select *, case when len(exclude_hits) > 0 then 'excluded' when len(seniority_hits) > 0 then 'seniority'
                       when len(locs) > 0 and len(location_hits) = 0 then 'location'
                       when len(types) > 0 and len(type_hits) = 0 then 'employment'
                       when len(title_hits) = 0 then 'no_keywords' else 'matched' end as reason_class,
               'source:' || {norm('company')} || ':' || {norm('source_job_id')} as dedup_key from h)"""

# Keywords in first-seen order without repeats; 'gizmo' is listed twice.
_KEYWORDS = "list_filter(title_hits, lambda k, i: list_position(title_hits, k) = i)"
_REASON = f"""case reason_class when 'excluded' then 'excluded keyword(s): ' || array_to_string(exclude_hits, ', ')
   when 'seniority' then 'excluded seniority: old' when 'location' then 'location did not match configured filters: ' || location
   when 'employment' then 'employment type did not match: ' || employment_type
   when 'no_keywords' then 'no configured title or description keywords matched'
   else 'title matched: ' || array_to_string(title_hits, ', ') || '; location matched: ' || array_to_string(location_hits, ', ') end"""

DOC_CTES = f"""
  v as ({views.DOCS_SQL}),
  n as (select *, {norm('title')} as t, {norm('description')} as x, {norm('location')} as l,
               case company_ord % 3 when 0 then ['EN', 'Remote'] when 1 then ['fr', 'de'] else ['en', 'ES', 'usa'] end as locs,
               case company_ord % 3 when 0 then ['EN'] when 1 then ['fr', 'de'] else ['en', 'ES'] end as specific,
               case company_ord % 3 when 1 then ['th', 'le'] else ['the', 'la', 'der'] end as titles,
               case company_ord % 3 when 2 then ['viagra', 'password', 'internship', 'lorem'] else ['viagra', 'password', 'internship'] end as excludes from v),
  h as (select *, list_filter(titles, lambda k: contains(t, k)) as title_hits,
               list_filter(['hetion', 'ieux', 'Wh', 'ción'], lambda k: contains(x, {norm('k')})) as text_hits,
               list_filter(excludes, lambda k: contains(trim(t || ' ' || x || ' ' || l), k)) as exclude_hits,
               list_filter(['qu', 'heit'], lambda k: contains(t, k)) as seniority_hits,
               list_filter(specific, lambda k: contains(l, lower(k))) as location_hits from n),
  d as (select *, case when len(exclude_hits) > 0 then 'excluded' when len(seniority_hits) > 0 then 'seniority'
                       when len(location_hits) = 0 then 'location'
                       when len(title_hits) + len(text_hits) = 0 then 'no_keywords' else 'matched' end as reason_class,
               'fallback:' || {norm('company')} || ':' || t || ':' || l as dedup_key from h)"""


def star_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(views.star(spark, sf_dir), views.star_rules(spark, sf_dir), views.STAR_FILTERS)


def doc_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(views.docs(spark, sf_dir), views.doc_rules(spark, sf_dir), views.DOC_FILTERS)


def _matched(df: DataFrame) -> DataFrame:
    return df.where("match_status = 'matched'")


def _joined(name: str) -> Column:
    return F.array_join(F.transform(name, lambda k: k["raw"]), "|").alias(name)


@query("D01_effective_rules", f"""
  with r as ({views.STAR_RULES_SQL})
  select company_ord, array_to_string(titles, '|') as title_kw, 'unused' as description_kw, array_to_string(locs, '|') as location_kw,
         array_to_string(types, '|') as employment_kw from r""")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = R.effective_rules(views.star_rules(spark, sf_dir), views.STAR_FILTERS)
    return rules.select("company_ord", *[_joined(n) for n in ["title_kw", "description_kw", "location_kw", "employment_kw"]])


@query("D02_clean_list", """
  select p_partkey, p_name || '|' || p_brand as kept from part""")
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.concat(F.lit("\t "), "p_name", F.lit("  ")), F.lit("   "), F.lit(None).cast("string"), F.lit(""), F.concat("p_brand", F.lit("\n")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(R.clean_list(raw), "|").alias("kept"))


@query("D03_excludes", """
  select s_suppkey as company_ord, case when s_suppkey % 5 = 0 then 'bolt|internship|rod' else 'bolt|internship' end as closed,
         case when s_suppkey % 5 = 0 then 'bolt|rod' else 'bolt' end as open from supplier""")
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = views.star_rules(spark, sf_dir)
    filters = views.STAR_FILTERS
    allowing = R.GlobalFilters(**{**filters.__dict__, "allow_internships": True})
    closed = R.effective_rules(companies, filters).select("company_ord", F.array_join(F.transform("exclude_kw", lambda k: k["raw"]), "|").alias("closed"))
    opened = R.effective_rules(companies, allowing).select("company_ord", F.array_join(F.transform("exclude_kw", lambda k: k["raw"]), "|").alias("open"))
    return closed.join(opened, "company_ord")


@query("D04_contains_any", f"""
  select doc_id, array_to_string(list_filter(['Th e', 'ción', 'LA', 'la', '---', 'qu'], lambda k: contains({norm('text')}, {norm('k')})), '|') as hits from documents""")
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword without letters matches every text; repeats in the list stay."""
    keywords = F.array(*map(F.lit, ["Th e", "ción", "LA", "la", "---", "qu"]))
    rows = table(spark, sf_dir, "documents").select("doc_id", norm_text("text").alias("n"), R.with_norms(keywords).alias("k"))
    return rows.select("doc_id", F.array_join(R.contains_any("n", "k"), "|").alias("hits"))


@query("D05_job_text", f"""
  with s as ({views.STAR_SQL})
  select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, {norm("title || ' ' || department || ' ' || location || ' ' || employment_type")} as text from s""")
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.normalise_fields(views.star(spark, sf_dir))
    text = R.job_text("n_title", "n_description", "n_department", "n_location", "n_employment")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", text.alias("text"))


def _class_rows(name: str, reason: str) -> tuple[str, str]:
    return name, f"""
  with {STAR_CTES} select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, {_REASON} as match_reason from d where reason_class = '{reason}'"""


def _of_class(spark: SparkSession, sf_dir: str, reason: str) -> DataFrame:
    rows = star_decided(spark, sf_dir).where(F.col("reason_class") == reason)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "match_reason")


@query(*_class_rows("D06_excluded", R.EXCLUDED))
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_class(spark, sf_dir, R.EXCLUDED)


@query(*_class_rows("D07_seniority", R.SENIORITY))
def d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_class(spark, sf_dir, R.SENIORITY)


@query(*_class_rows("D08_location", R.LOCATION))
def d08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_class(spark, sf_dir, R.LOCATION)


@query(*_class_rows("D09_employment", R.EMPLOYMENT))
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_class(spark, sf_dir, R.EMPLOYMENT)


@query("D10_keyword_merge", f"""
  with {DOC_CTES}, m as (select *, list_concat(title_hits, text_hits) as k from d)
  select doc_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), '|') as keywords from m where reason_class = 'matched'""")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(doc_decided(spark, sf_dir)).select("doc_id", F.array_join("matched_keywords", "|").alias("keywords"))


@query("D11_decision_ladder", f"""
  with {DOC_CTES}
  select doc_id, reason_class, case reason_class when 'excluded' then 'excluded keyword(s): ' || array_to_string(exclude_hits, ', ')
    when 'seniority' then 'excluded seniority: ' || array_to_string(seniority_hits, ', ')
    when 'location' then 'location did not match configured filters: ' || location
    when 'no_keywords' then 'no configured title or description keywords matched'
    else concat_ws('; ', case when len(title_hits) > 0 then 'title matched: ' || array_to_string(title_hits, ', ') end,
                   case when len(text_hits) > 0 then 'description matched: ' || array_to_string(text_hits, ', ') end,
                   'location matched: ' || array_to_string(location_hits, ', ')) end as match_reason from d""")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_decided(spark, sf_dir).select("doc_id", "reason_class", "match_reason")


@query("D12_stamped_rows", f"""
  with {STAR_CTES}
  select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, company, case when reason_class = 'matched' then 'matched' else 'filtered_out' end as match_status,
         case when reason_class = 'matched' then array_to_string({_KEYWORDS}, '|') else '' end as keywords, {_REASON} as match_reason from d""")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_decided(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "company", "match_status", F.array_join("matched_keywords", "|").alias("keywords"), "match_reason"
    )


@query("D13_matched_only", f"""
  with {STAR_CTES} select company, count(*) as n_matched from d where reason_class = 'matched' group by 1""")
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(star_decided(spark, sf_dir)).groupBy("company").agg(F.count(F.lit(1)).alias("n_matched"))


@query("D14_check_rules", """
  select s_suppkey as company_ord, case s_suppkey % 4 when 0 then 'company name is required' when 1 then 'unknown source type'
         when 2 then 'a locator is required' end as breach from supplier where s_suppkey % 4 < 3""")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("company_ord") % 4
    rules = views.star_rules(spark, sf_dir)
    broken = rules.withColumns(
        {
            "company": F.when(k == 0, F.lit(" ")).otherwise(F.col("company")),
            "source_type": F.when(k == 0, "custom").when(k == 1, "homegrown").otherwise("lever"),
            "ats_identifier": F.when(k == 2, F.lit("")).otherwise("x"),
        }
    )
    return R.check_rules(broken).select("company_ord", "breach")


# -- keys and deduplication ---------------------------------------------------------------------


@query("E01_dedup_key", f"""
  with {DOC_CTES}, s as ({views.STAR_SQL})
  select 'doc ' || doc_id as id, dedup_key from d
  union all select 'page ' || page_id, 'url:' || {sha16(norm_url('url'))} from pages
  union all select 'line ' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_quantity || '-' || l_extendedprice, 'source:' || {norm('company')} || ':' || {norm('source_job_id')} from s""")
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = E.with_dedup_key(views.docs(spark, sf_dir)).select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("id"), "dedup_key")
    pages = E.with_dedup_key(views.pages(spark, sf_dir)).select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("id"), "dedup_key")
    line = F.concat_ws("-", *[F.col(c).cast("string") for c in ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]])
    lines = E.with_dedup_key(views.star(spark, sf_dir)).select(F.concat(F.lit("line "), line).alias("id"), "dedup_key")
    return docs.unionByName(pages).unionByName(lines)


_EVEN_SEEN = "seen as (select dedup_key from d where l_orderkey % 2 = 0)"


def even_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of even orders stand for the stored keys."""
    return E.with_dedup_key(views.star(spark, sf_dir).where("l_orderkey % 2 = 0")).select("dedup_key")


@query("E02_anti_join_seen", f"""
  with {STAR_CTES}, {_EVEN_SEEN}
  select company, count(*) as n, count(*) filter (dedup_key in (select dedup_key from seen)) as n_seen from d where reason_class = 'matched' group by 1""")
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = star_decided(spark, sf_dir)
    matched, seen = _matched(decided).select("company", "dedup_key"), even_seen(spark, sf_dir)
    fresh = E.unseen(matched, seen).withColumn("was_seen", F.lit(0))
    known = E.already_seen(matched, seen).withColumn("was_seen", F.lit(1))
    return fresh.unionByName(known).groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.sum("was_seen").alias("n_seen"))


@query("E03_first_in_run", f"""
  with {STAR_CTES}, x as (select *, row_number() over (partition by dedup_key order by company_ord, l_shipdate, l_partkey, l_linenumber) as rn from d where reason_class = 'matched')
  select dedup_key, company, title, l_partkey, strftime(l_shipdate, '%Y-%m-%d') as posted from x where rn = 1""")
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = E.first_in_run(_matched(star_decided(spark, sf_dir)), views.STAR_ORDER)
    return first.select("dedup_key", "company", "title", "l_partkey", F.col("date_posted").cast("string").alias("posted"))


@query("E04_duplicates_skipped", f"""
  with {STAR_CTES}, {_EVEN_SEEN}
  select company, count(*) filter (reason_class = 'matched')
         - count(distinct dedup_key) filter (reason_class = 'matched' and dedup_key not in (select dedup_key from seen)) as duplicates_skipped from d group by 1""")
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = star_decided(spark, sf_dir)
    counts = P.company_counts(decided, even_seen(spark, sf_dir))
    return counts.select("company", "duplicates_skipped")


@query("E05_rules_lookup", f"""
  with s as ({views.STAR_SQL}), r as ({views.STAR_RULES_SQL})
  select company, count(*) as n, cast(sum(len(titles)) as bigint) as n_keywords from s join r using (company) group by 1""")
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = R.effective_rules(views.star_rules(spark, sf_dir), views.STAR_FILTERS)
    joined = views.star(spark, sf_dir).select("company").join(rules.select("company", "title_kw"), "company")
    return joined.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("title_kw")).cast("bigint").alias("n_keywords"))


@query("E07_seen_union", f"""
  with {DOC_CTES}, k as (select dedup_key from d union select 'url:' || {sha16(norm_url('url'))} from pages) select dedup_key from k""")
def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.union_seen(E.with_dedup_key(views.docs(spark, sf_dir)), E.with_dedup_key(views.pages(spark, sf_dir)), E.with_dedup_key(views.docs(spark, sf_dir)))


@query("E08_concatenate", f"""
  with d as ({views.DOCS_SQL}) select 'docs' as source, company, count(*) as n from d group by all
  union all select 'pages', lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), count(*) from pages group by all""")
def e08(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = views.docs(spark, sf_dir).drop("doc_id").unionByName(views.pages(spark, sf_dir).drop("page_id"))
    return both.groupBy("source", "company").agg(F.count(F.lit(1)).alias("n"))


@query("E09_list_overlap", """
  select s_suppkey as company_ord, cast(s_suppkey % 4 = 1 as bigint) as names_us,
         (select count(*) from lineitem where l_suppkey = s_suppkey) as n from supplier""")
def e09(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.transform("location_filters", lambda f: F.lower(F.trim(f)))
    overlap = F.arrays_overlap(lowered, F.array(*map(F.lit, ["united states", "us", "usa"])))
    rules = views.star_rules(spark, sf_dir).select("company_ord", F.coalesce(overlap, F.lit(False)).cast("bigint").alias("names_us"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("company_ord")).agg(F.count(F.lit(1)).alias("n"))
    return rules.join(rows, "company_ord", "left").fillna(0, ["n"])


# -- reports ------------------------------------------------------------------------------------

_FUNNEL = f"""
  {STAR_CTES}, {_EVEN_SEEN},
  f as (select company, count(*) as jobs_fetched, count(*) filter (reason_class = 'matched') as jobs_matched,
               count(distinct dedup_key) filter (reason_class = 'matched' and dedup_key not in (select dedup_key from seen)) as new_jobs_inserted from d group by 1),
  res as (select s_name as company, s_suppkey as company_ord, coalesce(jobs_fetched, 0) as jobs_fetched, coalesce(jobs_matched, 0) as jobs_matched,
                 coalesce(new_jobs_inserted, 0) as new_jobs_inserted, coalesce(jobs_matched - new_jobs_inserted, 0) as duplicates_skipped
          from supplier left join f on f.company = s_name)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = star_decided(spark, sf_dir)
    return P.company_results(views.star_rules(spark, sf_dir), decided, even_seen(spark, sf_dir))


@query("F01_company_results", f"with {_FUNNEL} select * from res")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).drop("failures")


@query("F02_run_summary", f"""
  with {_FUNNEL} select count(*) as companies_checked, cast(sum(jobs_fetched) as bigint) as jobs_fetched, cast(sum(jobs_matched) as bigint) as jobs_matched,
         cast(sum(new_jobs_inserted) as bigint) as new_jobs_inserted, cast(sum(duplicates_skipped) as bigint) as duplicates_skipped from res""")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run_summary(_results(spark, sf_dir)).drop("failures", "failure_texts")


@query("F02_company_and_total", f"""
  with {_FUNNEL} select company, cast(sum(jobs_fetched) as bigint) as jobs_fetched, cast(sum(jobs_matched) as bigint) as jobs_matched,
         cast(sum(new_jobs_inserted) as bigint) as new_jobs_inserted, cast(sum(duplicates_skipped) as bigint) as duplicates_skipped from res group by rollup (company)""")
def f02_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.company_and_total(_results(spark, sf_dir))


@query("F03_failures", """
  select s_suppkey as company_ord, s_name as company, s_name || ': TimeoutError: gave up after ' || n || ' rows' as message
  from (select s_name, s_suppkey, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey group by all)""")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("company_ord")).agg(F.count(F.lit(1)).alias("n"))
    failed = views.star_rules(spark, sf_dir).join(rows, "company_ord")
    text = F.concat(F.lit("gave up after "), F.col("n").cast("string"), F.lit(" rows"))
    return P.failure_rows(failed.withColumn("message", P.failure_message("company", "TimeoutError", text)))


@query("F04_nested_summary", f"""
  with {_FUNNEL}, t as (
    select 'company' as level, company_ord, company, 1 as companies_checked, jobs_fetched, jobs_matched, new_jobs_inserted, duplicates_skipped from res
    union all select 'total', null, null, count(*), sum(jobs_fetched), sum(jobs_matched), sum(new_jobs_inserted), sum(duplicates_skipped) from res)
  select level, company_ord, company, cast(companies_checked as bigint) as companies_checked, cast(jobs_fetched as bigint) as jobs_fetched,
         cast(jobs_matched as bigint) as jobs_matched, cast(new_jobs_inserted as bigint) as new_jobs_inserted,
         cast(duplicates_skipped as bigint) as duplicates_skipped from t""")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.summary_report(_results(spark, sf_dir))


@query("F05_reason_breakdown", f"""
  with {STAR_CTES} select company, reason_class, count(*) as n from d group by all""")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reason_breakdown(star_decided(spark, sf_dir))
