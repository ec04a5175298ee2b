"""Company-table queries: identity, current record, search, projection, filters, analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kanon.operators import analytics as A
from kanon.operators import search as S
from kanon.operators.identity import current_only, current_rows, flag_current, identity_key, search_order
from kanon.plans.catalog import query
from kanon.plans.sqlbits import SOURCE_PROFILE_SQL, pct_sql, present_sql, with_flagged
from kanon.sources.bindings import company_history, with_bindings
from kanon.plans.sqlbits import IDENTITY_SQL


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_registry_sources(flag_current(company_history(spark, sf)))


def current(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_registry_sources(current_rows(company_history(spark, sf)))


# ---------------------------------------------------------------- W2 / W1 / F1
@query("identity_key", with_bindings(f"select id, {IDENTITY_SQL} as identity_key from company_history", "company_history"))
def q_identity_key(spark, sf):
    return company_history(spark, sf).select("id", identity_key().alias("identity_key"))


@query("current_record", with_flagged("select id, identity_key, current_rank, is_current from flagged"))
def q_current_record(spark, sf):
    return flag_current(company_history(spark, sf)).select("id", "identity_key", "current_rank", "is_current")


@query("search_current", with_flagged("select id, ceidg_id, nip, name, status, current_rank from current_rows"))
def q_search_current(spark, sf):
    return current(spark, sf).select("id", "ceidg_id", "nip", "name", "status", "current_rank")


# ---------------------------------------------------------------- L1 / L2 / F9
_PAGE_ORDER_SQL = ("is_current desc, current_rank asc, coalesce(removed_on, started_on, cast(updated_at as date)) "
                   "desc nulls last, updated_at desc nulls first, ceidg_id asc nulls last, id asc")


@query("search_page", with_flagged(f"""
select ceidg_id as "ceidgId", nip, regon, name, status, legal_form as "legalForm", country, city,
       main_pkd_code as "mainPkdCode", '{{' || array_to_string(registry_sources, ',') || '}}' as "registrySources"
from (select *, string_split({SOURCE_PROFILE_SQL}, '+') as registry_sources from flagged)
where upper(voivodeship) = upper('europe') and city ilike '%build%'
order by {_PAGE_ORDER_SQL}
limit 25 offset 25"""))
def q_search_page(spark, sf):
    """Search with history included, filters voivodeship = ' europe ' and city ~ 'build', page 2 of 25."""
    df = flagged(spark, sf)
    hits = current_only(df, include_history=True).filter(S.search_filter(voivodeship=" europe ", city="build"))
    ordered = S.page(hits, page_no=2, size=25, order=search_order(hits))
    return S.project(ordered, None)


@query("project_dynamic", with_flagged("""
select name, nip, city, '{' || array_to_string(registry_sources, ',') || '}' as "registrySources",
       is_current as "isCurrent", current_rank as "currentRank", started_on as "startedOn"
from (select *, string_split(""" + SOURCE_PROFILE_SQL + """, '+') as registry_sources from current_rows)"""))
def q_project_dynamic(spark, sf):
    """' name , NIP,nip, bogus ,city,registrySources, isCurrent,currentRank,startedOn' over current rows."""
    return S.project(current(spark, sf), " name , NIP,nip, bogus ,city,registrySources, isCurrent,currentRank,startedOn")


@query("filter_eq_ci", with_flagged(
    "select id, voivodeship, status from current_rows where upper(voivodeship) = upper('europe') "
    "and upper(status) = upper('aktywny')"))
def q_filter_eq_ci(spark, sf):
    return current(spark, sf).filter(S.search_filter(voivodeship="  europe ", status="aktywny ")).select(
        "id", "voivodeship", "status")


@query("filter_contains_ci", with_flagged(
    "select id, name, county from current_rows where name ilike '%mer#00000_1%' and county ilike '%nation_1%'"))
def q_filter_contains_ci(spark, sf):
    """``_`` typed by the user stays a one-character wildcard (not escaped)."""
    return current(spark, sf).filter(S.search_filter(name="MER#00000_1", county=" nation_1")).select(
        "id", "name", "county")


@query("filter_prefix", with_flagged(
    "select id, main_pkd_code from current_rows where main_pkd_code ilike '1%'"))
def q_filter_prefix(spark, sf):
    return current(spark, sf).filter(S.analytics_filter(pkd_prefix=" 1%% ")).select("id", "main_pkd_code")


@query("filter_presence", with_flagged(
    f"select id, email, phone, krs_number from current_rows where {present_sql('email')} "
    f"and not ({present_sql('phone')}) and {present_sql('krs_number')}"))
def q_filter_presence(spark, sf):
    return current(spark, sf).filter(S.search_filter(has_email=True, has_phone=False, has_krs=True)).select(
        "id", "email", "phone", "krs_number")


@query("filter_date_range", with_flagged(
    "select id, started_on from current_rows where started_on >= date '1996-01-01' and started_on <= date '1996-12-31'"))
def q_filter_date_range(spark, sf):
    return current(spark, sf).filter(S.analytics_filter(started_from="1996-01-01", started_to="1996-12-31")).select(
        "id", "started_on")


@query("filter_array_member", with_flagged(
    f"select id, ceidg_id, krs_number from current_rows where ({SOURCE_PROFILE_SQL}) = 'CEIDG+KRS'"))
def q_filter_array_member(spark, sf):
    """F5 ``upper(' krs ') = any(registry_sources)``."""
    return current(spark, sf).filter(S.analytics_filter(registry_source=" krs ")).select("id", "ceidg_id", "krs_number")


@query("total_rows", with_flagged(
    "select count(*) as total_rows from current_rows where city ilike '%mach%'"))
def q_total_rows(spark, sf):
    return S.total_rows(current(spark, sf).filter(S.search_filter(city="mach")))


# ---------------------------------------------------------------- A1 / A2
def _summary_sql(where: str = "") -> str:
    cnt = {
        "active": "upper(coalesce(status, '')) in ('AKTYWNY', 'ACTIVE')",
        "suspended": "upper(coalesce(status, '')) like 'ZAWIESZ%'",
        "with_email": present_sql("email"),
        "with_phone": present_sql("phone"),
        "with_website": present_sql("website"),
    }
    inner = ", ".join(f"count(*) filter (where {v}) as {k}" for k, v in cnt.items())
    outer = ", ".join(f"{k}, {pct_sql(k, 'total')} as {k}_pct" for k in cnt)
    return with_flagged(f"select total, {outer} from (select count(*) as total, {inner} from current_rows {where})")


@query("market_summary", _summary_sql())
def q_market_summary(spark, sf):
    return A.market_summary(current(spark, sf))


def _dist_sql(bucket_expr: str, limit: int = 20, min_bucket: int = 10, where: str = "") -> str:
    return with_flagged(f"""
select bucket_key, companies, active_companies, total_count, {pct_sql('companies', 'total_count')} as share_pct
from (
  select coalesce(nullif({bucket_expr}, ''), 'brak') as bucket_key, count(*) as companies,
         count(*) filter (where upper(coalesce(status, '')) in ('AKTYWNY', 'ACTIVE')) as active_companies,
         (select count(*) from current_rows {where}) as total_count
  from current_rows {where}
  group by 1
  having count(*) >= {min_bucket}
  order by companies desc, bucket_key
  limit {limit})""")


@query("distribution_topn", _dist_sql("county", limit=20, min_bucket=10))
def q_distribution_topn(spark, sf):
    return A.distribution(current(spark, sf), "county", limit=20, min_bucket=10)


@query("distribution_year", _dist_sql("cast(year(started_on) as varchar)", limit=0 or 20, min_bucket=10,
                                      where="where upper(status) = upper('AKTYWNY')"))
def q_distribution_year(spark, sf):
    df = current(spark, sf).filter(S.analytics_filter(status="AKTYWNY"))
    return A.distribution(df, "startedYear", limit=0, min_bucket=0)


@query("source_profile", _dist_sql(f"({SOURCE_PROFILE_SQL})", limit=20, min_bucket=1))
def q_source_profile(spark, sf):
    return A.distribution(current(spark, sf), "sourceProfile", limit=20, min_bucket=1)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """entry(): how many current companies per region, and what share."""
    return A.distribution(current(spark, sf), "voivodeship", limit=20, min_bucket=10)
