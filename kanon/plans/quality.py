"""Quality queries: counters (A3), duplicates (A4), samples (A5), unique-key violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kanon.operators import quality as Q
from kanon.plans.catalog import query
from kanon.plans.company import flagged
from kanon.plans.sqlbits import present_sql as P
from kanon.plans.sqlbits import with_flagged
from kanon.sources.bindings import company_history, with_bindings

_PHONE1 = r"(\+48[0-9]{9}|\+48 [0-9]{2} [0-9]{3} [0-9]{2} [0-9]{2}|\+[0-9]{10,15})"
_INVALID_COUNTRY = f"{P('country')} and not regexp_matches(country, '^[A-Z]{{2}}$')"
_INVALID_PHONE = f"{P('phone')} and not regexp_matches(phone, '^{_PHONE1}(, {_PHONE1})*$')"
_INVALID_EMAIL = f"{P('email')} and not regexp_matches(email, '(?i)^[A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{{2,}}$')"


@query("quality_counts", with_bindings(f"""
select count(*) as total,
       count(*) filter (where not {P('nip')}) as missing_nip,
       count(*) filter (where not {P('regon')}) as missing_regon,
       count(*) filter (where not {P('nip')} and not {P('regon')}) as missing_nip_and_regon,
       count(*) filter (where {_INVALID_COUNTRY}) as invalid_country,
       count(*) filter (where coalesce(regexp_matches(street, '(?i)^(ul\\.|ulica\\s+)'), false)) as street_prefix_left,
       count(*) filter (where not {P('city')}) as missing_city,
       count(*) filter (where not {P('phone')}) as missing_phone,
       count(*) filter (where {_INVALID_PHONE}) as invalid_phone,
       count(*) filter (where not {P('email')}) as missing_email,
       count(*) filter (where {_INVALID_EMAIL}) as invalid_email,
       count(*) filter (where not {P('website')}) as missing_website
from company_history""", "company_history"))
def q_quality_counts(spark, sf):
    return Q.quality_counts(company_history(spark, sf))


def _dup_sql() -> str:
    parts = [
        ("nip_history", "nip", "true"),
        ("multi_current_nip", "nip", "is_current"),
        ("regon", "regon", "is_current"),
        ("krs_number", "krs_number", "is_current"),
    ]
    union = "\nunion all\n".join(
        f"select '{k}' as k, {c} as v, count(*) as n from flagged where {w} and {P(c)} group by {c} having count(*) > 1"
        for k, c, w in parts)
    aggs = ",\n       ".join(
        f"count(*) filter (where k = '{k}') as {k}_groups, "
        f"cast(coalesce(sum(n) filter (where k = '{k}'), 0) as bigint) as {k}_rows" for k, _, _ in parts)
    return with_flagged(f"select {aggs}\nfrom ({union}) g")


@query("duplicate_report", _dup_sql())
def q_duplicate_report(spark, sf):
    return Q.duplicate_report(flagged(spark, sf))


@query("quality_samples", with_bindings(f"""
select * from (select 'invalid_country' as sample_kind, coalesce(country, '') as value, count(*) as n
               from company_history where {_INVALID_COUNTRY} group by country order by n desc, country limit 10)
union all
select * from (select 'invalid_phone' as sample_kind, coalesce(phone, '') as value, count(*) as n
               from company_history where {_INVALID_PHONE} group by phone order by n desc, phone limit 10)""",
    "company_history"))
def q_quality_samples(spark, sf):
    h = company_history(spark, sf)
    c = Q.samples(h, "country", Q.invalid_country()).select(F.lit("invalid_country").alias("sample_kind"), "*")
    p = Q.samples(h, "phone", Q.invalid_phone()).select(F.lit("invalid_phone").alias("sample_kind"), "*")
    return c.unionByName(p)


@query("unique_violations", with_bindings("""
select coalesce(nip, '') as nip, coalesce(regon, '') as regon, count(*) as n
from company_history group by 1, 2 having count(*) > 1""", "company_history"))
def q_unique_violations(spark, sf):
    return Q.unique_violations(company_history(spark, sf), ["nip", "regon"])
