"""Normaliser queries (H1–H13, N8, F12) over whole driver texts and the company bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kanon.functions import contact as C
from kanon.functions import text as T
from kanon.functions.dates import parse_date
from kanon.plans import duck_norm as D
from kanon.plans.catalog import query
from kanon.sources.bindings import company_history, with_bindings
from kanon.sources.tables import read_table


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text", "lang")


@query("norm_clean", f"select doc_id, {D.clean('text')} as text_clean from documents")
def q_norm_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text("text").alias("text_clean"))


@query("norm_title", f"""
select 'part' as src, p_partkey as key, {D.title('upper(p_name)')} as value from part
union all
select 'doc' as src, doc_id as key, {D.title('text')} as value from documents""")
def q_norm_title(spark, sf):
    parts = read_table(spark, sf, "part").select(
        F.lit("part").alias("src"), F.col("p_partkey").alias("key"), T.title_case(F.upper("p_name")).alias("value"))
    docs = _docs(spark, sf).select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("key"), T.title_case("text").alias("value"))
    return parts.unionByName(docs)


@query("norm_street", f"""
select p_partkey, {D.street("'UL. ' || upper(p_name)")} as street_ul, {D.street("'ulica  ' || p_name")} as street_ulica,
       {D.street('p_name')} as street_plain from part""")
def q_norm_street(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select(
        "p_partkey",
        T.street(F.concat(F.lit("UL. "), F.upper("p_name"))).alias("street_ul"),
        T.street(F.concat(F.lit("ulica  "), F.col("p_name"))).alias("street_ulica"),
        T.street("p_name").alias("street_plain"),
    )


@query("norm_country", with_bindings(
    f"select id, {D.country('country')} as country_code, {D.country('county')} as county_code from company_history",
    "company_history"))
def q_norm_country(spark, sf):
    return company_history(spark, sf).select(
        "id", T.country_code("country").alias("country_code"), T.country_code("county").alias("county_code"))


@query("norm_region", with_bindings(
    f"select id, {D.voivodeship('voivodeship')} as voivodeship, {D.voivodeship('lower(county)')} as county "
    "from company_history", "company_history"))
def q_norm_region(spark, sf):
    return company_history(spark, sf).select(
        "id", T.voivodeship("voivodeship").alias("voivodeship"), T.voivodeship(F.lower("county")).alias("county"))


@query("norm_email", f"""
with raw as (select doc_id, {D.email_list_raw('text')} as l from documents),
     dist as (select doc_id, {D.ordered_distinct('l')} as l from raw)
select doc_id, {D.join_or_null('l')} as emails from dist""")
def q_norm_email(spark, sf):
    return _docs(spark, sf).select("doc_id", C.email_list("text").alias("emails"))


@query("norm_website", f"""
with raw as (select page_id, {D.website_list_raw('url')} as l from pages),
     dist as (select page_id, {D.ordered_distinct('l')} as l from raw)
select page_id, {D.join_or_null('l')} as websites from dist""")
def q_norm_website(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", C.website_list("url").alias("websites"))


_PHONE_CTE = f"""
with raw as (select doc_id, {D.phone_list_raw('text')} as l from documents),
     dist as (select doc_id, {D.ordered_distinct('l')} as l from raw)"""


@query("norm_phone", _PHONE_CTE + f"\nselect doc_id, {D.join_or_null('l')} as phones from dist")
def q_norm_phone(spark, sf):
    return _docs(spark, sf).select("doc_id", C.phone_list("text").alias("phones"))


@query("norm_phone_types", _PHONE_CTE + f"""
select doc_id,
       {D.join_or_null(f"list_filter(l, lambda p: {D.is_mobile('p')})")} as phone_mobile,
       {D.join_or_null("list_filter(l, lambda p: starts_with(p, '+48 '))")} as phone_landline,
       {D.phone_json('l')} as phones_json
from dist""")
def q_norm_phone_types(spark, sf):
    d = C.with_phone_columns(_docs(spark, sf).select("doc_id", "text"), F.col("text"))
    return d.select("doc_id", "phone_mobile", "phone_landline", "phones_json")


@query("norm_digits", f"select doc_id, {D.digits('text')} as digits, {D.digits('text', 10)} as digits10 from documents")
def q_norm_digits(spark, sf):
    return _docs(spark, sf).select("doc_id", T.digits("text").alias("digits"), T.digits("text", 10).alias("digits10"))


@query("norm_code", with_bindings(
    f"select id, {D.activity_code('dotted')} as code from (select id, "
    "substring(main_pkd_code, 1, 2) || '.' || substring(main_pkd_code, 3, 2) || '.' || lower(substring(main_pkd_code, 5)) "
    "|| ' ' as dotted from company_history)", "company_history"))
def q_norm_code(spark, sf):
    h = company_history(spark, sf)
    pk = F.col("main_pkd_code")
    dotted = F.concat(F.substr(pk, F.lit(1), F.lit(2)), F.lit("."), F.substr(pk, F.lit(3), F.lit(2)), F.lit("."),
                      F.lower(F.substr(pk, F.lit(5))), F.lit(" "))
    return h.select("id", T.activity_code(dotted).alias("code"))


@query("norm_postal", f"""
select 'part' as src, p_partkey as key, {D.postal("cast(p_partkey * 7 as varchar)")} as postal from part
union all
select 'doc' as src, doc_id as key, {D.postal('text')} as postal from documents""")
def q_norm_postal(spark, sf):
    p = read_table(spark, sf, "part").select(
        F.lit("part").alias("src"), F.col("p_partkey").alias("key"),
        T.postal_code((F.col("p_partkey") * 7).cast("string")).alias("postal"))
    d = read_table(spark, sf, "documents").select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("key"), T.postal_code("text").alias("postal"))
    return p.unionByName(d)


@query("norm_legal_form", with_bindings(f"""
select 'row' as src, id as key, {D.legal_form('legal_form')} as legal_form from company_history
union all
select 'doc' as src, doc_id as key, {D.legal_form('text')} as legal_form from documents""",
    "company_history"))
def q_norm_legal_form(spark, sf):
    h = company_history(spark, sf).select(
        F.lit("row").alias("src"), F.col("id").alias("key"), T.legal_form("legal_form").alias("legal_form"))
    d = _docs(spark, sf).select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("key"), T.legal_form("text").alias("legal_form"))
    return h.unionByName(d)


@query("norm_status", with_bindings(
    f"select b_id, {D.source_status('source_status')} as status, upper({D.clean('name')}) as name_upper from registry_b",
    "registry_b"))
def q_norm_status(spark, sf):
    from kanon.sources.bindings import registry_b

    return registry_b(spark, sf).select(
        "b_id", T.source_status("source_status").alias("status"), T.status("name").alias("name_upper"))


@query("content_hash", "select doc_id, sha256(text) as text_sha256 from documents")
def q_content_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", T.content_hash("text").alias("text_sha256"))


@query("fold_accents", f"""
select doc_id, {D.fold('text')} as folded, {D.fold('text', True)} as folded_l from documents""")
def q_fold_accents(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", T.fold_accents("text").alias("folded"), T.fold_accents("text", True).alias("folded_l"))


# report selection — file type equal ignoring case, name contains ignoring case and accents (ł → l too).
def report_filter(type_col, name_col, file_type: str | None, name_contains: str | None):
    preds = []
    if file_type is not None and file_type.strip() != "":
        preds.append(F.lower(F.col(type_col)) == file_type.lower())
    if name_contains is not None and name_contains.strip() != "":
        needle = F.lower(T.fold_accents(F.lit(name_contains), True))
        preds.append(F.instr(F.lower(T.fold_accents(F.col(name_col), True)), needle) > 0)
    out = F.lit(True)
    for p in preds:
        out = out & p
    return out


@query("filter_accent_insensitive", f"""
select doc_id, lang from documents
where lower(lang) = 'fr' and instr(lower({D.fold('text', True)}), lower({D.fold("'ÉLLE'", True)})) > 0""")
def q_filter_accent_insensitive(spark, sf):
    d = _docs(spark, sf)
    return d.filter(report_filter("lang", "text", "FR", "ÉLLE")).select("doc_id", "lang")


@query("multi_format_date", """
select o_orderkey, s as date_text,
       coalesce(try_strptime(s, '%d.%m.%Y'), try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%d-%m-%Y'),
                try_strptime(s, '%Y%m%d'))::date as parsed
from (select o_orderkey,
             case o_orderkey % 5 when 0 then strftime(o_orderdate, '%d.%m.%Y') when 1 then strftime(o_orderdate, '%Y-%m-%d')
                  when 2 then strftime(o_orderdate, '%d-%m-%Y') when 3 then strftime(o_orderdate, '%Y%m%d')
                  else 'n/a ' || cast(o_orderkey as varchar) end as s
      from orders)""")
def q_multi_format_date(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    s = (F.when(k % 5 == 0, F.date_format(d, "dd.MM.yyyy")).when(k % 5 == 1, F.date_format(d, "yyyy-MM-dd"))
         .when(k % 5 == 2, F.date_format(d, "dd-MM-yyyy")).when(k % 5 == 3, F.date_format(d, "yyyyMMdd"))
         .otherwise(F.concat(F.lit("n/a "), k.cast("string"))))
    return o.select("o_orderkey", s.alias("date_text")).withColumn("parsed", parse_date("date_text"))


# ------------------------------------------------------------------ H15 / W6
RENORMALIZE_ORACLE = with_bindings(f"""
select id, {D.digits('nip')} as nip, {D.digits('regon')} as regon, {D.digits('krs_number', 10)} as krs_number,
       {D.clean('name')} as name, upper({D.clean('status')}) as status, {D.voivodeship('voivodeship')} as voivodeship,
       {D.title('county')} as county, {D.title('city')} as city, {D.legal_form('legal_form')} as legal_form,
       {D.activity_code('main_pkd_code')} as main_pkd_code, {D.country('country')} as country, {D.street('street')} as street,
       {D.join_or_null(D.ordered_distinct(D.phone_list_raw('phone')))} as phone,
       {D.join_or_null(D.email_list_raw('email'))} as email, {D.join_or_null(D.website_list_raw('website'))} as website
from company_history""", "company_history")


@query("renormalize", RENORMALIZE_ORACLE)
def q_renormalize(spark, sf):
    """Every stored company row re-normalised with the write-time rules."""
    from kanon.operators.renormalize import renormalize

    cols = ["id", "nip", "regon", "krs_number", "name", "status", "voivodeship", "county", "city", "legal_form",
            "main_pkd_code", "country", "street", "phone", "email", "website"]
    return renormalize(company_history(spark, sf).select(*cols)).select(*cols)


@query("renormalize_sql", RENORMALIZE_ORACLE)
def q_renormalize_sql(spark, sf):
    """H1-H12 as SQL functions: the stored company rows re-normalised by plain SQL text."""
    from kanon.functions.sql import register

    register(spark)
    return spark.sql("""
        select id, norm_digits(nip) as nip, norm_digits(regon) as regon, norm_krs_number(krs_number) as krs_number, norm_clean(name) as name,
               norm_status(status) as status, norm_voivodeship(voivodeship) as voivodeship, norm_title(county) as county, norm_title(city) as city,
               norm_legal_form(legal_form) as legal_form, norm_code(main_pkd_code) as main_pkd_code, norm_country(country) as country, norm_street(street) as street,
               norm_phone(phone) as phone, norm_email(email) as email, norm_website(website) as website
        from {rows}""", rows=company_history(spark, sf))


# Spellings of three cities; every customer has one, every supplier another.
_CITIES = ("ŁÓDŹ", "Łódź", "lodz", "Kraków", "KRAKOW", "krakÓw", "Zürich", "zurich")
_FOLDED_CITY = "lower(strip_accents(translate({0}, 'łŁ', 'lL')))"


@query("collated_places", f"""
with c as (select c_custkey as k, list_extract({list(_CITIES)}, 1 + cast(c_custkey % 8 as integer)) as city from customer),
s as (select distinct list_extract({list(_CITIES)}, 1 + cast(s_suppkey % 3 as integer)) as city from supplier)
select min(c.city) as city, count(*) as customers, count(*) filter (where {_FOLDED_CITY.format('c.city')} = 'lodz') as in_lodz,
       count(*) filter (where exists (select 1 from s where {_FOLDED_CITY.format('s.city')} = {_FOLDED_CITY.format('c.city')})) as supplied
from c group by {_FOLDED_CITY.format('c.city')}""")
def q_collated_places(spark, sf):
    """F2 / F12 by collation: filter, join and grouping take letters for equal whatever their case and accents are."""
    from kanon.operators.search import eq_place, place_key

    city = lambda k, n: F.element_at(F.array(*[F.lit(x) for x in _CITIES]), (F.col(k) % n + 1).cast("int"))
    c = read_table(spark, sf, "customer").select(city("c_custkey", 8).alias("city"))
    s = read_table(spark, sf, "supplier").select(place_key(city("s_suppkey", 3)).alias("place")).distinct()
    met = c.join(s, place_key("city") == F.col("place"), "left")
    return met.groupBy(place_key("city").alias("place")).agg(
        F.min("city").alias("city"), F.count("*").alias("customers"), F.count_if(eq_place("city", " Lódz ")).alias("in_lodz"),
        F.count("place").alias("supplied")).drop("place")


# What the batch rules make of stored values: column -> (stored, expected). Row k of the orders holds value k mod n of each.
_BATCH_VALUES = {
    "email": ((" Ola 1 @Mail.TEST ", "ola1@mail.test"), ("brak", "brak"), ("  ", None), (None, None)),
    "website": (("Sklep", "sklep"), (" WWW.Sklep.test// ", "https://www.sklep.test"), ("HTTP://A.test/X/", "http://a.test/x"), ("", None), (None, None)),
    "street": (("UL. POLNA-LESNA 4A", "Polna-Lesna 4a"), ("ulica lipowa", "Lipowa"), ("AL. NIEPODLEGLOSCI", "al. Niepodleglosci"), ("bulw. odry", "bulw. Odry"),
               ("Ul.", None), (None, None)),
    "country": ((" polska ", "PL"), ("Oesterreich", "OESTERREICH"), ("de", "DE"), ("", None), ("rp", "PL")),
    "postal_code": (("00950", "00-950"), (" 12-34 ", "12-34"), ("", None), ("80 001", "80-001")),
    "legal_form": (("SPOLKA Z O.O. W LIKWIDACJI I INNE", "Spolka z O.O. w Likwidacji i Inne"), (" fundacja ", "Fundacja"), (None, None)),
    "city": (("BIELSKO-BIALA", "Bielsko-Biala"), ("nowy  dwor 2maja", "Nowy  Dwor 2maja"), (" ŁÓDŹ", "Łódź")),
    "krs_number": (("12-34", "0000001234"), ("brak", None), (None, None)),
    "status": ((" aktywny", "AKTYWNY"), ("", None)),
    "main_pkd_code": (("47.11.z", "4711Z"), ("--", None)),
    "nip": (("555-000 11.22", "5550001122"), ("x", None)),
    "voivodeship": (("SLASKIE", "Śląskie"), (" śląskie", "Śląskie"), ("LODZKIE", "Łódzkie"), ("ŁÓDZKIE", "Łódzkie"), ("warminsko-mazurskie", "Warmińsko-Mazurskie"),
                    ("KUJAWSKO-POMORSKIE", "Kujawsko-Pomorskie"), ("BRANDENBURGIA", "Brandenburgia"), ("  ", None), (None, None)),
    "phone": (("505 123 456", "+48505123456"), ("22 555-66-77", "+48 22 555 66 77"), ("0048 600 700 800; 48 12 345 67 89", "+48600700800, +48 12 345 67 89"),
              ("600700800/600700800", "+48600700800"), ("48600700800226667788", "+48600700800, +48 22 666 77 88"), ("600700800|226667788501502503", "+48600700800, +48 22 666 77 88, +48501502503"),
              ("+49 30 1234567", "+49301234567"), ("12 34", None), (" ", None), (None, None)),
}
# Where the first form of the job differs.
_FIRST_VALUES = {
    "street": ("ul. Polna-Lesna 4a", "Ulica Lipowa", "al. Niepodleglosci", "bulw. Odry", "ul.", None),
    "country": ("POLSKA", "OESTERREICH", "DE", None, "RP"),
    "phone": ("+48505123456", "+48225556677", "+48600700800, +48123456789", "+48600700800", "+48600700800, +48226667788", "+48600700800, +48226667788, +48501502503",
              "+49301234567", None, None, None),
}


def _listed(values) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v + "'" for v in values) + "]"


def _expected(values, alias: str) -> str:
    return f"list_extract({_listed(values)}, 1 + cast(o_orderkey % {len(values)} as integer)) as {alias}"


@query("renormalize_batch", "select o_orderkey as id, " + ", ".join(
    [_expected([e for _, e in pairs], c) for c, pairs in _BATCH_VALUES.items()] + [_expected(v, f"first_{c}") for c, v in _FIRST_VALUES.items()]) + " from orders")
def q_renormalize_batch(spark, sf):
    """H15 with the batch rules, in their second form and (``first_...``) their first."""
    from kanon.operators.renormalize import FIRST_RULES, renormalize_batch

    rows = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    value = lambda v: F.element_at(F.array(*[F.lit(s) for s, _ in v]), (F.col("id") % len(v) + 1).cast("int"))
    stored = rows.select("id", *[value(v).alias(c) for c, v in _BATCH_VALUES.items()], *[value(_BATCH_VALUES[c]).alias(f"first_{c}") for c in _FIRST_VALUES])
    return renormalize_batch(renormalize_batch(stored), {f"first_{c}": FIRST_RULES[c] for c in _FIRST_VALUES})


@query("split_ordinal", rf"""
with p as (select doc_id, {D.join_or_null(D.ordered_distinct(D.phone_list_raw('text')))} as phones from documents)
select doc_id, ordinal, item from (
  select doc_id, unnest(generate_series(1, len(string_split_regex(phones, '\s*,\s*')))) as ordinal,
         unnest(string_split_regex(phones, '\s*,\s*')) as item
  from p where phones is not null)""")
def q_split_ordinal(spark, sf):
    """Each document's normalised phone list split back into (ordinal, number) rows."""
    from kanon.operators.renormalize import split_ordinal

    d = _docs(spark, sf).select("doc_id", C.phone_list("text").alias("phones"))
    return split_ordinal(d, "doc_id", "phones")
