"""Match / merge / upsert / diff queries (J1–J12, D1–D6) over the two registries and part versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kanon.functions import text as T
from kanon.operators import analytics as A
from kanon.operators import merge as MG
from kanon.operators import search as S
from kanon.operators.search import text_cast
from kanon.plans import duck_norm as D
from kanon.plans.catalog import query
from kanon.plans.company import current
from kanon.operators.identity import flag_current
from kanon.plans.sqlbits import IDENTITY_SQL, RANK_SQL, SOURCE_PROFILE_SQL, present_sql as P, with_flagged
from kanon.sources.bindings import BINDING_SQL, company_history, registry_b, usage_log, with_bindings
from kanon.sources.sinks import kept
from kanon.sources.tables import read_table


def _cand_sql(master: str) -> str:
    rules = ((1, "krs_number"), (2, "nip"), (3, "regon"))
    return "\nunion all\n".join(
        f"select b.b_id, {r} as rule, h.id from registry_b b join {master} h on trim(b.{k}) = trim(h.{k}) "
        f"where {P('b.' + k)} and {P('h.' + k)}" for r, k in rules)


_BEST_SQL = ("select b_id, id as master_id, rule from (select *, row_number() over (partition by b_id order by rule, id) "
             "as rn from cand) where rn = 1")


@query("match_priority", with_bindings(_BEST_SQL, "company_history", "registry_b",
                                       extra={"cand": _cand_sql("company_history")}))
def q_match_priority(spark, sf):
    return MG.match_entities(registry_b(spark, sf), company_history(spark, sf), "b_id")


@query("link_status", with_bindings("""
select b.b_id, case when c.n is null then 'unmatched' when c.n = 1 then 'linked' else 'ambiguous' end as link_status,
       case when c.n = 1 then c.lo end as master_id
from registry_b b left join (select b_id, count(distinct id) as n, min(id) as lo from cand group by b_id) c on c.b_id = b.b_id""",
    "company_history", "registry_b", extra={"cand": _cand_sql("company_history")}))
def q_link_status(spark, sf):
    return MG.link_status(registry_b(spark, sf), company_history(spark, sf), "b_id")


def _feed(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("c"),
                              (F.col("l_orderkey") + F.col("l_linenumber")).cast("string")).alias("company_id"))


_FEED_SQL = ("select concat(case when l_linenumber % 2 = 0 then 'C' else 'c' end, "
             "cast(l_orderkey + l_linenumber as varchar)) as company_id from lineitem")


@query("anti_existing", with_bindings(
    "select distinct company_id from feed f where not exists "
    "(select 1 from company_history h where upper(h.ceidg_id) = upper(f.company_id))",
    "company_history", extra={"feed": _FEED_SQL}))
def q_anti_existing(spark, sf):
    return MG.new_ids(_feed(spark, sf), company_history(spark, sf), "company_id", "ceidg_id")


@query("semi_existing", with_bindings(
    "select distinct company_id from feed f where exists "
    "(select 1 from company_history h where upper(h.ceidg_id) = upper(f.company_id))",
    "company_history", extra={"feed": _FEED_SQL}))
def q_semi_existing(spark, sf):
    return MG.existing_ids(_feed(spark, sf), company_history(spark, sf), "company_id", "ceidg_id")


# ------------------------------------------------------------------ J5 / J6
# Court rows and the company columns that the court policy touches, as SQL text that both engines read
# (a binding like those of sources/bindings.py; the folding and merging under test are not in it).
_COURT_COLS = {
    "krs_number": "krs_number", "nip": "nip", "regon": "regon",
    "krs_register_type": "'RejP'", "krs_court_name": "concat('SAD ', county)",
    "krs_last_entry_date": "cast(concat('20', lpad(cast(b_id % 20 as string), 2, '0'), '-03-15') as date)",
    "krs_representatives": "concat('{\"osoba\":', cast(b_id as string), '}')",
    "raw_krs_payload": "concat('{\"odpis\":', cast(b_id as string), '}')",
    "krs_updated_at": "cast(concat('2024-02-', lpad(cast(1 + b_id % 28 as string), 2, '0'), ' 06:00:00') as timestamp)",
    "source_detail_url": "concat('https://example.invalid/odpis/', cast(b_id as string))",
    "last_detail_source_hash": "concat('hash-', cast(b_id as string))",
    "legal_form": "case when b_id % 3 = 0 then null when b_id % 3 = 1 then '' else 'Spolka Akcyjna' end",
    "registered_on": "case when b_id % 5 <> 0 then cast(concat('199', cast(b_id % 10 as string), '-07-01') as date) end",
    "electronic_delivery_address": "case when b_id % 2 = 0 then concat('AE:PL-', cast(b_id as string)) end",
    "country": "case when b_id % 4 <> 0 then 'PL' end", "voivodeship": "cast(null as string)",
    "municipality": "case when b_id % 7 = 0 then 'Centrum' end", "city": "case when b_id % 3 <> 0 then 'Warszawa' else ' ' end",
    "street": "case when b_id % 2 = 1 then 'Polna' end", "building": "cast(b_id as string)", "unit": "cast(null as string)",
    "postal_code": "case when b_id % 6 = 0 then '00-001' end", "main_pkd_code": "case when b_id % 4 = 1 then '6201Z' end",
    "pkd_codes": "case when b_id % 4 = 1 then '[{\"kod\":\"6201Z\"}]' end",
}
_MASTER_COLS = {
    "krs_register_type": "cast(null as string)", "krs_court_name": "cast(null as string)", "krs_last_entry_date": "cast(null as date)",
    "krs_representatives": "cast(null as string)", "raw_krs_payload": "cast(null as string)", "krs_updated_at": "cast(null as timestamp)",
    "source_detail_url": "case when id % 3 = 0 then concat('https://example.invalid/firma/', cast(id as string)) when id % 3 = 1 then '' end",
    "last_detail_source_hash": "case when id % 2 = 0 then concat('detail-', cast(id as string)) end",
    "registered_on": "case when id % 2 = 0 then started_on end", "electronic_delivery_address": "case when id % 4 = 0 then '' end",
    "municipality": "case when id % 5 = 0 then 'Stara' end", "building": "case when id % 2 = 0 then '1' end", "unit": "case when id % 3 = 0 then '2' end",
    "postal_code": "case when id % 2 = 1 then '30-002' end", "pkd_codes": "cast(null as string)",
}
_POLICY = MG.COURT_POLICY
_DATES = ("registered_on", "krs_last_entry_date", "krs_updated_at")
_OWN = ["id", "ceidg_id", "started_on", "removed_on", "updated_at"]


def court_rows(spark, sf):
    """Court registry rows with every column of the policy (normalised name, status, county)."""
    b = registry_b(spark, sf)
    shared = [F.expr(e.replace("as timestamp", "as timestamp_ntz")).alias(c) for c, e in _COURT_COLS.items()]
    return b.select("b_id", T.clean_text("name").alias("name"), T.source_status("source_status").alias("status"),
                    T.place_name("county").alias("county"), F.array(F.lit("KRS")).alias("registry_sources"), *shared)


def company_rows(spark, sf):
    """Current company rows (string id) with every column of the policy."""
    c = current(spark, sf)
    shared = [F.expr(e.replace("as timestamp", "as timestamp_ntz")).alias(k) for k, e in _MASTER_COLS.items()]
    own = [F.col(k).cast("string").alias(k) if k == "id" else F.col(k) for k in _OWN]
    return c.select(*own, *[k for k in _POLICY if k not in _MASTER_COLS], *shared)


_COURT_SQL = (f"select b_id, {D.clean('name')} as name, {D.source_status('source_status')} as status, {D.title('county')} as county, "
              "['KRS'] as registry_sources, " + ", ".join(f"{e} as {c}" for c, e in _COURT_COLS.items()) + " from registry_b")
_MASTER_SQL = ("select * replace (cast(id as varchar) as id), " + ", ".join(f"{e} as {c}" for c, e in _MASTER_COLS.items())
               + f", string_split({SOURCE_PROFILE_SQL}, '+') as registry_sources from current_rows")


def _has(c: str, x: str) -> str:
    return f"{x}.{c} is not null" if c in _DATES else P(f"{x}.{c}")


def _fold_sql(c: str) -> str:
    kind = _POLICY[c]
    if kind == MG.OVERWRITE:
        return f"first(i.{c} order by i.b_id desc) as {c}"
    if kind == MG.UNION:
        return f"['KRS'] as {c}"
    return f"{'arg_min' if kind == MG.KEEP_EXISTING else 'arg_max'}(i.{c}, i.b_id) filter (where {_has(c, 'i')}) as {c}"


def _merge_sql(c: str) -> str:
    kind = _POLICY[c]
    if kind == MG.OVERWRITE:
        return f"f.{c} as {c}"
    if kind == MG.UNION:
        return f"list_sort(list_distinct(list_concat(m.{c}, f.{c}))) as {c}"
    if kind == MG.KEEP_EXISTING:
        return f"case when {_has(c, 'm')} then m.{c} else f.{c} end as {c}"
    rest = f"m.{c}" if c in _DATES else f"nullif(m.{c}, '')"
    return f"case when {_has(c, 'f')} then f.{c} else {rest} end as {c}"


_MINT_SQL = f"sha256(case when {P('i.krs_number')} then 'krs:' || trim(i.krs_number) else 'row:' || cast(i.b_id as varchar) end)"
_MERGE_CTES = {
    "cur": _MASTER_SQL, "registry_b": BINDING_SQL["registry_b"], "incoming": _COURT_SQL, "cand": _cand_sql("cur"),
    "best": _BEST_SQL,
    "folded": "select best.master_id, " + ", ".join(map(_fold_sql, _POLICY)) + " from incoming i join best on best.b_id = i.b_id group by 1",
    "updated": "select m.id, m.ceidg_id, m.started_on, m.removed_on, m.updated_at, " + ", ".join(map(_merge_sql, _POLICY))
               + " from cur m join folded f on f.master_id = m.id",
    "inserted": f"select {_MINT_SQL} as id, " + ", ".join(map(_fold_sql, _POLICY))
                + " from incoming i where i.b_id not in (select b_id from cand) group by 1",
}
_TEXT_SOURCES = "'{' || array_to_string(registry_sources, ',') || '}' as registry_sources"
_SHOWN = ["id", *_POLICY]


def shown(df, *more):
    return df.select(*[text_cast(F.col(c), df.schema[c].dataType).alias(c) if c == "registry_sources" else F.col(c)
                       for c in (*_SHOWN, *more)])


@query("merge_survivorship", with_flagged(
    f"select * replace ({_TEXT_SOURCES}) from (select {', '.join(_SHOWN)} from updated)", extra=_MERGE_CTES))
def q_merge_survivorship(spark, sf):
    """Company rows that a court row matches, every column by the court policy."""
    master, inc = company_rows(spark, sf), court_rows(spark, sf)
    matched = MG.match_entities(inc, master, "b_id").select("b_id", F.col("master_id").alias("id"))
    folded = MG.fold_incoming(inc.join(matched, "b_id"), "id", "b_id", _POLICY)
    return shown(MG.merge_survivorship(master, folded, "id", _POLICY))


@query("insert_unmatched", with_flagged(
    f"select * replace ({_TEXT_SOURCES}) from (select {', '.join(_SHOWN)} from inserted)", extra=_MERGE_CTES))
def q_insert_unmatched(spark, sf):
    """Court rows without a match become rows of their own with sources {KRS} and a minted id."""
    master, inc = company_rows(spark, sf), court_rows(spark, sf)
    matched = MG.match_entities(inc, master, "b_id").select("b_id")
    new = inc.join(matched, "b_id", "left_anti").withColumn("id", MG.minted_id("b_id"))
    return shown(MG.fold_incoming(new, "id", "b_id", _POLICY))


_MERGED_SQL = ("select id, ceidg_id, started_on, removed_on, updated_at, " + ", ".join(_POLICY) + " from updated union all by name select id, ceidg_id, started_on, removed_on, updated_at, "
               + ", ".join(_POLICY) + " from cur where id not in (select id from updated) union all by name select * from inserted")
_MERGED_EVENT = "coalesce(removed_on, registered_on, started_on, cast(updated_at as date), date '0001-01-01')"


MERGED_ORACLE = with_flagged(f"""
select id, {', '.join(c for c in _POLICY if c != 'registry_sources')}, {_TEXT_SOURCES}, identity_key,
       id = first(id order by {RANK_SQL}, {_MERGED_EVENT} desc, updated_at desc nulls first, id) over (partition by identity_key
            order by {RANK_SQL}, {_MERGED_EVENT} desc, updated_at desc nulls first, id
            rows between unbounded preceding and unbounded following) as is_current
from (select *, {IDENTITY_SQL} as identity_key from merged)""", extra=_MERGE_CTES | {"merged": _MERGED_SQL})


@query("merged_master", MERGED_ORACLE)
def q_merged_master(spark, sf):
    """J5 ∪ J6 ∪ untouched rows, then one current row per identity (W1) over the result."""
    merged = MG.merge_registry(company_rows(spark, sf), court_rows(spark, sf), "b_id")
    return shown(flag_current(merged), "identity_key", "is_current")


# ------------------------------------------------------------------ A2a / F10 / F11 over a table that has every column
_DIMENSION_SQL = {
    "voivodeship": "voivodeship", "county": "county", "municipality": "municipality", "city": "city", "status": "status", "mainPkdCode": "main_pkd_code",
    "startedYear": "cast(year(started_on) as varchar)", "registeredYear": "cast(year(registered_on) as varchar)", "sourceProfile": SOURCE_PROFILE_SQL, "legalForm": "legal_form",
}


def _dimension_sql(name: str, bucket: str) -> str:
    return f"""(select '{name}' as dimension, coalesce(nullif({bucket}, ''), 'brak') as bucket_key, count(*) as companies,
  count(*) filter (where upper(status) in ('AKTYWNY', 'ACTIVE')) as active_companies, (select count(*) from cur) as total_count
  from cur group by 2 order by companies desc, bucket_key limit 100)"""


@query("distribution_dimensions", with_flagged(" union all ".join(_dimension_sql(n, e) for n, e in _DIMENSION_SQL.items()), extra={"cur": _MASTER_SQL}))
def q_distribution_dimensions(spark, sf):
    """All ten dimensions, looked up by name in another case. The current companies are found once, with the columns that
    the dimensions read, and counted ten times."""
    rows = kept(company_rows(spark, sf).select("voivodeship", "county", "municipality", "city", "status", "main_pkd_code", "started_on", "registered_on",
                                               "krs_number", "ceidg_id", "legal_form"), "dimensions")
    parts = [A.distribution(rows, n.upper(), limit=100, min_bucket=1).select(F.lit(n).alias("dimension"), "bucket_key", "companies", "active_companies", "total_count")
             for n in _DIMENSION_SQL]
    return reduce(DataFrame.unionByName, parts)


@query("filter_exact_place", with_flagged("select id, county, municipality from cur where upper(county) = 'NATION_3' and upper(municipality) = 'STARA'", extra={"cur": _MASTER_SQL}))
def q_filter_exact_place(spark, sf):
    """county and municipality match as wholes."""
    return company_rows(spark, sf).filter(S.analytics_filter(county=" nation_3", municipality="stara ")).select("id", "county", "municipality")


_STORED_COLS = {"is_current", "current_rank", "id", "ceidg_id", "started_on", "removed_on", "updated_at", *_POLICY}
_API_SQL = ", ".join(f"{'null' if c not in _STORED_COLS else _TEXT_SOURCES.rsplit(' as ', 1)[0] if c == 'registry_sources' else c} as \"{api}\"" for api, (c, _) in S.CATALOG.items())


@query("project_all", with_flagged(f"""
select {_API_SQL}
from (select *, {RANK_SQL} as current_rank, id = first(id order by {RANK_SQL}, {_MERGED_EVENT} desc, updated_at desc nulls first, id)
                                over (partition by identity_key order by {RANK_SQL}, {_MERGED_EVENT} desc, updated_at desc nulls first, id
                                      rows between unbounded preceding and unbounded following) as is_current
      from (select *, {IDENTITY_SQL} as identity_key from merged))""", extra=_MERGE_CTES | {"merged": _MERGED_SQL}))
def q_project_all(spark, sf):
    """all 60 names, resolved on the merged company table; columns that no source brought are there and empty."""
    merged = flag_current(MG.merge_registry(company_rows(spark, sf), court_rows(spark, sf), "b_id"))
    return S.project(S.with_catalog(merged), ",".join(S.CATALOG))


@query("backfill_join", with_flagged(f"""
select m.id, coalesce(nullif(trim(coalesce(m.krs_number, '')), ''), d.krs_number) as krs_number
from current_rows m left join (select nip, max(krs_number) as krs_number from registry_b
                               where {P('nip')} and {P('krs_number')} group by nip) d on d.nip = m.nip""",
    extra={"registry_b": BINDING_SQL["registry_b"]}))
def q_backfill_join(spark, sf):
    derived = (registry_b(spark, sf).filter(MG.present("nip") & MG.present("krs_number"))
               .groupBy("nip").agg(F.max("krs_number").alias("krs_number")))
    return MG.backfill(current(spark, sf).select("id", "nip", "krs_number"), derived, "nip", ["krs_number"]).select(
        "id", "krs_number")


# ------------------------------------------------------------------ J4 / D1 / D6 on part versions
_PART_COLS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _part_old(spark, sf):
    return read_table(spark, sf, "part").filter(F.col("p_partkey") % 2 == 0)


def _part_full(spark, sf):
    p = read_table(spark, sf, "part")
    return p.withColumn("p_retailprice", F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") + 1)
                        .otherwise(F.col("p_retailprice")))


def _part_new(spark, sf):
    return _part_full(spark, sf).filter(F.col("p_partkey") % 10 != 4)  # those are gone


_OLD_SQL = "select * from part where p_partkey % 2 = 0"
_FULL_SQL = ("select p_partkey, p_name, p_brand, p_type, p_size, "
             "case when p_partkey % 3 = 0 then p_retailprice + 1 else p_retailprice end as p_retailprice from part")
_NEW_SQL = f"{_FULL_SQL} where p_partkey % 10 <> 4"


@query("upsert_overwrite", with_bindings("""
select coalesce(o.p_partkey, b.p_partkey) as p_partkey,
       case when b.p_partkey is not null then b.p_name else o.p_name end as p_name,
       case when o.p_partkey is not null then o.p_brand else b.p_brand end as p_brand,
       case when b.p_partkey is not null then b.p_type else o.p_type end as p_type,
       case when b.p_partkey is not null then b.p_size else o.p_size end as p_size,
       case when b.p_partkey is not null then b.p_retailprice else o.p_retailprice end as p_retailprice
from old o full outer join (select * from new where p_partkey % 3 = 0) b on o.p_partkey = b.p_partkey""",
    extra={"old": _OLD_SQL, "new": _FULL_SQL}))
def q_upsert_overwrite(spark, sf):
    """batch = changed / new parts (key % 3 = 0), deduplicated by key; brand is protected."""
    batch = MG.dedupe_latest(_part_full(spark, sf).filter(F.col("p_partkey") % 3 == 0), "p_partkey", ["p_size"])
    return MG.upsert_overwrite(_part_old(spark, sf), batch.select(*_part_old(spark, sf).columns), "p_partkey",
                               protected=("p_brand",))


@query("hash_diff", with_bindings("""
select change, count(*) as n from (
  select case when o.p_partkey is null then 'insert' when n.p_partkey is null then 'delete'
              when o.p_name = n.p_name and o.p_brand = n.p_brand and o.p_type = n.p_type and o.p_size = n.p_size
                   and o.p_retailprice = n.p_retailprice then 'unchanged' else 'update' end as change
  from old o full outer join new n on o.p_partkey = n.p_partkey) group by change""",
    extra={"old": _OLD_SQL, "new": _NEW_SQL}))
def q_hash_diff(spark, sf):
    d = MG.hash_diff(_part_old(spark, sf), _part_new(spark, sf), "p_partkey", _PART_COLS)
    return d.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_diff", with_bindings("""
select p_partkey, change, changed_columns from (
  select coalesce(n.p_partkey, o.p_partkey) as p_partkey,
         case when o.p_partkey is null then 'added' when n.p_partkey is null then 'removed'
              when o.p_retailprice is distinct from n.p_retailprice or o.p_size is distinct from n.p_size then 'changed'
              else 'same' end as change,
         concat_ws(',', case when o.p_partkey is not null and n.p_partkey is not null and o.p_size is distinct from n.p_size then 'p_size' end,
                   case when o.p_partkey is not null and n.p_partkey is not null and o.p_retailprice is distinct from n.p_retailprice then 'p_retailprice' end,
                   case when o.p_partkey is null or n.p_partkey is null then 'p_size,p_retailprice' end) as changed_columns
  from old o full outer join new n on o.p_partkey = n.p_partkey) where change <> 'same'""",
    extra={"old": _OLD_SQL, "new": _NEW_SQL}))
def q_snapshot_diff(spark, sf):
    return MG.snapshot_diff(_part_old(spark, sf), _part_new(spark, sf), "p_partkey", ["p_size", "p_retailprice"])


# ------------------------------------------------------------------ D2–D5
@query("suppress", with_flagged("""
select id from current_rows
where sha256(nip) is null or sha256(nip) not in (select sha256(lpad(cast(c_custkey as varchar), 10, '0'))
                                                 from customer where c_acctbal < 0)"""))
def q_suppress(spark, sf):
    c = read_table(spark, sf, "customer").filter(F.col("c_acctbal") < 0)
    optout = c.select(F.sha2(F.lpad(F.col("c_custkey").cast("string"), 10, "0"), 256).alias("id_hash"))
    return MG.suppress(current(spark, sf), optout, "nip").select("id")


@query("retention", with_bindings(
    "select request_id from usage_log where ts >= cast(date '2024-12-15' - interval 11 month as timestamp)", "usage_log"))
def q_retention(spark, sf):
    return MG.retain(usage_log(spark, sf), "ts", 11, "2024-12-15").select("request_id")


def _name_key_sql(x: str) -> str:
    return f"lower(regexp_replace({D.fold(x, True)}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def _pairs_sql(a: str, b: str) -> str:
    """Audit pairs of two CTEs (blk, name), stated over all pairs: a block on both sides must be equal, up to 8 edits; else
    up to 2 edits."""
    side = lambda x, t: f"(select distinct nullif(trim(blk), '') as blk, {_name_key_sql('name')} as {t}_key, name as {t}_name from {x} where name is not null) {t}"
    return f"""
select distinct a_name, b_name, levenshtein(a_key, b_key) as distance from {side(a, 'a')} join {side(b, 'b')} on a.blk = b.blk
where levenshtein(a_key, b_key) <= 8
union
select distinct a_name, b_name, levenshtein(a_key, b_key) from {side(a, 'a')}, {side(b, 'b')}
where (a.blk is null or b.blk is null) and a_key <> '' and b_key <> '' and abs(length(a_key) - length(b_key)) <= 2 and levenshtein(a_key, b_key) <= 2"""


@query("name_candidates", with_bindings(_pairs_sql("court_names", "company_names"), "registry_b", "company_history", extra={
    "court_names": "select regexp_extract(name, '([0-9]+)$', 1) as blk, name from registry_b",
    "company_names": "select regexp_extract(name, '([0-9]+)$', 1) as blk, name from company_history"}))
def q_name_candidates(spark, sf):
    blk = F.regexp_extract(F.col("name"), r"([0-9]+)$", 1)  # the registry number embedded in the name
    return MG.name_candidates(registry_b(spark, sf), company_history(spark, sf), "name", "name", blk, blk)


# Names that share their words and differ by a code; misspelt by 0 to 3 edits on one side.
_CODE = "substr(md5(cast(c_custkey as string)), 1, 10)"
_STORED_NAME = f"'Zakład ' || c_mktsegment || ' ' || {_CODE}"
_TYPED_NAME = f"""case c_custkey % 5 when 0 then 'ZAKLAD ' || c_mktsegment || ', ' || {_CODE}
  when 1 then 'Zakład ' || c_mktsegment || ' ' || substr({_CODE}, 2) when 2 then 'Zaklady ' || c_mktsegment || ' ' || {_CODE} || 'q'
  when 3 then 'Zakad ' || c_mktsegment || ' ' || substr({_CODE}, 1, 9) || 'q' else 'Zkd ' || c_mktsegment || ' q' || {_CODE} end"""
_TYPED = f"select case when c_custkey % 3 = 0 then cast(c_nationkey as string) end as blk, {_TYPED_NAME} as name from customer"
_STORED = f"select case when c_custkey % 2 = 0 then cast(c_nationkey as string) when c_custkey % 7 = 0 then ' ' end as blk, {_STORED_NAME} as name from customer"


@query("name_candidates_unblocked", with_bindings(_pairs_sql("typed", "stored"), extra={"typed": _TYPED, "stored": _STORED}))
def q_name_candidates_unblocked(spark, sf):
    """D4 where most rows have no block and all names share their words."""
    c = read_table(spark, sf, "customer")
    blk = F.expr("case when c_custkey % 2 = 0 then cast(c_nationkey as string) when c_custkey % 7 = 0 then ' ' end")
    typed = c.select(F.expr("case when c_custkey % 3 = 0 then cast(c_nationkey as string) end").alias("blk"), F.expr(_TYPED_NAME).alias("name"))
    stored = c.select(blk.alias("blk"), F.expr(_STORED_NAME).alias("name"))
    return MG.name_candidates(typed, stored, "name", "name", F.col("blk"), F.col("blk"))


@query("enrichment_worklist", with_flagged(
    f"select id, nip, regon from current_rows where ({P('nip')} or {P('regon')}) and not {P('krs_number')}"))
def q_enrichment_worklist(spark, sf):
    return MG.enrichment_worklist(current(spark, sf)).select("id", "nip", "regon")


# Court address paths per column, first present wins.
_SEAT = "$.odpis.dane.dzial1.siedzibaIAdres"
COURT_PATHS = {
    "country": (f"{_SEAT}.adres.kraj", f"{_SEAT}.siedziba.kraj"),
    "voivodeship": (f"{_SEAT}.siedziba.wojewodztwo", f"{_SEAT}.adres.wojewodztwo"),
    "county": (f"{_SEAT}.siedziba.powiat", f"{_SEAT}.adres.powiat"),
    "municipality": (f"{_SEAT}.siedziba.gmina", f"{_SEAT}.adres.gmina"),
    "city": (f"{_SEAT}.adres.miejscowosc", f"{_SEAT}.siedziba.miejscowosc", f"{_SEAT}.adres.poczta"),
    "street": (f"{_SEAT}.adres.ulica",), "building": (f"{_SEAT}.adres.nrDomu",), "unit": (f"{_SEAT}.adres.nrLokalu",),
    "postal_code": (f"{_SEAT}.adres.kodPocztowy",),
    "electronic_delivery_address": (f"{_SEAT}.adresDoDoreczenElektronicznychWpisanyDoBAE",),
}


@query("backfill_paths", with_bindings("""
select b_id, case when b_id % 3 = 0 then 'POLSKA' else 'PL' end as country, case when b_id % 2 = 0 then 'mazowieckie' end as voivodeship,
       county, case when b_id % 2 = 1 then 'Gmina ' || cast(b_id as varchar) end as municipality, 'WARSZAWA' as city,
       'ul. Polna' as street, cast(b_id as varchar) as building, case when b_id % 4 = 0 then '7' end as unit, '00-001' as postal_code,
       'AE:PL-' || cast(b_id as varchar) as electronic_delivery_address,
       case when b_id % 3 = 0 then 'Spółka' else 'JEDNOOSOBOWA DZIAŁALNOŚĆ GOSPODARCZA' end as legal_form,
       case when b_id % 5 = 0 then date '2001-01-01' else date '1999-09-09' end as registered_on
from registry_b""", "registry_b"))
def q_backfill_paths(spark, sf):
    """Blank columns of court rows filled from JSON paths of their raw excerpt, legal form and registered-on
    from the row's other columns."""
    k = F.col("b_id")
    b = registry_b(spark, sf)
    seat = F.struct(F.struct(F.when(k % 2 == 0, "mazowieckie").alias("wojewodztwo"), F.col("county").alias("powiat"),
                             F.lit("POLSKA").alias("kraj")).alias("siedziba"),
                    F.struct(F.when(k % 2 == 1, F.concat(F.lit("Gmina "), k.cast("string"))).alias("gmina"),
                             F.lit("WARSZAWA").alias("poczta"), F.lit("ul. Polna").alias("ulica"), k.cast("string").alias("nrDomu"),
                             F.when(k % 4 == 0, 7).alias("nrLokalu"), F.lit("00-001").alias("kodPocztowy")).alias("adres"),
                    F.concat(F.lit("AE:PL-"), k.cast("string")).alias("adresDoDoreczenElektronicznychWpisanyDoBAE"))
    raw = F.to_json(F.struct(F.struct(F.struct(F.struct(seat.alias("siedzibaIAdres")).alias("dzial1")).alias("dane")).alias("odpis")))
    blank = {c: F.lit("") if i % 2 else F.lit(None).cast("string") for i, c in enumerate(COURT_PATHS)}
    blank["country"] = F.when(k % 3 != 0, "PL").otherwise("")
    blank["county"] = F.when(k % 3 == 0, "").otherwise(F.col("county"))
    rows = b.select("b_id", *[e.alias(c) for c, e in blank.items()], raw.alias("raw_krs_payload"),
                    F.when(k % 3 == 1, "").alias("legal_form"), F.when(k % 3 == 0, "Spółka").alias("krs_legal_form"),
                    F.array(F.lit("CEIDG")).alias("registry_sources"), F.when(k % 5 == 0, F.lit("2001-01-01").cast("date")).alias("registered_on"),
                    F.lit("1999-09-09").cast("date").alias("started_on"))
    out = MG.backfill_profile(MG.backfill_paths(rows, "raw_krs_payload", COURT_PATHS))
    return out.select("b_id", *COURT_PATHS, "legal_form", "registered_on")
