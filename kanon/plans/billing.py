"""Billing queries over the usage-log binding: cost, prices, ledger, reconciliation, usage, keys, debit fold, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kanon.operators import aggregates as AG
from kanon.operators import billing as B
from kanon.operators import rates as R
from kanon.plans.catalog import query
from kanon.sources.bindings import usage_log, with_bindings
from kanon.sources.tables import read_table

AS_OF = "2024-01-31 00:00:00"


def requests_with_cost(spark, sf) -> DataFrame:
    """Usage log with the selected API columns of each call and its B1 cost."""
    u = usage_log(spark, sf)
    selected = F.array_compact(F.array(
        F.lit("name"), F.lit("nip"),
        F.when(F.col("has_contact"), F.lit("phone")),
        F.when(F.col("has_raw"), F.lit("rawKrsPayload")),
        F.when(F.col("request_id") % 7 == 0, F.lit("pkdCodes")),
    ))
    return u.withColumn("selected_columns", selected).withColumn(
        "cost", B.query_cost(F.col("selected_columns"), F.col("returned_rows")))


_COST_SQL = ("1 + greatest(1, returned_rows) * (1 + cast(has_contact as int) + cast(request_id % 7 = 0 as int) "
             "+ 10 * cast(has_raw as int))")
_REQ_SQL = f"select *, cast({_COST_SQL} as bigint) as cost from usage_log"


def _req(sql: str, *extra_names) -> str:
    return with_bindings(sql, "usage_log", extra={"req": _REQ_SQL})


@query("query_cost", _req("select request_id, cost from req"))
def q_query_cost(spark, sf):
    return requests_with_cost(spark, sf).select("request_id", "cost")


_PKG_SQL = ("select * from (values ('starter', 'Starter', 50000, 49), ('growth', 'Growth', 250000, 149), "
            "('scale', 'Scale', 1000000, 399), ('enterprise', 'Enterprise', 3000000, 999)) p(code, name, tokens, price)")
_PKG_SQL = f"select code, name, cast(tokens as bigint) as tokens, cast(price as bigint) as price from ({_PKG_SQL})"


def _round_even_sql(num: str, den: str) -> str:
    q, r = f"(({num}) // ({den}))", f"(({num}) % ({den}))"
    return f"({q} + case when 2 * {r} > ({den}) then 1 when 2 * {r} = ({den}) and {q} % 2 = 1 then 1 else 0 end)"


@query("unit_prices", with_bindings(f"""
select u.user_id, p.code, cast({_round_even_sql('p.price * 10000000', 'p.tokens')} as double) / 10000 as price_per_1000,
       cast({_round_even_sql('p.tokens * 100', 'p.price')} as double) / 100 as tokens_per_unit,
       u.usage_tokens,
       cast({_round_even_sql('u.usage_tokens * ' + _round_even_sql('p.price * 10000000', 'p.tokens'), '100000')} as double) / 100
       as usage_value
from (select user_id, sum(cost) as usage_tokens from req group by user_id) u cross join pkg p""",
    "usage_log", extra={"req": _REQ_SQL, "pkg": _PKG_SQL}))
def q_unit_prices(spark, sf):
    """Each user's consumed tokens valued at every package's unit price. The four packages are a
    literal array exploded per user row — no join."""
    usage = requests_with_cost(spark, sf).groupBy("user_id").agg(F.sum("cost").alias("usage_tokens"))
    pkgs = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(t).cast("bigint").alias("tokens"),
                              F.lit(p).cast("bigint").alias("price")) for c, _n, t, p in B.PACKAGES])
    x = usage.select("user_id", "usage_tokens", F.explode(pkgs).alias("p"))
    ppk, tpu = B.unit_price_columns(F.col("p.tokens"), F.col("p.price"))
    value = F.bround(F.col("usage_tokens").cast("decimal(20,0)") * ppk / F.lit(1000), 2)
    return x.select("user_id", F.col("p.code").alias("code"), ppk.cast("double").alias("price_per_1000"),
                    tpu.cast("double").alias("tokens_per_unit"), "usage_tokens", value.cast("double").alias("usage_value"))


def ledger(spark, sf) -> DataFrame:
    """Token ledger: one debit per call (``delta = -cost``) after the sign-up grant."""
    r = requests_with_cost(spark, sf)
    led = r.select("request_id", "user_id", "api_key_id", "ts", (-F.col("cost")).alias("delta"))
    return B.running_balance(led, "user_id", "ts", "request_id", "delta", F.lit(B.GRANT))


_LEDGER_SQL = (f"select request_id, user_id, api_key_id, ts, -cost as delta, {B.GRANT} + sum(-cost) over "
               "(partition by user_id order by ts, request_id rows between unbounded preceding and current row) "
               "as balance_after from req")


@query("running_balance", with_bindings("select request_id, user_id, balance_after from led", "usage_log",
                                        extra={"req": _REQ_SQL, "led": _LEDGER_SQL}))
def q_running_balance(spark, sf):
    return ledger(spark, sf).select("request_id", "user_id", "balance_after")


@query("ledger_reconcile", with_bindings(f"""
select u.user_id, u.balance, l.last_balance, {B.GRANT} + l.delta_sum as expected_balance,
       u.balance = {B.GRANT} + l.delta_sum and l.last_balance = {B.GRANT} + l.delta_sum as consistent
from (select user_id, {B.GRANT} - sum(cost) as balance from req group by user_id) u
join (select user_id, arg_max(balance_after, (ts, request_id)) as last_balance, sum(delta) as delta_sum
      from led group by user_id) l on l.user_id = u.user_id""",
    "usage_log", extra={"req": _REQ_SQL, "led": _LEDGER_SQL}))
def q_ledger_reconcile(spark, sf):
    users = (requests_with_cost(spark, sf).groupBy("user_id")
             .agg((F.lit(B.GRANT) - F.sum("cost")).alias("balance")).withColumn("opening", F.lit(B.GRANT)))
    return B.reconcile(ledger(spark, sf), users, "user_id")


@query("usage_by_day", _req("""
select api_key_id, endpoint, cast(ts as date) as day, count(*) as calls, cast(sum(returned_rows) as bigint) as rows,
       cast(sum(cost) as bigint) as tokens
from req group by 1, 2, 3"""))
def q_usage_by_day(spark, sf):
    r = requests_with_cost(spark, sf)
    return r.groupBy("api_key_id", "endpoint", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("returned_rows").cast("bigint").alias("rows"),
        F.sum("cost").cast("bigint").alias("tokens"))


# ------------------------------------------------------------------ keys / users
def api_keys(spark, sf) -> DataFrame:
    """Keys seen in the log: created at first use; every 7th (user+key) revoked a day later; keys of
    users divisible by 3 expire 20 days after creation."""
    u = usage_log(spark, sf)
    k = u.groupBy("user_id", "api_key_id").agg(F.min("ts").alias("created_at"))
    return k.select(
        "user_id", "api_key_id", "created_at",
        F.concat(F.lit("key-"), F.col("user_id").cast("string"), F.lit("-"), F.col("api_key_id").cast("string"))
        .alias("key_name"),
        F.when((F.col("user_id") + F.col("api_key_id")) % 7 == 0, F.col("created_at") + F.expr("INTERVAL 1 DAYS"))
        .alias("revoked_at"),
        F.when(F.col("user_id") % 3 == 0, F.col("created_at") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"),
    )


def api_users(spark, sf) -> DataFrame:
    u = usage_log(spark, sf).select("user_id").distinct()
    return u.select("user_id", (F.col("user_id") % 5 != 0).alias("confirmed"), (F.col("user_id") % 13 == 0).alias("disabled"))


_KEYS_SQL = """select user_id, api_key_id, min(ts) as created_at, 'key-' || cast(user_id as varchar) || '-' || cast(api_key_id as varchar) as key_name,
       case when (user_id + api_key_id) % 7 = 0 then min(ts) + interval 1 day end as revoked_at,
       case when user_id % 3 = 0 then min(ts) + interval 20 day end as expires_at
from usage_log group by user_id, api_key_id"""
_USERS_SQL = "select distinct user_id, user_id % 5 <> 0 as confirmed, user_id % 13 = 0 as disabled from usage_log"


def active_keys(keys: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Keys that are not revoked / expired as of ``as_of`` and belong to a confirmed, enabled user."""
    t = F.lit(as_of).cast("timestamp_ntz")
    ok_key = (F.col("revoked_at").isNull() | (F.col("revoked_at") > t)) & (F.col("expires_at").isNull() | (F.col("expires_at") > t))
    ok_user = F.col("confirmed") & ~F.col("disabled")
    return keys.filter(ok_key).join(users.filter(ok_user), "user_id")


_ACTIVE_SQL = f"""select k.user_id, k.api_key_id from keys k join users u on u.user_id = k.user_id
where (k.revoked_at is null or k.revoked_at > timestamp '{AS_OF}') and (k.expires_at is null or k.expires_at > timestamp '{AS_OF}')
  and u.confirmed and not u.disabled"""


@query("active_keys", with_bindings(_ACTIVE_SQL, "usage_log", extra={"keys": _KEYS_SQL, "users": _USERS_SQL}))
def q_active_keys(spark, sf):
    return active_keys(api_keys(spark, sf), api_users(spark, sf), AS_OF).select("user_id", "api_key_id")


@query("ledger_enriched", with_bindings("""
select l.request_id, l.delta, l.balance_after, k.key_name, k.revoked_at is not null as key_revoked
from led l left join keys k on k.user_id = l.user_id and k.api_key_id = l.api_key_id""",
    "usage_log", extra={"req": _REQ_SQL, "led": _LEDGER_SQL, "keys": _KEYS_SQL}))
def q_ledger_enriched(spark, sf):
    k = api_keys(spark, sf).select("user_id", "api_key_id", "key_name", F.col("revoked_at").isNotNull().alias("key_revoked"))
    return ledger(spark, sf).join(k, ["user_id", "api_key_id"], "left").select(
        "request_id", "delta", "balance_after", "key_name", "key_revoked")


@query("usage_per_user", with_bindings(f"""
select u.user_id, coalesce(a.active_keys, 0) as active_keys, coalesce(q.query_count, 0) as query_count
from users u
left join (select user_id, count(*) as active_keys from keys
           where (revoked_at is null or revoked_at > timestamp '{AS_OF}') and (expires_at is null or expires_at > timestamp '{AS_OF}')
           group by user_id) a on a.user_id = u.user_id
left join (select user_id, count(*) as query_count from usage_log group by user_id) q on q.user_id = u.user_id
where u.confirmed and not u.disabled""", "usage_log", extra={"keys": _KEYS_SQL, "users": _USERS_SQL}))
def q_usage_per_user(spark, sf):
    """Active keys and query count per confirmed, enabled user (correlated counts as joins)."""
    t = F.lit(AS_OF).cast("timestamp_ntz")
    k = api_keys(spark, sf).filter((F.col("revoked_at").isNull() | (F.col("revoked_at") > t))
                                   & (F.col("expires_at").isNull() | (F.col("expires_at") > t)))
    ak = k.groupBy("user_id").agg(F.count(F.lit(1)).alias("active_keys"))
    qc = usage_log(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("query_count"))
    users = api_users(spark, sf).filter(F.col("confirmed") & ~F.col("disabled")).select("user_id")
    zero = F.lit(0).cast("bigint")
    return (users.join(ak, "user_id", "left").join(qc, "user_id", "left")
            .select("user_id", F.coalesce("active_keys", zero).alias("active_keys"),
                    F.coalesce("query_count", zero).alias("query_count")))


@query("recent_per_user", with_bindings("""
select user_id, request_id, endpoint, rank from (
  select user_id, request_id, endpoint, row_number() over (partition by user_id order by ts desc, request_id desc) as rank
  from usage_log) where rank <= 10""", "usage_log"))
def q_recent_per_user(spark, sf):
    """The 10 most recent calls per user (top-N per group, limited below the shuffle)."""
    u = usage_log(spark, sf)
    return AG.top_n_per_group(u, "user_id", [F.col("ts").desc(), F.col("request_id").desc()], 10).select(
        "user_id", "request_id", "endpoint", "rank")


# ------------------------------------------------------------------ T9
DEBIT_ORACLE = with_bindings(f"""
with recursive r as (select user_id, request_id, cost,
                            row_number() over (partition by user_id order by ts, request_id) as rn from req),
fold(user_id, rn, request_id, bal, accepted) as (
  select user_id, 0, cast(null as bigint), cast({B.GRANT} as bigint), cast(null as boolean) from (select distinct user_id from r)
  union all
  select r.user_id, r.rn, r.request_id, case when f.bal >= r.cost then f.bal - r.cost else f.bal end, f.bal >= r.cost
  from fold f join r on r.user_id = f.user_id and r.rn = f.rn + 1)
select request_id, user_id, accepted, bal as balance_after from fold where rn > 0""",
    "usage_log", extra={"req": _REQ_SQL})


@query("debit_fold", DEBIT_ORACLE)
def q_debit_fold(spark, sf):
    r = requests_with_cost(spark, sf).select("user_id", "ts", "request_id", "cost")
    out = B.debit_fold(r, "user_id", "ts", "request_id", "cost", B.GRANT)
    return out.select("request_id", "user_id", "accepted", "balance_after")


# ------------------------------------------------------------------ W8
SHORT_WINDOW, SHORT_LIMIT = 180, 1
HOUR_WINDOW, HOUR_LIMIT = 3600, 4
MIN_GAP = 120


def _window_count_sql(seconds: int) -> str:
    return (f"(select count(*) from events e2 where e2.event_type = e.event_type "
            f"and e2.ts > e.ts - interval {seconds} second and (e2.ts < e.ts or (e2.ts = e.ts and e2.event_id <= e.event_id)))")


@query("rate_audit", f"""
select event_id, event_type, n_short, n_hour, gap_seconds,
       n_short > {SHORT_LIMIT} or n_hour > {HOUR_LIMIT} or coalesce(gap_seconds < {MIN_GAP}, false) as breach
from (select e.event_id, e.event_type, {_window_count_sql(SHORT_WINDOW)} as n_short, {_window_count_sql(HOUR_WINDOW)} as n_hour,
             (epoch_us(e.ts) - epoch_us(lag(e.ts) over (partition by e.event_type order by e.ts, e.event_id))) / 1000000.0
             as gap_seconds
      from events e)""")
def q_rate_audit(spark, sf):
    """Request counts in the trailing 180 s / 3600 s per source, gap to the previous request,
    and breaches of the (scaled) limits 1 / 180 s, 4 / 3600 s, 120 s minimum gap."""
    e = read_table(spark, sf, "events").select("event_id", "event_type", "ts")
    out = R.rate_audit(e, "event_type", "ts", "event_id", {"n_short": SHORT_WINDOW, "n_hour": HOUR_WINDOW})
    breach = ((F.col("n_short") > SHORT_LIMIT) | (F.col("n_hour") > HOUR_LIMIT)
              | F.coalesce(F.col("gap_seconds") < MIN_GAP, F.lit(False)))
    return out.select("event_id", "event_type", "n_short", "n_hour", "gap_seconds", breach.alias("breach"))
