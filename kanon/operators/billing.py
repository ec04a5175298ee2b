"""Token billing: query cost (B1), package prices (B3), ledger balance (W7), reconciliation (B4),
usage roll-ups (B5, A14), key / user joins (J11) and the conditional debit fold (T9).

T9 is order dependent (a request is debited only if the balance covers it), so it
is not a plain cumulative sum. Exact and skew-safe plan:

1. running cost and rank per user (multi-level prefix sums, no per-user task);
2. every request whose running cost stays within the grant is accepted — exact,
   since no earlier request can have been rejected;
3. after a user's first shortfall the balance is below one request's cost, i.e.
   below that request's cost. From there on the requests (the "tail") are cut into chunks of at most ``CHUNK_ROWS``
   requests of a user, by rank; each chunk computes, vectorised, its transition table ``start balance → end
   balance`` over ``0..shortfall balance`` (< one request's cost; a request that costs more than that balance is
   rejected whatever came before and leaves the table as it is); the tables (one per chunk) are
   composed in chunk order to give every chunk its exact start balance; a last
   pass replays each chunk from that balance. Chunks are bounded by rows, however
   dense a user's requests are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from kanon.operators.aggregates import running_sum, running_sums
from kanon.session import ensure_checkpoint_dir

# Pricing constants.
CHUNK_ROWS = 4096
GRANT = 5000                      # tokens granted on sign-up
ANALYTICS_COST = 25               # flat cost of an analytics call
CONTACT_COLUMNS = ("phone", "phoneMobile", "phoneLandline", "phonesJson", "email", "website",
                   "electronicDeliveryAddress", "otherContactForm")
RAW_COLUMNS = ("rawIndexPayload", "rawDetailPayload", "rawKrsPayload")
CODES_COLUMN = "pkdCodes"
# code, name, tokens, price
PACKAGES = (("starter", "Starter", 50_000, 49), ("growth", "Growth", 250_000, 149),
            ("scale", "Scale", 1_000_000, 399), ("enterprise", "Enterprise", 3_000_000, 999))


def query_cost(selected: Column, returned_rows: Column) -> Column:
    """B1: ``1 + max(1, rows) * (1 + contact + codes + 10 * raw)`` from the selected column names."""
    sel = F.transform(selected, lambda s: F.lower(s))
    lower = lambda names: F.array(*[F.lit(n.lower()) for n in names])
    contact = F.arrays_overlap(sel, lower(CONTACT_COLUMNS)).cast("int")
    codes = F.array_contains(sel, CODES_COLUMN.lower()).cast("int")
    raw = F.arrays_overlap(sel, lower(RAW_COLUMNS)).cast("int")
    return (F.lit(1) + F.greatest(F.lit(1), returned_rows) * (F.lit(1) + contact + codes + F.lit(10) * raw)).cast("bigint")


def unit_price_columns(tokens: Column, price: Column) -> tuple[Column, Column]:
    """(price per 1000 tokens at 4 dp, tokens per currency unit at 2 dp), half-even, exact decimals."""
    t, p = tokens.cast("decimal(20,0)"), price.cast("decimal(20,4)")
    return F.bround(p * F.lit(1000) / t, 4), F.bround(t / p, 2)


def unit_prices(packages: DataFrame) -> DataFrame:
    """B3 over a package table (code, name, tokens, price)."""
    ppk, tpu = unit_price_columns(F.col("tokens"), F.col("price"))
    return packages.select("code", "name", "tokens", "price", ppk.alias("price_per_1000"), tpu.alias("tokens_per_unit"))


def running_balance(ledger: DataFrame, user: str, ts: str, tie: str, delta: str, opening: Column) -> DataFrame:
    """``balance_after = opening + running sum(delta)`` per user in (ts, id) order."""
    r = running_sum(ledger, user, ts, tie, F.col(delta), "_cum")
    return r.withColumn("balance_after", opening + F.col("_cum")).drop("_cum")


def reconcile(ledger: DataFrame, users: DataFrame, user: str) -> DataFrame:
    """Last ``balance_after`` = opening + sum of deltas = the user's stored balance."""
    last = F.max_by(F.col("balance_after"), F.struct("ts", "request_id"))
    per = ledger.groupBy(user).agg(last.alias("last_balance"), F.sum("delta").alias("delta_sum"))
    j = users.join(per, user, "left")
    expected = F.col("opening") + F.coalesce(F.col("delta_sum"), F.lit(0))
    return j.select(user, "balance", "last_balance", expected.alias("expected_balance"),
                    ((F.col("balance") == expected) & (F.coalesce(F.col("last_balance"), F.col("opening")) == expected))
                    .alias("consistent"))


# ------------------------------------------------------------------ T9 conditional debit
def debit_fold(requests: DataFrame, user: str, ts: str, tie: str, cost: str, grant: int = GRANT,
               chunk_rows: int = CHUNK_ROWS, opening: DataFrame | None = None) -> DataFrame:
    """Per request ``accepted`` and ``balance_after`` under "debit only if balance >= cost". Users start with
    ``grant``, or with their ``balance`` in ``opening`` (one row per user) if they have one there."""
    # the running cost feeds four branches below: cut the lineage once (reliable checkpoint in the
    # shared spark.checkpoint.dir, so a lost executor re-reads files instead of recomputing)
    ensure_checkpoint_dir(requests.sparkSession)
    rs = running_sums(requests.select(user, ts, tie, cost), user, ts, tie,
                      {"_cum": F.col(cost), "_rank": F.lit(1)})
    start = F.lit(grant).cast("long")
    if opening is not None:
        own = opening.select(F.col(user).alias("_user"), F.col("balance").cast("long").alias("_open"))
        rs = rs.join(own, F.col(user) == F.col("_user"), "left").drop("_user")
        start = F.coalesce("_open", start)
    rs = rs.select(user, ts, tie, cost, "_cum", "_rank", start.alias("_open")).checkpoint(eager=True)
    head_ok = F.col("_cum") <= F.col("_open")
    head = rs.filter(head_ok).select(user, ts, tie, cost, F.lit(True).alias("accepted"),
                                     (F.col("_open") - F.col("_cum")).alias("balance_after"))
    # first shortfall per user: the balance before it, opening - (cum - cost), is below that cost
    first = (rs.filter(~head_ok).groupBy(user)
             .agg(F.min(F.struct(F.col(ts), F.col(tie), (F.col("_open") - F.col("_cum") + F.col(cost)).alias("b")))
                  .alias("f"))
             .select(user, F.col("f.b").alias("_b0")))
    cand = rs.filter(~head_ok).join(first, user).withColumn(
        "_bkt", F.floor((F.col("_rank") - 1) / F.lit(chunk_rows)).cast("bigint"))

    nparts = requests.sparkSession.conf.get("spark.sql.shuffle.partitions")
    nparts = int(nparts) if nparts and nparts.isdigit() else 200

    # The three passes below stream over partitions sorted by (user, bucket, ts, id): state for the
    # current chunk is carried across Arrow batches, so memory stays one batch and no per-group
    # pandas objects are built.
    def tables(it):
        cur, table = None, None
        for pdf in it:
            us, bs, ss, ts_ = [], [], [], []
            u, k = pdf[user].to_numpy(), pdf["_bkt"].to_numpy()
            c, b0 = pdf[cost].to_numpy(np.int64), pdf["_b0"].to_numpy(np.int64)
            for i in range(len(pdf)):
                key = (u[i], k[i])
                if key != cur:
                    if cur is not None:
                        us.append(cur[0]); bs.append(cur[1]); ts_.append(table)
                    # after the shortfall the balance never exceeds _b0, so states 0.._b0 suffice
                    cur, table = key, np.arange(int(b0[i]) + 1, dtype=np.int64)
                ci = c[i]
                if ci <= b0[i]:
                    table = np.where(table >= ci, table - ci, table)
            if us:  # an empty frame would carry float columns Arrow cannot turn into list<long>
                yield pd.DataFrame({user: us, "_bkt": bs, "_t": ts_})
        if cur is not None:
            yield pd.DataFrame({user: [cur[0]], "_bkt": [cur[1]], "_t": [table]})

    tschema = f"{user} long, _bkt long, _t array<long>"
    tab = (cand.select(user, "_bkt", ts, tie, cost, "_b0")
           .repartition(nparts, user, "_bkt").sortWithinPartitions(user, "_bkt", ts, tie)
           .mapInPandas(tables, tschema))

    def compose(it):
        cur, b = None, None
        for pdf in it:
            u, k, b0, tabs = pdf[user].to_numpy(), pdf["_bkt"].to_numpy(), pdf["_b0"].to_numpy(), pdf["_t"]
            starts = np.empty(len(pdf), dtype=np.int64)
            for i in range(len(pdf)):
                if u[i] != cur:
                    cur, b = u[i], int(b0[i])
                starts[i] = b
                b = int(tabs.iat[i][b])
            if len(pdf):
                yield pd.DataFrame({user: u, "_bkt": k, "_start": starts})

    # one row per (user, bucket), each a table of shortfall balance + 1 longs (< one request cost)
    starts = (tab.join(first, user).repartition(nparts, user).sortWithinPartitions(user, "_bkt")
              .mapInPandas(compose, f"{user} long, _bkt long, _start long"))

    out_schema = StructType(requests.select(user, ts, tie, cost).schema.fields
                            + [StructField("accepted", BooleanType()), StructField("balance_after", LongType())])

    def replay(it):
        cur, b = None, None
        for pdf in it:
            u, k = pdf[user].to_numpy(), pdf["_bkt"].to_numpy()
            c, st = pdf[cost].to_numpy(np.int64), pdf["_start"].to_numpy(np.int64)
            acc = np.empty(len(pdf), dtype=bool)
            after = np.empty(len(pdf), dtype=np.int64)
            for i in range(len(pdf)):
                key = (u[i], k[i])
                if key != cur:
                    cur, b = key, int(st[i])
                ok = b >= c[i]
                if ok:
                    b -= int(c[i])
                acc[i], after[i] = ok, b
            if len(pdf):
                yield pdf[[user, ts, tie, cost]].assign(accepted=acc, balance_after=after)

    replayed = (cand.join(starts, [user, "_bkt"]).select(user, ts, tie, cost, "_bkt", "_start")
                .repartition(nparts, user, "_bkt").sortWithinPartitions(user, "_bkt", ts, tie)
                .mapInPandas(replay, out_schema))
    return head.unionByName(replayed)
