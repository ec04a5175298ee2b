"""Entity match, golden-record merge, upserts and diffs.

Plan shape for matching (J1/J9): the reference matches with one OR-predicate
(``number = … or nip = … or regon = …``), which Spark would run as a
nested-loop join. Here each side is read once and exploded to its (rule, key)
pairs, the master side is *aggregated per pair* (min / max target id), and one
equi-join on the pair follows: a key held by a third of the master rows costs
one partial-aggregated row in the shuffle and never multiplies the join
output. The (min, max) pair also decides ambiguity exactly: a row is linked to
one master iff every matching key names a single master and all of them name
the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanon.functions.common import blank_null, present
from kanon.functions.text import fold_accents
from kanon.operators.names import HOT, near_pairs, spread
from kanon.sources.sinks import kept

# Match rules in priority order (rule number, key column).
MATCH_KEYS = ((1, "krs_number"), (2, "nip"), (3, "regon"))


def _rule_keys(df: DataFrame, row_id: str, keys) -> DataFrame:
    """(row id, rule, key) for every non-blank key of a row."""
    pairs = [F.when(present(k), F.struct(F.lit(rule).alias("rule"), F.trim(F.col(k)).alias("_k"))) for rule, k in keys]
    return df.select(F.col(row_id), F.explode(F.array_compact(F.array(*pairs))).alias("p")).select(row_id, "p.*")


def match_candidates(incoming: DataFrame, master: DataFrame, in_id: str, master_id: str = "id",
                     keys=MATCH_KEYS) -> DataFrame:
    """All (in_id, rule, min target, max target) per matching key; NULL / blank keys never match."""
    targets = (_rule_keys(master, master_id, keys).groupBy("rule", "_k")
               .agg(F.min(master_id).alias("_min_id"), F.max(master_id).alias("_max_id")))
    return _rule_keys(incoming, in_id, keys).join(targets, ["rule", "_k"]).select(in_id, "rule", "_min_id", "_max_id")


def match_entities(incoming: DataFrame, master: DataFrame, in_id: str, master_id: str = "id",
                   keys=MATCH_KEYS) -> DataFrame:
    """Best single target per incoming row — lowest rule, then lowest master id."""
    cand = match_candidates(incoming, master, in_id, master_id, keys)
    best = F.min(F.struct(F.col("rule"), F.col("_min_id")))
    return cand.groupBy(in_id).agg(best.alias("b")).select(
        in_id, F.col("b._min_id").alias("master_id"), F.col("b.rule").alias("rule"))


def link_status(incoming: DataFrame, master: DataFrame, in_id: str, master_id: str = "id",
                keys=MATCH_KEYS) -> DataFrame:
    """``linked`` / ``unmatched`` / ``ambiguous`` per incoming row (distinct masters 1 / 0 / >1)."""
    cand = match_candidates(incoming, master, in_id, master_id, keys)
    per_in = cand.groupBy(in_id).agg(
        F.min("_min_id").alias("lo"), F.max("_max_id").alias("hi"),
        F.bool_or(F.col("_min_id") != F.col("_max_id")).alias("multi"))
    single = (~F.col("multi")) & (F.col("lo") == F.col("hi"))
    return (incoming.select(in_id).join(per_in, in_id, "left")
            .select(in_id,
                    F.when(F.col("lo").isNull(), "unmatched").when(single, "linked").otherwise("ambiguous")
                    .alias("link_status"),
                    F.when(single, F.col("lo")).alias("master_id")))


def new_ids(feed: DataFrame, master: DataFrame, feed_id: str, master_key: str) -> DataFrame:
    """Feed ids not yet in the master (case-insensitive); feed deduplicated first."""
    f = feed.select(F.col(feed_id)).distinct()
    m = master.select(F.upper(F.col(master_key)).alias("_mk")).distinct()
    return f.join(m, F.upper(f[feed_id]) == m["_mk"], "left_anti")


def existing_ids(feed: DataFrame, master: DataFrame, feed_id: str, master_key: str) -> DataFrame:
    """J2 twin: feed ids already present in the master."""
    f = feed.select(F.col(feed_id)).distinct()
    m = master.select(F.upper(F.col(master_key)).alias("_mk")).distinct()
    return f.join(m, F.upper(f[feed_id]) == m["_mk"], "left_semi")


def dedupe_latest(batch: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Keep the last row per key by ``order_cols`` (``max_by`` with map-side partial aggregation)."""
    cols = [c for c in batch.columns if c != key]
    return (batch.groupBy(key)
            .agg(F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in order_cols])).alias("r"))
            .select(key, "r.*"))


def upsert_overwrite(master: DataFrame, batch: DataFrame, key: str, protected: tuple[str, ...] = (),
                     unions: tuple[str, ...] = (), newest: str | None = None) -> DataFrame:
    """Keyed upsert, last write wins: every non-protected column is replaced by the batch value
    (even NULL) when the key is in the batch; ``protected`` columns keep the master value and the arrays of
    ``unions`` grow. With ``newest`` a batch row older by that column than its master row changes nothing."""
    m = master.select(*[F.col(c).alias(f"m_{c}") for c in master.columns])
    b = batch.select(*[F.col(c).alias(f"b_{c}") for c in batch.columns])
    j = m.join(b, m[f"m_{key}"] == b[f"b_{key}"], "full_outer")
    in_batch = F.col(f"b_{key}").isNotNull()
    in_master = F.col(f"m_{key}").isNotNull()
    if newest:
        in_batch = in_batch & ~F.coalesce(F.col(f"b_{newest}") < F.col(f"m_{newest}"), F.lit(False))
    out = [F.coalesce(F.col(f"m_{key}"), F.col(f"b_{key}")).alias(key)]
    for c in master.columns:
        if c == key:
            continue
        if c in unions:
            both = F.array_union(F.coalesce(F.col(f"m_{c}"), F.array()), F.coalesce(F.col(f"b_{c}"), F.array()))
            out.append(F.when(F.col(f"b_{key}").isNull(), F.col(f"m_{c}")).otherwise(F.array_sort(both)).alias(c))
        elif c in protected:
            out.append(F.when(in_master, F.col(f"m_{c}")).otherwise(F.col(f"b_{c}")).alias(c))
        else:
            out.append(F.when(in_batch, F.col(f"b_{c}")).otherwise(F.col(f"m_{c}")).alias(c))
    return j.select(*out)


# ------------------------------------------------------------------ J5 survivorship
# Survivorship policy per column kind.
OVERWRITE, KEEP_EXISTING, PREFER_INCOMING, UNION = "overwrite", "keep_existing", "prefer_incoming", "union"


def fold_incoming(incoming: DataFrame, group: str, seq: str, policy: dict[str, str]) -> DataFrame:
    """Fold several incoming rows for one target first: overwrite = last, prefer-incoming = last
    non-blank, keep-existing = first non-blank, union = distinct union (all by ``seq``)."""
    aggs = []
    ordered = F.struct(F.col(seq).alias("s"))
    for c, kind in policy.items():
        if kind == OVERWRITE:
            aggs.append(F.max_by(F.col(c), ordered).alias(c))
        elif kind == PREFER_INCOMING:
            aggs.append(F.max_by(F.col(c), F.when(_filled(incoming, c), ordered)).alias(c))
        elif kind == KEEP_EXISTING:
            aggs.append(F.min_by(F.col(c), F.when(_filled(incoming, c), ordered)).alias(c))
        elif kind == UNION:
            aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col(c))))).alias(c))
    return incoming.groupBy(group).agg(*aggs)


def _survivor(kind: str, mc: Column, ic: Column, text: bool) -> Column:
    """Value of a column of a row that both sides have."""
    if kind == OVERWRITE:
        return ic
    if kind == KEEP_EXISTING:
        return F.when(present(mc), mc).otherwise(ic) if text else F.coalesce(mc, ic)
    if kind == PREFER_INCOMING:
        return F.when(present(ic), ic).otherwise(F.nullif(mc, F.lit(""))) if text else F.coalesce(ic, mc)
    return F.array_sort(F.array_union(F.coalesce(mc, F.array()), F.coalesce(ic, F.array())))


def merge_survivorship(master: DataFrame, incoming: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """Per-column survivorship of one folded incoming row onto its master row (joined on ``key``)."""
    j = master.alias("m").join(incoming.alias("i"), F.col(f"m.{key}") == F.col(f"i.{key}"), "inner")
    return j.select(*[_survivor(policy[c], F.col(f"m.{c}"), F.col(f"i.{c}"), _is_str(master, c)).alias(c) if c in policy and c != key else F.col(f"m.{c}").alias(c)
                      for c in master.columns])


# What a court row does to each column of the company row that it matches.
COURT_POLICY = (
    dict.fromkeys(("krs_number", "krs_register_type", "krs_court_name", "krs_last_entry_date", "krs_representatives",
                   "raw_krs_payload", "krs_updated_at"), OVERWRITE)
    | dict.fromkeys(("source_detail_url", "last_detail_source_hash", "nip", "regon", "name", "status"), KEEP_EXISTING)
    | dict.fromkeys(("legal_form", "registered_on", "electronic_delivery_address", "country", "voivodeship", "county",
                     "municipality", "city", "street", "building", "unit", "postal_code", "main_pkd_code", "pkd_codes"),
                    PREFER_INCOMING)
    | {"registry_sources": UNION}
)


def minted_id(in_id: str, number: str = "krs_number") -> Column:
    """Deterministic id of a court row without a company row: the hash of its court number (else of its own id)."""
    own = F.when(present(number), F.concat(F.lit("krs:"), F.trim(F.col(number)))).otherwise(
        F.concat(F.lit("row:"), F.col(in_id).cast("string")))
    return F.sha2(own, 256)


def merge_registry(master: DataFrame, incoming: DataFrame, in_id: str, policy: dict[str, str] = COURT_POLICY,
                   master_id: str = "id", matched: DataFrame | None = None) -> DataFrame:
    """J5 ∪ J6: the whole company table after a court batch. Matched rows are merged by ``policy``, the others of
    the master stay, and court rows without a match become rows of their own (one per court number) with a
    minted id. ``master_id`` is a string. ``matched`` (in_id, master_id) takes the place of the match by keys."""
    if matched is None:
        matched = match_entities(incoming, master, in_id, master_id).select(in_id, F.col("master_id").alias(master_id))
    # every court row is aimed at a row, stored or new, and folded with those aimed at the same one; then the master is
    # read by one join, which merges, keeps and adds
    link = matched.select(F.col(in_id).alias("_in"), F.col(master_id).alias("_to"))
    aimed = incoming.join(link, F.col(in_id) == F.col("_in"), "left").withColumn(master_id, F.coalesce("_to", minted_id(in_id)))
    folded = fold_incoming(aimed, master_id, in_id, policy)
    j = master.alias("m").join(folded.alias("i"), F.col(f"m.{master_id}") == F.col(f"i.{master_id}"), "full_outer")
    stored, met = F.col(f"m.{master_id}"), F.col(f"i.{master_id}").isNotNull()
    out = [F.coalesce(stored, F.col(f"i.{master_id}")).alias(master_id) if c == master_id
           else F.when(met, _survivor(policy[c], F.col(f"m.{c}"), F.col(f"i.{c}"), _is_str(master, c))).otherwise(F.col(f"m.{c}")).alias(c) if c in policy
           else F.col(f"m.{c}").alias(c) for c in master.columns]
    return j.select(*out)


def _filled(df: DataFrame, c: str) -> Column:
    return blank_null(c).isNotNull() if _is_str(df, c) else F.col(c).isNotNull()


def _is_str(df: DataFrame, c: str) -> bool:
    return dict(df.dtypes)[c] == "string"


def backfill(master: DataFrame, derived: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Fill blank master columns from a derived table (one row per key) — left join + coalesce."""
    d = derived.select(F.col(key).alias("_dk"), *[F.col(c).alias(f"_d_{c}") for c in cols])
    # rows without a key find nothing: they stay out of the shuffle, where they would share one partition
    keyed, rest = master.filter(F.col(key).isNotNull()), master.filter(F.col(key).isNull())
    j = keyed.join(d, keyed[key] == d["_dk"], "left")
    fill = lambda df, other: df.select(*[F.coalesce(blank_null(c), other(c)).alias(c) if c in cols else F.col(c)
                                         for c in master.columns])
    return fill(j, lambda c: F.col(f"_d_{c}")).unionByName(fill(rest, lambda c: F.lit(None).cast("string")))


def backfill_paths(master: DataFrame, json_col: str, targets: dict[str, tuple[str, ...]]) -> DataFrame:
    """``coalesce(nullif(col, ''), json path 1, json path 2, …)`` projection."""
    out = master
    for c, paths in targets.items():
        out = out.withColumn(c, F.coalesce(blank_null(c), *[F.get_json_object(F.col(json_col), p) for p in paths]))
    return out


SOLE_TRADER = "JEDNOOSOBOWA DZIAŁALNOŚĆ GOSPODARCZA"


def backfill_profile(df: DataFrame) -> DataFrame:
    """Blank legal form from the court's, else the sole-trader form for trader rows; registered-on from
    started-on."""
    trader = F.when(F.array_contains("registry_sources", "CEIDG"), F.lit(SOLE_TRADER))
    court = blank_null("krs_legal_form") if "krs_legal_form" in df.columns else F.lit(None).cast("string")
    return (df.withColumn("legal_form", F.coalesce(F.nullif(F.col("legal_form"), F.lit("")), court, trader))
              .withColumn("registered_on", F.coalesce("registered_on", "started_on")))


# ------------------------------------------------------------------ D1 / D6 diffs
def row_hash(cols: list[str]) -> Column:
    """Stable content hash of the listed columns (NULL-aware, order-sensitive)."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}), 256)


def hash_diff(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Per key ``insert`` / ``update`` / ``unchanged`` / ``delete`` by payload hash."""
    o = old.select(F.col(key).alias("_ok"), row_hash(cols).alias("_oh"))
    n = new.select(F.col(key).alias("_nk"), row_hash(cols).alias("_nh"))
    j = o.join(n, o["_ok"] == n["_nk"], "full_outer")
    change = (F.when(F.col("_ok").isNull(), "insert").when(F.col("_nk").isNull(), "delete")
              .when(F.col("_oh") == F.col("_nh"), "unchanged").otherwise("update"))
    return j.select(F.coalesce("_nk", "_ok").alias(key), change.alias("change"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Version-to-version diff: change kind and the list of changed columns per key."""
    o = old.select(F.col(key).alias("_ok"), *[F.col(c).alias(f"o_{c}") for c in cols])
    n = new.select(F.col(key).alias("_nk"), *[F.col(c).alias(f"n_{c}") for c in cols])
    j = o.join(n, o["_ok"] == n["_nk"], "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.lit(c)) for c in cols]),
                       lambda x: x.isNotNull())
    kind = (F.when(F.col("_ok").isNull(), "added").when(F.col("_nk").isNull(), "removed")
            .when(F.size(changed) > 0, "changed").otherwise("same"))
    return j.select(F.coalesce("_nk", "_ok").alias(key), kind.alias("change"),
                    F.array_join(changed, ",").alias("changed_columns")).filter(F.col("change") != "same")


# ------------------------------------------------------------------ D2 / D3 / D4 / D5
def suppress(df: DataFrame, optout: DataFrame, id_col: str, hash_col: str = "id_hash") -> DataFrame:
    """Drop rows whose hashed identifier is on the opt-out list (left anti join on the hash)."""
    h = df.withColumn("_h", F.sha2(F.col(id_col), 256))
    return h.join(optout.select(F.col(hash_col).alias("_h")).distinct(), "_h", "left_anti").drop("_h")


def retain(df: DataFrame, ts_col: str, months: int, as_of: str) -> DataFrame:
    """D3: keep rows newer than ``as_of - months`` (a partition filter when the log is date-partitioned)."""
    cutoff = F.add_months(F.lit(as_of).cast("date"), -months)
    return df.filter(F.col(ts_col) >= cutoff.cast("timestamp_ntz"))


def name_key(c) -> Column:
    """Folded, lower-cased, punctuation-free name used for candidate search."""
    return F.lower(F.regexp_replace(fold_accents(c, True), r"[^\p{L}\p{N}]+", ""))


def name_candidates(a: DataFrame, b: DataFrame, a_name: str, b_name: str, block_a: Column, block_b: Column,
                    max_distance: int = 8, loose_distance: int = 2) -> DataFrame:
    """Audit-only name pairs by the edit distance of the folded names; each pair once.

    Two rows with a blocking key (the caller's choice: an identifier fragment, a postal code; it must be selective) are
    a pair if the keys are equal and the distance is at most ``max_distance``. If one of them has none, the whole other
    side is searched, up to ``loose_distance``, by :func:`kanon.operators.names.near_pairs`. All rows with a letter or
    digit take part there; both sides are first reduced to distinct (block, name), so a name repeated on many rows costs one row."""
    def prep(df, name, blk, tag):
        return df.select(blank_null(blk).alias("_blk"), name_key(F.col(name)).alias(f"{tag}_key"),
                         F.col(name).alias(f"{tag}_name")).filter(F.col(f"{tag}_key").isNotNull()).distinct()

    def names(df, tag):
        return df.select(f"{tag}_key", f"{tag}_name").distinct()

    # written once: each search plans with stored names, not with all that the names are made of
    pa, pb = kept(prep(a, a_name, block_a, "a"), "names"), kept(prep(b, b_name, block_b, "b"), "names")
    blank_a, blank_b = pa.filter("_blk is null and a_key <> ''"), pb.filter("_blk is null and b_key <> ''")
    pa_named, pb_named = pa.filter("a_key <> ''"), pb.filter("b_key <> ''")
    d = F.levenshtein("a_key", "b_key", max_distance)
    # a block with many names is dealt over salts, and the pairs over tasks: compared, not read, they are the work
    salts = pb.groupBy("_blk").count().select("_blk", F.ceil(F.col("count") / HOT).cast("int").alias("_salts"))
    blocked_a = pa.join(salts, "_blk").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).repartition(spread(a), "_blk", "_salt")
    blocked_b = pb.join(salts, "_blk").withColumn("_salt", F.pmod(F.xxhash64("b_name"), F.col("_salts")).cast("int")).repartition(spread(a), "_blk", "_salt")
    found = [blocked_a.join(blocked_b, ["_blk", "_salt"]).select("a_name", "b_name", d.alias("distance")).filter("distance >= 0")]
    for left, right in ((blank_a, pb_named), (pa_named.filter("_blk is not null"), blank_b)):
        near = near_pairs(left, right, "a_key", "b_key", min(loose_distance, max_distance))
        found.append(near.join(names(left, "a"), "a_key").join(names(right, "b"), "b_key").select("a_name", "b_name", "distance"))
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def enrichment_worklist(df: DataFrame) -> DataFrame:
    """Rows with a tax or statistical number but no court number."""
    return df.filter((present("nip") | present("regon")) & ~present("krs_number"))
