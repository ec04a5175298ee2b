"""Invariants: one current row per identity, idempotent upserts, order independence, exact folds."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from kanon.operators import aggregates as AG
from kanon.operators import billing as B
from kanon.operators import merge as MG
from kanon.operators.names import near_pairs
from kanon.operators import rates as R
from kanon.operators.identity import flag_current, flag_current_window
from kanon.sources.bindings import company_history


def test_one_current_row_per_identity(spark):
    f = flag_current(company_history(spark, SF_SMALL))
    per = f.groupBy("identity_key").agg(F.sum(F.col("is_current").cast("int")).alias("n"))
    assert per.filter("n <> 1").count() == 0
    w = flag_current_window(company_history(spark, SF_SMALL))
    a = {r["id"]: r["is_current"] for r in f.select("id", "is_current").collect()}
    b = {r["id"]: r["is_current"] for r in w.select("id", "is_current").collect()}
    assert a == b


def test_rank_and_null_updated_quirks(spark):
    df = spark.createDataFrame(
        [(1, "n1", "WYKREŚLONY", dt.datetime(2024, 1, 2)), (2, "n1", "WYKRESLONY", dt.datetime(2024, 1, 1)),
         (3, "n2", "AKTYWNY", dt.datetime(2024, 1, 5)), (4, "n2", "AKTYWNY", None)],
        "id long, nip string, status string, updated_at timestamp_ntz")
    df = df.withColumn("krs_number", F.lit(None).cast("string")).withColumn("regon", F.lit(None).cast("string")) \
           .withColumn("ceidg_id", F.lit(None).cast("string")).withColumn("started_on", F.lit(dt.date(2023, 1, 1)))
    got = {r["id"]: (r["current_rank"], r["is_current"]) for r in flag_current(df).collect()}
    assert got[1] == (4, False) and got[2] == (3, True)      # accented spelling ranks 4 (kept literal)
    assert got[4][1] is True  # same event date: NULL updated_at sorts first, like DESC NULLS FIRST


def test_match_priority_and_link_status(spark):
    master = spark.createDataFrame(
        [(10, "0000000001", "111", "r1"), (11, None, "222", "r2"), (12, None, "222", None), (13, " ", "333", "r3")],
        "id long, krs_number string, nip string, regon string")
    inc = spark.createDataFrame(
        [(1, "0000000001", "222", None), (2, None, "222", None), (3, None, None, "r3"), (4, "", "", ""), (5, None, "333", "r1")],
        "b_id long, krs_number string, nip string, regon string")
    m = {r["b_id"]: (r["master_id"], r["rule"]) for r in MG.match_entities(inc, master, "b_id").collect()}
    assert m == {1: (10, 1), 2: (11, 2), 3: (13, 3), 5: (13, 2)}
    s = {r["b_id"]: r["link_status"] for r in MG.link_status(inc, master, "b_id").collect()}
    assert s == {1: "ambiguous", 2: "ambiguous", 3: "linked", 4: "unmatched", 5: "ambiguous"}


def test_upsert_is_idempotent_and_order_independent(spark):
    master = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, keep string")
    batch = spark.createDataFrame([(2, "B", None, 1), (2, "BB", "z", 2), (3, "c", "w", 1)],
                                  "k long, v string, keep string, seq int")
    dedup = MG.dedupe_latest(batch, "k", ["seq"]).drop("seq")
    once = MG.upsert_overwrite(master, dedup, "k", protected=("keep",))
    twice = MG.upsert_overwrite(once, dedup, "k", protected=("keep",))
    assert sorted(rows(once)) == sorted(rows(twice)) == [(1, "a", "x"), (2, "BB", "y"), (3, "c", "w")]
    shuffled = MG.dedupe_latest(batch.repartition(3).orderBy(F.rand(7)), "k", ["seq"]).drop("seq")
    assert sorted(rows(MG.upsert_overwrite(master, shuffled, "k", ("keep",)))) == sorted(rows(once))


def test_survivorship_policy(spark):
    master = spark.createDataFrame([(1, "K0", "", "Old", "Powiat A", ["CEIDG"])],
                                   "id long, krs_number string, nip string, name string, county string, registry_sources array<string>")
    inc = spark.createDataFrame([(1, 5, "K1", "999", "New", "", ["KRS"]), (1, 6, None, "888", None, "Powiat B", ["KRS"])],
                                "id long, seq long, krs_number string, nip string, name string, county string, registry_sources array<string>")
    policy = {"krs_number": MG.OVERWRITE, "nip": MG.KEEP_EXISTING, "name": MG.KEEP_EXISTING,
              "county": MG.PREFER_INCOMING, "registry_sources": MG.UNION}
    folded = MG.fold_incoming(inc, "id", "seq", policy)
    r = MG.merge_survivorship(master, folded, "id", policy).first()
    assert r["krs_number"] is None                 # overwrite = last incoming, even NULL
    assert r["nip"] == "999" and r["name"] == "Old"  # keep existing when non-blank, else first incoming
    assert r["county"] == "Powiat B"               # prefer last non-blank incoming
    assert r["registry_sources"] == ["CEIDG", "KRS"]


def test_running_sum_matches_window(spark):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    a = AG.running_sum(e, "user_id", "ts", "event_id", F.col("value"), "cum")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    b = e.withColumn("cum2", F.sum("value").over(w))
    j = a.join(b.select("event_id", "cum2"), "event_id")
    assert j.filter(F.abs(F.col("cum") - F.col("cum2")) > 1e-6).count() == 0


def _brute_debit(reqs, grant):
    out, bal = {}, {}
    for u, ts, rid, c in sorted(reqs, key=lambda r: (r[0], r[1], r[2])):
        b = bal.get(u, grant)
        ok = b >= c
        if ok:
            b -= c
        bal[u] = b
        out[rid] = (ok, b)
    return out


def test_debit_fold_matches_sequential(spark):
    random.seed(3)
    data = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=random.randint(0, 60 * 24 * 5)), i, random.randint(2, 900))
            for i, u in enumerate(random.choices([1, 2, 3], weights=[8, 1, 1], k=400))]
    df = spark.createDataFrame(data, "user_id long, ts timestamp_ntz, request_id long, cost long")
    got = {r["request_id"]: (r["accepted"], r["balance_after"])
           for r in B.debit_fold(df, "user_id", "ts", "request_id", "cost", 5000).collect()}
    assert got == _brute_debit(data, 5000)


def test_rate_audit_matches_brute_force(spark):
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "event_type", "ts")
    got = {r["event_id"]: (r["n5"], r["n60"]) for r in
           R.rate_audit(e, "event_type", "ts", "event_id", {"n5": 3000, "n60": 36000}).collect()}
    ev = [(r["event_id"], r["event_type"], r["ts"]) for r in e.collect()]
    for eid, typ, ts in ev[:150]:
        same = [(t, i) for i, ty, t in ev if ty == typ and (t, i) <= (ts, eid)]
        n5 = sum(1 for t, _ in same if (ts - t).total_seconds() < 3000)
        n60 = sum(1 for t, _ in same if (ts - t).total_seconds() < 36000)
        assert got[eid] == (n5, n60)


def test_names_without_a_block_have_candidates(spark):
    a = ["Zakład Krawiecki Nowak", "Piekarnia Złoty Kłos", "Kowalski", "Firma 12", "!!", None] + [f"Sklep {c}{d}lwia" for c in "abcdefghijklmnop" for d in "abcdefghijklmnop"]
    b = ["ZAKLAD KRAWIECKI NOWAK", "Piekarnia Zloty Klos 7", "Kowalsky", "Firma 12", "Firma 13", "Firma", "??", None]
    df = lambda names: spark.createDataFrame([(n,) for n in names * 2], "name string")
    blk = F.regexp_extract("name", "([0-9]+)$", 1)
    got = rows(MG.name_candidates(df(a), df(b), "name", "name", blk, blk))
    near = {(x, y): d for x, y, d in got}
    assert len(got) == len(near)
    assert near == {("Zakład Krawiecki Nowak", "ZAKLAD KRAWIECKI NOWAK"): 0, ("Piekarnia Złoty Kłos", "Piekarnia Zloty Klos 7"): 1,
                    ("Kowalski", "Kowalsky"): 1, ("Firma 12", "Firma 12"): 0, ("Firma 12", "Firma"): 2}
    common = [f"Sklep {c}" for c in "abcdefghijklmnop"]
    got = rows(MG.name_candidates(df(common), df(common), "name", "name", blk, blk))
    assert sorted(got) == sorted((x, y, int(x != y)) for x in common for y in common)


def _names(rng, n):
    words = ["zakład", "usługowy", "przedsiębiorstwo", "handlowo", "produkcyjne", "transport", "nowak", "kowalski", "sp z oo", "x"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 5))) + rng.choice(["", " a", " ab", " 7", " krawiec", " krawcowa"]) for _ in range(n)]


def _typed(rng, s):
    for _ in range(rng.randrange(0, 4)):
        i, c = rng.randrange(len(s) + 1), rng.choice("abxz")
        s = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1:], s[:i] + c + s[i + 1:]])
    return s


def test_near_names_are_all_pairs(spark):
    """Recall 1.0 and nothing else against all pairs, whatever is hot: names share words, and segments are refined and
    salted from two names on."""
    import duckdb

    rng = random.Random(8)
    a = sorted(set(_names(rng, 2500)))
    b = sorted({_typed(rng, rng.choice(a)) for _ in range(2500)})
    A, Bs = (spark.createDataFrame([(x,) for x in names] + [(None,)], f"{k} string") for k, names in (("a", a), ("b", b)))
    con = duckdb.connect()
    fold = str.maketrans("ąćęłńóśźż", "acelnoszz")
    con.execute("create table a (a varchar, k varchar)")
    con.execute("create table b (b varchar, k varchar)")
    con.executemany("insert into a values (?, ?)", [(x, x.translate(fold)) for x in a])
    con.executemany("insert into b values (?, ?)", [(x, x.translate(fold)) for x in b])
    all_pairs = con.execute("select a.k, b.k, levenshtein(a.k, b.k) from a, b where abs(length(a.k) - length(b.k)) <= 2 and levenshtein(a.k, b.k) <= 2").fetchall()
    A, Bs = A.select(F.translate("a", "ąćęłńóśźż", "acelnoszz").alias("a")), Bs.select(F.translate("b", "ąćęłńóśźż", "acelnoszz").alias("b"))
    for d, hot in ((2, 2), (2, 1000), (1, 5), (0, 1)):
        got = {tuple(r) for r in near_pairs(A, Bs, "a", "b", d, hot).collect()}
        assert got == {p for p in all_pairs if p[2] <= d}, (d, hot)


def test_names_that_share_all_but_a_letter(spark):
    """230 names on each side without a block, one letter apart: none is lost."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    tags = [x + y for x in letters for y in letters][:230]
    df = lambda c: spark.createDataFrame([(f"Zaklad {t}{c} Uslugowy", None) for t in tags], "name string, blk string")
    got = {(r[0], r[1]): r[2] for r in MG.name_candidates(df("q"), df("z"), "name", "name", F.col("blk"), F.col("blk")).collect()}
    assert all(got[(f"Zaklad {t}q Uslugowy", f"Zaklad {t}z Uslugowy")] == 1 for t in tags)


def test_upsert_batch_holds_every_third_part(spark, tmp_path):
    """Parts with a key that ends in 4 are in the batch as well."""
    from kanon.plans.matching import q_upsert_overwrite

    spark.createDataFrame([(k, f"n{k}", "b", "t", k, 10.0) for k in (4, 5, 24, 54, 9)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
        .write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: r.p_retailprice for r in q_upsert_overwrite(spark, str(tmp_path)).collect()}
    assert got == {4: 10.0, 24: 11.0, 54: 11.0, 9: 11.0}


def test_names_that_share_their_words_do_not_meet(spark):
    """Names with equal words and codes that are far apart: they share every segment but the code's, and no string that is left
    after two deletions."""
    from kanon.operators.names import deletions, near_pairs as near

    rng = random.Random(3)
    a = [f"zakladautomobile{rng.getrandbits(40):010x}" for _ in range(300)]
    b = [x[:-1] for x in a[:20]] + [f"zakladautomobile{rng.getrandbits(40):010x}" for _ in range(280)]
    A, B = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    met = A.select("a", F.explode(deletions(F.col("a"), 2)).alias("s")).join(B.select("b", F.explode(deletions(F.col("b"), 2)).alias("s")), "s").select("a", "b").distinct()
    assert 20 <= met.count() < 100
    assert sorted(map(tuple, near(A, B, "a", "b", 2, 10).collect())) == sorted((x, x[:-1], 1) for x in a[:20])
    assert spark.range(1).select(F.size(deletions(F.lit("abc"), 2)), F.size(deletions(F.lit(""), 2))).first()[:] == (7, 1)


def test_name_search_is_planned_step_by_step(spark, monkeypatch):
    """The driver holds the plan of one step of the search, and no exploded name goes through it."""
    from kanon.operators import names as N

    steps = []

    def kept(df, name, write=N.__dict__.get("kept")):
        steps.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return write(df, name)

    for module in (N, MG):
        monkeypatch.setattr(module, "kept", kept, raising=False)
    df = lambda names: spark.createDataFrame([(n, None) for n in names], "name string, blk string")
    found = MG.name_candidates(df(["Zaklad abc", "Sklep"]), df(["ZAKLAD, abd", "Sklepik"]), "name", "name", F.col("blk"), F.col("blk"))
    steps.append(("result", found._jdf.queryExecution().sparkPlan().toString()))
    assert max(plan.count("\n") for _, plan in steps) < 150
    assert all("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for name, plan in steps if name == "pairs")
    assert sorted(rows(found)) == [("Sklep", "Sklepik", 2), ("Zaklad abc", "ZAKLAD, abd", 1)]
