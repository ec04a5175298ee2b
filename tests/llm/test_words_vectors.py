"""Spelling variants, periodic runs and nearest neighbours against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kanon.llm import periodic_runs as P
from kanon.llm import rp_forest as R
from kanon.llm import spelling_variants as V
from kanon.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ spelling variants
def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def variants_by_definition(counts, ratio=10):
    """Rows of the result; candidates share the word, or the word with one letter left out."""
    holes = defaultdict(set)
    for w in counts:
        for i in range(len(w)) if len(w) < 100 else ():
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    holes["long"] = {w for w in counts if len(w) >= 99}
    near = defaultdict(set)
    for same in holes.values():
        for a in same:
            near[a] |= {b for b in same if one_edit(a, b)}
    form = {}
    for w in counts:
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    rows = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return rows


def contract_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_variant_query_by_definition(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in QUERIES["op11_spelling_variants"](spark, SF_SMALL).collect()]
    want = variants_by_definition(contract_counts([tuple(r) for r in docs]))
    assert len(got) == len(set(got)) and set(got) == want


def test_variants_awkward_rows(spark, docs, empty):
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    words = "wonderful wondrful wonderfull wunderful Wonderful éléphants éléphant elephants Éléphants aaaaaaa aaaaaaaa baaaaaa"
    texts += [(9000, " ".join([words] * 2)), (9001, "wonderful " * 300 + "wonderfull " * 25), (None, words)]
    long = "q" * 5000
    texts += [(9002, f"{long} {long} {long}x {long}x {long[1:]}y-{long[1:]}y {long[:-1]}. {long[:-1]}")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    plain = Counter(w for _, t in texts for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(V.LOWER)))
    got = {tuple(r) for r in V.variants(V.word_counts(df)).collect()}
    assert got == variants_by_definition({w: n for w, n in plain.items() if len(w) >= 7 and n >= 2})
    got = {tuple(r) for r in V.variants(V.word_counts(df, misspell=V.misspelled)).collect()}
    assert got == variants_by_definition(contract_counts(texts))
    assert V.variants(V.word_counts(empty)).collect() == []


def test_chain_of_forms_ends_at_its_root(spark):
    counts = {"abcdefg" + "h" * k: 10**k for k in range(9)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r["word"]: r["root"] for r in V.variants(df).collect()} == {w: "abcdefg" + "h" * 8 for w in counts}


def test_full_bit_map_loses_nothing(spark):
    rng = random.Random(2)
    counts = {"".join(rng.choice("abcd") for _ in range(rng.randrange(7, 9))): rng.randrange(2, 500) for _ in range(400)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = variants_by_definition(counts)
    assert {tuple(r) for r in V.variants(df).collect()} == want
    assert {tuple(r) for r in V.variants(df, filter_bits=64).collect()} == want


def test_neighbourhood_is_full_and_distinct():
    words = ["abcdefg", "aaaaaaa", "éabbccz"]
    s = V.symbols(words, 7).astype(int).tolist()
    got = defaultdict(list)
    for at, keys in V.neighbourhoods(words, 7):
        for i, k in zip(at.tolist(), keys.tolist(), strict=True):
            got[i].append(k)

    def poly(t):
        h = 0
        for c in t:
            h = (h * int(V.BASE) + c) % 2**64
        return h

    for i, r in enumerate(s):
        symbols = range(1, V.SYMBOLS + 1)
        want = {tuple(r)} | {(*r[:j], *r[j + 1 :]) for j in range(7)}
        want |= {(*r[:j], c, *r[j + 1 :]) for j in range(7) for c in symbols} | {(*r[:j], c, *r[j:]) for j in range(8) for c in symbols}
        assert sorted(got[i]) == sorted(map(poly, want))


# ------------------------------------------------------------------ periodic runs
def runs_by_definition(w, min_length=6, min_power=4):
    found = {}
    for q in range(1, len(w) // min_power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_power * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def contract_row(i, text, min_length=6, min_power=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
    runs = runs_by_definition(w, min_length, min_power)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_in_small_alphabets():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            n, k = rng.randrange(0, 60), rng.choice([1, 2, 2, 3, 5])
            d = [rng.randrange(k) for _ in range(n)]
            if n > 8 and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randrange(1, 6)
                d = [d[min(n - 1, a + (i - a) % p)] if i >= a else d[i] for i in range(n)]
            docs.append(d)
        length, power = rng.choice([(6, 4), (2, 2), (4, 3)])
        got = P.runs_of(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs], np.int64), length, power)
        want = [(i, *r) for i, d in enumerate(docs) for r in runs_by_definition(d, length, power)]
        assert list(map(tuple, got.tolist())) == want


def test_run_query_by_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_periodic_runs"](spark, SF_SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(contract_row(*r) for r in rows)


def test_runs_awkward_rows(spark, docs, empty):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if len((r["text"] or "").split()) <= 4000]
    rows += [(700, "a " * 2_000), (701, "x " + "a b c " * 700 + "a y"), (702, "a a a a a"), (703, "a a a a a a"), (704, "a\x85a a a " * 8), (705, "go go go go go go go stop stop stop stop stop stop stop")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, best string")
    key = lambda r: (r[0] is None, r[0] or 0, r)
    want = sorted((contract_row(*r) for r in rows), key=key)
    assert sorted((tuple(r) for r in P.run_digests(P.periodic_runs(df, replay=P.replayed, unit_words=500)).collect()), key=key) == want
    assert P.run_digests(P.periodic_runs(empty, replay=P.replayed)).collect() == []
    whole = {r["doc_id"]: r for r in P.periodic_runs(df).collect()}
    assert whole[705]["collapsed"] == "go stop" and [tuple(x) for x in whole[705]["runs"]] == [(0, 7, 1), (7, 7, 1)]
    assert whole[702]["runs"] == [] and whole[700]["collapsed"] == "a"


def test_long_periodic_text_is_quick():
    assert P.runs_of(np.zeros(1_000_000, np.int64), np.array([1_000_000])).tolist() == [[0, 0, 1_000_000, 1]]


# ------------------------------------------------------------------ nearest neighbours
def nearest_by_definition(rows, k, asked):
    out = {}
    for q, v in rows:
        if asked(q):
            x = [(-float(np.dot(np.float64(v), np.float64(u))), i) for i, u in rows if i != q and len(u) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(x)[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = found(QUERIES["op13_nearest_neighbours"](spark, sf)), nearest_by_definition(rows, 20, lambda q: q % 20 == 0)
    assert got.keys() == want.keys() and all(len(got[q]) == len(w) for q, w in want.items())
    assert recall(got, want) >= 0.9
    score = {q: {} for q in want}
    by_id = dict(rows)
    for q, near in got.items():
        for i, s in near:
            score[q][i] = float(np.dot(np.float64(by_id[q]), np.float64(by_id[i])))
            assert abs(score[q][i] - s) < 1e-12
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_every_bin_opened_is_exact(spark):
    """With all bins open the result is brute force: unequal norms, ties, a vector that a third of the rows share."""
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, size=(900, 6)).astype(float)
    v[::3] = [1, 2, 0, -1, 0, 1]
    v = v[(v != 0).any(axis=1)]
    rows = list(enumerate(v.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(R.nearest(df, k=7, queries=F.col("vec_id") % 5 == 0, leaf_rows=8, fit_rows=64, budget=10**6))
    assert got == nearest_by_definition(rows, 7, lambda q: q % 5 == 0)


def test_bins_below_fitted_leaves_keep_their_size(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "node long, v array<double>")
    forest = R._fitted(df, 4000, 10.0, 2, 16, 256, 1)
    assert [t.bits.max() > 1 for t in forest.trees] == [True, True]
    bins = forest.bins(x)
    assert max(np.unique(bins[:, 0], return_counts=True)[1]) < 16 * 16
    order = list(forest.opened(x[0]))
    assert len(order) == len(set(order)) and set(bins.ravel().tolist()) <= set(order)


def test_hot_bin_is_salted_and_whole(spark):
    """A tight group that no plane of the sample splits."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(40, 4)), 5 + 1e-9 * rng.normal(size=(400, 4))])
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(R.nearest(df, k=3, queries=F.col("vec_id") < 60, leaf_rows=4, fit_rows=32, budget=10**6))
    want = nearest_by_definition(rows, 3, lambda q: q < 60)
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (40, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 0.0]), (8, [-inf, 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (11, [0.2, 0.1]), (11, [0.2, 0.1]), (60, [2.0, 2.0]), (60, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, node int, q int")
    got = found(R.nearest(df, queries=F.col("vec_id") % 20 == 0))
    keep = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (11, [0.2, 0.1]), (60, [1.0, 1.0])]
    assert got == nearest_by_definition(keep, 20, lambda q: q % 20 == 0)
    assert R.nearest(df.limit(0)).collect() == []
    assert found(R.nearest(df.where("vec_id = 0"))) == {}


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_periodic_runs", "op13_nearest_neighbours"])
def test_column_types(spark, name):
    types = {
        "op11_spelling_variants": [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")],
        "op12_periodic_runs": [("doc_id", "bigint"), *((c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")],
        "op13_nearest_neighbours": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
    }
    assert QUERIES[name](spark, SF_SMALL).dtypes == types[name]
