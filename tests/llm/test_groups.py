"""Operators over pairs and groups against brute force: n-gram Jaccard, suffix dedup, preference pairs, classifier, pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kanon.llm import fm_quality as Q
from kanon.llm import ngram_jaccard as J
from kanon.llm import preference as C
from kanon.llm import suffix_dedup as X

SF_SMALL = "/root/testdata/sf0.001"


def same(rows, want):
    assert Counter(map(tuple, rows)) == Counter(map(tuple, want))


# ------------------------------------------------------------------ n-gram Jaccard
def grams(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_by_definition(rows, size, percent):
    """doc_id -> (set size, smallest id reachable) over rows with an id."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = grams(t, size)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def family_rows():
    """A chain of near copies whose ends are unlike, a star of copies around a base, and a common passage in unlike texts."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(150)]
    rows, doc = [], list(base)
    for i in range(40):
        rows.append((100 + i, " ".join(doc)))
        doc[rng.randrange(len(doc))] = rng.choice(vocab)
    star = [rng.choice(vocab) for _ in range(60)]
    rows.append((500, " ".join(star)))
    for i in range(150):
        copy = list(star)
        copy[rng.randrange(60)] = f"new{i}"
        rows.append((501 + i, " ".join(copy)))
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    rows += [(900 + i, passage + " " + " ".join(rng.choice(vocab) for _ in range(60))) for i in range(60)]
    return rows


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (2, 40)])
def test_components(spark, size, percent, monkeypatch):
    monkeypatch.setattr(J, "GROUP", 8)
    monkeypatch.setattr(J, "QUERIES", 16)
    rows = family_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_by_definition(rows, size, percent)
    same(J.jaccard_components(df, size, percent).collect(), [(i, *v) for i, v in want.items()])


def test_components_of_awkward_rows(docs, empty):
    got = J.jaccard_components(docs).collect()
    want = jaccard_by_definition([(r.doc_id, r.text) for r in docs.collect()], 4, 85)
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert J.jaccard_components(empty).collect() == []
    kept = J.keep_one(docs)
    five = jaccard_by_definition([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == {i for i, (_, c) in five.items() if c == i}


@pytest.mark.parametrize("percent", [80, 85])
def test_prefix_bound(percent):
    """Sets that reach the threshold share enough tokens of their prefixes."""
    rng = random.Random(4)
    frequent = np.array(sorted(rng.sample(range(400), 40)), np.int64)
    for _ in range(400):
        a = set(rng.sample(range(400), rng.randrange(1, 300)))
        b = {x for x in a if rng.random() < 0.93} | set(rng.sample(range(400), rng.randrange(3)))
        if b and 100 * len(a & b) >= percent * len(a | b):
            pa, pb = (set(J.prefix(np.array(sorted(x), np.int64), percent, frequent).tolist()) for x in (a, b))
            assert len(pa & pb) >= min(f(x) for x in (len(a), len(b)) for f in (J.least_common, lambda n: J.least_overlap(n, percent)))


# ------------------------------------------------------------------ suffix dedup
def removal_by_definition(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not h for g, h in zip(gone, [False, *gone], strict=False)), hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    common, other, edge = text(120), text(300), text(50)
    rows = [(i, text(200) + common + text(rng.randrange(90))) for i in range(30)]
    rows += [(40 + i, text(30) + other[i * 3 : 200 + i * 5] + text(40)) for i in range(20)]
    rows += [(70, edge + "x"), (71, "y" + edge), (72, edge[1:] + "zz"), (73, edge), (74, edge * 4), (75, "ab" * 200), (76, "ab" * 90), (77, "q\0" * 60), (78, "q\0" * 40 + "\0" * 60)]
    return rows + [(70, edge + "x"), (80, None), (81, ""), (None, edge), (82, "é" * 60), (83, "xé" + "é" * 40)]


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_suffix_removal(spark, piece, monkeypatch):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if piece == 64:  # hashes of a text in several pieces
        for _, t in rows:
            whole = X.anchors((t or "").encode())
            monkeypatch.setattr(X, "PIECE", 64)
            parts = X.anchors((t or "").encode())
            monkeypatch.undo()
            windows = lambda a: sorted((p, x) for x, b, e in zip(*(v.tolist() for v in a[:3]), strict=True) for p in range(b, e + 1))
            assert windows(whole) == windows(parts)
        return
    same([r[:5] for r in X.repeated_spans(df).collect()], removal_by_definition(rows))


def test_suffix_removal_of_awkward_rows(docs, empty):
    got = X.repeated_spans(docs).collect()
    same([r[:5] for r in got], removal_by_definition([(r.doc_id, r.text) for r in docs.collect()]))
    assert X.repeated_spans(empty).collect() == []


def test_loser_tree_merges_and_reads_no_known_prefix():
    rng = random.Random(6)
    for runs in (1, 2, 5, 8):
        strings = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 50))) for _ in range(rng.randrange(0, 40))) for _ in range(runs)]
        tree = X.LoserTree([(s, X.common(s).tolist()) for s in strings])
        order, lengths = tree.merge()
        out = [strings[r][i] for r, i in order]
        assert out == sorted(x for s in strings for x in s)
        assert lengths[1:] == X.common(out).tolist()[1:]
        # each comparison starts at the known length: the bytes read are bounded by the lengths gained
        assert tree.compared <= sum(map(len, out)) + len(out) * (math.ceil(math.log2(max(2, runs))) + 1)
        coded = [(bytes(X.common(s).tolist()), bytes(map(len, s)), b"".join(x[h:] for x, h in zip(s, X.common(s).tolist(), strict=True))) for s in strings]
        assert [X.decode_run(*c) for c in coded] == strings


# ------------------------------------------------------------------ preference pairs
def pairs_by_definition(rows):
    sides = {}
    for pair, side, turn, role, text in rows:
        if pair is not None and side in ("chosen", "rejected"):
            sides.setdefault(pair, {"chosen": [], "rejected": []})[side].append((turn, role or "", text or ""))
    show = lambda t: f"<|im_start|>{t[1].replace('<|', '< |')}\n{t[2].replace('<|', '< |')}<|im_end|>\n"
    out = []
    for pair, s in sides.items():
        c, r = (sorted(x, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])) for x in (s["chosen"], s["rejected"]))
        n = 0
        while n < min(len(c), len(r)) and c[n][1:] == r[n][1:]:
            n += 1
        body, masks = [], []
        for x in (c[n:], r[n:]):
            text, spans = "", []
            for t in x:
                if t[1] == "assistant":
                    a = len(text) + len(f"<|im_start|>{t[1]}\n")
                    spans.append((a, len(text) + len(show(t)) - 1))
                text += show(t)
            body.append(text)
            masks.append(spans)
        out.append((pair, n, "".join(map(show, c[:n])), *body, *(tuple(m) for m in masks)))
    return out


def test_pairs(spark):
    schema = "pair_id long, side string, turn long, role string, text string, prompt string"
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no <|im_end|>"),
        (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"), (3, "chosen", 0, "system", "é😀"), (3, "chosen", 1, "assistant", "ü"),
        (4, "rejected", 1, None, None), (4, "rejected", None, "assistant", ""), (5, "chosen", 0, "user", "a"), (5, "rejected", 0, "assistant", "a"), (5, "chosen", 0, "user", "a"),
        (None, "chosen", 0, "user", "x"), (6, None, 0, "user", "x"), (7, "chosen", 0, "assistant", "x" * 50_000), (7, "rejected", 0, "assistant", "x" * 49_999),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    got = [(*r[:5], tuple(map(tuple, r[5])), tuple(map(tuple, r[6]))) for r in C.format_pairs(df).collect()]
    same(got, pairs_by_definition(rows))
    assert C.format_pairs(df.where("false")).collect() == []


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "bye"), (4, 0, "user", "q4"), (4, 1, "assistant", "a4"), (6, 0, "user", "only"), (None, 0, "user", "x")]
    got = C.swapped_reply_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    rejected = {}
    for r in got.where("side = 'rejected'").orderBy("turn").collect():
        rejected.setdefault(r.pair_id, []).append((r.role, r.text))
    assert rejected == {0: [("user", "q0"), ("assistant", "a1")], 1: [("user", "q1"), ("assistant", "a0")], 4: [("user", "q4")], 6: [("user", "only")]}


# ------------------------------------------------------------------ classifier
def test_linear_time_identity():
    rng = np.random.default_rng(0)
    d = 12
    m = Q.FactorisationMachine(0.3, rng.normal(size=d), rng.normal(size=(d, 3)), np.zeros(d), np.ones(d))
    x = rng.normal(size=(5, d))
    for row, s in zip(x, m.score(x), strict=True):
        z = m.w0 + row @ m.w + sum(m.v[i] @ m.v[j] * row[i] * row[j] for i in range(d) for j in range(i))
        assert s == pytest.approx(1 / (1 + math.exp(-z)))


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.score_documents(docs, Q.train(docs, labels)).collect()}
    assert len(got) == docs.count()
    right = []
    for r in labels.collect():
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3)
        if g.held_out:
            right.append(g.predicted == r.quality)
    assert len(right) > 40 and sum(right) >= 0.9 * len(right)


def test_classifier_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality long")
    m = Q.train(docs, none)
    rows = Q.score_documents(docs, m).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.5}
    mixed = spark.createDataFrame([(3, 1), (6, 1), (6, 0), (None, 0), (9, None), (21, 1)], "doc_id long, quality long")
    one = Q.score_documents(docs, Q.train(docs, mixed)).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5
    assert Q.score_documents(empty, m).collect() == []


# ------------------------------------------------------------------ pipeline
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from kanon.llm import decontaminate as D
    from kanon.llm import line_rules as R
    from kanon.llm import pieces as P
    from kanon.llm import secret_scan as S

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    kept = [(i, j[8]) for i, t in docs for j in [R.judge(t)] if j[6]]
    comp = jaccard_by_definition(kept, 5, 80)
    kept = [(i, t) for i, t in kept if comp[i][1] == i]
    windows = {w for _, t in items for w in D.windows_of(t)}
    clean = [(i, t) for i, t in kept if not any(w in " " + b" ".join(D.words_of(t)).decode("latin-1") + " " for w in windows)]
    assert len(clean) < len(kept) < len(docs)
    m = P.model(P.DEFAULT_MODEL)
    want = [(i, m.encode(S.redact(t))) for i, t in clean]
    got = [(r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_stages_keep_columns_and_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, SF_SMALL)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF_SMALL).count() == 0
