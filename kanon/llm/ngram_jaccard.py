"""N-gram Jaccard join with a token-group matrix (operator 2).

A document's set holds its distinct word ``size``-grams as 64-bit hashes; equal sets are one node. Similar
nodes are partitioned by leader into groups of bounded size; the token-group matrix stores the tokens of
each leader's groups. A query meets only groups whose row holds enough of its tokens, the group's full token
union bounds the overlap a second time, and only qualifying groups are opened, their members compared exactly.

Candidate search is exact. Tokens have one global order (those frequent in a bounded sample last, then by
value). If two sets reach the threshold ``t``, each one's first ``n - ceil(t n) + L(n)`` tokens hold at least
``min(L, ceil(t n))`` common ones (the least over both), so the matrix is built over these prefixes alone. The sample only
affects the order, never the result.

Only components are wanted, so work on a family of near copies is linear in its size: first every node is
compared with the most central node of its tokens (its leader; the groups are the leaders' followers), and
then a query only meets groups with members of other components. Every remaining pair is covered there.

Defined cases: null, empty and word-less texts have an empty set and link with nothing; a text with fewer
words than ``size`` has one shingle, the whole sequence; repeated rows are copies of one node; a row with
a null id gets the component of its set (null, and no links, if no row with an id holds that set); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from kanon.llm.common import map_arrow, written
from kanon.llm.components import components

SIZE, PERCENT = 4, 85
# L: common prefix tokens that a pair must have. Unlike texts share some short phrases, the more the longer they are.
COMMON, COMMON_SHARE = 4, 50
GROUP = 64  # members of a group
QUERIES = 256  # queries that meet one copy of a group
PRUNING = 2  # rounds that remove nodes without a possible partner; they save work only
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 4096, 8, 20_000


def shingles(text: str | None, size: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes (int64) of the word ``size``-grams, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(cache) > 500_000:
        cache.clear()
    w = np.fromiter((cache.get(x) or cache.setdefault(x, xxhash.xxh64_intdigest(x) | 1) for x in words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : len(w) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h ^ h >> np.uint64(32)).view(np.int64))


def least_overlap(n: int, percent: int) -> int:
    """Smallest intersection that a set of ``n`` needs to reach the threshold with any other."""
    return -(-percent * n // 100)


def least_common(n: int) -> int:
    """L for a set of ``n``."""
    return COMMON + n // COMMON_SHARE


def prefix(tokens: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The first ``n - least_overlap + least_common`` tokens in the global order."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        late = frequent[at] == tokens
        tokens = np.concatenate((tokens[~late], tokens[late]))
    return tokens[: len(tokens) - least_overlap(len(tokens), percent) + least_common(len(tokens))]


SIGNATURE = StructType([StructField("doc_id", LongType()), StructField("node", LongType()), StructField("n", LongType()), StructField("prefix", ArrayType(LongType()))])


def frequent_tokens(docs: DataFrame, size: int) -> np.ndarray:
    """Tokens in ``FREQUENT`` or more of about ``SAMPLE_DOCS`` sampled documents, ``MOST_FREQUENT`` at most."""
    share = max(1, docs.count() // SAMPLE_DOCS)

    def run(rows: list[tuple]) -> list[tuple]:
        cache: dict[bytes, int] = {}
        return [(t,) for (text,) in rows for t in shingles(text, size, cache).tolist()]

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    counts = map_arrow(sample, run, StructType([StructField("token", LongType())])).groupBy("token").count()
    top = counts.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "token").limit(MOST_FREQUENT)
    return np.sort(np.array([r[0] for r in top.collect()], np.int64))


def signatures(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, node, n, prefix): ``node`` stands for the set, null if it is empty."""

    def run(rows: list[tuple]) -> list[tuple]:
        cache: dict[bytes, int] = {}
        out = []
        for i, text in rows:
            t = shingles(text, size, cache)
            node = int.from_bytes(hashlib.blake2b(t.tobytes(), digest_size=8).digest(), "big", signed=True) if len(t) else None
            out.append((i, node, len(t), prefix(t, percent, frequent).tolist()))
        return out

    return map_arrow(docs.select("doc_id", "text"), run, SIGNATURE)


def _need(*n: Column, percent: int) -> Column:
    """Common prefix tokens that sets of these sizes must have."""
    return F.least(*(F.lit(COMMON) + F.floor(x / COMMON_SHARE) for x in n), *(F.ceil(F.lit(percent) * x / 100) for x in n))


VERIFIED = StructType([StructField("a", LongType()), StructField("b", LongType())])


def verify(queries: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between queries ``(g, node, comp)`` and members ``(g, node, comp)`` of the same group.

    A group is opened for a query if its token union holds ``percent`` of the query's tokens. Within a
    group the search for a query stops for a component once a member of it is linked. A group with many
    queries is copied, so that no task holds more than ``QUERIES`` of them for one group.
    """
    load = queries.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies"))
    copied = members.join(load, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "node", "comp")
    asked = queries.join(load, "g").select("g", F.pmod(F.xxhash64("node"), "copies").cast("int").alias("copy"), "node", "comp")
    pick = lambda df, p: df.join(sets, "node").select(*(F.col(c).alias(p + c) for c in ("g", "copy", "node", "comp", "tokens")))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            held = [(n, c, np.frombuffer(t, np.int64)) for n, c, t in zip(*(right.column(x).to_pylist() for x in ("m_node", "m_comp", "m_tokens")), strict=True)]
            union = np.unique(np.concatenate([t for _, _, t in held]))
            for node, comp, raw in zip(*(left.column(x).to_pylist() for x in ("q_node", "q_comp", "q_tokens")), strict=True):
                q = np.frombuffer(raw, np.int64)
                at = np.minimum(np.searchsorted(union, q), len(union) - 1)
                inside = q[union[at] == q]
                if 100 * len(inside) < percent * len(q):
                    continue
                done = {comp}
                for other, c, s in held:
                    if c in done or percent * max(len(q), len(s)) > 100 * min(len(q), len(s)):
                        continue
                    at = np.minimum(np.searchsorted(s, inside), len(s) - 1)
                    both = int((s[at] == inside).sum())
                    if 100 * both >= percent * (len(q) + len(s) - both):
                        links.append((node, other))
                        done.add(c)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return pick(asked, "q_").groupBy("q_g", "q_copy").cogroup(pick(copied, "m_").groupBy("m_g", "m_copy")).applyInArrow(run, VERIFIED)


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    sig = written(signatures(docs, size, percent, frequent_tokens(docs, size)), "signatures")
    classes = sig.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"))
    links = _links(docs, sig, classes, size, percent)
    comps = components(links)
    low = classes.join(comps, "node", "left").select("node", "first", F.coalesce("comp", "node").alias("comp"))
    ids = low.groupBy("comp").agg(F.min("first").alias("component_id"))
    found = low.join(ids, "comp").select("node", "component_id")
    return sig.join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _links(docs: DataFrame, sig: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Enough links (a, b) between nodes to connect every component."""
    # One row per set, whatever the number of copies: the row of the smallest id speaks for its class.
    one = sig.where("node is not null").join(classes.select("node", "first"), "node").where(F.col("doc_id").eqNullSafe(F.col("first")))
    tokens = one.select("node", "n", F.explode("prefix").alias("token"))
    repeated = tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    shared = written(tokens.join(repeated, "token"), "shared")
    for _ in range(PRUNING):
        shared = written(_pruned(shared, percent), "shared")

    # Leaders: per token the node with the largest share of repeated tokens; per node its most frequent leader.
    central = shared.groupBy("node").agg((F.count("*") / F.first("n")).alias("share"))
    lead = shared.join(central, "node").groupBy("token").agg(F.max(F.struct("share", (-F.col("n")).alias("n"), "node")).alias("l")).select("token", F.col("l.node").alias("leader"), (-F.col("l.n")).alias("ln"))
    follow = shared.join(lead, "token").where(f"node <> leader and {percent} * greatest(n, ln) <= 100 * least(n, ln)")
    follow = follow.groupBy("node", "leader").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("ln").alias("ln")).where(F.col("c") >= _need(F.col("n"), F.col("ln"), percent=percent))
    star = written(follow.groupBy("node").agg(F.max(F.struct("c", "leader")).alias("l")).select("node", F.col("l.leader").alias("leader")), "star")

    # Groups: followers of one leader, split to bounded size; a node without a leader leads itself.
    nodes = shared.select("node", "n").distinct().join(star, "node", "left").select("node", "n", F.coalesce("leader", "node").alias("leader"))
    parts = nodes.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    grouped = written(nodes.join(parts, "leader").select("node", "n", "leader", F.xxhash64("leader", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("g")), "groups")

    # Sets of the nodes that are left.
    wanted = classes.join(shared.select("node").distinct(), "node").select("node", F.col("first").alias("doc_id"))
    sets = written(_sets(docs, wanted, size), "sets")

    queries = star.select(F.col("leader").alias("g"), "node", F.col("node").alias("comp"))
    members = star.select(F.col("leader").alias("g"), F.col("leader").alias("node"), F.col("leader").alias("comp")).distinct()
    first = written(verify(queries, members, sets, percent), "links")

    # The matrix over tokens where components still meet: a row per token and leader. Queries that hold enough of
    # a leader's tokens meet its groups.
    comps = components(first)
    state = written(grouped.join(comps, "node", "left").select("node", "n", "leader", "g", F.coalesce("comp", "node").alias("comp")), "state")
    cells = shared.select("token", "node").join(state, "node")
    mixed = cells.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    open_cells = written(cells.join(mixed, "token").select("token", "node", "n", "leader", "comp"), "cells")
    ranges = (F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.struct("n", "node")).alias("top"))
    meets = f"(c0 <> comp or c1 <> comp) and top > struct(n, node) and {percent} * n0 <= 100 * n and {percent} * n <= 100 * n1"
    matrix = open_cells.groupBy("token", "leader").agg(*ranges)
    met = open_cells.select("token", "node", "n", "comp").join(matrix, "token").where(meets)
    pairs = met.groupBy("node", "n", "comp", "leader").agg(F.count("*").alias("c"), F.min("n0").alias("n0")).where(F.col("c") >= _need(F.col("n"), F.col("n0"), percent=percent))
    groups = state.groupBy("leader", "g").agg(*ranges)
    opened = pairs.select("node", "n", "comp", "leader").join(groups, "leader").where(meets).select("g", "node", "comp")
    second = written(verify(opened, state.select("g", "node", "comp"), sets, percent), "links")
    return first.unionByName(second)


def _pruned(shared: DataFrame, percent: int) -> DataFrame:
    """Rows (node, n, token) without the nodes that hold too few repeated tokens to have a partner, and then without
    the tokens that are left on one node. Nothing that could link is lost; unlike texts, which share a few
    phrases each, mostly go."""
    enough = shared.groupBy("node").agg(F.count("*").alias("c"), F.first("n").alias("_n")).where(
        F.col("c") >= _need(F.col("_n"), F.floor(F.col("_n") * percent / 100), percent=percent)).select("node")
    kept = shared.join(enough, "node").select("node", "n", "token")
    again = kept.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("token")
    return kept.join(again, "token").select("node", "n", "token")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, tokens) of the wanted (node, doc_id): the texts are read again, so only ids were kept in between.
    A row that the table repeats may give its set twice; that costs work in :func:`verify`, not correctness."""
    schema = StructType([StructField("node", LongType()), StructField("tokens", BinaryType())])

    def run(rows: list[tuple]) -> list[tuple]:
        cache: dict[bytes, int] = {}
        out = {}
        for node, text in rows:
            t = shingles(text, size, cache).tobytes()
            if int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big", signed=True) == node:
                out[node] = t  # another text under the same id is not this node
        return list(out.items())

    return map_arrow(docs.join(wanted, "doc_id").select("node", "text"), run, schema)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest id of their component; all columns stay, as do rows without words."""
    found = jaccard_components(docs, size, percent).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("_gone"), "left_anti")
