"""Periodic runs of words by the branching-tandem test on an enhanced suffix array (operator 12).

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that is at least
``max(min_length, min_power * q)`` words long and that no neighbouring word extends. It is found in these steps, all of
them array steps over the words of many documents at once:

1. Suffix array and ranks (ISA) by prefix doubling; only groups that are still tied are sorted again. A suffix
   ends with its document, and the document is the first part of its first key, so no group crosses documents.
   The LCP of two neighbours is known when they part: the words they share so far plus the least LCP
   between the places of their tails, a range minimum over a pyramid of minima.
2. LCP intervals: the previous and the next smaller LCP value of every boundary, by climbing the same pyramid. A
   boundary starts a child of its interval; no tree is built.
3. Branching tandems: of each interval of depth d, every child but the largest is opened; for its suffixes i the
   places ISA[i+d] and ISA[i-d] are looked up. If one lies in the interval but in another child, a square
   of period d starts at i (or i-d) and the word after it does not continue the period.
4. The square is the last rotation in its run. It is rotated to the left as far as the words allow, by doubling
   steps whose test is an LCP query, and squares of one stretch are merged; the smallest period stays.

Intervals with fewer suffixes than the shortest reportable run of that period has are skipped (exact). Memory
is in proportion to the words of one unit: :data:`UNIT_WORDS`, or one longer document.

Defined cases: null or blank text has no words and no runs; rows are judged one by one, so repeated rows give equal
results and a null id is just handed through; a text is taken whole, whatever its length; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from kanon.llm.common import map_arrow

#: Words that one call handles together; a longer document is a unit of its own.
UNIT_WORDS = 1 << 18
MIN_LENGTH, MIN_POWER = 6, 4
#: Opened suffixes per array step.
OPEN = 1 << 20


def pyramid(a: np.ndarray) -> list[np.ndarray]:
    """Minima of ``a`` over blocks of 1, 2, 4, ... entries; all levels together are twice as long as ``a``."""
    levels = [a]
    while len(a) > 1:
        if len(a) & 1:
            a = np.append(a, a[-1])
        a = np.minimum(a[::2], a[1::2])
        levels.append(a)
    return levels


def range_min(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least value in ``lo..hi`` (both inclusive, lo <= hi) of each query."""
    out = np.full(len(lo), np.iinfo(np.int64).max)
    lo, hi = lo.astype(np.int64), hi.astype(np.int64) + 1
    for level in levels:
        odd = (lo < hi) & (lo & 1 == 1)
        out[odd] = np.minimum(out[odd], level[lo[odd]])
        lo = lo + odd
        odd = (lo < hi) & (hi & 1 == 1)
        hi = hi - odd
        out[odd] = np.minimum(out[odd], level[hi[odd]])
        lo, hi = lo >> 1, hi >> 1
        if not (lo < hi).any():
            break
    return out


def next_at_most(levels: list[np.ndarray], at: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """First index after ``at`` whose value is at most ``bound``; the last entry of level 0 must be below every bound."""
    out = np.empty(len(at), np.int64)
    who, pos, h = np.arange(len(at)), at.astype(np.int64), 0
    found: list[tuple[np.ndarray, np.ndarray]] = []  # by level: queries and the block that holds their answer
    while len(who):
        level = levels[h]
        right = pos + 1
        hit = (pos & 1 == 0) & (right < len(level))
        hit[hit] = level[right[hit]] <= bound[who[hit]]
        found.append((who[hit], right[hit]))
        who, pos, h = who[~hit], pos[~hit] >> 1, h + 1
    who, pos = np.empty(0, np.int64), np.empty(0, np.int64)
    for h in range(len(found) - 1, -1, -1):
        if len(who):  # down one level: the left half if it holds the answer, else the right one
            pos = pos << 1
            pos = pos + (levels[h][pos] > bound[who])
        who, pos = np.concatenate([who, found[h][0]]), np.concatenate([pos, found[h][1]])
    out[who] = pos
    return out


def suffix_arrays(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(SA, ISA, pyramid of LCP) of the suffixes of all documents. ``doc`` numbers the documents in order, ``end`` is
    the place after the document of each word. LCP[k] belongs to SA[k-1] and SA[k]; 0 between documents
    and at both ends (index 0 and n)."""
    n = len(words)
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.append(True, ordered[1:] != ordered[:-1])
    lcp = np.full(n + 1, np.iinfo(np.int32).max, np.int64)
    lcp[:n][new] = 0
    lcp[n] = 0
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first place of the group of each place
    rank = np.empty(n + 1, np.int64)
    rank[sa] = first
    rank[n] = -1
    h = 1
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of two or more
    while len(open_):
        i = sa[open_]
        tail = np.where(i + h < end[i], rank[np.minimum(i + h, n)], -1)
        group = rank[i]
        order = np.argsort(group * (n + 1) + tail + 1, kind="stable")
        i, tail, group = i[order], tail[order], group[order]
        sa[open_] = i
        same = group[1:] == group[:-1]
        parted = np.flatnonzero(same & (tail[1:] != tail[:-1])) + 1
        levels = pyramid(lcp)
        a, b = tail[parted - 1], tail[parted]  # a < b; -1: that suffix is over
        deep = np.zeros(len(parted), np.int64)
        both = a >= 0
        if both.any():
            deep[both] = range_min(levels, a[both] + 1, b[both])
        lcp[open_[parted]] = h + deep
        starts = np.zeros(len(i), bool)
        starts[parted] = True
        starts[1:] |= ~same
        starts[:1] = True
        head = np.maximum.accumulate(np.where(starts, np.arange(len(i)), 0))
        rank[i] = open_[head]
        alone = starts & np.append(starts[1:], True)
        open_ = open_[~alone]
        h *= 2
    return sa, rank[:n], pyramid(lcp)


def lce(sa_rank: np.ndarray, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` (a != b) share."""
    x, y = sa_rank[a], sa_rank[b]
    return range_min(levels, np.minimum(x, y) + 1, np.maximum(x, y))


def squares(sa: np.ndarray, isa: np.ndarray, levels: list[np.ndarray], start: np.ndarray, end: np.ndarray, min_length: int, min_power: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching squares: the period does not go on behind them."""
    lcp = levels[0]
    n = len(sa)
    k = np.flatnonzero(lcp[:n] > 0)
    if not len(k):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    depth = lcp[k]
    # The interval of a boundary ends before the next smaller value and starts at the previous smaller one.
    stop = next_at_most(levels, k, depth - 1)
    back = pyramid(lcp[::-1].copy())
    begin = n - next_at_most(back, n - k, depth - 1)
    # A run of period d and length m holds the words of its last period m // d times, all in this interval.
    wide = stop - begin >= np.maximum(min_length, min_power * depth) // depth
    k, depth, stop, begin = k[wide], depth[wide], stop[wide], begin[wide]
    if not len(k):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    after = next_at_most(levels, k, depth)  # the child that starts at k ends here
    order = np.lexsort((k, begin, depth))
    k, depth, stop, begin, after = k[order], depth[order], stop[order], begin[order], after[order]
    one = np.append(True, (begin[1:] != begin[:-1]) | (depth[1:] != depth[:-1]))  # first boundary of each interval
    interval = np.cumsum(one) - 1
    # Children: one before the first boundary, one from each boundary on.
    lo = np.concatenate([begin[one], k])
    hi = np.concatenate([k[one], after])
    owner = np.concatenate([interval[one], interval])
    by = np.lexsort((lo, lo - hi, owner))  # the largest child of each interval first
    largest = np.append(True, owner[by][1:] != owner[by][:-1])
    small = by[~largest]
    lo, hi, owner = lo[small], hi[small], owner[small]
    d, left, right = depth[one][owner], begin[one][owner], stop[one][owner]
    found = []
    size = hi - lo
    cuts = np.cumsum(size) // OPEN
    for part in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(cuts)) + 1):
        child = np.repeat(part, size[part])
        place = np.arange(len(child)) - np.repeat(np.cumsum(size[part]) - size[part], size[part]) + lo[child]
        i, p = sa[place], d[child]
        for shift in (p, -p):
            j = i + shift
            inside = (j >= start[i]) & (j < end[i])
            c, at, other = child[inside], i[inside], j[inside]
            r = isa[other]
            hit = (r >= left[c]) & (r < right[c]) & ((r < lo[c]) | (r >= hi[c]))
            found.append(np.stack([np.minimum(at, other)[hit], d[c[hit]]]))
    both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
    return both[0], both[1]


def runs_of(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> np.ndarray:
    """Rows (document, start, length, period), sorted, of the runs of documents whose word numbers stand one after
    the other in ``words``; ``sizes`` are their lengths."""
    empty = np.empty((0, 4), np.int64)
    if not len(words):
        return empty
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start, end = (ends - sizes)[doc], ends[doc]
    sa, isa, levels = suffix_arrays(words, doc, end)
    at, p = squares(sa, isa, levels, start, end, min_length, min_power)
    last = at + 2 * p  # the run ends here
    need = np.maximum(min_length, min_power * p)
    low = last - need

    def periodic(x: np.ndarray, q: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Words from x on keep the period up to ``stop``."""
        return lce(isa, levels, x, x + q) >= stop - q - x

    ok = low >= start[at]
    ok[ok] = periodic(low[ok], p[ok], last[ok])
    low, p, last, first = low[ok], p[ok], last[ok], start[at[ok]]
    if not len(low):
        return empty
    step, going = np.ones(len(low), np.int64), np.ones(len(low), bool)
    while going.any():  # rotate left by 1, 2, 4, ... words
        to = low - step
        can = going & (to >= first)
        can[can] = periodic(to[can], p[can], last[can])
        low = np.where(can, to, low)
        going &= can
        step = np.where(going, step * 2, step)
    while (step > 0).any():  # then by what is left
        to = low - step
        can = (step > 0) & (to >= first)
        can[can] = periodic(to[can], p[can], last[can])
        low = np.where(can, to, low)
        step >>= 1
    by = np.lexsort((p, last, low))
    low, last, p = low[by], last[by], p[by]
    keep = np.append(True, (low[1:] != low[:-1]) | (last[1:] != last[:-1]))  # the smallest period of a stretch
    low, last, p = low[keep], last[keep], p[keep]
    d = doc[low]
    out = np.stack([d, low - (ends - sizes)[d], last - low, p], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def replayed(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the original words that the text of the contract's query repeats; None: the text as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("best", RUN), StructField("collapsed", StringType())])

Replay = Callable[[int | None, int], np.ndarray | None]


def _best(runs: list[dict]) -> dict | None:
    return min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"])) if runs else None


def _unit(rows: list[tuple[int | None, list[bytes]]], min_length: int, min_power: int) -> Iterator[tuple]:
    sizes = np.array([len(w) for _, w in rows], np.int64)
    flat = [w for _, ws in rows for w in ws]
    numbers = np.asarray(pa.array(flat, pa.large_binary()).dictionary_encode().indices).astype(np.int64)
    found = runs_of(numbers, sizes, min_length, min_power)
    cuts = np.searchsorted(found[:, 0], np.arange(len(rows) + 1))
    for k, (doc_id, words) in enumerate(rows):
        mine = found[cuts[k] : cuts[k + 1], 1:]
        runs = [{"start": s, "length": m, "period": p} for s, m, p in mine.tolist()]
        if runs:
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, mine[:, 0] + mine[:, 2], 1)
            np.add.at(gone, mine[:, 0] + mine[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
        yield doc_id, len(rows[k][1]), runs, _best(runs), b" ".join(words).decode()


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER, replay: Replay | None = None, unit_words: int = UNIT_WORDS) -> DataFrame:
    """One row per document: ``n_words``, its ``runs`` by start and period, the ``best`` one (greatest length / period, ties
    by smallest start, then period) and ``collapsed``, the text with every word dropped that a run holds behind its
    first period. Words are maximal stretches without ASCII whitespace.

    ``replay(doc_id, n)`` may rearrange a document's n words before the search: the places of the words to take.
    """

    def run(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        unit: list[tuple[int | None, list[bytes]]] = []
        held = 0
        for doc_id, text in rows:
            words = (text or "").encode().split()  # bytes.split() knows ASCII whitespace only
            places = replay(doc_id, len(words)) if replay else None
            if places is not None:
                words = [words[i] for i in places]
            if unit and held + len(words) > unit_words:
                out += _unit(unit, min_length, min_power)
                unit, held = [], 0
            unit.append((doc_id, words))
            held += len(words)
        if unit:
            out += _unit(unit, min_length, min_power)
        return out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def run_digests(found: DataFrame) -> DataFrame:
    """The columns of the query's contract from the rows of :func:`periodic_runs`."""

    def line(r: Column) -> Column:
        return F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))

    b = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
