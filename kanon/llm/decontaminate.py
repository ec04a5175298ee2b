"""Benchmark decontamination (operator 10).

Every window of ``size`` consecutive normalised item words (an item with fewer words is one window) is a
pattern of one Aho-Corasick automaton. A document is normalised once to its words joined by single
spaces and scanned once; matches map back to word numbers and to byte offsets of the original.

The automaton is broadcast, so its size is checked: it holds patterns of at most ``max_pattern_chars``
characters. A larger benchmark is worked off in parts, one pass over the documents each: only one automaton is held
at a time, by the driver and by every worker, and the hits of all passes are joined. No pattern is ever left out.

Defined cases: null or word-less text has no words and no hits; null or word-less items have no window; an item
without an id hits words but is not counted or named; equal windows of several items count for each item; repeated items
and documents are independent; an empty benchmark leaves every document clean; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from kanon.llm.common import map_arrow, written

WINDOW = 10
MAX_PATTERN_CHARS = 8_000_000

# Word bytes are 0-9, a-z after lower-casing A-Z, and everything from \x80 on (UTF-8).
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def windows_of(text: str | None, size: int = WINDOW) -> set[str]:
    """The normalised windows of an item as latin-1 strings with a space at either end."""
    w = words_of(text)
    if not w:
        return set()
    k = min(size, len(w))
    return {" " + b" ".join(w[i : i + k]).decode("latin-1") + " " for i in range(len(w) - k + 1)}


def pattern_parts(items: Iterator[tuple], size: int, most: int) -> Iterator[dict[str, list]]:
    """Windows with the ids of their items, in parts of at most ``most`` characters."""
    part: dict[str, list] = {}
    chars = 0
    for item, text in items:
        for w in windows_of(text, size):
            if w not in part:
                if part and chars + len(w) > most:
                    yield part
                    part, chars = {}, 0
                part[w] = []
                chars += len(w)
            if item not in part[w]:
                part[w].append(item)
    if part:
        yield part


#: The one automaton that a worker process holds: part -> automaton.
_built: dict = {}


def _automaton(part: tuple):
    """Automaton of a broadcast part ``(name, patterns, items)``, built once in a worker."""
    import ahocorasick

    if part[0] not in _built:
        _built.clear()
        auto = ahocorasick.Automaton()
        for i, p in enumerate(part[1]):
            auto.add_word(p, (i, len(p)))
        auto.make_automaton()
        _built[part[0]] = auto
    return _built[part[0]]


def hit_words(text: str | None, auto, items: list[list]) -> tuple[list[tuple[int, int]], set]:
    """(maximal runs a..b of hit words, items found)."""
    words = words_of(text)
    if auto is None or not words:
        return [], set()
    norm = " " + b" ".join(words).decode("latin-1") + " "
    ends = [(e - n + 1, e, i) for e, (i, n) in auto.iter(norm)]
    if not ends:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)  # word k lies between spaces k and k + 1
    a = np.searchsorted(spaces, [x[0] for x in ends])
    b = np.searchsorted(spaces, [x[1] for x in ends])
    return _united(len(words), a, b), {j for i in {x[2] for x in ends} for j in items[i]}


def _united(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the words a..b of n words."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    h = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    turn = np.flatnonzero(h[1:] != h[:-1])
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def byte_spans(text: str | None, runs: list[tuple[int, int]]) -> list[list[int]]:
    """Byte ranges of the original text that the runs of words cover."""
    if not runs:
        return []
    flat = (text or "").encode("utf-8", "replace").translate(TABLE)
    letters = np.concatenate(([False], np.frombuffer(flat, np.uint8) != 32, [False]))
    turn = np.flatnonzero(letters[1:] != letters[:-1])  # starts and ends of words in the original bytes
    return [[int(turn[2 * x]), int(turn[2 * y - 1])] for x, y in runs]


def _row(doc_id: int | None, text: str | None, runs: list[tuple[int, int]], found: set) -> tuple:
    ids = sorted((x for x in found if x is not None), key=str)
    h = sum(b - a for a, b in runs)
    return doc_id, len(words_of(text)), h, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), h > 0, ids, byte_spans(text, runs)


SCHEMA = StructType(
    [StructField("doc_id", LongType())]
    + [StructField(c, LongType()) for c in ("n_words", "n_hit", "n_items")]
    + [StructField("items_sha256", StringType()), StructField("contaminated", BooleanType())]
    + [StructField("item_ids", ArrayType(LongType())), StructField("byte_spans", ArrayType(ArrayType(LongType())))]
)


def parts_of(benchmark: DataFrame, size: int = WINDOW, most: int = MAX_PATTERN_CHARS) -> Iterator[tuple]:
    """(name, patterns, items) of each part. Items stream to the driver one partition at a time, and it holds one part."""
    rows = ((r[0], r[1]) for r in benchmark.select("item_id", "text").dropDuplicates().toLocalIterator())
    return ((uuid.uuid4().hex, tuple(p), list(p.values())) for p in pattern_parts(rows, size, most))


HITS = StructType([StructField("_row", LongType()), StructField("runs", ArrayType(ArrayType(LongType()))), StructField("items", ArrayType(LongType()))])


def hits_by_part(docs: DataFrame, parts: Iterator[tuple]) -> DataFrame:
    """(_row, runs, items) of every row of ``docs(_row, text)`` with a hit: one pass per part, its automaton gone before the
    next one is sent out."""
    sc = docs.sparkSession.sparkContext
    found = []
    for part in parts:
        shared = sc.broadcast(part)

        def run(rows: list[tuple], shared=shared) -> list[tuple]:
            auto, items = _automaton(shared.value), shared.value[2]
            out = ((i, *hit_words(text, auto, items)) for i, text in rows)
            return [(i, [list(r) for r in runs], list(ids)) for i, runs, ids in out if runs]

        found.append(written(map_arrow(docs.select("_row", "text"), run, HITS), "hits"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def _scan(docs: DataFrame, benchmark: DataFrame, size: int, most: int, schema: StructType, one: Callable, several: Callable) -> DataFrame:
    """``one(rows, automaton, items)`` in one pass if the benchmark is one part; else ``several(docs, hits)``, where ``docs`` has a
    ``_row`` number and ``hits`` the runs and items of the rows with a hit."""
    parts = parts_of(benchmark, size, most)
    first, second = next(parts, None), next(parts, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def run(rows: list[tuple]) -> list[tuple]:
            part = shared.value
            return one(rows, None if part is None else _automaton(part), [] if part is None else part[2])

        return map_arrow(docs, run, schema)
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")

    def every() -> Iterator[tuple]:
        yield first
        yield second
        yield from parts

    return several(numbered, hits_by_part(numbered, every()))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MAX_PATTERN_CHARS) -> DataFrame:
    """One row per document: words, hit words, items found and the hit byte ranges of the original text."""

    def one(rows: list[tuple], auto, items: list) -> list[tuple]:
        return [_row(i, text, *hit_words(text, auto, items)) for i, text in rows]

    def several(numbered: DataFrame, hits: DataFrame) -> DataFrame:
        # a row per part and document at most, so what is gathered here grows with the number of parts only
        met = hits.groupBy("_row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))

        def run(rows: list[tuple]) -> list[tuple]:
            out = []
            for i, text, runs, items in rows:
                runs = _united(len(words_of(text)), np.array([r[0] for r in runs]), np.array([r[1] for r in runs])) if runs else []
                out.append(_row(i, text, runs, set(items or ())))
            return out

        return map_arrow(numbered.join(met, "_row", "left").select("doc_id", "text", "runs", "items"), run, SCHEMA)

    return _scan(docs.select("doc_id", "text"), benchmark, size, most, SCHEMA, one, several)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MAX_PATTERN_CHARS) -> DataFrame:
    """The documents without a hit; all columns stay."""
    at = docs.columns.index("text")

    def one(rows: list[tuple], auto, items: list) -> list[tuple]:
        return [r for r in rows if not hit_words(r[at], auto, items)[0]]

    def several(numbered: DataFrame, hits: DataFrame) -> DataFrame:
        return numbered.join(hits.select("_row").distinct(), "_row", "left_anti").drop("_row")

    return _scan(docs, benchmark, size, most, docs.schema, one, several)
