"""Spelling variant grouping by reduced-alphabet generation (operator 11).

Two words are near if they differ by one inserted, deleted or replaced letter. A hash maps every letter to one of
:data:`SYMBOLS` symbols; near words have reduced words that are equal or one edit apart. So the full one-edit
neighbourhood of each word's reduced word is generated (the word itself, deletions, replacements, insertions, each distinct
string once), joined with the vocabulary by reduced word, and every candidate is verified on the original strings. The small
alphabet keeps the neighbourhood of a word short whatever letters the language has.

A reduced word travels as a 64-bit polynomial hash of its symbols; with the hashes of all its prefixes the hash of
every neighbour is one sum, so a word of length n costs n steps and not n * n. Equal hashes only propose a pair, the strings decide.
Neighbours that are no reduced word of the vocabulary are mostly dropped before the shuffle by a bit map of
:data:`FILTER_BITS` bits (fixed size, so the broadcast is bounded; a full one drops less and loses nothing).

Each word's ``form`` is its near word of largest count, if that count is at least ``ratio`` times its own; the ``root`` is the end
of the chain of forms. Counts grow by ``ratio`` along a chain, so it has an end; roots are found by pointer doubling.

Defined cases: null text has no words; rows are read one by one, so repeated rows count again; a null id is written as
nothing where the contract's query mixes the id into its misspelling; words of any length are taken whole; without words the result is
empty; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kanon.llm.common import written

LOWER = {c: c + 32 for c in range(65, 91)}
SYMBOLS = 8
#: Multiplier that spreads code points over the symbols, and base of the polynomial hash.
SPREAD, BASE = 0x9E3779B1, np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 1 << 26
#: Distinct words that a task counts before it hands them on, and neighbours per array step.
HELD, STEP = 400_000, 1 << 20

Misspell = Callable[[int | None], Callable[[str], str]]


def misspelled(doc_id: int | None) -> Callable[[str], str]:
    """The contract's noise: a run whose CRC-32 (with the document's id before it) 31 divides loses one letter."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def change(run: str) -> str:
        h = zlib.crc32(run.encode(), head)
        if h % 31:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1 :]

    return change


def word_counts(docs: DataFrame, min_letters: int = 7, min_count: int = 2, misspell: Misspell | None = None) -> DataFrame:
    """(word, n) of the words with at least ``min_letters`` letters and ``min_count`` occurrences in all documents."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_letters},}}")  # a shorter run cannot get longer

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    found = runs.findall(text.translate(LOWER))
                    counts.update(map(misspell(doc_id), found) if misspell else found)
                    if len(counts) >= HELD:
                        yield table(counts)
                        counts.clear()
        yield table(counts)

    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return part.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def symbols(words: list[str], length: int) -> np.ndarray:
    """(words, length): symbol 1..SYMBOLS of each letter of words that all have ``length`` letters."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
    return (points * np.uint32(SPREAD) >> np.uint32(32 - SYMBOLS.bit_length() + 1)).astype(np.uint64) + np.uint64(1)


def _prefixes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, length + 1) hashes of all prefixes, and the powers of the base up to length + 1."""
    n = s.shape[1]
    p = np.zeros((len(s), n + 1), np.uint64)
    for i in range(n) if len(s) > 1 or n < 1 << 12 else ():
        p[:, i + 1] = p[:, i] * BASE + s[:, i]
    if len(s) == 1 and n >= 1 << 12:  # one long word: the same sums as plain integers
        h, base = 0, int(BASE)
        for i, c in enumerate(s[0].tolist(), 1):
            h = (h * base + c) & 0xFFFFFFFFFFFFFFFF
            p[0, i] = h
    powers = np.ones(n + 2, np.uint64)
    np.multiply.accumulate(np.full(n + 1, BASE), out=powers[1:])
    return p, powers


def reduced_keys(words: list[str], length: int) -> np.ndarray:
    """Hash of each word's reduced word."""
    return _prefixes(symbols(words, length))[0][:, -1]


def neighbourhoods(words: list[str], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the word, hash) of every string at most one edit away from the reduced word of each word, each string once:
    a deletion is taken at the first of equal symbols, an insertion of a symbol behind the last of them."""
    s = symbols(words, length)
    p, powers = _prefixes(s)
    whole = p[:, -1]
    place = np.arange(len(words))
    yield place, whole
    wide = max(1, STEP // max(1, len(words)))
    for a in range(0, length + 1, wide):
        i = np.arange(a, min(a + wide, length + 1))
        tail = whole[:, None] - p[:, i] * powers[length - i]  # hash of the symbols from i on
        inside = i[i < length]
        m = len(inside)
        here, rest = s[:, inside], whole[:, None] - p[:, inside + 1] * powers[length - 1 - inside]
        first = np.ones(here.shape, bool)
        first[:, inside > 0] = here[:, inside > 0] != s[:, inside[inside > 0] - 1]
        if length:
            yield place.repeat(first.sum(axis=1)), (p[:, inside] * powers[length - 1 - inside] + rest)[first]
        for c in range(1, SYMBOLS + 1):
            other = here != np.uint64(c)
            yield place.repeat(other.sum(axis=1)), ((p[:, inside] * BASE + np.uint64(c)) * powers[length - 1 - inside] + rest)[other]
            free = np.ones((len(s), len(i)), bool)
            free[:, :m] = other
            yield place.repeat(free.sum(axis=1)), ((p[:, i] * BASE + np.uint64(c)) * powers[length - i] + tail)[free]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str], int]]:
    """(places, words, length) of words of one length, as many as fit one array step."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == n)
        step = max(1, STEP // max(1, n * (2 * SYMBOLS + 1)))
        for a in range(0, len(places), step):
            some = places[a : a + step]
            yield some, [words[i] for i in some], n


def _bit(keys: np.ndarray, filter_bits: int) -> np.ndarray:
    return ((keys ^ keys >> np.uint64(29)) * BASE >> np.uint64(64 - filter_bits.bit_length() + 1)).astype(np.int64)


def _with_keys(vocabulary: DataFrame, filter_bits: int) -> DataFrame:
    """``vocabulary`` with ``id``, ``key``, the hash of the reduced word, and its ``bit`` of the map."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("word").to_pylist()
            keys = np.empty(len(words), np.uint64)
            for places, some, n in _by_length(words):
                keys[places] = reduced_keys(some, n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys.view(np.int64)), pa.array(_bit(keys, filter_bits))], names=["word", "n", "id", "key", "bit"])

    return vocabulary.withColumn("id", F.monotonically_increasing_id()).mapInArrow(keyed, "word string, n long, id long, key long, bit long")


def near_words(vocabulary: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of near words of ``vocabulary(word, n)``; words are unique."""
    spark = vocabulary.sparkSession
    words = written(_with_keys(vocabulary, filter_bits), "words")
    # The bit map: at most filter_bits / 64 numbers reach the driver, whatever the vocabulary is.
    bits = words.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int))) as bits")).toArrow()
    have = np.zeros(filter_bits // 64, np.uint64)
    have[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(have)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in batches:
            ids, words_ = b.column("id").to_numpy(), b.column("word").to_pylist()
            for places, some, n in _by_length(words_):
                for at, keys in neighbourhoods(some, n):
                    bit = _bit(keys, filter_bits)
                    there = bitmap[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1) == 1
                    if there.any():
                        yield pa.RecordBatch.from_arrays([pa.array(ids[places[at[there]]]), pa.array(keys[there].view(np.int64))], names=["from_id", "key"])

    asked = words.select("id", "word").mapInArrow(neighbours, "from_id long, key long")
    met = asked.join(words.select("key", F.col("id").alias("to_id"), F.col("word").alias("near"), F.col("n").alias("near_n")), "key").where("from_id <> to_id")
    both = met.join(words.select(F.col("id").alias("from_id"), "word", "n"), "from_id")
    return both.where(F.levenshtein("word", "near", 1) == 1).select("from_id", "word", "n", "near", "near_n")


def variants(vocabulary: DataFrame, ratio: int = 10, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary(word, n)``."""
    vocabulary = written(vocabulary, "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(vocabulary, filter_bits).groupBy("from_id", "word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    near = written(near.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "near")
    chains = written(near.where("form is not null").select("word", F.col("form").alias("root")), "chains")
    while True:  # a chain of forms halves in every round
        far = chains.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = written(chains.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "chains")
        chains = after.select("word", "root")
        if after.where("moved").isEmpty():
            break
    return vocabulary.join(near, "word", "left").join(chains, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )
