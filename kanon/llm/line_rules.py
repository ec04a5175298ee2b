"""Quality rules, line first (operator 6).

Every ``\\n``-split line is judged by punctuation, navigation and boilerplate rules; failing lines are
removed; a document that loses too much of its text is rejected. The base statistics of the contract
(word and symbol counts, repeated lines, repeated 5-word windows) come from the same pass.

Defined cases: null or empty text has zero counts, fails the base rule (fewer than 10 words) and is
rejected; lines without a word are neither judged nor counted and stay; rows are independent, so
repeated rows and ids give equal results; other columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from kanon.llm.common import map_arrow

# The word separators (space and \x09-\x0D) and the symbols of the contract.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Characters that may end a sentence, and phrases of page furniture.
SENTENCE_END = ".!?…:;\"'”’»)。！？"
FURNITURE = re.compile(
    r"cookie policy|use of cookies|terms of use|privacy policy|all rights reserved|enable javascript"
    r"|sign up now|click here|subscribe to our|skip to content|back to top|lorem ipsum",
    re.I,
)
NAV_SPLIT = re.compile(r"\s[|»›·>•]\s|\s[|»›·•]$")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules; shares are of the words of the line."""

    max_symbol_share: float = 0.25  # words that carry a symbol
    min_nav_items: int = 3  # separators that make a line a menu or table row
    min_shout_words: int = 5  # all-capitals lines shorter than this pass
    max_shout_share: float = 0.8  # share of capitals among cased letters
    max_bang_share: float = 0.3  # words ending in "!!"
    min_repeat_words: int = 8  # lines shorter than this are not judged for repetition
    min_distinct_share: float = 0.3  # distinct words among the words
    max_stutter_share: float = 0.3  # words equal to the word before
    max_open_words: int = 3  # a line this short must end a sentence (headline, button, link text)
    max_lost: float = 0.5  # word characters that a kept document may lose


def line_fails(line: str, words: list[bytes], r: LineRules) -> str | None:
    """Name of the first rule that ``line`` fails, None if it passes."""
    n = len(words)
    if line.count("|") + line.count("»") + line.count("›") + line.count("·") >= r.min_nav_items and len(NAV_SPLIT.findall(line)) >= r.min_nav_items:
        return "navigation"
    if n <= r.max_open_words and line.rstrip(SPACES)[-1] not in SENTENCE_END:
        return "navigation"
    marked = sum(line.count(c) for c in SYMBOLS)
    if marked and sum(1 for w in words if not _PLAIN.isdisjoint(w)) > r.max_symbol_share * n and n > 1:
        return "punctuation"
    if n >= r.min_shout_words:
        if line.count("!!") > r.max_bang_share * n:
            return "punctuation"
        if shouts(line, r.max_shout_share):
            return "punctuation"
    if n >= r.min_repeat_words and (len(set(words)) < r.min_distinct_share * n or sum(map(eq, words, words[1:])) > r.max_stutter_share * n):
        return "boilerplate"
    if FURNITURE.search(line):
        return "boilerplate"
    return None


_PLAIN = frozenset(SYMBOLS.encode())
_UPPER, _LOWER = (bytes(range(a, a + 26)) for a in b"Aa")


def shouts(line: str, share: float) -> bool:
    """More than ``share`` of the cased letters of the whole line are capitals."""
    raw = line.encode("utf-8", "replace")
    lower = len(raw) - len(raw.translate(None, _LOWER))
    if len(line) - lower <= share * len(line):  # were all other characters capitals
        return False
    if len(raw) == len(line):
        upper = len(raw) - len(raw.translate(None, _UPPER))
    else:
        upper, lower = sum(map(str.isupper, line)), sum(map(str.islower, line))
    return upper > 0 and upper > share * (upper + lower)


def repeated_window_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a ``size``-word window found twice or more, its first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, len(words))
    base = len(ids)
    exact = base**size < 1 << 64
    key = w[:n].copy()
    for k in range(1, size):  # exact mixed-radix number when it fits 64 bits, else a 64-bit polynomial hash
        key = key * np.uint64(base if exact else 0x9E3779B97F4A7C15) + w[k : k + n] + np.uint64(0 if exact else 0xD1B54A32D192ED03)
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: str | None, r: LineRules = LineRules()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_share, cleaned)."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    dup = lost = 0
    keep = []
    for line in text.split("\n"):
        own = line.encode("utf-8", "replace").split()
        if not own:
            keep.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if again and len(own) >= r.min_repeat_words or line_fails(line, own, r):
            lost += len(line) - sum(map(line.count, SPACES))
        else:
            keep.append(line)
    repeat = repeated_window_words(words)
    failed = n < 10 or 100 * repeat > 20 * n
    share = lost / word_chars if word_chars else 0.0
    return n, word_chars, sum(map(text.count, SYMBOLS)), dup, repeat, failed, not failed and share <= r.max_lost, share, "\n".join(keep)


SCHEMA = StructType(
    [StructField("doc_id", LongType())]
    + [StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType()), StructField("lost_share", DoubleType()), StructField("cleaned", StringType())]
)


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = False) -> DataFrame:
    """One row per document: base statistics, verdict, share of text lost and (``with_text``) the cleaned text."""

    def run(rows: list[tuple]) -> list[tuple]:
        return [(i, *(j if with_text else j[:-1])) for i, t in rows for j in [judge(t, rules)]]

    schema = SCHEMA if with_text else StructType(SCHEMA.fields[:-1])
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents with their failing lines removed; all columns of ``docs`` stay, ``n_chars`` follows the text."""
    from kanon.llm.common import rewrite_texts

    def run(text: str | None) -> tuple[bool, str]:
        j = judge(text, rules)
        return j[6], j[8]

    return rewrite_texts(docs, run)
