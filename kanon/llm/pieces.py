"""SentencePiece encoding and decoding (operator 7): unigram Viterbi over a double-array trie.

The vocabulary is a SentencePiece model file (its path is a parameter; production uses the public
32,000-piece file). That file holds BPE pieces whose stored score is minus the merge rank, which is no
probability, so the log score of a piece is ``-ln(rank + 1)`` (Zipf's law over the ranks; ``scores="model"``
takes the stored numbers instead), held as an integer of millionths so that sums are exact. The best
segmentation maximises the sum; among equal sums the one whose last piece starts first (the longest) wins.

Text becomes pieces as follows: a space is the marker U+2581, a non-empty text gets one marker in front,
characters without a piece, and a literal U+2581, fall back to the byte pieces of their UTF-8 form at
the least score minus 10 per character. Decoding reverses every step, so each text comes back exactly.

No piece has a marker after another character, so a segmentation never crosses the border before a marker: the
text is cut there and each unit is segmented once per task and remembered (bounded memory; the result
does not depend on it). A vocabulary with border-crossing pieces is handled without cutting.

Defined cases: null text gives null ids, empty text gives no ids; lone surrogates cannot occur in a Spark
string; repeated rows and ids are independent; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

MARK = "▁"
UNIT = 1_000_000
BYTE_PENALTY = 10 * UNIT
CACHE_UNITS = 300_000
LONG_UNIT = 96  # bytes; longer units are segmented one by one
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[at] & 0x7F) << shift
        shift += 7
        at += 1
        if b[at - 1] < 0x80:
            return out, at


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protocol-buffer message."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        if tag & 7 == 0:
            value, at = _varint(b, at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else _varint(b, at)
            value, at = b[at : at + size], at + size
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, stored score, type) by id. Types: 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte."""
    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for number, message in _fields(raw):
        if number == 1:
            m = dict(_fields(message))
            out.append((m[1].decode(), float(np.frombuffer(m.get(2, b"\0\0\0\0"), "<f4")[0]), m.get(3, 1)))
    return out


class DoubleArray:
    """Trie over UTF-8 bytes in two arrays: the child of ``s`` by byte ``c`` is ``base[s] + c + 1`` if ``check``
    there is ``s``; ``value[s]`` is the id of the piece that ends in ``s``, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, i in keys.items():
            s = 0
            for c in key:
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    ends.append(-1)
                s = children[s][c]
            ends[s] = i
        base, check, value = [0], [0], [-1]

        def grow(to: int) -> None:
            more = max(0, to - len(base)) + 4096
            base.extend([0] * more)
            check.extend([-1] * more)
            value.extend([-1] * more)

        # Nodes with one child fill the first gap; the others search forward from a place that moves on
        # after repeated failures, so construction stays linear in practice.
        gap = place = 300  # beyond every byte, so that a base is never below 1
        todo = [(0, 0)]
        while todo:
            node, at = todo.pop()
            value[at] = ends[node]
            codes = sorted(children[node])
            if not codes:
                continue
            if len(codes) == 1:
                while gap < len(check) and check[gap] >= 0:
                    gap += 1
                b = gap - codes[0] - 1
            else:
                b, tries = place, 0
                while any(b + c + 1 < len(check) and check[b + c + 1] >= 0 for c in codes):
                    b += 1
                    tries += 1
                if tries > 32:
                    place = b
            if b + 258 > len(base):
                grow(b + 258)
            base[at] = b
            for c in codes:
                check[b + c + 1] = at
                todo.append((children[node][c], b + c + 1))
        grow(len(base))
        self.base, self.check, self.value = base, check, value

    def prefixes(self, text: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, id) of every piece that starts at ``at``, shortest first."""
        base, check, value = self.base, self.check, self.value
        s = 0
        for i in range(at, len(text)):
            t = base[s] + text[i] + 1
            if check[t] != s or t == 0:
                return
            s = t
            if value[s] >= 0:
                yield i + 1, value[s]


class Unigram:
    def __init__(self, pieces: list[tuple[str, float, int]], scores: str = "zipf"):
        self.pieces = [p for p, _, _ in pieces]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4) and p]
        if scores == "zipf":
            rank = {i: r for r, (i, _, _) in enumerate(sorted(normal, key=lambda x: (-x[2], x[0])))}
            self.score = {i: -round(math.log(rank[i] + 1) * UNIT) for i, _, _ in normal}
        else:
            self.score = {i: round(s * UNIT) for i, _, s in normal}
        self.fallback = min(self.score.values(), default=0) - BYTE_PENALTY
        self.trie = DoubleArray({p.encode(): i for i, p, _ in normal})
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for _, p, _ in normal)
        self.normal = {i for i, _, _ in normal}

    def viterbi(self, unit: str) -> list[int]:
        """Ids of the best segmentation of one unit."""
        raw = unit.encode()
        n = len(raw)
        best: list[float] = [-math.inf] * (n + 1)
        back: list[tuple[int, int] | None] = [None] * (n + 1)
        best[0] = 0
        at = 0
        for ch in unit:
            width = len(ch.encode())
            if best[at] > -math.inf:
                whole = False
                for end, i in self.trie.prefixes(raw, at):
                    whole |= end == at + width
                    if best[at] + self.score[i] > best[end]:
                        best[end], back[end] = best[at] + self.score[i], (at, i)
                if not whole and best[at] + self.fallback > best[at + width]:
                    best[at + width], back[at + width] = best[at] + self.fallback, (at, -1)
            at += width
        out: list[int] = []
        while at:
            start, i = back[at]  # type: ignore[misc]
            out += [i] if i >= 0 else [self.byte_id[c] for c in reversed(raw[start:at])]
            at = start
        return out[::-1]

    def viterbi_batch(self, units: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of many units: the same recurrence as :meth:`viterbi`, one array step for all of them."""
        raws = [u.encode() for u in units]
        out: list[bytes] = [b""] * len(units)
        order = sorted(range(len(units)), key=lambda k: len(raws[k]))
        for at in range(0, len(order), 8192):
            chunk = order[at : at + 8192]
            short = [k for k in chunk if len(raws[k]) <= LONG_UNIT]
            for k in chunk[len(short) :]:
                out[k] = np.array(self.viterbi(units[k]), np.int32).tobytes()
            if short:
                for k, ids in zip(short, self._batch([raws[k] for k in short]), strict=True):
                    out[k] = ids
        return out

    def _batch(self, raws: list[bytes]) -> list[bytes]:
        base, check, value, score, byte_id = self.arrays
        n, size = len(raws), len(raws[-1])
        length = np.fromiter(map(len, raws), np.int64, n)
        text = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in raws), np.uint8).reshape(n, size).astype(np.int64)
        starts = (text & 0xC0) != 0x80
        best = np.full((n, size + 1), np.iinfo(np.int64).min)  # every character's start gets a score before it is read
        best[:, 0] = 0
        piece = np.full((n, size + 1), -1, np.int64)
        prev = np.tile(np.arange(-1, size), (n, 1))
        for i in range(size):
            row = np.flatnonzero((length > i) & starts[:, i])
            if not len(row):
                continue
            width = 1 + (text[row, i] >= 0xC0) + (text[row, i] >= 0xE0) + (text[row, i] >= 0xF0)
            whole = np.zeros(len(row), bool)
            live, state = np.arange(len(row)), np.zeros(len(row), np.int64)
            for j in range(i, size):
                t = base[state] + text[row[live], j] + 1
                ok = (check[t] == state) & (length[row[live]] > j)
                live, state = live[ok], t[ok]
                if not len(live):
                    break
                v = value[state]
                hit = v >= 0
                if hit.any():
                    k, v = live[hit], v[hit]
                    r = row[k]
                    whole[k] |= width[k] == j + 1 - i
                    new = best[r, i] + score[v]
                    up = new > best[r, j + 1]
                    r, v = r[up], v[up]
                    best[r, j + 1], piece[r, j + 1], prev[r, j + 1] = new[up], v, i
            r = row[~whole]
            if len(r):
                end = i + width[~whole]
                new = best[r, i] + self.fallback
                up = new > best[r, end]
                r, end = r[up], end[up]
                best[r, end], piece[r, end], prev[r, end] = new[up], -1, end - 1
        tokens = np.zeros((n, size), np.int32)  # filled from the right; a fallback walks back byte by byte
        place, count = length.copy(), np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            p = place[live]
            v = piece[live, p]
            count[live] += 1
            tokens[live, size - count[live]] = np.where(v >= 0, v, byte_id[text[live, p - 1]])
            place[live] = prev[live, p]
            live = live[place[live] > 0]
        return [tokens[k, size - c :].tobytes() for k, c in enumerate(count.tolist())]

    @cached_property
    def arrays(self) -> tuple[np.ndarray, ...]:
        score = np.zeros(len(self.pieces), np.int64)
        score[list(self.score)] = list(self.score.values())
        byte_id = np.zeros(256, np.int32)
        byte_id[list(self.byte_id)] = list(self.byte_id.values())
        check = np.array(self.trie.check)
        check[0] = -2  # the root is nobody's child
        return np.array(self.trie.base), check, np.array(self.trie.value), score, byte_id

    def units(self, text: str) -> list[str]:
        """Parts of the marked text that are segmented by themselves."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return _UNIT.findall(marked) if self.cuts else [marked]

    def encode(self, text: str) -> list[int]:
        if MARK not in text:
            return [i for u in self.units(text) for i in self.viterbi(u)]
        out: list[int] = []  # literal markers become byte pieces; what lies between is segmented as usual
        for k, part in enumerate(text.split(MARK)):
            if k:
                out += [self.byte_id[c] for c in MARK.encode()]
            marked = (MARK if not k else "") + part.replace(" ", MARK)
            for u in (_UNIT.findall(marked) if self.cuts else [marked] if marked else []):
                out += self.viterbi(u)
        return out

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes that each id stands for (markers are spaces), one after the other, with their starts and lengths."""
        spelled = [bytes((self.id_byte[i],)) if i in self.id_byte else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        sizes = np.array([len(x) for x in spelled], np.int64)
        return np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode_rows(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts of rows whose ids stand one after the other: row k has ids ``ends[k]..ends[k + 1]``. The marker
        in front of a text is taken off."""
        blob, starts, sizes = self.spelled
        n = sizes[ids]
        after = np.concatenate(([0], np.cumsum(n)))
        raw = blob[np.repeat(starts[ids] - after[:-1], n) + np.arange(after[-1])].tobytes()
        cut = after[ends].tolist()
        return [raw[a + 1 : b] for a, b in zip(cut, cut[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_rows(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode()


# A run of markers with what follows up to the next marker.
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@lru_cache(maxsize=2)
def model(path: str, scores: str = "zipf") -> Unigram:
    return Unigram(read_pieces(path), scores)


SCHEMA = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("n_byte_tokens", LongType()), StructField("round_trip", BooleanType()), StructField("ids", ArrayType(IntegerType()))])


def encode_documents(docs: DataFrame, path: str = DEFAULT_MODEL, scores: str = "zipf") -> DataFrame:
    """One row per document: token ids, their number, and whether decoding the row's ids gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, scores)
        is_byte = np.zeros(len(m.pieces), bool)
        is_byte[list(m.id_byte)] = True
        known: dict[str, bytes] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                if len(known) > CACHE_UNITS:
                    known = {}
                cut = [None if t is None or MARK in t else m.units(t) for t in texts]
                new = list({u for units in cut if units for u in units if u not in known})
                for u, ids in zip(new, m.viterbi_batch(new), strict=True):
                    known[u] = ids
                rows = []
                for text, units in zip(texts, cut, strict=True):
                    if text is None:
                        rows.append(None)
                    elif units is None:
                        rows.append(np.array(m.encode(text), np.int32))
                    else:
                        rows.append(np.frombuffer(b"".join([known[u] for u in units]), np.int32))
                sizes = [0 if r is None else len(r) for r in rows]
                values = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.int32)])
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
                back = [raw == (text or "").encode() for raw, text in zip(m.decode_rows(values, ends), texts, strict=True)]
                bytes_before = np.concatenate(([0], np.cumsum(is_byte[values])))
                none = pa.array([r is None for r in rows])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()), mask=none)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(bytes_before[ends[1:]] - bytes_before[ends[:-1]], pa.int64()), pa.array(back), ids],
                    names=SCHEMA.fieldNames(),
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def decode_ids(encoded: DataFrame, path: str = DEFAULT_MODEL, scores: str = "zipf") -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    from kanon.llm.common import map_arrow
    from pyspark.sql.types import StringType

    def run(rows: list[tuple]) -> list[tuple]:
        m = model(path, scores)
        ids = [r[1] or [] for r in rows]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        texts = m.decode_rows(np.array([x for y in ids for x in y], np.int64), ends)
        return [(i, None if own is None else raw.decode()) for (i, own), raw in zip(rows, texts, strict=True)]

    return map_arrow(encoded.select("doc_id", "ids"), run, StructType([StructField("doc_id", LongType()), StructField("text", StringType())]))
