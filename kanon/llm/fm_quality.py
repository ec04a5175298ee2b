"""Quality classifier (operator 5): a factorisation machine over hashed words, structure and metadata.

``score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairwise part is computed in
linear time as ``(||V'x||^2 - sum_i ||v_i||^2 x_i^2) / 2``.

Features come from the whole text and nothing else: square-rooted shares of words hashed into ``words``
buckets, structure statistics (symbols, separators, capitals, repetition, line and word lengths) and the
text's size as metadata. Labels, lang, source and doc_id are never inputs.

The model is fitted on a bounded sample: at most ``FIT_ROWS`` labelled documents outside the held-out
fold (crc32 of the id as text mod 5 = 0), those with the smallest hash of their id. Only their feature
vectors reach the driver. Scoring covers every document.

Defined cases: null text is empty and has a score as any other; ids labelled 0 and 1 at once are not
learned from; null labels and ids are skipped in fitting; a null id is not held out; with no labels
every score is 0.5, with a single class it is that class's smoothed rate; repeated rows score alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from kanon.llm.common import map_arrow

FIT_ROWS = 6000
BUCKETS = 512
RANK = 8
THRESHOLD = 0.3
STRUCTURE = 16


def _bucket(word: bytes) -> int:
    import zlib

    return zlib.crc32(word) % BUCKETS


def structure(text: str, words: list[bytes]) -> list[float]:
    """Statistics between about 0 and 2 of the shape and size of a text."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upper = float(((raw >= 65) & (raw <= 90)).sum()) / chars
    distinct = len(set(words))
    symbols = sum(map(text.count, "#*$%&<>"))
    stops = sum(map(text.count, ".!?"))
    return [
        math.log1p(n) / 8,
        math.log1p(chars) / 10,
        min(2.0, 4 * symbols / n),
        min(2.0, 4 * text.count("|") / n),
        min(2.0, 2 * text.count("!!") / n),
        2 * upper,
        distinct / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n * 2,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / n if n > 2 else 0.0,
        min(2.0, math.log1p(n / max(1, len(lines))) / 3),
        1 - len(set(lines)) / max(1, len(lines)),
        min(2.0, chars / n / 8),
        min(2.0, 10 * stops / n),
        min(2.0, 8 * text.count(",") / n),
        min(2.0, 10 * sum(map(text.count, "0123456789")) / chars),
        float(n < 10),
    ]


def features(texts: list[str | None], cache: dict[bytes, int]) -> np.ndarray:
    """Dense rows: ``BUCKETS`` word shares (square root), then ``STRUCTURE`` statistics."""
    out = np.zeros((len(texts), BUCKETS + STRUCTURE), np.float32)
    for k, text in enumerate(texts):
        text = text or ""
        words = text.encode("utf-8", "replace").split()
        if words:
            if len(cache) > 500_000:
                cache.clear()
            ids = []
            for w in words:
                b = cache.get(w)
                if b is None:
                    b = cache[w] = _bucket(w.lower().strip(b".,;:!?"))
                ids.append(b)
            out[k, :BUCKETS] = np.sqrt(np.bincount(ids, minlength=BUCKETS) / len(words))
        out[k, BUCKETS:] = structure(text, words)
    return out


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) * self.scale
        z = self.w0 + x @ self.w + 0.5 * (((x @ self.v) ** 2) - (x**2) @ (self.v**2)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def fit(x: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = 40, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """Mini-batch Adam on the logistic loss; deterministic for a given order of rows."""
    d = x.shape[1]
    mean, scale = (x.mean(0), 1 / (x.std(0) + 0.05)) if len(x) else (np.zeros(d, np.float32), np.ones(d, np.float32))
    scale[:BUCKETS] *= 0.3  # many weak word features beside few strong ones
    rng = np.random.default_rng(seed)
    p = (float(y.sum()) + 1) / (len(y) + 2) if len(y) else 0.5
    m = FactorisationMachine(math.log(p / (1 - p)), np.zeros(d, np.float32), rng.normal(0, 0.01, (d, rank)).astype(np.float32), mean, scale)
    if len(y) == 0 or y.min() == y.max():
        m.v[:] = 0
        return m
    z = ((x - mean) * scale).astype(np.float32)
    state = [(np.zeros_like(a), np.zeros_like(a)) for a in (m.w, m.v)]
    b0 = [0.0, 0.0]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            b = order[at : at + batch]
            xb = z[b]
            xv = xb @ m.v
            out = m.w0 + xb @ m.w + 0.5 * (xv**2 - (xb**2) @ (m.v**2)).sum(1)
            g = ((1 / (1 + np.exp(-np.clip(out, -30, 30)))) - y[b]).astype(np.float32) / len(b)
            grads = (xb.T @ g + decay * m.w, xb.T @ (g[:, None] * xv) - ((xb**2).T @ g)[:, None] * m.v + decay * m.v)
            step += 1
            for a, gr, (s1, s2) in zip((m.w, m.v), grads, state, strict=True):
                s1 += 0.1 * (gr - s1)
                s2 += 0.001 * (gr**2 - s2)
                a -= rate * (s1 / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.999**step)) + 1e-8)
            b0[0] += 0.1 * (float(g.sum()) - b0[0])
            b0[1] += 0.001 * (float(g.sum()) ** 2 - b0[1])
            m.w0 -= rate * (b0[0] / (1 - 0.9**step)) / (math.sqrt(b0[1] / (1 - 0.999**step)) + 1e-8)
    return m


def fold() -> F.Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> FactorisationMachine:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y"))
    sample = known.where("y = _y").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # The sample is bounded by ``most``, so it may be broadcast; one row per id.
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    def run(rows: list[tuple]) -> list[tuple]:
        x = features([r[2] for r in rows], {})
        return [(r[0], int(r[1]), v.tolist()) for r, v in zip(rows, x, strict=True)]

    schema = StructType([StructField("doc_id", LongType()), StructField("y", IntegerType()), StructField("x", ArrayType(FloatType()))])
    got = map_arrow(joined, run, schema).dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    y = got.column("y").to_numpy().astype(np.float32)
    x = np.array(got.column("x").combine_chunks().flatten(), np.float32).reshape(len(y), BUCKETS + STRUCTURE)
    return fit(x, y)


SCHEMA = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType())])


def score_documents(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """One row per document: held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s = model.score(features(part.column(1).to_pylist(), cache))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
