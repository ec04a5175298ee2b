"""Sharding by a Feistel permutation over global row numbers (operator 8).

Rows get global numbers 0..N-1 in the order of (doc_id, size, CRC). A keyed Feistel network permutes the
smallest even-bit domain that holds N; numbers that leave 0..N-1 walk the cycle until they are back, so
the result is a permutation of exactly N. Place p means shard ``p mod shards``, slot ``p div shards``:
shard counts differ by one row at most, slots have no gap, and both follow from (row number, N, key)
alone, so any row's place can be computed, and inverted, without the data.

Defined cases: null text has size 1 and the CRC of no bytes; null ids sort first; repeated rows are
rows of their own (equal rows may swap numbers among themselves); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kanon.llm.common import written

ROUNDS = 6
MASK = (1 << 64) - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Keys of the rounds by the SplitMix64 sequence."""
    keys = []
    for _ in range(rounds):
        seed = (seed + 0x9E3779B97F4A7C15) & MASK
        z = (seed ^ seed >> 30) * 0xBF58476D1CE4E5B9 & MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
        keys.append(z ^ z >> 31)
    return keys


def half_bits(n: int) -> int:
    """Bits of one half of the smallest domain 4**h that holds n numbers."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    z = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(32)


def permute(x: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Place of each row number 0 <= x < n (or, inverse, the row number of each place)."""
    h = np.uint64(half_bits(n))
    low = np.uint64((1 << int(h)) - 1)
    keys = round_keys(seed)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & low), left
            else:
                left, right = right, left ^ (_mix(right, k) & low)
        return left << h | right

    out = once(x.astype(np.uint64))
    while (far := out >= n).any():  # cycle walking: back into 0..n-1 after finitely many steps
        out[far] = once(out[far])
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` 0..N-1 in the order of ``order``, and N.

    A range shuffle sorts; the sorted rows are written once, so each file's rows keep their place; the
    number is the place in its partition plus the rows of the partitions before. Only one count per
    partition reaches the driver.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fixed = written(sorted_rows.select("*", place.alias("_place")), "numbered").select(
        "*", F.shiftright("_place", 33).cast("int").alias("_part"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    )
    counts = sorted((r[0], r[1]) for r in fixed.groupBy("_part").count().collect())  # one row per partition
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    offset = spark.createDataFrame(offsets, "_part int, _before long")
    return fixed.join(F.broadcast(offset), "_part").select(*df.columns, (F.col("_at") + F.col("_before")).alias("row_number")), total


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """One row per document: size, text_crc32, row_number, place, shard, slot under the ``rows`` law."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows, n = numbered(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), ["doc_id", "size", "text_crc32"])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(permute(x.to_numpy(), n, seed))

    place = F.pandas_udf(run, "long")  # type: ignore[call-overload]
    p = F.col("place")
    return rows.withColumn("place", place("row_number")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (p % shards).cast("int").alias("shard"), F.floor(p / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "place",
    )
