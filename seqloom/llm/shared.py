"""What the training-data operators use of the library's tables module, and filters of a fixed size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import SALTS, Forest, by_salt, components, discard, group_values, in_units, lookup, materialize, salt_of, salts_in_use, shared_dir, whole_units

__all__ = ["SALTS", "Forest", "bloom_bits", "by_salt", "components", "discard", "group_values", "in_bloom", "in_units", "lookup", "materialize", "mark_among", "salt_of", "salts_in_use", "shared_dir", "whole_units"]

#: Bits of a Bloom filter, whatever the input: one that is full passes all, and the join that follows decides alone.
BLOOM_BITS = 1 << 24
#: Places of a 64-bit hash in the filter: the 24 bits from each of these on.
PLACES = (0, 20, 40)


def bloom_bits(hashes: DataFrame) -> np.ndarray:
    """The filter of the first column (a well-mixed long), as bytes. The driver gathers its words, at most BLOOM_BITS / 64."""
    h = hashes.columns[0]
    at = F.explode(F.array(*(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(BLOOM_BITS - 1)) for k in PLACES))).alias("p")
    words = hashes.select(at).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(BLOOM_BITS // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return table.view(np.uint8)


def in_bloom(octets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (64-bit numbers) the filter may hold."""
    ok = np.ones(len(hashes), bool)
    for k in PLACES:
        p = (hashes.view(np.uint64) >> np.uint64(k)) & np.uint64(BLOOM_BITS - 1)
        ok &= (octets[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def mark_among(rows: DataFrame, hash_: Column, hashes: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: whether the row's hash may be among the first column of ``hashes``. False is certain.

    A join with a bitmap of BLOOM_BITS bits, one word a row: at most BLOOM_BITS / 64 rows of two longs whatever the
    input, so it is broadcast. No row goes to Python or through a shuffle.
    """
    at = lambda h: h.bitwiseAND(F.lit(BLOOM_BITS - 1))
    p = at(F.col(hashes.columns[0]))
    words = hashes.select(F.shiftright(p, 6).alias("_seqloom_w"), p.alias("p"))
    words = words.groupBy("_seqloom_w").agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("_seqloom_b"))
    marked = rows.withColumn("_seqloom_p", at(hash_)).withColumn("_seqloom_w", F.shiftright("_seqloom_p", 6))
    marked = marked.join(F.broadcast(materialize(words, "bitmap")), "_seqloom_w", "left")
    bit = F.getbit("_seqloom_b", F.col("_seqloom_p").bitwiseAND(F.lit(63)).cast("int")) == 1
    return marked.withColumn(out, F.coalesce(bit, F.lit(False))).drop("_seqloom_w", "_seqloom_b", "_seqloom_p")
