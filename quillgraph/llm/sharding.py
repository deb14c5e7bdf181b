"""Reproducible sharding by a Feistel permutation over global row numbers.

Row numbers come from file offsets (no shuffle, see ``_shared.number_rows``). A generalized
Feistel network permutes the smallest a x b grid that holds the n rows; numbers that leave
0..n-1 walk the cycle until they are back. Position p goes to shard p mod k, slot p div k:
shards differ by one row at most, slots have no gaps, and both can be computed from a row
number alone (``position``). Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import _shared

#: A prime below 2^31: products of two residues stay within 63 bits.
PRIME = 2_147_483_647


def round_keys(seed: int, rounds: int) -> list[tuple[int, int]]:
    keys, x = [], (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            pair.append((x >> 33) % (PRIME - 2) + 1)
        keys.append((pair[0], pair[1]))
    return keys


def grid(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, -(-max(n, 1) // a)


def _once(row: np.ndarray, n: int, seed: int, rounds: int) -> np.ndarray:
    """One pass of the network over the grid."""
    a, b = grid(n)
    x, y, p, q = row // b, row % b, a, b
    for mul, add in round_keys(seed, rounds):
        u = (y * mul + add) % PRIME
        x, y, p, q = y, (x + ((u * u + add) % PRIME ^ u)) % p, q, p
    return x * b + y


def position(row: int, n: int, seed: int = 1, rounds: int = 8) -> int:
    """The permuted position of one row number."""
    at = _once(np.array([row], dtype=np.int64), n, seed, rounds)
    while at[0] >= n:
        at = _once(at, n, seed, rounds)
    return int(at[0])


def longest_walk(n: int, seed: int = 1, rounds: int = 8) -> int:
    """Passes that the longest cycle walk needs after its first.

    Walks pass through numbers from n on only, fewer than the square root of n plus one; all
    that a row can come to first are walked to their ends.
    """
    a, b = grid(n)
    outside = np.arange(n, a * b, dtype=np.int64)
    walked, steps = np.setdiff1d(outside, _once(outside, n, seed, rounds)), 0
    while len(walked):
        walked, steps = _once(walked, n, seed, rounds), steps + 1
        walked = walked[walked >= n]
    return steps


def _permuted(row: Column, a: int, b: int, seed: int, rounds: int) -> Column:
    """One pass of the network. Rounds are even in number, so the halves end as they began."""
    keys = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c")) for m, c in round_keys(seed, rounds)])

    def step(acc: Column, key: Column) -> Column:
        mixed = F.transform(
            F.array(F.pmod(acc["y"] * key["m"] + key["c"], F.lit(PRIME).cast("long"))),
            lambda u: F.pmod(acc["x"] + F.pmod(u * u + key["c"], F.lit(PRIME).cast("long")).bitwiseXOR(u), acc["p"]),
        )
        return F.struct(acc["y"].alias("x"), mixed[0].alias("y"), acc["q"].alias("p"), acc["p"].alias("q"))

    halves = F.struct(
        F.call_function("div", row, F.lit(b).cast("long")).alias("x"),
        F.pmod(row, F.lit(b).cast("long")).alias("y"),
        F.lit(a).cast("long").alias("p"),
        F.lit(b).cast("long").alias("q"),
    )
    return F.aggregate(keys, halves, step, lambda acc: acc["x"] * F.lit(b).cast("long") + acc["y"])


def permuted(row: Column, n: int, seed: int = 1, rounds: int = 8) -> Column:
    """``position`` as a column expression."""
    a, b = grid(n)
    end = F.lit(n).cast("long")

    def walk(acc: Column, _: Column) -> Column:
        return F.when(acc < end, acc).otherwise(_permuted(acc, a, b, seed, rounds))

    first, steps = _permuted(row, a, b, seed, rounds), longest_walk(n, seed, rounds)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, walk) if steps else first


def shard(docs: DataFrame, shards: int = 16, seed: int = 1, rounds: int = 8) -> DataFrame:
    """(doc_id, text, row_number, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``law`` is "rows" (counts differ by one at most) and ``grown_shard`` NULL. ``size`` is the
    UTF-8 bytes of the text plus one (1 for a NULL text, whose CRC is that of nothing).
    Rows count by position, so repeated rows and NULL ids each get a slot; other columns of
    the input are ignored, also those named like a result; an empty table gives an empty
    result. The same files give the same shards and slots on any cluster.
    """
    rows, n = _shared.number_rows(docs, _shared.column_or_null(docs, "doc_id", "long").alias("doc_id"), F.col("text").cast("string").alias("text"), name="row_number")
    at = rows.withColumn("_p", permuted(F.col("row_number"), n, seed, rounds))
    filled = F.coalesce(F.col("text"), F.lit(""))
    return at.select(
        "doc_id",
        "text",
        "row_number",
        (F.octet_length(filled).cast("long") + 1).alias("size"),
        F.crc32(filled).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.pmod("_p", F.lit(shards).cast("long")).cast("int").alias("shard"),
        F.call_function("div", F.col("_p"), F.lit(shards).cast("long")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 1) -> None:
    """Write one folder a shard, each sorted by slot within its files.

    Every row is written, also repeated rows and those with a NULL id or text (which stay NULL);
    an empty table leaves a folder without shards; a folder that exists is an error and stays.
    """
    out = shard(docs, shards, seed)
    out.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
