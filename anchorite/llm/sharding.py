"""Sharding by a uniform shuffle with exact shard sizes.

Exact counts of the rows that each partition sends to each shard are drawn from
the multivariate hypergeometric distribution (rows of a partition by shard
sizes); each partition is permuted by a keyed hash and dealt out by those
counts; after the exchange each shard is permuted again. Given the counts, both
permutations make every arrangement equally likely, and shard sizes are at most
one apart. Only DataFrame functions touch the rows; the driver draws the matrix
of partitions by shards.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frames

SHARDS, SEED = 24, 20_240_601
#: Rows that one task ranks in the second permutation; a shard with more is ranked in parts of its hash range.
RANK_ROWS = 1_000_000
#: Partitions of the matrix; those of a scan with more are folded together, so the matrix has a fixed size.
MAX_PARTS = 4096
LAW = "rows"


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` taken without replacement: inversion that goes out from the mode on both sides."""
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    top = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - top
    down, up, p, q = mode, mode, top, top
    while u > 0 and (down > lo or up < hi):
        if down > lo:
            p *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p
            if u <= 0:
                return down
        if up < hi:
            q *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= q
            if u <= 0:
                return up
    return mode


def matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts from each partition to each shard, with the rows of partitions and shard sizes at most one apart as margins."""
    rng = random.Random(seed)
    total = sum(rows)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    rng.shuffle(left)
    out = []
    for n in rows:
        rest, line = sum(left), []
        for s in range(shards):
            k = hypergeometric(rng, left[s], rest - left[s], n)
            rest -= left[s]
            n -= k
            line.append(k)
        left = [a - k for a, k in zip(left, line, strict=True)]
        out.append(line)
    return out


def shuffle_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each input row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``).

    A null text has size 8 and the crc32 of no bytes; ids may be null. Repeated
    rows each get a place of their own, in any order among them. An empty input
    gives no rows. Other columns are ignored. Partitions are those of the scan,
    written down before any count is drawn, so a lost executor changes nothing.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), (F.spark_partition_id() % MAX_PARTS).alias("part"), F.monotonically_increasing_id().alias("uid"))
    thin = frames.stored(thin, "thin")
    counts = sorted((r[0], r[1]) for r in thin.groupBy("part").count().collect())
    total = sum(n for _, n in counts)
    cuts = []
    for (part, _), line in zip(counts, matrix([n for _, n in counts], shards, seed), strict=True):
        cuts.append((part, [sum(line[: s + 1]) for s in range(shards)]))
    # At most MAX_PARTS rows of a fixed width.
    ends = F.broadcast(spark.createDataFrame(cuts, "part int, ends array<long>"))
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "uid", "doc_id", "text_crc32"), "uid")
    ranked = thin.withColumn("k", F.row_number().over(local)).join(ends, "part")
    dealt = ranked.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("k"))).cast("int"))
    again = F.xxhash64(F.lit(seed + 1), "uid", "doc_id", "text_crc32")
    parts = max(1, -(-total // (shards * RANK_ROWS)))
    dealt = dealt.select("doc_id", "size", "text_crc32", "uid", "shard", again.alias("h")).withColumn("sub", F.pmod(F.shiftrightunsigned("h", 20), F.lit(parts)).cast("int"))
    if parts > 1:
        dealt = frames.stored(dealt, "dealt")
        before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
        base = F.broadcast(dealt.groupBy("shard", "sub").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"))
        dealt = dealt.join(base, ["shard", "sub"])
    else:
        dealt = dealt.withColumn("base", F.lit(0).cast("long"))
    slot = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("h", "uid")) - 1 + F.col("base")
    return dealt.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_shards(frames.table(spark, sf_dir, "documents"))
