"""Uniform shuffle into shards of equal row counts by a hypergeometric communication matrix.

How many rows partition p sends to shard s, in a uniform random shuffle with fixed shard sizes, follows a
multivariate hypergeometric law. The matrix of these counts is drawn first; then rows are permuted within
their partition, cut by the matrix's row, exchanged, and permuted again within their shard. The result is
distributed as a uniform permutation of all rows, with exact shard sizes, and needs no global sort.

Only DataFrame functions touch rows. The driver draws the matrix: partitions x shards numbers.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed

#: Rows of a permutation block: the largest group that one task sorts. A shard is cut into such blocks.
BLOCK_ROWS = 200_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw of the number of good items among ``draws`` from ``good + bad`` without replacement.

    Inversion outwards from the mode: the work is in the order of the standard deviation, whatever the size.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    lf = math.lgamma
    p = math.exp(
        lf(good + 1) - lf(mode + 1) - lf(good - mode + 1) + lf(bad + 1) - lf(draws - mode + 1) - lf(bad - draws + mode + 1) - lf(total + 1) + lf(draws + 1) + lf(total - draws + 1)
    )
    left = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode  # rounding has left a rest below the smallest probability


def communication_matrix(rows: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """Counts of rows from each partition to each shard; shard sizes differ by at most one."""
    total, rng = sum(rows), random.Random(seed)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in rows:
        line, left, rest = [], n, sum(free)
        for s in range(shards):
            rest -= free[s]
            take = hypergeometric(rng, free[s], rest, left)
            line.append(take)
            left -= take
        free = [f - t for f, t in zip(free, line, strict=True)]
        matrix.append(line)
    return matrix


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 42, columns: Sequence[Column] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``columns`` of every row of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard).

    Every row counts, null columns and repeated rows included; an empty table gives an empty result. Only
    the narrow ``columns`` are exchanged. They must not be named ``shard``, ``slot`` or begin with ``_s``.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    # The identity of a row is its place in the scan; the checkpoint fixes it against recomputation.
    rows = checkpointed(df.select(*columns, F.monotonically_increasing_id().alias("_s_row")))
    names = [c for c in rows.columns if c != "_s_row"]
    # A source partition is cut into runs, so that a very large one is no large group.
    part = F.concat_ws(":", F.shiftright("_s_row", 33), F.floor(F.col("_s_row").bitwiseAND(2**33 - 1) / block_rows))
    rows = rows.withColumn("_s_part", part)
    counts = {r["_s_part"]: r["n"] for r in rows.groupBy("_s_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    bounds = []
    for p, line in zip(parts, matrix, strict=True):
        ends, at = [], 0
        for n in line:
            at += n
            ends.append(at)
        bounds.append((p, ends))
    # One row per block of rows: smaller than the data by the block size.
    cuts = df.sparkSession.createDataFrame(bounds, "_s_part string, _s_ends array<bigint>")
    local = Window.partitionBy("_s_part").orderBy(F.xxhash64(F.lit(seed), "_s_row"), "_s_row")
    ranked = rows.withColumn("_s_rank", F.row_number().over(local)).join(cuts, "_s_part")
    sent = ranked.withColumn("shard", F.size(F.filter("_s_ends", lambda e: e < F.col("_s_rank"))))
    # Second permutation: hash order within the shard, in blocks that one task sorts.
    most = sum(counts.values()) // shards + 1
    blocks = max(1, math.ceil(most / block_rows))
    key = F.xxhash64(F.lit(seed + 1), "_s_row")
    sent = checkpointed(sent.select(*names, "_s_row", "shard", key.alias("_s_key"), F.pmod(F.shiftright(key, 20), F.lit(blocks)).cast("int").alias("_s_block")))
    sizes = sent.groupBy("shard", "_s_block").agg(F.count(F.lit(1)).alias("_s_n"))
    before = sizes.withColumn("_s_from", F.sum("_s_n").over(Window.partitionBy("shard").orderBy("_s_block")) - F.col("_s_n")).drop("_s_n")
    place = Window.partitionBy("shard", "_s_block").orderBy("_s_key", "_s_row")
    out = sent.withColumn("_s_at", F.row_number().over(place)).join(before, ["shard", "_s_block"])
    return out.select(*names, F.col("shard").cast("int").alias("shard"), (F.col("_s_from") + F.col("_s_at") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Shard, slot and check values of each document, under the law ``rows``.

    A null text has no bytes (size 8, check value 0); a null id is kept as it is.
    """
    text = F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8")
    columns = [F.col(id_column).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]
    out = shuffle_to_shards(docs, shards, seed, columns)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
