"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into three segments. Two fingerprints within four bits differ in at most one bit in one
of the segments, so each segment is a hash table: a fingerprint stands in the table under its own segment,
and looks up the Hamming ball of radius one around it. Of two segments that differ in one bit, one has a
zero there, so only zero bits are flipped. Table matches are verified on complete fingerprints.

Equal fingerprints are one node. Buckets with many different fingerprints are cut into blocks, and every
pair of blocks is a cell that any task can take; a cell emits a spanning forest of its links, never its
pairs, so the output is linear in the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, id_text
from tessella.llm.components import connected_components

BITS = 64
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Different fingerprints in one bucket beyond which it is cut into blocks of this size.
BLOCK = 4096
LEFT, RIGHT = 1, 2


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of the text with A-Z lower-cased; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[s:e], 42) for s, e in spans], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """``id, fp, th`` of every row: its fingerprint as a signed long, and the hash of its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((majority(shingle_hashes(t, width)) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"id": b["id"], "th": b["th"], "fp": fps.view(np.int64)})

    text = F.col(text_column).cast("string")
    rows = docs.select(id_text(id_column).alias("id"), _text_hash(text_column).alias("th"), text.alias("text"))
    return rows.mapInPandas(run, "id string, th long, fp long").select(F.col("id").cast("long").alias("id"), "fp", "th")


def _text_hash(text_column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))


class Forest:
    """Union-find over positions 0..n-1 in vectorised steps."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b = a[apart], b[apart]
            if not len(a):
                return
            low, high = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def cell_links(cell: np.ndarray, role: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of all left-right pairs within ``distance`` bits that share a cell."""
    nodes, at = np.unique(fps, return_inverse=True)
    value, forest = nodes.view(np.uint64), Forest(len(nodes))
    left, right = np.flatnonzero(role & LEFT), np.flatnonzero(role & RIGHT)
    left, right = left[np.argsort(cell[left], kind="stable")], right[np.argsort(cell[right], kind="stable")]
    cells = np.unique(cell[left])
    l0, l1 = np.searchsorted(cell[left], cells), np.searchsorted(cell[left], cells, "right")
    r0, r1 = np.searchsorted(cell[right], cells), np.searchsorted(cell[right], cells, "right")
    nl, nr = l1 - l0, r1 - r0
    pairs = nl * nr

    def link(li: np.ndarray, ri: np.ndarray) -> None:
        a, b = at[left[li]], at[right[ri]]
        near = (a != b) & (np.bitwise_count(value[a] ^ value[b]) <= distance)
        forest.add(a[near], b[near])

    small = np.flatnonzero((pairs > 0) & (pairs <= 1 << 16))
    ends = np.cumsum(pairs[small])
    i = 0
    while i < len(small):  # about two million pairs at a time
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 21), "right")))
        g = small[i:j]
        which = np.repeat(np.arange(len(g)), pairs[g])
        off = np.arange(len(which)) - np.repeat(np.cumsum(pairs[g]) - pairs[g], pairs[g])
        link(l0[g][which] + off // nr[g][which], r0[g][which] + off % nr[g][which])
        i = j
    for g in np.flatnonzero(pairs > 1 << 16):
        step = max(1, (1 << 20) // int(nr[g]))
        for s in range(int(l0[g]), int(l1[g]), step):
            e = min(s + step, int(l1[g]))
            li = np.repeat(np.arange(s, e), nr[g])
            link(li, np.tile(np.arange(r0[g], r1[g]), e - s))
    moved = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[moved], nodes[forest.root[moved]]


def near_links(nodes: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the fingerprints (distinct column ``fp``) within ``distance`` bits."""
    if not 0 <= distance <= 2 * len(SEGMENTS) - 1:
        raise ValueError(f"radius one in {len(SEGMENTS)} segments finds at most {2 * len(SEGMENTS) - 1} bits")
    exact, ball = [], []
    for s, (low, width) in enumerate(SEGMENTS):
        own = F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1)
        key = F.lit(s << 32).bitwiseOR(own)
        exact.append(F.struct(key.alias("key"), F.lit(True).alias("own")))
        for bit in range(width):
            flipped = F.when(own.bitwiseAND(1 << bit) == 0, key.bitwiseOR(F.lit(1 << bit)))
            ball.append(F.struct(flipped.alias("key"), F.lit(False).alias("own")))
    keyed = nodes.select("fp", F.explode(F.array(*exact, *ball)).alias("k")).select("fp", "k.key", "k.own").filter("key is not null")
    hot = nodes.select(F.explode(F.array(*[e["key"] for e in exact])).alias("key")).groupBy("key").count().filter(F.col("count") > block)
    hot = checkpointed(hot.select("key", F.ceil(F.col("count") / block).cast("int").alias("k")))
    if hot.isEmpty():
        cells = keyed.select("fp", F.struct("key", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("c"), F.when(F.col("own"), LEFT + RIGHT).otherwise(RIGHT).alias("role"))
    else:
        cut = keyed.join(hot, "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        every = F.sequence(F.lit(0), F.col("k") - 1)
        as_left = F.transform(every, lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(LEFT).alias("role")))
        as_right = F.transform(every, lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(RIGHT).alias("role")))
        places = F.when(F.col("own"), F.concat(as_left, as_right)).otherwise(as_right)
        cells = cut.select("fp", "key", F.explode(places).alias("p")).select("fp", F.struct("key", "p.i", "p.j").alias("c"), F.col("p.role").alias("role"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A partition is sorted by cell: whole cells are processed as they fill a chunk.
        held: list[pd.DataFrame] = []
        rows = 0

        def flush(parts: list[pd.DataFrame]) -> pd.DataFrame:
            all_ = pd.concat(parts, ignore_index=True)
            a, b = cell_links(all_["cell"].to_numpy(np.int64), all_["role"].to_numpy(np.int8), all_["fp"].to_numpy(np.int64), distance)
            return pd.DataFrame({"a": a, "b": b})

        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= 1 << 20:
                all_ = pd.concat(held, ignore_index=True)
                cut_at = int(np.argmax(all_["cell"].to_numpy() == all_["cell"].iloc[-1]))  # the first row of the unfinished cell
                yield flush([all_.iloc[:cut_at] if cut_at else all_])
                rest = all_.iloc[cut_at:]
                if not cut_at:  # a long cell: its left rows came first and wait for the remaining right rows
                    rest = rest[(rest["role"] & LEFT) > 0].assign(role=np.int8(LEFT))
                held, rows = [rest], len(rest)
        if rows:
            yield flush(held)

    # The cell's hash stands for the cell: a collision only adds pairs, which are verified all the same.
    placed = cells.select("fp", F.xxhash64("c.key", "c.i", "c.j").alias("cell"), F.col("role").cast("byte").alias("role"))
    placed = placed.repartition("cell").sortWithinPartitions("cell", F.col("role") % 2 == 0)
    return placed.mapInPandas(run, "a long, b long")


def _grouped(rows: DataFrame, distance: int) -> DataFrame:
    """``fp, root``: the group of each different fingerprint; the groups of fingerprints without links are left out."""
    return connected_components(near_links(rows.select("fp").distinct(), distance)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    The component is the smallest id that is reachable over fingerprints within ``distance`` bits. Rows with
    equal fingerprints are always together; texts without words have fingerprint zero and link like others. A
    null text counts as empty. A null id is never the smallest; a component of null ids only has a null
    component. Repeated rows each give a row. An empty table gives no rows. A text of any length counts whole. Only the
    two named columns are read, so others may have any name.
    """
    rows = checkpointed(fingerprints(docs, id_column, text_column, width).select("id", "fp"))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = checkpointed(_grouped(nodes, distance))
    # The least id of a group is a partial aggregate; only nodes that are linked need it, so no group meets in one task.
    least = nodes.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(least, "root").select("fp", "component_id")
    placed = nodes.join(of, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(placed, "fp").select(F.col("id").alias("doc_id"), text.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: one row of each group stays.

    That is the row with the smallest id (no id comes last), then the smallest text hash; of rows that repeat both, one.
    """
    rows = checkpointed(fingerprints(docs, id_column, text_column, width))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(order).alias("first")))
    roots = checkpointed(_grouped(nodes, distance))
    # Partial aggregates only: a hot group is one row per fingerprint, then one per task.
    placed = nodes.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("id"), F.col("first.th").alias("th"))
    # Rows that repeat id and text are one row; they collapse within their partition before anything is exchanged.
    mark, own = "_" + max([*docs.columns, ""], key=len), F.col(id_column).cast("long")
    none, key, th = f"{mark}n", f"{mark}i", f"{mark}t"
    rows_of = docs.select(own.isNull().alias(none), F.coalesce(own, F.lit(0)).alias(key), _text_hash(text_column).alias(th), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(mark))
    one = rows_of.groupBy(none, key, th).agg(F.first(mark).alias(mark))
    wanted = kept.select(F.col("id").isNull().alias(none), F.coalesce("id", F.lit(0)).alias(key), F.col("th").alias(th))
    return one.join(wanted, [none, key, th], "left_semi").select(F.col(f"{mark}.*"))
