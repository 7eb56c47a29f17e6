"""Best-fit packing into bins of several permitted lengths.

Pieces are placed by falling size. A piece goes to the open bin that it fits most tightly. If none has room, all permitted
lengths are weighed against each other: each is filled, on trial, with the largest pieces that are left and still fit, and
the length with the least cost per packed word is opened. A bin costs the positions of the smallest permitted length that
holds its contents, and a fixed amount for being a sequence. When all pieces are placed, each bin is cut down to that
length.

Pieces are dealt to independent groups by a hash of document and piece. A group holds a bounded amount of text, whatever
the input, and leaves at most a few bins partly filled, so its loss is a constant share.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, id_text

#: Permitted sequence lengths, in words, and what a sequence costs besides its positions.
LENGTHS, OVERHEAD = (512, 1024, 2048, 4096), 8
#: Characters of the texts per group of pieces.
GROUP = 3_000_000


class Left:
    """The sizes that are still to be placed."""

    def __init__(self, sizes: Sequence[int]) -> None:
        self.count: dict[int, int] = {}
        for n in sizes:
            self.count[n] = self.count.get(n, 0) + 1
        self.sizes = sorted(self.count)

    def remove(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.sizes[bisect.bisect_left(self.sizes, size)]

    def fill(self, room: int) -> int:
        """How much of ``room`` the largest sizes that fit, one after the other, would take."""
        taken, i = 0, bisect.bisect_right(self.sizes, room) - 1
        while i >= 0:
            size = self.sizes[i]
            taken += min(self.count[size], (room - taken) // size) * size
            i = min(i, bisect.bisect_right(self.sizes, room - taken)) - 1
        return taken


class Bins:
    """Open bins, ordered by free room."""

    def __init__(self, sizes: Sequence[int], lengths: Sequence[int], overhead: int = OVERHEAD) -> None:
        self.lengths, self.overhead = sorted(set(lengths)), overhead
        self.left = Left(sizes)
        self.free: list[tuple[int, int]] = []  # (room, bin), sorted
        self.used: list[int] = []
        self.opened: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """Put a piece into its best bin; returns the bin and the position in it."""
        self.left.remove(size)
        i = bisect.bisect_left(self.free, (size, -1))
        if i < len(self.free):
            room, b = self.free.pop(i)
        else:
            b, room = len(self.used), self._cheapest(size)
            self.used.append(0)
            self.opened.append(room)
        at = self.used[b]
        self.used[b] += size
        if room > size:
            bisect.insort(self.free, (room - size, b))
        return b, at

    def _cheapest(self, size: int) -> int:
        """The length with the least cost per packed word; of equal ones that which holds most, then the shortest."""

        def cost(length: int) -> tuple[float, int, int]:
            held = size + self.left.fill(length - size)
            return (self.holds(held) + self.overhead) / held, -held, length

        return min((n for n in self.lengths if n >= size), key=cost)

    def holds(self, words: int) -> int:
        """The smallest permitted length that holds so many words."""
        return self.lengths[bisect.bisect_left(self.lengths, words)]


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin, position and final capacity of each piece (sizes of 1 at least); larger pieces first, ties in the given order."""
    bins = Bins(sizes, lengths, overhead)
    where, at = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        where[i], at[i] = bins.place(sizes[i])
    return where, at, [bins.holds(bins.used[b]) for b in where]


PLACES = "array<struct<doc_id: long, piece: int, first_word: int, n_words: int, position: int>>"


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lengths: Sequence[int] = LENGTHS, group_size: int = GROUP) -> DataFrame:
    """Packed sequences of all words of all documents: ``bin_id, capacity, n_words, pieces, text``.

    A document longer than the largest length is cut into pieces of that length and a rest. ``pieces`` lists, in order of
    position, which words of which document stand where; ``text`` holds the words, joined by one space. A text without
    words (or null) is a row of its own in no bin: bin and capacity are null, the text is empty. Null ids and repeated
    rows are packed like all others; ties go by id, then text. An empty table gives no rows; other columns are not read.
    """
    most = max(lengths)
    if min(lengths) < 1:
        raise ValueError("lengths must be positive")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    groups = max(1, -(-total // group_size))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    # Exploding an array of one array keeps the words: as an expression they would be split at every use.
    rows = docs.select(id_text(id_column).alias("doc_id"), F.xxhash64(id_column, text).alias("h"), F.explode(F.array(words)).alias("words"))
    last = F.greatest(F.lit(0), F.ceil(F.size("words") / most).cast("int") - 1)
    pieces = rows.select("doc_id", "h", "words", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    part = F.slice("words", F.col("piece") * most + 1, F.lit(most))
    pieces = pieces.select("doc_id", "h", "piece", (F.col("piece") * most).alias("first_word"), F.size(part).alias("n_words"), F.array_join(part, " ").alias("text"))
    # Repeated rows have one hash, so a row's place in the scan salts it.
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("h", "piece", F.monotonically_increasing_id()), F.lit(groups)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "h", "piece"], kind="stable")
        key, out = int(g["g"].iloc[0]), []
        rows = list(zip(g["doc_id"], g["piece"].tolist(), g["first_word"].tolist(), g["n_words"].tolist(), g["text"], strict=True))
        full = [r for r in rows if r[3]]
        place = lambda r, at: {"doc_id": None if r[0] is None else int(r[0]), "piece": r[1], "first_word": r[2], "n_words": r[3], "position": at}
        bins: dict[int, list] = {}
        where, at, capacity = pack([r[3] for r in full], lengths)
        for r, b, a, c in zip(full, where, at, capacity, strict=True):
            bins.setdefault(b, []).append((a, c, r))
        for b, held in bins.items():
            held.sort(key=lambda x: x[0])
            out.append((f"{key}-{b}", held[0][1], sum(r[3] for _, _, r in held), [place(r, a) for a, _, r in held], " ".join(r[4] for _, _, r in held)))
        out += [(None, None, 0, [place(r, None)], "") for r in rows if not r[3]]
        frame = pd.DataFrame(out, columns=["bin_id", "capacity", "n_words", "pieces", "text"])
        return frame.astype({"capacity": "Int64"})

    return dealt.groupBy("g").applyInPandas(run, f"bin_id string, capacity int, n_words int, pieces {PLACES}, text string")


def placements(sequences: DataFrame) -> DataFrame:
    """A row per piece: ``doc_id, piece, first_word, n_words, position, bin_id, capacity``."""
    return sequences.select(F.explode("pieces").alias("p"), "bin_id", "capacity").select("p.*", "bin_id", "capacity")


__all__ = ["Bins", "pack", "pack_documents", "placements"]
