"""Hashed n-gram features of whole texts, computed for many texts at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Hash space of each feature family.
SIZE = 1 << 14
#: An odd multiplier whose high bits mix well (Knuth). A fixed value.
MIX = np.uint32(2654435761)
_POWER = 1099511628211  # FNV prime, odd: invertible modulo 2**64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _POWER, np.uint64)
    down = np.full(n, pow(_POWER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _slots(codes: np.ndarray) -> np.ndarray:
    return ((codes * MIX) >> np.uint32(18)).astype(np.int32)


def ngram_slots(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all features of the texts and, for both families, where each text's begin.

    Family one: byte 4-grams. Family two: words and word pairs, offset by ``SIZE``. Returns (character
    slots, their ends, word slots, their ends).
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(x + b"   " for x in raw) + b" ", np.uint8)
    ends = np.cumsum(lengths + 3)
    starts = ends - lengths - 3
    d = data.astype(np.uint32)
    grams = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
    inside = np.repeat(lengths > 0, lengths + 3)
    inside[(ends[:, None] + np.array([-3, -2, -1])).ravel()] = False  # the separators begin no gram
    inside = inside[: len(grams)]
    chars = _slots(grams[inside])
    char_ends = np.cumsum(lengths)
    space = (data == 32) | (data >= 9) & (data <= 13)
    word_start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    word_end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        words = (total[word_end] - total[word_start]) * down[word_start]
        words = (words ^ words >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        of = np.searchsorted(ends, word_start, "right")
        counts = np.bincount(of, minlength=len(raw)) if len(of) else np.zeros(len(raw), np.int64)
        pair = words[:-1] * np.uint64(31) + words[1:]
        same = of[:-1] == of[1:]
        pair = (pair ^ pair >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    single = (words >> np.uint64(50)).astype(np.int32) + SIZE
    double = (pair[same] >> np.uint64(50)).astype(np.int32) + SIZE
    all_slots = np.concatenate([single, double])
    all_of = np.concatenate([of, of[:-1][same]])
    order = np.argsort(all_of, kind="stable")
    word_counts = counts + np.maximum(counts - 1, 0)
    del starts
    return chars, char_ends, all_slots[order], np.cumsum(word_counts)


def mean_weight(weights: np.ndarray, slots: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mean weight of each text's slots (0 for a text without any)."""
    total = np.concatenate([[0.0], np.cumsum(weights[slots], dtype=np.float64)])
    begins = np.concatenate([[0], ends[:-1]])
    return (total[ends] - total[begins]) / np.maximum(ends - begins, 1)


def ranges(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about ``most`` (a larger item is a range of its own)."""
    i = 0
    while i < len(sizes):
        j, size = i, 0
        while j < len(sizes) and (j == i or size + sizes[j] <= most):
            size += sizes[j]
            j += 1
        yield i, j
        i = j


def batches_of_texts(texts: Sequence[str | None], characters: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about so many characters together (a longer text is a range of its own)."""
    return ranges([len(t or "") for t in texts], characters)
