"""Byte-level BPE in Spark's higher-order functions.

A text is cut into pieces by the tokenizer's pattern. Texts are taken in chunks of bounded size, and a chunk becomes
one row: its distinct words, and each text as positions in them. A word becomes the array of its bytes' token ids,
and a fold merges, again and again, the neighbouring pair with the lowest rank, until no pair has a rank; the texts'
ids are then gathered from the folded words. Since a token's id is its rank, the rank map is keyed by pairs of ids. It
is a literal: two arrays that form a perfect hash table (slot = key * multiplier[key mod P] mod M), since Spark's own
map lookup scans all keys.

Words that most chunks share are folded once for the whole corpus: the chunks of all texts are counted for each word, and
the folds of the most widespread ones, a bounded number, are broadcast. All other words are folded once in each chunk.
Both take the same fold, and texts never move.

The fold takes a step per merge and each step reads the whole word, so words of more than ``LONG`` bytes are folded with
a heap instead, beside the others. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed
from tessella.llm.textfeatures import ranges

#: Characters of a chunk (a longer text is a chunk of its own), and the bytes beyond which a heap folds a word.
CHUNK, LONG = 6_000_000, 128
#: Words whose folds are broadcast: about 20 MB. Which words these are changes the work, never the result.
SHARED = 500_000
NONE = 1 << 16
#: Patterns whose pieces hold a space at their beginning only, or nothing but white space, and look ahead over white space only.
#: Such a text may be cut before every space that follows another character than white space.
SPACED = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks. The file is the driver's."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@dataclass
class PerfectHash:
    """``slot(key) = key * multiplier[key % prime] % size``, without collisions among the given keys."""

    prime: int
    size: int
    multiplier: np.ndarray
    slots: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct, 0 <= key < 2**32."""
        prime = _prime(max(3, len(keys) // 3))
        size = _prime(max(5, 2 * len(keys)))
        groups: dict[int, list[int]] = {}
        for i, bucket in enumerate((keys % prime).tolist()):
            groups.setdefault(bucket, []).append(i)
        values = keys.tolist()
        while True:
            taken = bytearray(size)
            multiplier, slots = [1] * prime, [0] * len(values)
            for bucket, group in sorted(groups.items(), key=lambda g: -len(g[1])):
                own = [values[i] % size for i in group]
                if len(set(own)) < len(own):
                    break  # equal for every multiplier: another size is needed
                for m in range(1, size):
                    at = [k * m % size for k in own]
                    if not any(taken[x] for x in at) and len(set(at)) == len(at):
                        break
                else:
                    break
                multiplier[bucket] = m
                for i, x in zip(group, at, strict=True):
                    taken[x], slots[i] = 1, x
            else:
                return cls(prime, size, np.array(multiplier, np.int64), np.array(slots, np.int64))
            size = _prime(size + 1)


def _prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _numbers(values: Sequence[int], kind: str) -> Column:
    """A literal array, given as one string: a literal per number would be a tree of that many nodes."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def heap_fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word in n log n: the lowest pair, the leftmost of equal ones, is taken from a heap."""
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))  # where a token's successor and predecessor begin
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue  # one of the two has been merged since
        alive[after[i]] = False
        after[i] = end
        if end < n:
            before[end] = i
            rank = ranks.get(word[i : after[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, after[end]))
        if i:
            rank = ranks.get(word[before[i] : end])
            if rank is not None:
                heapq.heappush(heap, (rank, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


@dataclass
class Vocabulary:
    """A tokenizer's ranks, as literal tables."""

    ranks: dict[bytes, int]

    def __post_init__(self) -> None:
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * NONE + b] = rank
        if max(self.ranks.values()) >= NONE:
            raise ValueError("ids must fit in 16 bits")
        keys = np.fromiter(pairs, np.int64, len(pairs))
        self.hash = PerfectHash.build(keys)
        cells = np.full(self.hash.size, -(1 << 50), np.int64)
        cells[self.hash.slots] = keys * NONE + np.fromiter(pairs.values(), np.int64, len(pairs))
        self.cells = cells
        self.bytes_ = [self.ranks[bytes([i])] for i in range(256)]
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        #: Tokens that no sequence of merges makes: as whole words they are found by name.
        self.whole = {t: r for t, r in self.ranks.items() if len(t) > 1 and heap_fold(t, self.ranks) != [r]}

    def tables(self) -> Column:
        """One literal struct: a lambda binds it once, so every use reads the same arrays."""
        return F.struct(_numbers(self.cells.tolist(), "bigint").alias("cells"), _numbers(self.hash.multiplier.tolist(), "bigint").alias("mult"), _numbers(self.bytes_, "int").alias("bytes"))

    def _rank(self, t: Column, a: Column, b: Column) -> Column:
        """Rank of the pair (a, b), in the high bits of a cell of the fold; ``NONE`` if it has none."""
        key = a * NONE + b
        cell = F.get(t["cells"], (key * F.get(t["mult"], (key % self.hash.prime).cast("int")) % self.hash.size).cast("int"))
        # The table's cell holds key and rank: their difference is the rank, or outside of all ranks.
        return F.least((cell - key * NONE).bitwiseAND((1 << 62) - 1), F.lit(NONE)) * NONE

    def fold(self, t: Column, word: Column) -> Column:
        """Ids of one word, given as bytes.

        A cell of the fold is ``rank * 65536 + id``: a token and the rank of its pair with the next one. The
        least cell is the pair to merge, its first position the leftmost, and its rank the merged token.
        """
        latin = F.decode(word, "ISO-8859-1")
        ids = F.transform(F.split(latin, ""), lambda c: F.get(t["bytes"], F.ascii(c)).cast("bigint"))

        def begin(ids: Column) -> Column:
            return F.transform(ids, lambda a, i: F.coalesce(self._rank(t, a, F.get(ids, i + 1)), F.lit(NONE * NONE)) + a)

        def merge(x: Column, _: Column) -> Column:
            def at(p: Column) -> Column:
                token = F.shiftright(F.get(x, p - 1), 16)
                after = F.get(x, p + 1).bitwiseAND(NONE - 1)
                own = F.coalesce(self._rank(t, token, after), F.lit(NONE * NONE)) + token
                before = F.get(x, p - 2).bitwiseAND(NONE - 1)
                # One pass with a hole at the merged neighbour: slices and concatenation cost three times as much.
                cell = lambda c, i: F.when((i < p - 2) | (i > p), c).when(i == p - 1, own).when(i == p - 2, self._rank(t, before, token) + before)
                return F.filter(F.transform(x, cell), lambda c: c.isNotNull())

            def least(m: Column) -> Column:
                return F.when(m < NONE * NONE, F.get(F.transform(F.array(F.array_position(x, m).cast("int")), at), 0)).otherwise(x)

            return F.get(F.transform(F.array(F.array_min(x)), least), 0)

        def run(ids: Column) -> Column:
            steps = F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1)))
            return F.aggregate(steps, begin(ids), merge, lambda x: F.transform(x, lambda c: c.bitwiseAND(NONE - 1).cast("int")))

        return F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(F.get(F.transform(F.array(ids), run), 0))


def pieces_of(texts: pa.StringArray, findall: Callable[[str], list[str]], spaced: bool, only_words: bool = False) -> tuple[pa.BinaryArray, pa.ListArray | None]:
    """The different pieces of ``texts`` as bytes, and each text as positions in them (none if ``only_words``).

    ``spaced``: see ``SPACED``. Then each different part between spaces is matched once, all of them in one call, and not at each
    occurrence. White space before a space runs on into it, so a text with such a part is matched as a whole.
    """
    split = pc.split_pattern(texts, " ") if spaced else pa.array([[t] for t in texts.to_pylist()], pa.list_(pa.string()))
    split = split.cast(pa.list_(pa.string()))
    parts, at = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    at -= at[0]
    heads = parts.take(pa.array(at[:-1])).to_pylist()
    inner = np.ones(len(parts), bool)
    inner[at[:-1]] = False
    coded = parts.filter(pa.array(inner)).dictionary_encode()
    codes, different = np.asarray(coded.indices), coded.dictionary
    at -= np.arange(len(at))
    empty = pc.equal(pc.binary_length(different), 0)
    open_ = pc.or_(empty, pc.utf8_is_space(pc.utf8_slice_codeunits(different, -1))).to_numpy(zero_copy_only=False)
    safe = different.filter(pa.array(~open_))
    # Arrow joins without a Python string per part.
    matched = findall(" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(safe)], pa.int32()), safe), " ")[0].as_py()) if len(safe) else []
    starts = np.flatnonzero(np.fromiter((p[0] == " " for p in matched), bool, len(matched)))
    if len(starts) != len(safe):
        raise ValueError("the pattern matches over spaces")
    begins, sizes = np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
    begins[~open_], sizes[~open_] = starts, np.diff(np.append(starts, len(matched)))
    runs: list[tuple[np.ndarray, np.ndarray]] = []  # where each text's pieces begin among ``matched``, and how many follow

    def alone(text: str) -> tuple[list[int], list[int]]:
        found = findall(text)
        begin = len(matched)
        matched.extend(found)
        return [begin], [len(found)]

    for i, head in enumerate(heads):
        rest = codes[at[i] : at[i + 1]]
        last = ([], [])
        if len(rest) and ((head and head[-1].isspace()) or open_[rest[:-1]].any()):
            head, rest = texts[i].as_py(), rest[:0]
        elif len(rest) and open_[rest[-1]]:
            last, rest = alone(" " + different[int(rest[-1])].as_py()), rest[:-1]
        first = alone(head)
        runs.append((np.concatenate([first[0], begins[rest], last[0]]), np.concatenate([first[1], sizes[rest], last[1]])))
    words = pa.array(matched, pa.string()).dictionary_encode()
    if only_words:
        return words.dictionary.cast(pa.binary()), None
    numbers, n = np.asarray(words.indices), np.concatenate([r[1] for r in runs]).astype(np.int64)
    to = np.cumsum(n)
    flat = numbers[np.arange(to[-1]) + np.repeat(np.concatenate([r[0] for r in runs]).astype(np.int64) - to + n, n)]
    ends = np.cumsum([0, *(int(r[1].sum()) for r in runs)])
    return words.dictionary.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def chunks_of_words(docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_column: str, text_column: str, size: int, folds: pa.Table | None) -> DataFrame:
    """A row per chunk of texts: ``words`` (bytes, and the ids of those that are not left to the fold) and ``texts`` (id, positions).

    ``folds``: ids of a bounded number of words (columns ``word``, ``ids``, ``key``, in order of ``key``), or none.
    """
    # The size of the vocabulary and of ``SHARED`` words.
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.ranks, vocabulary.whole, folds))
    kinds = pa.schema([
        ("words", pa.list_(pa.struct([("word", pa.binary()), ("ids", pa.list_(pa.int32()))]))),
        ("texts", pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.list_(pa.int32()))]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern)
        ranks, whole, folds = shared.value
        empty = folds is None
        values, ends = (np.zeros(0, np.int32), np.zeros(1, np.int64)) if empty else _flat(folds["ids"].combine_chunks())
        keys, names = (np.zeros(0, np.uint64), pa.array([], pa.binary())) if empty else (folds["key"].to_numpy(), folds["word"].combine_chunks())
        begins, sizes = np.append(ends[:-1], len(values)), np.append(np.diff(ends), 0)

        def places(words: pa.BinaryArray) -> np.ndarray:
            """Rows of ``folds`` (one past the last for words that it lacks): found by hash, compared as they are."""
            none = len(keys)
            if not none or not len(words):
                return np.full(len(words), none)
            wanted = _keys(words)
            at = np.minimum(np.searchsorted(keys, wanted), none - 1)
            same = pc.equal(names.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
            return np.where(same, at, none)

        def known(words: pa.BinaryArray) -> pa.ListArray:
            """Ids of shared words, of long ones and of those without merges; null for all others."""
            at = places(words)
            start, n = begins[at], sizes[at]
            rare = pc.greater(pc.binary_length(words), LONG).to_numpy(zero_copy_only=False)
            if whole:
                rare |= pc.is_in(words, pa.array(list(whole), pa.binary())).to_numpy(zero_copy_only=False)
            own, after = [values], len(values)
            for i in np.flatnonzero(rare).tolist():
                w = words[i].as_py()
                own.append(np.array([whole[w]] if w in whole else heap_fold(w, ranks), np.int32))
                start[i], n[i], after = after, len(own[-1]), after + len(own[-1])
            table = np.concatenate(own) if len(own) > 1 else values
            to = np.concatenate([[0], np.cumsum(n)])
            flat = table[np.arange(to[-1]) + np.repeat(start - to[:-1], n)]
            return pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(n == 0))

        for b in batches:
            texts = b.column(1)
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            for i, j in ranges(lengths, size):
                words, at = pieces_of(pc.fill_null(texts.slice(i, j - i), ""), cut.findall, pattern in SPACED)
                named = pa.StructArray.from_arrays([words, known(words)], names=["word", "ids"])
                rows = pa.StructArray.from_arrays([b.column(0).slice(i, j - i), at], names=["doc_id", "at"])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(named)], named), pa.ListArray.from_arrays([0, len(rows)], rows)], schema=kinds)
                del words, at, named, rows
                pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "words array<struct<word: binary, ids: array<int>>>, texts array<struct<doc_id: long, at: array<int>>>")


def words_of_chunks(docs: DataFrame, pattern: str, text_column: str, size: int) -> DataFrame:
    """``word``: the different words of each chunk of texts, as bytes; a row per chunk and word. No piece is told its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern)
        for b in batches:
            texts = b.column(0)
            for i, j in ranges(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), size):
                words, _ = pieces_of(pc.fill_null(texts.slice(i, j - i), ""), cut.findall, pattern in SPACED, only_words=True)
                yield pa.RecordBatch.from_arrays([words], names=["word"])
                del words
                pa.default_memory_pool().release_unused()

    return docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, "word binary")


def _keys(words: pa.BinaryArray) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    at, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist(), memoryview(words.buffers()[2] or b"")
    return np.fromiter((xxh3_64_intdigest(data[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)), np.uint64, len(words))


def _folded(words: Column, vocabulary: Vocabulary) -> Column:
    """The ids of each of ``words``; the literal tables are bound once for all of them."""
    return F.get(F.transform(F.array(vocabulary.tables()), lambda t: F.transform(words, lambda w: F.coalesce(w["ids"], vocabulary.fold(t, w["word"])))), 0)


def shared_folds(words: DataFrame, vocabulary: Vocabulary, most: int = SHARED) -> pa.Table | None:
    """``word, ids`` of the words that occur in most chunks: at most ``most``, all in at least two chunks. ``words``: see ``words_of_chunks``."""
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("chunks"))
    words = checkpointed(words.filter("chunks > 1"))
    least, total = None, 0
    for r in words.groupBy("chunks").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("chunks")).collect():  # a row per number of chunks
        total += r["n"]
        if total > most:
            break
        least = r["chunks"]
    if least is None:
        return None
    group = words.filter(F.col("chunks") >= least).select(F.struct("word", F.lit(None).cast("array<int>").alias("ids")).alias("w"))
    folded = group.groupBy(F.pmod(F.xxhash64("w.word"), F.lit(max(1, total // 1000)))).agg(F.collect_list("w").alias("words"))  # about a thousand words each
    found = folded.select(F.inline(F.arrays_zip(F.col("words.word").alias("word"), _folded(F.col("words"), vocabulary).alias("ids")))).toDF("word", "ids").toArrow()
    keys = _keys(found["word"].combine_chunks())
    # Should two words share a hash, the second is folded in its chunks.
    return found.append_column("key", pa.array(keys)).take(pa.array(np.unique(keys, return_index=True)[1]))


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_column: str = "doc_id", text_column: str = "text", size: int = CHUNK, shared: int = SHARED) -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text, without special tokens.

    Null and empty texts have no ids. Null ids and repeated rows give a row each; an empty table none. Only the two named
    columns are read, so others may have any name. A text of any length is one row; a word is folded once in its chunk at
    most. ``size`` and ``shared`` change the work, not the result.
    """

    def gathered(ids: Column) -> Column:
        return F.transform("texts", lambda t: F.struct(t["doc_id"].alias("doc_id"), F.flatten(F.transform(t["at"], lambda i: F.get(ids, i))).alias("ids")))

    folds = shared_folds(words_of_chunks(docs, pattern, text_column, size), vocabulary, shared)
    rows = chunks_of_words(docs, vocabulary, pattern, id_column, text_column, size, folds)
    return rows.select(F.inline(F.get(F.transform(F.array(_folded(F.col("words"), vocabulary)), gathered), 0)))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, and where each row begins and ends."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _bytes(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    """The tokens of one text, concatenated."""
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, data`` of rows ``doc_id, ids``: the bytes that the ids stand for, concatenated."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = _flat(b.column(1))
            data = [_bytes(ids[s:e], shared.value) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, data binary")


def digests(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of rows ``doc_id, ids``; the decoded bytes come from the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = _flat(b.column(1))
            raw, spans = memoryview(ids.astype("<u4")), list(zip(at[:-1], at[1:], strict=True))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([e - s for s, e in spans], pa.int64()), pa.array([hashlib.sha256(raw[s:e]).hexdigest() for s, e in spans], pa.string()),
                pa.array([hashlib.sha256(_bytes(ids[s:e], shared.value)).hexdigest() for s, e in spans], pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


__all__ = ["Vocabulary", "decode", "digests", "encode", "heap_fold", "load_ranks"]
