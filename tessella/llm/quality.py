"""Quality rules: exact text counts plus a hashed n-gram classifier with a calibrated, fixed threshold.

The classifier is a logistic regression over hashed byte 4-grams, words and word pairs (relative
frequencies). It is fitted on a bounded sample of labelled rows outside the held-out fold; a quarter of the
sample is kept from the fit to calibrate probabilities (Platt). Texts are scored whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import held_out, id_text, spread
from tessella.llm.textfeatures import SIZE, batches_of_texts, mean_weight, ngram_slots

#: Bound of the labelled sample (rows of each class), and how far relative frequencies are scaled.
SAMPLE, SCALE = 1500, 100.0
#: Kept if the calibrated probability of good quality is at least this.
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS, SPACES = tuple("#*$%&|<>"), tuple(" \t\n\x0b\x0c\r")


@dataclass
class QualityModel:
    """Weights per slot, bias, and the calibration ``p = sigmoid(a * z + b)``."""

    weights: np.ndarray
    bias: float
    a: float
    b: float

    def probability(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j in batches_of_texts(texts):
            chars, char_ends, words, word_ends = ngram_slots(texts[i:j])
            z = SCALE * (mean_weight(self.weights, chars, char_ends) + mean_weight(self.weights, words, word_ends)) + self.bias
            out[i:j] = _sigmoid(self.a * z + self.b)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _sample(docs: DataFrame, labels: DataFrame, target: str, size: int) -> DataFrame:
    """``size`` labelled texts of each class, chosen by a hash of the id; conflicting labels count as 0."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.min(target).alias("y"))
    marks = marks.filter(~held_out(F.col("doc_id")))
    picked = None
    for y in (0, 1):
        part = marks.filter(F.col("y") == y).orderBy(spread(F.col("doc_id")), "doc_id").limit(size)
        picked = part if picked is None else picked.unionByName(part)
    # The sample is bounded by 2 * size ids, so it may be broadcast.
    # Of rows that repeat an id, the smallest text counts.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def fit_quality(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, rounds: int = 150) -> QualityModel:
    """Fit on at most ``2 * size`` labelled rows. Without rows of both classes every text is probably good."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for i, j in batches_of_texts(texts):
                chars, char_ends, words, word_ends = ngram_slots(texts[i:j])
                slots, values = [], []
                for k in range(j - i):
                    a, c = chars[char_ends[k - 1] if k else 0 : char_ends[k]], words[word_ends[k - 1] if k else 0 : word_ends[k]]
                    x = np.concatenate([np.bincount(a, minlength=SIZE) / max(len(a), 1), np.bincount(c - SIZE, minlength=SIZE) / max(len(c), 1)])
                    nonzero = np.flatnonzero(x)
                    slots.append(nonzero.astype(np.int16).tobytes())
                    values.append((SCALE * x[nonzero]).astype(np.float32).tobytes())
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j], "y": b["y"].iloc[i:j], "slots": slots, "values": values})

    rows = _sample(docs, labels, "quality", size).mapInPandas(features, "doc_id long, y int, slots binary, values binary").orderBy("doc_id").collect()
    y = np.array([r["y"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(2 * SIZE, np.float32), 0.0, 0.0, 4.0)
    slots = [np.frombuffer(r["slots"], np.int16).astype(np.int32) for r in rows]
    values = [np.frombuffer(r["values"], np.float32) for r in rows]
    held = np.arange(len(rows)) % 4 == 3
    fit = np.flatnonzero(~held)
    col = np.concatenate([slots[i] for i in fit])
    val = np.concatenate([values[i] for i in fit])
    row = np.repeat(np.arange(len(fit)), [len(slots[i]) for i in fit])
    t = y[fit]
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9)) / len(fit)
    w, bias = np.zeros(2 * SIZE), 0.0
    m, v = np.zeros(2 * SIZE + 1), np.zeros(2 * SIZE + 1)
    for k in range(1, rounds + 1):  # Adam on the whole sample
        z = np.bincount(row, val * w[col], minlength=len(fit)) + bias
        g = weight * (_sigmoid(z) - t)
        grad = np.append(np.bincount(col, val * g[row], minlength=2 * SIZE) + 1e-5 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    z = np.array([float(values[i] @ w[slots[i]]) + bias for i in range(len(rows))])
    a, b = _platt(z[held], y[held]) if 0 < y[held].sum() < held.sum() else (1.0, 0.0)
    return QualityModel(w.astype(np.float32), float(bias), a, b)


def _platt(z: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Logistic calibration with smoothed targets, by Newton steps; the slope never turns negative."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    c = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(x @ c)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * (c - [1, 0]))
        c = c - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(c[0], 1e-3)), float(c[1])


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, characters in words, symbols, duplicate lines, words in repeated three-word windows) of a text.

    Words are runs of characters other than space and U+0009 to U+000D.
    """
    if not text:
        return 0, 0, 0, 0, 0
    words = split_words(text)
    n = len(words)
    # Code points are counted on the text: continuation bytes of its words don't count.
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        pairs = x[:-1] * len(ids) + x[1:]
        if len(ids) > 1 << 20:  # three ids would not fit in 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(ids) + x[2:]
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = times[which] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeats = int(covered.sum())
    lines = [x for x in text.split("\n") if x and split_words(x)] if "\n" in text else []
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


#: str.split() also splits at other characters; bytes.split() splits at space and U+0009 to U+000D only.
def split_words(text: str) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def base_counts(texts: list[str | None]) -> pd.DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return pd.DataFrame([text_counts(t) for t in texts], columns=names, dtype=np.int64)


def quality_rules(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base verdict, probability and final verdict of every row, beside its id.

    A null or empty text has no words, so the base rules reject it. Null ids and repeated rows give a row
    each; an empty table gives none. A text of any length is counted and scored whole, and equal texts score alike. Only
    the two named columns are read, so others may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            out = base_counts(texts)
            out.insert(0, "doc_id", b["id"].to_numpy())
            out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
            out["probability"] = shared.value.probability(texts)
            out["kept"] = ~out["base_failed"] & (out["probability"] >= threshold)
            yield out

    rows = docs.select(id_text(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def keep_quality(docs: DataFrame, model: QualityModel, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes.

    Null and empty texts fail. Rows are judged one by one, so repeated rows stay or go together, and ids play no part; an
    empty table stays empty. No column is added, so the others may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def passes(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        c = base_counts(texts)
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        return ~failed & (shared.value.probability(texts) >= threshold)

    return docs.filter(passes(F.col(text_column)))
