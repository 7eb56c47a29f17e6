"""Masked pseudo-likelihood of texts under a bidirectional window network.

Words map to a fixed number of classes: the most frequent words of the corpus, and hashed shapes for all
others. The network predicts every word's class from the classes on both sides:
``softmax(W tanh(L[left] + R[right] + c) + b)``. Since a window is one class on each side, the counts of
(left, word, right) over the whole corpus are sufficient statistics: Spark counts every window of every
document, and numpy trains on the counts, so each token of the corpus takes part in every training step.

A word's probability is that of its class given the two neighbours, times that of the word in its class. The
second is estimated from the counts of all words of all documents, with add-one smoothing: a table that grows with the
vocabulary, stays distributed and is joined with the words of the texts. A text's score is the sum of both logarithms.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, checkpointed, id_text

#: Classes: one for the text's ends, the most frequent words, hashed shapes of the others.
FREQUENT, SHAPES, BUCKETS = 127, 4, 16
CLASSES = 1 + FREQUENT + SHAPES * BUCKETS
HIDDEN, ROUNDS = 32, 60


def shape(word: str) -> int:
    """0 lower case, 1 capitalised, 2 upper case, 3 anything with a digit or symbol."""
    core = word.strip(".,;:!?\"'()")
    if not core.isalpha():
        return 3
    return 0 if core.islower() else 2 if core.isupper() and len(core) > 1 else 1


def word_class(word: str) -> int:
    """The class of a word that is not frequent."""
    return 1 + FREQUENT + shape(word) * BUCKETS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class Classifier:
    """Maps words to classes and remembers them while memory is small."""

    def __init__(self, frequent: list[str]) -> None:
        self.fixed = {w: i + 1 for i, w in enumerate(frequent)}
        self.memory = dict(self.fixed)

    def __call__(self, text: str | None) -> np.ndarray:
        words = split_text(text)
        memory = self.memory
        if len(memory) > 400_000:
            memory = self.memory = dict(self.fixed)
        try:
            return np.fromiter(map(memory.__getitem__, words), np.int32, len(words))
        except KeyError:
            for w in words:
                if w not in memory:
                    memory[w] = word_class(w)
            return np.fromiter(map(memory.__getitem__, words), np.int32, len(words))


def split_text(text: str | None) -> list[str]:
    """Runs of characters other than space and U+0009 to U+000D (str.split() knows more white space)."""
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]


def windows(classes: np.ndarray) -> np.ndarray:
    """A code for each (left, word, right); the text's ends are class 0."""
    x = np.concatenate([[0], classes, [0]]).astype(np.int64)
    return (x[:-2] * CLASSES + x[2:]) * CLASSES + x[1:-1]


@dataclass
class WindowNetwork:
    """The trained network, as the table of log-probabilities [left, right, word] that it computes."""

    frequent: list[str]
    table: np.ndarray
    #: Logarithm of each class's words, different words and one for words never seen; 0 for frequent words.
    size: np.ndarray
    #: ``h, gain``: hash of each word that is not frequent, and the logarithm of its count and one.
    words: DataFrame | None = None

    def score(self, classes: np.ndarray) -> float:
        """The part of the log-likelihood that needs no word counts."""
        return float(self.table[windows(classes)].sum(dtype=np.float64) - self.size[classes].sum())


def train(cells: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, hidden: int = HIDDEN, seed: int = 7) -> np.ndarray:
    """Train on window counts with Adam over all contexts; the log-probabilities of all cells."""
    rng = np.random.default_rng(seed)
    n = np.zeros(CLASSES**3, np.float32)
    n[cells] = counts
    n = n.reshape(-1, CLASSES)
    seen = np.flatnonzero(n.any(axis=1))
    total = float(n.sum(dtype=np.float64)) or 1.0
    unigram = np.log((n.sum(axis=0, dtype=np.float64) + 1) / (total + CLASSES)).astype(np.float32)
    p = {
        "left": rng.normal(0, 0.3, (CLASSES, hidden)).astype(np.float32), "right": rng.normal(0, 0.3, (CLASSES, hidden)).astype(np.float32),
        "c": np.zeros(hidden, np.float32), "w": np.zeros((hidden, CLASSES), np.float32), "b": unigram,
    }
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    left, right = seen // CLASSES, seen % CLASSES
    mass = n[seen].sum(axis=1)
    for k in range(1, rounds + 1):
        g = {name: np.zeros_like(v) for name, v in p.items()}
        for i in range(0, len(seen), 8192):  # bounded memory; the step is over all of them
            s = slice(i, i + 8192)
            h = np.tanh(p["left"][left[s]] + p["right"][right[s]] + p["c"])
            z = h @ p["w"] + p["b"]
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z *= (mass[s] / z.sum(axis=1))[:, None]
            d = (z - n[seen[s]]) / total
            g["w"] += h.T @ d
            g["b"] += d.sum(axis=0)
            dh = (d @ p["w"].T) * (1 - h * h)
            np.add.at(g["left"], left[s], dh)
            np.add.at(g["right"], right[s], dh)
            g["c"] += dh.sum(axis=0)
        rate = 0.05 * (1 - 0.9 * (k - 1) / rounds)
        for name in p:
            m[name] = 0.9 * m[name] + 0.1 * g[name]
            v2[name] = 0.99 * v2[name] + 0.01 * g[name] ** 2
            p[name] -= rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v2[name] / (1 - 0.99**k)) + 1e-8)
    out = np.empty((CLASSES**2, CLASSES), np.float32)
    for a in range(CLASSES):
        h = np.tanh(p["left"][a] + p["right"] + p["c"])
        z = h @ p["w"] + p["b"]
        z -= z.max(axis=1, keepdims=True)
        out[a * CLASSES : (a + 1) * CLASSES] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out.ravel()


def count_windows(docs: DataFrame, frequent: list[str], text_column: str = "text") -> DataFrame:
    """``(cell, n)``: how often each window occurs, over all words of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify, total, fresh = Classifier(frequent), np.zeros(CLASSES**3, np.int32), []
        for b in batches:
            fresh += [windows(classify(t)) for t in b["text"]]
            if sum(map(len, fresh)) > 1 << 20:
                total += np.bincount(np.concatenate(fresh), minlength=len(total)).astype(np.int32)
                fresh = []
        if fresh:
            total += np.bincount(np.concatenate(fresh), minlength=len(total)).astype(np.int32)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 18):
            yield pd.DataFrame({"cell": at[i : i + (1 << 18)].astype(np.int32), "n": total[at[i : i + (1 << 18)]].astype(np.int64)})

    texts = docs.select(F.col(text_column).cast("string").alias("text"))
    return texts.mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def class_sizes(words: DataFrame, frequent: list[str]) -> np.ndarray:
    """``WindowNetwork.size`` from the counts ``w, count`` of all words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES, np.int64)
        for b in batches:
            of = np.array([word_class(w) for w in b["w"]], np.int64)
            total += np.bincount(of, b["count"].to_numpy() + 1, CLASSES).astype(np.int64)
        yield pd.DataFrame({"c": np.arange(CLASSES), "n": total})

    size = np.ones(CLASSES)
    for r in words.filter(~F.col("w").isin(frequent)).mapInPandas(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        size[r["c"]] += r["n"]
    return np.log(size)


def fit_network(docs: DataFrame, text_column: str = "text") -> WindowNetwork:
    """Train on every word of every document. The driver receives at most ``CLASSES ** 3`` counts; those of the words stay distributed."""
    words = checkpointed(split_words(docs.select(F.col(text_column).cast("string").alias("text"))).groupBy("w").count())
    frequent = [r["w"] for r in words.orderBy(F.desc("count"), "w").limit(FREQUENT).collect()]
    counts = checkpointed(count_windows(docs, frequent, text_column)).toArrow()
    gains = words.filter(~F.col("w").isin(frequent)).select(F.xxhash64("w").alias("h"), F.log1p("count").alias("gain"))
    return WindowNetwork(frequent, train(counts["cell"].to_numpy(), counts["n"].to_numpy()), class_sizes(words, frequent), gains)


def split_words(texts: DataFrame) -> DataFrame:
    """A row per word ``w`` of column ``text``, with the other columns."""
    others = [c for c in texts.columns if c != "text"]
    return texts.select(*others, F.explode(F.split("text", f"[{SPACE}]+")).alias("w")).filter("w <> ''")


def word_gains(docs: DataFrame, network: WindowNetwork, text_column: str) -> DataFrame:
    """``th, gain``: what the counts of its words add to the log-likelihood of each text, named by its hash."""
    texts = docs.select(F.col(text_column).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    words = split_words(texts).filter(~F.col("w").isin(network.frequent)).select("th", F.xxhash64("w").alias("h"))
    total = words.join(network.words, "h").groupBy("th").agg(F.sum("gain").alias("gain"))
    # Equal texts were added up; each has an equal share.
    return total.join(texts.groupBy("th").agg(F.count(F.lit(1)).alias("rows")), "th").select("th", (F.col("gain") / F.col("rows")).alias("gain"))


def pseudo_likelihood(docs: DataFrame, network: WindowNetwork, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_likelihood`` of every row.

    A text without words (or null) has likelihood 0 and a null mean. Null ids and repeated rows give a row
    each; an empty table gives none. Only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(network, words=None))  # a fixed number of cells

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        classify = Classifier(net.frequent)
        for b in batches:
            found = [classify(t) for t in b["text"]]
            n = np.fromiter(map(len, found), np.int64, len(found))
            total = np.array([net.score(x) if len(x) else 0.0 for x in found])
            yield pd.DataFrame({"doc_id": b["id"].to_numpy(), "th": b["th"], "n_words": n, "part": total})

    rows = docs.select(id_text(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    scored = rows.withColumn("th", F.xxhash64("text")).mapInPandas(run, "doc_id string, th long, n_words long, part double").withColumn("doc_id", F.col("doc_id").cast("long"))
    whole = scored.join(word_gains(docs, network, text_column), "th", "left").withColumn("log_likelihood", F.col("part") + F.coalesce("gain", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood")
    return whole.select("doc_id", "n_words", "log_likelihood", mean)
