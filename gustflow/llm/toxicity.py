"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word boundaries) and itself; n-grams share hashed
embedding rows, so unseen misspellings and inflections lie near what they are made of. A text is the
weighted average of its words' embeddings, and a linear softmax over that average tells how toxic it is.
A word's weight in the average is the exponential of a linear function of its embedding, so that a few
telling words count in a long text, too; order and places of words play no part. Embeddings, weights
and softmax are fitted together.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, labelled_sample, slices

#: Hashed embedding rows, n-gram lengths, and the greatest exponent of a word's weight.
BUCKETS = 1 << 16
SHORTEST, LONGEST = 3, 6
STEEPEST = 30.0
#: Words that a worker remembers before it starts afresh; bounds its memory.
REMEMBERED = 300_000
_STEP, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)
_EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def words_of(text: str | None) -> list[str]:
    """Lower-cased words, with the punctuation that stands at them."""
    return (text or "").lower().split()


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of many words' n-grams (boundaries marked) and of each word as a whole.

    Returns the rows and, for each row, the place of its word. Punctuation around a word is left out.
    An n-gram's row comes from a rolling polynomial over its code points, for all words at once.
    """
    marked = ["<" + (w.strip(_EDGES) or w) + ">" for w in words]
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters to the word's end
    rows = [np.fromiter((zlib.crc32(m.encode("utf-8", "surrogatepass")) for m in marked), dtype=np.int64, count=len(marked)) % BUCKETS]
    owners = [np.arange(len(marked))]
    rolling = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, min(LONGEST, len(codes)) + 1):
        rolling[: len(codes) - n + 1] = rolling[: len(codes) - n + 1] * _STEP + codes[n - 1 :]
        if n >= SHORTEST:
            whole = left >= n
            rows.append(((rolling[whole] * _MIX) >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owners.append(owner[whole])
    return np.concatenate(rows), np.concatenate(owners)


@dataclass
class SubwordModel:
    """embeddings (rows, width), attention (width,), softmax weights (width, 2) and bias (2,)."""

    embeddings: np.ndarray
    attention: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def by_row(self) -> np.ndarray:
        """(rows, 2): how much each embedding row speaks for toxic, and for weight in the average. Both are
        linear, so a word's are the means of its rows'."""
        return self.embeddings @ np.stack([self.weights[:, 1] - self.weights[:, 0], self.attention], axis=1)


class Scorer:
    """Scores texts under a model; remembers words seen before."""

    def __init__(self, model: SubwordModel):
        self.bias = float(model.bias[1] - model.bias[0])
        self.rows = model.by_row()
        self.known: dict[str, int] = {}
        self.margins = self.weights = np.zeros(0)

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probability that each text is toxic; without words by the bias alone."""
        parted = [words_of(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.margins = self.weights = np.zeros(0)
        new = list(set().union(*parted).difference(self.known))
        if new:
            rows, owners = ngrams(new)
            count = np.bincount(owners, minlength=len(new))
            margin, weight = (np.bincount(owners, weights=self.rows[rows, k], minlength=len(new)) / count for k in (0, 1))
            self.known.update(zip(new, range(len(self.margins), len(self.margins) + len(new)), strict=True))
            self.margins = np.concatenate([self.margins, margin])
            self.weights = np.concatenate([self.weights, np.exp(np.clip(weight, -STEEPEST, STEEPEST))])
        found = [self._score(words) for words in parted]
        for word in new:
            if len(word) > 64:  # hardly comes twice
                del self.known[word]
        return found

    def _score(self, words: list[str]) -> float:
        margin = self.bias
        if words:
            at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            margin += float(self.weights[at] @ self.margins[at] / self.weights[at].sum())
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, margin))))


def _gathered(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (length[0] of them), begin[1], ..."""
    return np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())


def fit(
    texts: list[str],
    labels: np.ndarray,
    width: int = 8,
    epochs: int = 3,
    rate: float = 0.1,
    decay: float = 1e-4,
    seed: int = 11,
    batch: int = 32,
) -> SubwordModel:
    """Adagrad on the softmax's log loss over whole texts' averages.

    Deterministic for the same texts in the same order. Without texts the model is the bias alone.
    """
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 0.3, (width, 2))
    model = SubwordModel(rng.normal(0, 0.1, (BUCKETS, width)), weights[:, 1] - weights[:, 0], weights, np.array([1.0, -1.0]))
    vocabulary: dict[str, int] = {}
    tokens = [
        np.unique(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], dtype=np.int64), return_counts=True) for t in texts
    ]
    words, parts, lengths = list(vocabulary), [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(words), 20_000):
        rows, owners = ngrams(words[at : at + 20_000])
        parts.append(rows[np.argsort(owners, kind="stable")].astype(np.int32))
        lengths.append(np.bincount(owners))
    flat, length = np.concatenate(parts), np.concatenate(lengths)
    begin = np.cumsum(length) - length
    seen = [np.full(BUCKETS, 1e-8), np.full(width, 1e-8), np.full((width, 2), 1e-8), np.full(2, 1e-8)]
    usable = np.array([i for i, (t, _) in enumerate(tokens) if len(t)], dtype=np.int64)
    for _ in range(epochs):
        order = rng.permutation(usable)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            sizes = np.array([len(tokens[i][0]) for i in some])
            starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(some)), sizes)
            ids, times = (np.concatenate([tokens[i][k] for i in some]) for k in (0, 1))
            unique, place = np.unique(ids, return_inverse=True)
            n = length[unique]
            grams = flat[_gathered(begin[unique], n)]
            each = (np.add.reduceat(model.embeddings[grams], np.cumsum(n) - n, axis=0) / n[:, None])[place]
            steep = np.clip(each @ model.attention, -STEEPEST, STEEPEST)
            share = times * np.exp(steep - np.maximum.reduceat(steep, starts)[of])
            share /= np.add.reduceat(share, starts)[of]
            mean = np.add.reduceat(share[:, None] * each, starts, axis=0)
            logits = mean @ model.weights + model.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some].astype(int)] -= 1
            p /= len(some)
            of_mean = (p @ model.weights.T)[of]
            along = (each * of_mean).sum(axis=1)
            of_steep = share * (along - np.add.reduceat(share * along, starts)[of])
            of_each = share[:, None] * of_mean + of_steep[:, None] * model.attention
            of_word = np.stack([np.bincount(place, weights=of_each[:, f], minlength=len(unique)) for f in range(width)], axis=1) / n[:, None]
            used = np.flatnonzero(np.bincount(grams, minlength=BUCKETS))
            spread = np.repeat(of_word, n, axis=0)
            of_rows = np.stack([np.bincount(grams, weights=spread[:, f], minlength=BUCKETS)[used] for f in range(width)], axis=1)
            of_rows += decay * model.embeddings[used]
            seen[0][used] += (of_rows**2).mean(axis=1)
            model.embeddings[used] -= rate * of_rows / np.sqrt(seen[0][used])[:, None]
            for k, (value, slope) in enumerate(
                ((model.attention, each.T @ of_steep), (model.weights, mean.T @ p), (model.bias, p.sum(axis=0))), start=1
            ):
                seen[k] += slope**2
                value -= rate * slope / np.sqrt(seen[k])
    return model


#: Labelled rows that the model is fitted on, about, and the characters of the longest of them.
EXAMPLES, LONGEST_EXAMPLE = 5000, 50_000
_scoring: tuple[SubwordModel | None, Scorer | None] = (None, None)


def learn(
    docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, label: str = "toxic", longest: int = LONGEST_EXAMPLE
) -> SubwordModel:
    """The model fitted on about ``examples`` labelled rows whose id is not held out, of ``longest`` characters at most.

    Contradicting labels of one id count as the greatest, repeated ids once, null ids and null labels not at
    all. Without usable rows the model is the bias alone.
    """
    rows = labelled_sample(docs, labels, label, examples, longest, ["text"])
    return fit([r["text"] or "" for r in rows], np.array([int(r["label"] > 0) for r in rows]))


def score_toxicity(docs: DataFrame, model: SubwordModel, threshold: float = 0.5) -> DataFrame:
    """docs with score (0 to 1, higher: more toxic) and predicted (1 if score >= threshold, else 0).

    Only the text is looked at, all of it. Null and empty texts have the score of the bias alone. Every
    row is scored, repeated ones alike; a score at the threshold is predicted 1; an empty table gives no
    rows. Columns of docs named like the results give way. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        global _scoring
        if _scoring[0] is not sent.value:
            _scoring = (sent.value, Scorer(sent.value))
        scorer = _scoring[1]
        for texts in batches:
            yield pd.Series([x for some in slices(texts.tolist()) for x in scorer.scores(some)], dtype="float64")

    kept = columns_of(docs, ("score", "predicted"))
    return docs.select(*kept, scored(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
