"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ])

The pairwise part is the sum-of-squares identity, so a text is scored in time linear in its distinct
features. The model is fitted in numpy on a bounded sample of labelled rows and sent to the tasks,
which score whole texts batch by batch.
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

from .common import columns_of, labelled_sample

#: Buckets of hashed words; structure statistics and metadata come after them.
BUCKETS = 1 << 15
#: Words that a worker remembers before it starts afresh; bounds its memory.
REMEMBERED = 150_000

_CLASS = np.zeros((256, 9))
for _k, _chars in enumerate(
    (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\r\x0b\x0c", b"\n", b"#*$%&|<>", b".,;:!?", b"!", b"|")
):
    _CLASS[list(_chars), _k] = 1
STATISTICS = 15


class Features:
    """Sparse features of a text: (indices, values)."""

    def __init__(self) -> None:
        self.bucket: dict[str, int] = {}

    def _buckets(self, words: list[str]) -> np.ndarray:
        known = self.bucket
        if len(known) > REMEMBERED:
            known.clear()
        get = known.get
        out = []
        for w in words:
            b = get(w)
            if b is None:
                b = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
                if len(w) <= 64:
                    known[w] = b
            out.append(b)
        return np.array(out, dtype=np.int64)

    def of(self, text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        n = len(words)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        size = max(1, len(raw))
        upper, lower, digit, space, newline, symbol, stop, shout, bar = np.bincount(raw, minlength=256) @ _CLASS
        buckets, counts = np.unique(self._buckets(words), return_counts=True)
        lines = text.split("\n")
        known = float(len(text)) if n_chars is None or not math.isfinite(n_chars) else float(n_chars)
        stats = np.array(
            [
                1.0,
                upper / size * 4,
                lower / size,
                digit / size * 8,
                space / size * 4,
                min(newline / max(1, n) * 8, 3),
                min(symbol / max(1, n) * 2, 3),
                stop / max(1, n) * 2,
                min(shout / max(1, n) * 2, 3),
                min(bar / max(1, n) * 2, 3),
                len(buckets) / max(1, n) * 2,
                math.log1p(n) / 4,
                min(len(raw) / max(1, n) / 8, 3),
                math.log1p(max(0.0, known)) / 8,
                (len(lines) - len(set(lines))) / max(1, len(lines)),
            ]
        )
        weight = np.log1p(counts)
        norm = math.sqrt(float(weight @ weight)) or 1.0
        return (
            np.concatenate([buckets, BUCKETS + np.arange(STATISTICS)]),
            np.concatenate([weight / norm, stats]),
        )


@dataclass
class FactorisationMachine:
    """Bias, linear weights (features,) and factors (features, rank)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index]
        sums = value @ v
        return float(self.bias + value @ self.linear[index] + 0.5 * (sums @ sums - (value**2) @ (v**2).sum(axis=1)))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.logit(index, value)))))


def fit(
    examples: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    rank: int = 8,
    epochs: int = 6,
    rate: float = 0.05,
    decay: float = 1e-4,
    seed: int = 7,
    batch: int = 32,
) -> FactorisationMachine:
    """Adagrad on the log loss. Deterministic for the same examples in the same order.

    Without examples, or with labels of one kind, the model still scores: it then learns the rate.
    """
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    rate_of_ones = (float(labels.sum()) + 1) / (len(labels) + 2)
    model = FactorisationMachine(math.log(rate_of_ones / (1 - rate_of_ones)), np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    seen_w, seen_v = np.full(size, 1e-8), np.full((size, rank), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            index = np.concatenate([examples[i][0] for i in some])
            value = np.concatenate([examples[i][1] for i in some])
            row = np.repeat(np.arange(len(some)), [len(examples[i][0]) for i in some])
            begins = np.searchsorted(row, np.arange(len(some)))
            v = model.factors[index]
            xv = value[:, None] * v
            sums = np.add.reduceat(xv, begins)
            logit = (
                model.bias
                + np.add.reduceat(value * model.linear[index], begins)
                + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((xv**2).sum(axis=1), begins))
            )
            off = 1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[some]
            each = off[row] * value
            grad_v = each[:, None] * (sums[row] - xv)
            used, where = np.unique(index, return_inverse=True)
            gw = np.bincount(where, weights=each) / len(some) + decay * model.linear[used]
            gv = np.stack([np.bincount(where, weights=grad_v[:, f]) for f in range(rank)], axis=1) / len(some) + decay * model.factors[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            model.linear[used] -= rate * gw / np.sqrt(seen_w[used])
            model.factors[used] -= rate * gv / np.sqrt(seen_v[used])
            model.bias -= rate * float(off.mean())
    return model


#: Labelled rows that the model is fitted on, about, and the characters of the longest of them.
EXAMPLES, LONGEST_EXAMPLE = 6000, 50_000
_scoring: tuple[FactorisationMachine | None, Features] = (None, Features())


def learn(
    docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, label: str = "quality", longest: int = LONGEST_EXAMPLE
) -> FactorisationMachine:
    """The model fitted on about ``examples`` labelled rows whose id is not held out, of ``longest`` characters at most.

    A null length counts as the text's own, as does a table without n_chars. Contradicting labels of one id count as
    the greatest, repeated ids once, null ids and null labels not at all. Without usable rows the model is even.
    """
    if "n_chars" not in docs.columns:
        docs = docs.withColumn("n_chars", F.lit(None).cast("long"))
    rows = labelled_sample(docs, labels, label, examples, longest, ["text", "n_chars"])
    features = Features()
    return fit([features.of(r["text"], r["n_chars"]) for r in rows], np.array([float(r["label"] > 0) for r in rows]))


def classify(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 if score >= threshold, else 0).

    Only the text and its recorded length (n_chars; the text's own length where null or missing) are
    looked at. Null and empty texts are scored by the statistics of an empty text. Every row is scored,
    repeated ones alike; a score at the threshold is predicted 1; an empty table gives no rows. Columns of
    docs named like the results give way. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        global _scoring
        if _scoring[0] is not sent.value:
            _scoring = (sent.value, Features())
        known, features = _scoring
        for texts, lengths in batches:
            yield pd.Series([known.score(*features.of(t, n)) for t, n in zip(texts, lengths, strict=True)], dtype="float64")

    length = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    kept = columns_of(docs, ("score", "predicted"))
    return docs.select(*kept, scored(F.col("text"), length.cast("double")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
