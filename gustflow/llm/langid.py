"""Language ID by segmentation-marginalised unigrams.

Pieces of a fixed public vocabulary have a probability in each language. A word's probability is the
sum over all its segmentations into pieces of the products of their probabilities, which the forward
algorithm sums in one pass, however long the word is: it goes on block by block and keeps as many places
as the longest piece has characters. A text's probability is the product over its words. Probabilities
are fitted by expectation maximisation over all segmentations, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chance, columns_of, fold, private, slices

#: Words that a worker remembers before it starts afresh, and their numbers (one for each language); bound its memory.
REMEMBERED, NUMBERS = 250_000, 5_000_000
#: Words of up to BLOCK characters times languages that are summed at once, and characters of longer ones.
CELLS, LONG_CELLS = 200_000, 2_000_000
#: Characters of a block, after which the forward sums are scaled anew; so few that none gets too small.
BLOCK = 24
#: What a text has when it is null or has no letter.
UNDETERMINED = "und"

_EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def pieces_of(path: str) -> list[str]:
    """The pieces of a sentencepiece model file in order, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
    ]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words, with the punctuation that stands at them."""
    return (text or "").lower().split()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


_STEP, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)
#: log2 of the slots of the table of piece beginnings.
_SLOTS = 20


class Lattice:
    """All pieces at all places of words; its last piece number stands for any unknown character."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.size = len(self.number) + 1
        self.longest = max(map(len, pieces), default=0)
        # beginnings of pieces by a rolling polynomial over code points, in a table with open addresses
        begins = {p[:k]: -1 for p in pieces for k in range(1, len(p) + 1)} | self.number
        self.keys = np.zeros((1 << _SLOTS) + 64, dtype=np.uint64)
        self.values = np.full(len(self.keys), -1, dtype=np.int64)
        self.probes = 1
        for part, number in begins.items():
            h = 0
            for c in part:
                h = (h * int(_STEP) + ord(c)) & 0xFFFFFFFFFFFFFFFF
            slot = first = (h * int(_MIX) & 0xFFFFFFFFFFFFFFFF) >> (64 - _SLOTS)
            while self.keys[slot]:
                slot += 1
            self.keys[slot], self.values[slot] = h, number
            self.probes = max(self.probes, slot - first + 1)

    def _found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a beginning's, and the number of the piece that it is (-1: none)."""
        slot = ((hashes * _MIX) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        hit = self.keys[slot] == hashes
        number = np.where(hit, self.values[slot], -1)
        for k in range(1, self.probes):
            rest = np.flatnonzero(~hit & (self.keys[slot + (k - 1)] != 0))
            if not len(rest):
                break
            same = self.keys[slot[rest] + k] == hashes[rest]
            hit[rest[same]] = True
            number[rest[same]] = self.values[slot[rest[same]] + k]
        return hit, number

    def edges(self, runs: list[str]) -> np.ndarray:
        """Rows (run, start, end, piece) of all pieces in the runs of characters, sorted by end then run."""
        lengths = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        codes = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        of = np.repeat(np.arange(len(runs)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = np.repeat(lengths, lengths) - place
        alive = np.arange(len(codes))
        rolling = np.zeros(len(codes), dtype=np.uint64)
        parts = []
        for n in range(1, self.longest + 1):
            inside = left[alive] >= n
            alive, rolling = alive[inside], rolling[inside]
            if not len(alive):
                break
            rolling = rolling * _STEP + codes[alive + (n - 1)]
            hit, number = self._found(rolling)
            if n == 1:  # an unknown character is a piece of its own
                number = np.where(number < 0, self.size - 1, number)
            some = number >= 0
            parts.append(np.stack([of[alive[some]], place[alive[some]], place[alive[some]] + n, number[some]], axis=1))
            alive, rolling = alive[hit], rolling[hit]
        table = np.concatenate(parts) if parts else np.zeros((0, 4), dtype=np.int64)
        return table[np.argsort(table[:, 2] * (len(runs) + 1) + table[:, 0], kind="stable")]

    def forward(self, alpha: np.ndarray, edges: np.ndarray, p: np.ndarray) -> np.ndarray:
        """alpha (runs, places, languages), the probability of what comes before each place, filled in along the edges."""
        for end, some in _by(edges[:, 2]):
            run, start, piece = edges[some, 0], edges[some, 1], edges[some, 3]
            where = np.flatnonzero(np.diff(run, prepend=-1))
            alpha[run[where], end] = np.add.reduceat(alpha[run, start] * p[piece], where, axis=0)
        return alpha

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """(words, languages): log probabilities, all segmentations of each whole word summed.

        The forward sums of the places before a block that a piece may reach back to are carried into it,
        scaled to one for each word and language.
        """
        marked = list(map(_marked, words))
        lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
        out = np.zeros((len(words), p.shape[1]))
        back = max(1, self.longest)
        now, at = np.arange(len(words)), 0
        carried = np.zeros((len(now), back + 1, p.shape[1]))
        carried[:, back] = 1.0
        scale = np.zeros((len(now), p.shape[1]))
        while len(now):
            before = min(at, back - 1)
            edges = self.edges([marked[i][at - before : at + BLOCK] for i in now])
            edges = edges[edges[:, 2] > before] + np.array([0, back - before, back - before, 0])
            alpha = np.zeros((len(now), back + BLOCK + 1, p.shape[1]))
            alpha[:, : back + 1] = carried
            self.forward(alpha, edges, p)
            ends = lengths[now] <= at + BLOCK
            out[now[ends]] = np.log(alpha[ends, back + lengths[now[ends]] - at]) + scale[ends]
            carried = alpha[~ends, BLOCK : BLOCK + back + 1]
            most = carried.max(axis=1)
            carried = carried / most[:, None]
            scale = scale[~ends] + np.log(most)
            now, at = now[~ends], at + BLOCK
        return out

    def expected(self, runs: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(pieces, languages): how often each piece is expected in whole runs that come counts (runs, languages) times.

        Runs of more than BLOCK characters are summed in logarithms, as their probabilities get too small.
        """
        total = np.zeros((self.size, p.shape[1]))
        short = np.flatnonzero([len(r) <= BLOCK for r in runs])
        step = max(1, CELLS // p.shape[1])
        for at in range(0, len(short), step):
            some = short[at : at + step]
            total += self._expected([runs[i] for i in some], counts[some], p)
        for i in sorted(set(range(len(runs))).difference(short.tolist()), key=lambda i: len(runs[i])):
            total += self._expected_long(runs[i], counts[i], np.log(p))
        return total

    def _expected_long(self, run: str, counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """``expected`` of one run of any length, some languages at a time."""
        edges = self.edges([run])
        _, start, end, piece = edges.T
        back = edges[np.lexsort((edges[:, 2], -edges[:, 1]))]
        out = np.zeros(logs.shape)
        step = max(1, LONG_CELLS // (len(run) + 1))
        for k in range(0, logs.shape[1], step):
            lp = logs[:, k : k + step]
            alpha = np.full((len(run) + 1, lp.shape[1]), -np.inf)
            alpha[0] = 0.0
            for stop, some in _by(end):
                alpha[stop] = np.logaddexp.reduce(alpha[start[some]] + lp[piece[some]], axis=0)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0.0
            for at, some in _by(-back[:, 1]):
                beta[-at] = np.logaddexp.reduce(beta[back[some, 2]] + lp[back[some, 3]], axis=0)
            for j in range(lp.shape[1]):
                share = np.exp(alpha[start, j] + lp[piece, j] + beta[end, j] - alpha[-1, j]) * counts[k + j]
                out[:, k + j] += np.bincount(piece, weights=share, minlength=self.size)
        return out

    def _expected(self, runs: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """``expected`` of runs of at most BLOCK characters."""
        edges = self.edges(runs)
        lengths = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        alpha = np.zeros((len(runs), int(lengths.max(initial=0)) + 1, p.shape[1]))
        alpha[:, 0] = 1.0
        self.forward(alpha, edges, p)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(runs)), lengths] = 1.0
        back = edges[np.lexsort((edges[:, 0], -edges[:, 1]))]
        for start, some in _by(-back[:, 1]):
            run, end, piece = back[some, 0], back[some, 2], back[some, 3]
            where = np.flatnonzero(np.diff(run, prepend=-1))
            beta[run[where], -start] = np.add.reduceat(beta[run, end] * p[piece], where, axis=0)
        run, start, end, piece = edges.T
        share = alpha[run, start] * p[piece] * beta[run, end] / alpha[run, lengths[run]] * counts[run]
        return np.stack([np.bincount(piece, weights=share[:, k], minlength=self.size) for k in range(p.shape[1])], axis=1)


def _marked(word: str) -> str:
    """A word as the vocabulary writes it: marked at its beginning, without punctuation around it."""
    return "▁" + (word.strip(_EDGES) or word)


def _by(keys: np.ndarray):
    """(key, slice) of each run of equal keys."""
    if len(keys):
        at = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        for a, b in zip(at, [*at[1:], len(keys)], strict=True):
            yield int(keys[a]), slice(a, b)


@dataclass
class LanguageModel:
    """languages, their log priors and piece probabilities (pieces and unknown, languages)."""

    pieces: list[str]
    languages: list[str]
    prior: np.ndarray
    p: np.ndarray


def fit(
    texts: list[str],
    langs: list[str],
    pieces: list[str],
    docs_of: dict[str, int] | None = None,
    rounds: int = 3,
    smoothing: float = 0.05,
) -> LanguageModel:
    """Piece probabilities by expectation maximisation, from even ones; deterministic.

    docs_of: how many documents each language has, for its prior (default: as in the examples). Words are learned
    from whole, whatever their length.
    """
    languages = sorted(set(langs))
    place = {x: k for k, x in enumerate(languages)}
    counted: dict[str, Counter] = {x: Counter() for x in languages}
    for text, lang in zip(texts, langs, strict=True):
        for word, n in Counter(words_of(text)).items():
            marked = _marked(word)
            counted[lang][marked] += n
    words = sorted(set().union(*counted.values())) if counted else []
    counts = np.zeros((len(words), len(languages)))
    for x, c in counted.items():
        counts[:, place[x]] = [c[w] for w in words]
    lattice = Lattice(pieces)
    p = np.full((lattice.size, max(1, len(languages))), 1.0 / lattice.size)
    for _ in range(rounds if words else 0):
        total = smoothing + lattice.expected(words, counts, p)
        p = total / total.sum(axis=0)
    of = np.array([1.0 + (docs_of or Counter(langs))[x] for x in languages]) if languages else np.ones(1)
    return LanguageModel(pieces, languages, np.log(of / of.sum()), p)


class Identifier:
    """Names the languages of texts under a model; remembers words seen before."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.lattice = Lattice(model.pieces)
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, model.p.shape[1]))
        self.most = min(REMEMBERED, NUMBERS // model.p.shape[1])
        self.step = max(1, CELLS // model.p.shape[1])

    def name(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its posterior probability) of each text."""
        parted = [words_of(t) if has_letter(t) else [] for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
            self.logs = self.logs[:0]
        new = list(set().union(*parted).difference(self.known))
        for at in range(0, len(new), self.step):
            some = new[at : at + self.step]
            self.known.update(zip(some, range(len(self.logs), len(self.logs) + len(some)), strict=True))
            self.logs = np.concatenate([self.logs, self.lattice.log_probability(some, self.model.p)])
        named = [self._named(words) for words in parted]
        for word in new:
            if len(word) > 64:  # hardly comes twice
                del self.known[word]
        return named

    def _named(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        logs = self.model.prior + self.logs[at].sum(axis=0)
        odds = np.exp(logs - logs.max())
        best = int(odds.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())


#: Rows of each language that the model is fitted on, about; rows of all languages together; characters of
#: the longest of them; languages that are learned.
EXAMPLES, ROWS, LONGEST_EXAMPLE, LANGUAGES = 600, 12_000, 20_000, 200
_naming: tuple[LanguageModel | None, Identifier | None] = (None, None)


def learn(
    docs: DataFrame,
    path: str,
    examples: int = EXAMPLES,
    parts: int = 3,
    at: int = 1,
    rows: int = ROWS,
    longest: int = LONGEST_EXAMPLE,
    languages: int = LANGUAGES,
) -> LanguageModel:
    """The model fitted on about ``examples`` rows of each language whose id is not held out.

    Bounds of the sample: ``rows`` rows in all, of ``longest`` characters at most, of the ``languages`` most
    frequent languages. Rows without a language are no examples; rows of one id and language count once.
    Counts of documents by language, for the priors, are over all rows that may be learned from.
    """
    usable = docs.filter(F.col("lang").isNotNull() & (fold("doc_id", parts) != at)).select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    found = {r["lang"]: r["n"] for r in counts.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    each = min(examples, rows / max(1, len(found)))
    rate = F.lit(0.0)
    for lang, n in found.items():
        rate = F.when(F.col("lang") == lang, F.lit(each / n)).otherwise(rate)
    sample = (
        usable.filter((chance("doc_id") < rate) & (F.coalesce(F.char_length("text"), F.lit(0)) <= longest))
        .groupBy("doc_id", "lang")
        .agg(F.min("text").alias("text"))
        .toArrow()
        .to_pylist()
    )
    sample.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"]))
    return fit([r["text"] or "" for r in sample], [r["lang"] for r in sample], pieces_of(path), found)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score, the posterior probability of that language (0 to 1).

    Only the text is looked at, all of it; a null text or one without a letter is ``und`` with score
    0, as is every text under a model that learned no language. Every row is named, repeated ones
    alike; of languages that are equally likely the first by name is taken. An empty table gives no rows.
    Columns of docs named like the results give way. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    named_as = private(docs) + "named"

    @F.pandas_udf("lang_pred string, score double")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        global _naming
        if _naming[0] is not sent.value:
            _naming = (sent.value, Identifier(sent.value))
        identifier = _naming[1]
        for texts in batches:
            pairs = [x for some in slices(texts.tolist()) for x in identifier.name(some)]
            yield pd.DataFrame(pairs, columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": "float64"})

    kept = columns_of(docs, ("lang_pred", "score"))
    return docs.select(*kept, named(F.col("text")).alias(named_as)).select(*kept, f"{named_as}.lang_pred", f"{named_as}.score")
