"""Whole scores and expectations of the learned operators against plain loops; packing and formatting at their seams."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gustflow.llm import chat_format, langid, packing, quality_fm, toxicity

TEXTS = [None, "", " \n ", "one", "Good words, good words!\nGood words\nGood words | <b> 12", "é漢字 ÀB\tx" * 7, "zz " * 500, "a" * 3000 + " b"]


def plain_statistics(text, n_chars):
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    size, n = max(1, len(raw)), max(1, len(words))
    of = lambda chars: sum(raw.count(c.encode()) for c in chars)
    upper, lower = (sum(a <= b <= z for b in raw) for a, z in ((65, 90), (97, 122)))
    known = len(text) if n_chars is None else n_chars
    return [
        1.0, upper / size * 4, lower / size, of("0123456789") / size * 8, of(" \t\r\x0b\x0c") / size * 4, min(of("\n") / n * 8, 3),
        min(of("#*$%&|<>") / n * 2, 3), of(".,;:!?") / n * 2, min(of("!") / n * 2, 3), min(of("|") / n * 2, 3),
        len({zlib.crc32(w.encode()) % quality_fm.BUCKETS for w in words}) / n * 2, math.log1p(len(words)) / 4, min(len(raw) / n / 8, 3),
        math.log1p(max(0.0, known)) / 8, (len(lines) - len(set(lines))) / max(1, len(lines)),
    ]


def plain_quality(text, n_chars, model):
    """Bias, linear terms and every pair of features, one by one."""
    text = text or ""
    buckets = Counter(zlib.crc32(w.encode()) % quality_fm.BUCKETS for w in text.split())
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in buckets.values())) or 1.0
    x = {b: math.log1p(c) / norm for b, c in buckets.items()} | {quality_fm.BUCKETS + k: v for k, v in enumerate(plain_statistics(text, n_chars))}
    logit = model.bias + sum(v * model.linear[i] for i, v in x.items())
    items = list(x.items())
    for k, (i, v) in enumerate(items):
        logit += sum(v * u * float(model.factors[i] @ model.factors[j]) for j, u in items[k + 1 :])
    return 1 / (1 + math.exp(-logit))


def test_quality_scores_are_all_pairs(spark):
    rng = np.random.default_rng(1)
    size = quality_fm.BUCKETS + quality_fm.STATISTICS
    model = quality_fm.FactorisationMachine(-0.3, rng.normal(0, 0.2, size), rng.normal(0, 0.2, (size, 8)))
    rows = [(k, t, None if k % 2 else 10 * k) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for r in quality_fm.classify(df, model).collect():
        assert r["score"] == pytest.approx(plain_quality(r["text"], r["n_chars"], model), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_quality_learning_follows_the_slope():
    """One step of the fit moves every parameter along the loss's slope, as differences of the loss tell."""
    rng = np.random.default_rng(5)
    f = quality_fm.Features()
    examples = [f.of("good words here", None), f.of("bad ### words", 3), f.of("good good", 1)]
    labels = np.array([1.0, 0.0, 1.0])
    start = quality_fm.fit(examples, labels, epochs=0)
    moved = quality_fm.fit(examples, labels, epochs=1, decay=0.0, batch=8)

    def loss(m):
        return -sum(math.log(m.score(*x) if y else 1 - m.score(*x)) for x, y in zip(examples, labels, strict=True)) / 3

    assert loss(moved) < loss(start)
    used = np.unique(np.concatenate([i for i, _ in examples]))
    for i in rng.choice(used, 6, replace=False):
        for array, other in ((start.linear, moved.linear), (start.factors, moved.factors)):
            where = (i,) if array.ndim == 1 else (i, 2)
            old = array[where]
            array[where] = old + 1e-5
            up = loss(start)
            array[where] = old - 1e-5
            slope = (up - loss(start)) / 2e-5
            array[where] = old
            if abs(slope) > 1e-6:
                assert np.sign(other[where] - old) == -np.sign(slope)


def plain_rows(word):
    """Embedding rows of a word: as a whole and of each n-gram, by the polynomial written out."""
    marked = "<" + (word.strip(toxicity._EDGES) or word) + ">"
    rows = [zlib.crc32(marked.encode()) % toxicity.BUCKETS]
    for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
        for at in range(len(marked) - n + 1):
            h = 0
            for c in marked[at : at + n]:
                h = (h * 1_000_003 + ord(c)) % 2**64
            rows.append((h * 0x9E3779B97F4A7C15 % 2**64 >> 40) % toxicity.BUCKETS)
    return rows


def plain_toxicity(text, m):
    words = (text or "").lower().split()
    logits = m.bias.copy()
    if words:
        vectors = [np.mean([m.embeddings[r] for r in plain_rows(w)], axis=0) for w in words]
        weights = [math.exp(v @ m.attention) for v in vectors]
        mean = sum(w * v for w, v in zip(weights, vectors, strict=True)) / sum(weights)
        logits = mean @ m.weights + m.bias
    p = np.exp(logits - logits.max())
    return p[1] / p.sum()


def test_toxicity_scores_are_the_weighted_average(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    rng = np.random.default_rng(2)
    m = toxicity.SubwordModel(rng.normal(0, 1, (toxicity.BUCKETS, 8)), rng.normal(0, 1, 8), rng.normal(0, 1, (8, 2)), np.array([0.4, -0.1]))
    texts = [*TEXTS, "Some (other) words... of, this TEXT", "x", "!!! ???", "xy " * 40 + "zw"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_toxicity(df, m).collect():
        assert r["score"] == pytest.approx(plain_toxicity(r["text"], m), abs=1e-9)
    scorer = toxicity.Scorer(m)
    for _ in range(3):  # what is remembered and what is not give the same
        assert scorer.scores(texts) == pytest.approx([plain_toxicity(t, m) for t in texts], abs=1e-9)


def test_toxicity_learning_follows_the_slope():
    texts, labels = ["mild words here", "nasty nastier word", "words of praise", "nasty thing"], np.array([0, 1, 0, 1])
    start = toxicity.fit(texts, labels, epochs=0)
    moved = toxicity.fit(texts, labels, epochs=1, decay=0.0, rate=0.01, batch=8)

    def loss(m):
        return -sum(math.log(plain_toxicity(t, m) if y else 1 - plain_toxicity(t, m)) for t, y in zip(texts, labels, strict=True)) / 4

    assert loss(moved) < loss(start)
    for name in ("attention", "weights", "bias"):
        array, other = getattr(start, name), getattr(moved, name)
        for where in np.ndindex(array.shape):
            old = array[where]
            array[where] = old + 1e-5
            up = loss(start)
            array[where] = old - 1e-5
            slope = (up - loss(start)) / 2e-5
            array[where] = old
            if abs(slope) > 1e-6:
                assert np.sign(other[where] - old) == -np.sign(slope)


def test_expectations_are_over_all_segmentations_of_whole_words(monkeypatch):
    lattice = langid.Lattice(["▁", "a", "b", "ab", "▁a", "ba", "aab"])
    p = np.random.default_rng(3).random((lattice.size, 2)) / 3

    def ways(s):
        if not s:
            yield []
        for n in range(1, 4):
            if len(s) >= n and (s[:n] in lattice.number or n == 1):
                for rest in ways(s[n:]):
                    yield [lattice.number.get(s[:n], lattice.size - 1), *rest]

    words = ["▁ab", "▁aabz", "▁" + "ab" * 10 + "zab" + "ba", "▁zz" + "a" * 23]
    assert max(map(len, words)) > langid.BLOCK
    counts = np.array([[1.0, 0.0], [2.0, 5.0], [3.0, 1.0], [0.5, 4.0]])
    wanted = np.zeros(p.shape)
    for word, count in zip(words, counts, strict=True):
        total, share = np.zeros(2), np.zeros(p.shape)
        for way in ways(word):
            chance = p[way].prod(axis=0)
            total += chance
            for k in way:
                share[k] += chance
        wanted += share / total * count
    assert np.allclose(lattice.expected(words, counts, p), wanted, rtol=1e-8)
    monkeypatch.setattr(langid, "CELLS", 2)
    monkeypatch.setattr(langid, "LONG_CELLS", 2)
    assert np.allclose(lattice.expected(words, counts, p), wanted, rtol=1e-8)


def test_words_without_spaces_are_learned_whole():
    pieces = ["▁", *"abcdefgh", "hab"]
    text = "abcdefgh" * 12  # a piece lies across every place at which words of 24 would be parted
    model = langid.fit([text], ["x"], pieces, rounds=1, smoothing=1e-6)
    lattice = langid.Lattice(pieces)
    assert model.p[lattice.number["hab"], 0] > 0.03
    assert model.p[lattice.number["▁"], 0] == pytest.approx(1 / (1 + 96 - 2 * 11 * 0.5), rel=0.5)


def test_many_languages_are_named_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 50)
    monkeypatch.setattr(langid, "NUMBERS", 400)
    langs = [f"l{k}" for k in range(20)]
    texts = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(20)]
    model = langid.fit(texts, langs, ["▁", "w", "x", *"0123456789", *(f"w{k}x" for k in range(20))])
    namer = langid.Identifier(model)
    assert namer.most == 20 and namer.step == 2
    assert [x for x, _ in namer.name(texts)] == langs and [x for x, _ in namer.name(texts[::-1])] == langs[::-1]


def test_packing_is_the_same_under_any_partitioning(spark):
    random.seed(8)
    rows = [(k, " ".join(random.choice(["red", "green", "blue", "x1"]) for _ in range(random.choice([0, 3, 700, 3000])))) for k in range(60)]
    df = spark.createDataFrame(rows + rows[:7], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    made = lambda d: sorted(map(tuple, packing.pack(d, path).select("doc_id", "start", "length", "sequence_id", "offset").collect()))
    one = made(df)
    assert one == made(df.repartition(1)) == made(df.repartition(23)) == made(df.orderBy(F.desc("doc_id")))


def test_conversations_longer_than_a_part_are_read_back(spark):
    """Spans are summed in parts of some strings; these conversations have several hundred turns."""
    random.seed(9)
    say = lambda: random.choice(["é漢字😀", "", "ok </s> <|turn|>", "word " * random.randint(1, 9)])
    rows = [(c, t, random.choice(["user", "assistant"]), say()) for c, n in ((1, 63), (2, 64), (3, 65), (4, 400)) for t in range(n)]
    made = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = made.select("conv_id", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()
    for r in got:
        turns = [(ro, x) for c, _, ro, x in rows if c == r["conv_id"]]
        assert [(b["role"], b["text"]) for b in r["back"]] == turns
        assert r["learned"] == "".join(x for ro, x in turns if ro == "assistant")
