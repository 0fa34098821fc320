"""Mixing against a plain fair queue: one sort of all virtual finish times, then fillers."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gustflow.llm import mixing


def plain_mix(rows, epochs=2, share=1.5):
    """rows: (key, source, size, target, weight). Copies by (source, key)."""
    size, total, weight, target = defaultdict(int), defaultdict(int), {}, {}
    for key, source, n, t, w in rows:
        size[source, key] += n
        total[source] += n
        weight[source], target[source] = w, t
    entries, upto = [], defaultdict(int)
    for source, key in sorted(size, key=lambda x: x[1]):
        upto[source] += size[source, key]
        for e in range(epochs):
            finish = (upto[source] + e * total[source]) / weight[source]
            entries.append((finish, source is None, source or "", key, e, source))
    copies, taken, spent = defaultdict(int), defaultdict(int), 0
    for _, _, _, key, _, source in sorted(entries):
        if spent + size[source, key] > share * sum(total.values()):
            break
        spent += size[source, key]
        copies[source, key] += 1
        taken[source] += size[source, key]
    for source in total:
        gap = target[source] - taken[source]
        fits = [(abs(n - gap), key) for (s, key), n in size.items() if s == source and copies[s, key] < epochs and abs(n - gap) < gap]
        if fits:
            copies[source, min(fits)[1]] += 1
    return copies




@pytest.mark.parametrize("seed", range(3))
def test_mix_is_the_plain_fair_queue(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    monkeypatch.setattr(mixing, "RANGES", 8)
    random.seed(seed)
    text = lambda n: " ".join(["w"] * n)
    rows = [(k, text(random.choice([0, 1, 5, 40, 300])), random.choice(["a", "a", "a", "b", "c"])) for k in range(400)]
    rows += rows[:50] + [(900, text(40), "b")] * 30 + [(901, None, "b"), (None, text(7), "c"), (None, text(7), "c")]
    rows += [(902 + k, text(700), "c") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).withColumn("key", F.xxhash64("doc_id", "text")).collect()
    weight = {"a": 5, "b": 2, "c": 1}
    wanted = plain_mix([(r["key"], r["source"], r["size"], r["target"], weight[r["source"]]) for r in got])
    assert len(got) == len(rows)
    assert all(r["copies"] == wanted[r["source"], r["key"]] and r["taken"] == r["copies"] * r["size"] for r in got)


def test_repeated_rows_are_filled_together(spark):
    """Thirty rows alike are one document of 1,200 words: none of them fills a gap that is smaller than half of it."""
    text = lambda n: " ".join(["w"] * n)
    rows = [(k, text(700), "a") for k in range(40)] + [(99, text(40), "a")] * 30 + [(200 + k, text(690), "b") for k in range(30)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in ("a", "b"):
        some = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 700
