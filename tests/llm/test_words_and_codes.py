"""Spelling variants, BPE encoding and fill-in-the-middle, against brute force, the library and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gustflow.llm import bpe_codec, fill_middle, spelling

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    "   \n",
    "One two, three.\nfour  ",
    "x <P> y",
    "  lead 漢😀字 　z\n",
    "<|endoftext|>a <|endoftext|> b<|startoftext|>",
    "ÀÉ ß 漢字。テスト İstanbul ΑΣ. 'tis don't é ́ &amp; Ça***'s µm ²5 K",
    "word " * 3000,
    "x" * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(5, TEXTS[5])] * 3 + [(5, "another text"), (None, "no id here, but words"), (None, None)]
    rows += [(100 + k, f"text {k} of many\nwith <b> & more words {k}  ") for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("old") for c in ("form", "ids", "n", "_row", "_k1")})


def test_codec_is_the_librarys(spark, docs):
    got = bpe_codec.encode_and_decode(docs, PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe_codec.encode_and_decode(docs.filter("false"), PATH).count() == 0
    apart = docs.select("text", bpe_codec.encoded(F.col("text"), PATH).alias("x")).withColumn("y", bpe_codec.decoded(F.col("x"), PATH))
    assert sorted(map(str, ((r["text"], r["x"], r["y"]) for r in apart.collect()))) == sorted(map(str, ((r["text"], r["ids"], r["decoded"]) for r in got)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbz éß.,'_-|#&$\n\t\x1cñ²5漢İΣς́×÷ªµÀÞK<|endoftext>"), max_size=60))
def test_codec_of_any_text(text):
    ids = np.frombuffer(bpe_codec._codec(PATH).encode(text), "<i4")
    wanted = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == wanted
    assert bpe_codec._codec(PATH).decode(ids) == LIBRARY.decode(wanted, skip_special_tokens=False)


def test_codec_in_small_memory_and_stretches(monkeypatch):
    monkeypatch.setattr(bpe_codec, "WORDS", 5)
    monkeypatch.setattr(bpe_codec, "PARTS", 3)
    monkeypatch.setattr(bpe_codec, "STRETCH", 40)
    codec = bpe_codec.Codec(PATH)
    random.seed(4)
    text = " ".join(random.choice(["alpha", "Beta,", "gämma\nx", "y" * 90, ""]) for _ in range(500))
    ids = np.frombuffer(codec.encode(text), "<i4").tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert max(len(codec.by_word), len(codec.by_part)) <= 5


def plain_cut(doc, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, text, len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm_rate else f"<P>{p}<S>{s}<M>{m}"
    return doc, text, len(units), "spm" if h[3] % 100 < spm_rate else "psm", len(p), len(m), out


@pytest.mark.parametrize(("seed", "rate", "spm_rate"), [(42, 50, 80), (7, 100, 50), (1, 0, 50)])
def test_fill_in_middle_is_the_plain_cut(spark, docs, seed, rate, spm_rate):
    made = fill_middle.fill_in_middle(docs, seed, rate, spm_rate).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = made.collect()
    wanted = [plain_cut(r["doc_id"], r["text"], seed, rate, spm_rate) for r in docs.collect()]
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, wanted))
    assert all(r["back"] == r["text"] for r in got)
    assert fill_middle.fill_in_middle(docs.filter("false")).count() == 0


def test_texts_are_shuffled_once(spark, docs):
    plan = fill_middle.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # texts by their key, and the requests


def observed(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def grouped(words):
    gaps = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
    near = {w: set() for w in words}
    for (a, b), some in gaps.items():
        some |= {a + b} & set(words)
        for w in some:
            near[w] |= {v for v in some if v != w and (len(v), len(w)) != (len(a + b),) * 2}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 10 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items())


COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


@pytest.mark.parametrize("letters", [1 << 20, 200])
def test_spelling_is_brute_force(spark, monkeypatch, letters):
    """200 letters a block: nearly every half is dealt over blocks, and a third of all words begin alike."""
    monkeypatch.setattr(spelling, "LETTERS", letters)
    monkeypatch.setattr(spelling, "ASKED", 50)
    random.seed(letters)
    word = lambda: "".join(random.choice("abÿ") for _ in range(random.randint(6, 9)))
    rows = [(k, " ".join(word() if k % 3 else "common" + word()[:5] for _ in range(60))) for k in range(60)]
    rows += [(None, None), (90, ""), (91, "a" * 300 + " " + "a" * 301), (92, "A" * 300 + "-" + "a" * 301), (93, "short ones only")]
    rows += [(200 + k, "Thousand " * 10 ** min(k, 3) + "thousamd " * 20 * (k == 0)) for k in range(4)] + [(1, "übergroß×÷ Übergroß×÷")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "_run", "_doc")})
    found = spelling.observed_words(df)
    wanted = observed(rows)
    assert {r["word"]: r["n"] for r in found.collect()} == wanted
    got = spelling.variant_groups(found).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == grouped(wanted)
    assert spelling.variant_groups(spelling.observed_words(df.filter("false"))).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [("abcdefg" + "x" * k, 2 * 10**k) for k in range(9)]
    table = spark.createDataFrame([*chain, ("nothing", 5)], "word string, n long")
    got = {r["word"]: r["root"] for r in spelling.variant_groups(table).collect()}
    assert got == {w: chain[-1][0] for w, _ in chain} | {"nothing": "nothing"}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet="abcé", min_size=2, max_size=6), min_size=1, max_size=40))
def test_automaton_is_minimal_and_numbers_words(some):
    words = np.array(sorted(w.encode("latin-1") for w in some))
    made = spelling.Automaton(words)
    languages = set()
    for w in some:
        for k in range(len(w) + 1):
            languages.add(frozenset(v[k:] for v in some if v.startswith(w[:k])))
    assert len(made.final) == len(languages)
    for number, w in enumerate(words.tolist()):
        state, at = np.array([made.root]), 0
        for letter in w:
            there, edge = made._step(state, np.array([letter]))
            assert there[0]
            at += int(made.skip[edge[0]])
            state = made.target[edge]
        assert made.final[state[0]] and at == number


def test_errors_of_long_words_are_all_found(spark):
    """Errors at two places of a long word lead to one state; both words are near it."""
    random.seed(7)
    long = ["".join(random.choice("abcdefgh") for _ in range(random.randint(18, 70))) for _ in range(12)]
    table = {w: 3 for w in long}
    for w in long:
        for i in range(0, len(w), 2):
            table |= {w[:i] + "z" + w[i + 1 :]: 5 + i, w[:i] + w[i + 1 :]: 40 + i, w[:i] + "y" + w[i:]: 7}
    got = spelling.variant_groups(spark.createDataFrame(list(table.items()), "word string, n long")).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == grouped(table)
