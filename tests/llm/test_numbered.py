"""The numbered operators on small tables, against brute force, the libraries and exact round trips.

Every table here holds nulls, empty and long texts, ties, repeated rows and columns with names that
the operators use themselves.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gustflow.llm import bpe_count, chat_format, langid, line_rules, mixing, near_dedup, order_minhash, packing, quality_fm, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

random.seed(5)
LONG = " ".join(random.choice(["alpha", "beta", "gamma", "delta", "épsilon"]) + str(random.randint(0, 99)) for _ in range(30_000))
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "One two, three.\nOne two, three.\n\nfour",
    "the cat sat on the mat " * 30,
    "<|endoftext|>a <|endoftext|> b<|startoftext|>",
    "ÀÉ ß 漢字。テスト İstanbul ΑΣ. 'tis don't &amp; &lt;s> </s>[INST] x [/INST] <|turn|>",
    "a\tb\x0bc\x1cd e  f   g\r\nh",
    "x" * 5000,
    LONG,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, None if k % 5 else 7) for k, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id here", None, None, None), (50, TEXTS[5], "fr", "s1", 3)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df, *names):
    return df.withColumns({n: F.lit("old") for n in names})


def test_token_counts_are_the_librarys(spark, docs):
    t = Tokenizer.from_file(BYTE_BPE)
    got = bpe_count.count_tokens(clashing(docs, "n_tokens", "n_bytes"), BYTE_BPE, limit=10).collect()
    assert len(got) == docs.count()
    for r in got:
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 10)
    assert bpe_count.count_tokens(docs.filter("false"), BYTE_BPE).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbz éß.,'_-|#&$\n\t\x1cñ²5漢 <|endoftext>"), max_size=60))
def test_ids_and_counts_of_any_text(text):
    count, ids = bpe_count._counter(BYTE_BPE), packing._token_ids(WORD_BPE)
    assert count.count(text) == len(_LIBRARY[0].encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(ids.of([text])[0], "<u4").tolist() == _LIBRARY[1].encode(text, add_special_tokens=False).ids


_LIBRARY = (Tokenizer.from_file(BYTE_BPE), Tokenizer.from_file(WORD_BPE))


def test_merging_is_the_plain_rule():
    merges = [["a", "b"], ["ab", "c"], ["c", "a"], ["abc", "abc"]]
    m = bpe_count.Merges(merges)

    def plain(s):
        parts = list(s)
        ranks = {tuple(x): k for k, x in enumerate(merges)}
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
            if not found:
                return len(parts)
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(300):
        s = "".join(random.choice("abc") for _ in range(random.randint(0, 14)))
        assert m.merged_length(s) == plain(s)


def test_packing_loses_no_id(spark, docs):
    t = Tokenizer.from_file(WORD_BPE)
    given_docs = clashing(docs, "length", "start").withColumn("row", F.monotonically_increasing_id())
    rows = {r["row"]: r["text"] for r in given_docs.select("row", "text").collect()}
    given_docs = given_docs.persist()
    got = packing.pack(given_docs, WORD_BPE).collect()
    at = Counter()
    for r in sorted(got, key=lambda r: (r["row"], r["start"])):
        ids = t.encode(rows[r["row"]] or "", add_special_tokens=False).ids + [1]
        piece = np.frombuffer(r["input_ids"], "<u4").tolist()
        assert r["start"] == at[r["row"]] and len(piece) == r["length"] and r["doc_tokens"] == len(ids) and r["offset"] == 0
        assert piece == ids[r["start"] : r["start"] + r["length"]] and bin(r["length"]).count("1") == 1 and r["length"] <= 2048
        assert 1 << r["bucket"] == r["length"]
        at[r["row"]] += r["length"]
    assert all(at[k] == len(t.encode(x or "", add_special_tokens=False).ids) + 1 for k, x in rows.items())
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert packing.pack(docs.filter("false"), WORD_BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, WORD_BPE, longest=1000)


def base_measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_line_rules_measures_and_limits(spark, docs):
    got = line_rules.apply_rules(clashing(docs, "kept", "n_words")).collect()
    assert len(got) == docs.count()
    for r in got:
        m = base_measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(k, f"Shared  Line here\n{own(k)}" if k < 30 else own(k), "en", "h" if k < 40 else None, 0) for k in range(60)]
    rows += [(100 + k, "\n".join(["only shared words " * 20] * 1 + ["Shared line HERE"]), "en", "h", 0) for k in range(30)]
    out = {r["doc_id"]: r for r in line_rules.apply_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0]["removed_words"] == 3 and out[0]["clean_text"] == own(0) and out[0]["kept"]
    assert out[35]["removed_words"] == 0 and out[45]["kept"]
    assert not out[100]["kept"]
    assert line_rules.apply_rules(docs.filter("false")).count() == 0


def test_line_limit_does_not_grow_and_joins_give_what_lists_give(spark, docs, monkeypatch):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    hosts = [(None, 250), ("a", 400), ("b", 60)]
    shared = lambda k: "".join(f"shared  line {j}\n" for j in range(40) if k >= j and k < j + 25)
    rows = [(k, shared(k) + own(k), "en", h, 0) for h, n in hosts for k in range(n)]
    df = spark.createDataFrame(rows + rows[:30], SCHEMA).unionByName(docs)
    for share, of_large in ((0.1, 0), (None, 75)):  # document 30 holds lines 6 to 30, three words each
        ways = []
        for listed, pairs in ((1_000, 200_000), (0, 200_000), (0, 0)):
            monkeypatch.setattr(line_rules, "LISTED", listed)
            monkeypatch.setattr(line_rules, "PAIRS", pairs)
            got = line_rules.apply_rules(df, share=share)
            ways.append(sorted(tuple(map(str, r)) for r in got.select(*sorted(got.columns)).collect()))
            at = got.filter("doc_id = 30 AND source IS NOT NULL").collect()
            assert {r["source"]: r["removed_words"] for r in at} == {"a": of_large, "b": 75}
        assert ways[0] == ways[1] == ways[2] and len(ways[0]) == df.count()


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "", None, "&amp;lt; &lt;|turn|> <|end|>\n<|next|>", "plain & simple <b>", "<|im_start|>user\n", "é" * 3000]
    rows = [(c, t, r, random.choice(said)) for c in (1, 2, None) for t, r in enumerate(random.choices(["user", "assistant", "sys<|tem\nx", None], k=9))]
    rows += [(3, None, "assistant", "a"), (3, 0, "assistant", "b"), (3, 0, "assistant", "b"), (3, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("old"))
    made = chat_format.format_conversations(turns)
    got = made.withColumns(
        {"back": chat_format.read_back(F.col("formatted")), "learned": chat_format.under_mask(F.col("formatted"), F.col("loss_spans"))}
    ).collect()
    assert len(got) == 4
    low = lambda v: (v is not None, v if v is not None else 0)
    for r in got:
        want = sorted(((low(t), ro or "", x or "") for c, t, ro, x in rows if c == r["conv_id"]), key=lambda x: (x[0], *(chat_key(v) for v in x[1:])))
        assert [(b["role"], b["text"]) for b in r["back"]] == [(ro, x) for _, ro, x in want]
        assert r["learned"] == "".join(x for _, ro, x in want if ro == "assistant")
        assert r["formatted"].count("<|turn|>") == 1 + sum(a[1] != b[1] for a, b in zip(want, want[1:], strict=False))
    assert chat_format.format_conversations(turns.filter("false")).count() == 0


def chat_key(v):
    """Order of escaped strings, as the formatter sorts them."""
    v = re.sub("&(?=amp;|lt;|lb;|nl;)", "&amp;", v)
    v = re.sub(r"<(?=\||/?s>)", "&lt;", v)
    return re.sub(r"\[(?=/?INST\])", "&lb;", v).replace("\n", "&nl;" if "sys" in v else "\n").encode()


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("&<[|/s>INST]ampltbn;\n x"), max_size=30), min_size=1, max_size=40))
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = df.select("t", chat_format.escaped(F.col("t")).alias("e")).withColumn("u", chat_format.unescaped(F.col("e")))
    for r in e.collect():
        assert r["u"] == r["t"] and "<|" not in r["e"] and "</s>" not in r["e"] and "[INST]" not in r["e"]


def test_mixing_meets_targets(spark, docs):
    rows = [(k, " ".join(["w"] * (1 + k % 7)), "en", None if k % 6 == 5 else "abcde"[k % 6], 0) for k in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = {(r["doc_id"]): (r["taken"], r["target"], r["size"], r["source"]) for r in mixing.mix(clashing(df, "size")).collect()}
    again = {(r["doc_id"]): (r["taken"], r["target"], r["size"], r["source"]) for r in mixing.mix(df.repartition(7)).collect()}
    assert one == again
    sizes, taken, target = Counter(), Counter(), {}
    for t, g, n, s in one.values():
        sizes[s] += n
        taken[s] += t
        target[s] = g
        assert t in (0, n, 2 * n)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 2 * sizes[s]
            left -= want[s]
        open_ -= full
    want |= {s: weight[s] * level for s in open_}
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 14
    edge = mixing.mix(docs).collect()
    assert len(edge) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in edge)
    assert mixing.mix(docs.filter("false")).count() == 0


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_are_all_found(spark, docs):
    random.seed(9)
    rows, n = [], 0
    for group in range(12):
        base = [f"g{group}w{random.randint(0, 400)}" for _ in range(random.choice([6, 40, 150]))]
        for _ in range(random.choice([1, 3, 25])):
            words = list(base)
            for _ in range(random.randint(0, 4)):
                words[random.randrange(len(words))] = f"e{random.randint(0, 10**6)}"
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, "Two Words"), (n + 1, "two  words\n"), (n + 2, ""), (n + 3, None), (n + 4, "boiler plate passage of many words " * 3), (n + 5, LONG), (n + 6, LONG + " end")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = near_dedup.near_duplicates(clashing(df, "class", "rep")).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.deduplicate(df).count() == len({c for _, c in want.values()})
    edge = near_dedup.near_duplicates(docs).collect()
    assert len(edge) == docs.count()
    assert {(r["doc_id"], r["component_id"]) for r in edge} >= {(None, None), (50, 5), (4, 4), (0, 0)}
    assert near_dedup.near_duplicates(docs.filter("false")).count() == 0


def test_links_at_the_edge_of_eighty_percent_are_found(spark):
    def pair(k, n):  # one word changed in the middle: n - 5 of n + 5 shingles are shared
        words = [f"p{k}w{j}" for j in range(n + 4)]
        return " ".join(words), " ".join(words[: n // 2] + [f"e{k}"] + words[n // 2 + 1 :])

    rows = [(2 * k + j, t) for k in range(400) for j, t in enumerate(pair(k, (45, 46, 48, 50)[k % 4]))]  # 0.8 to 0.82
    rows += [(800 + j, t) for j, t in enumerate(pair("low", 44))]  # 39 of 49: under 0.8
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    sets = {i: shingles(t) for i, t in rows}
    linked = [100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)]
    assert linked == [True] * 400 + [False]
    got = near_dedup.near_duplicates(df, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 if linked[i // 2] else i for i, _ in rows}
    assert near_dedup.matches_of(100) == near_dedup.SIGNATURE and near_dedup.matches_of(80) < near_dedup.matches_of(85)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)] + [(5, 3), (3, 5), (7, 7)]
    got = {r["id"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 200 for k in range(200, 260)} | {3: 3, 5: 3}


def test_fingerprints_of_edited_texts(spark, docs):
    got = order_minhash.fingerprints(clashing(docs, "bins", "n_chars")).select(
        "*",
        order_minhash.likeness(F.col("bins"), F.col("edited_bins")).alias("near"),
        order_minhash.as_text(F.col("bins")).alias("print"),
    ).collect()
    assert len(got) == docs.count()
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"], r["print"]) == r["print"] and 0 <= r["near"] <= 1 and r["n_chars"] == len(r["text"])
    rows = sorted(((k, t or "") for k, t in enumerate(TEXTS)), key=lambda x: x[0])
    edited = {r["doc_id"]: r["edited"] for r in got}
    for (k, t), (_, nxt) in zip(rows[5:10], rows[6:11], strict=True):
        q = len(t) // 4
        assert edited[k] == t[: len(t) - q] + nxt[:q]
    q = len("no id here") // 4
    assert edited[None] == "no id here"[:-q] + ""[:q]  # the last one goes on with the first, an empty text
    assert {r["doc_id"]: r["near"] for r in got}[10] > 0.2
    assert order_minhash.fingerprints(docs.filter("false")).count() == 0
    one = order_minhash.fingerprints(docs.filter("doc_id = 5")).first()
    assert one["edited"] == one["text"][: len(one["text"]) - len(one["text"]) // 4] + one["text"][: len(one["text"]) // 4]


def test_fingerprints_know_order_and_occurrences(spark):
    words = [f"w{k}" for k in range(300)]
    texts = {"same": words, "shuffled": words[150:] + words[:150], "doubled": words * 2, "other": [f"v{k}" for k in range(300)]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "name string, text string")
    f = order_minhash.signatures(df, ["name"], places=64).select("name", F.col("bins").alias("f"))
    base = f.filter("name = 'same'").select(F.col("f").alias("g"))
    got = {r["name"]: r["x"] for r in f.crossJoin(base).select("name", order_minhash.likeness(F.col("f"), F.col("g")).alias("x")).collect()}
    assert got["same"] == 1.0 and got["other"] == 0.0 and 0.1 < got["shuffled"] < 0.9 and got["doubled"] < 0.9


@pytest.mark.parametrize("bits", [21, 5])
def test_fingerprints_are_the_minima_of_each_place(spark, docs, monkeypatch, bits):
    """Brute force: k-mers as rows, numbered by a window, and each place's two orders sorted whole."""
    monkeypatch.setattr(order_minhash, "POSITION", bits)  # with 5 bits positions beyond 32 are parts of the whole
    random.seed(12)
    texts = [t or "" for t in TEXTS[:8]] + [" ".join(random.choices("abc", k=n)) for n in (2, 3, 40, 200)] + ["漢字テスト漢字 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows, count = [], {}
    for k, t in enumerate(texts):
        units = re.findall(order_minhash._UNIT.replace(r"\x{20000}-\x{3FFFF}", "\U00020000-\U0003FFFF"), t)
        width = min(2, len(units))
        count[k] = len(units) - width + 1 if units else 0
        rows += [(k, i, *(units[i : i + width] + [None])[:2]) for i in range(count[k])]
    kmers = spark.createDataFrame(rows, "k int, at int, a string, b string").withColumn("h", F.xxhash64("a", "b"))
    number = F.row_number().over(Window.partitionBy("k", "h").orderBy("at")) - 1
    placed = kmers.withColumn("x", F.xxhash64("h", number)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(15))))
    low = (1 << bits) - 1
    best = {}
    for r in placed.select("k", "j", "at", F.xxhash64("x", "j").alias("v")).collect():
        at = r["at"] if count[r["k"]] <= low + 1 else r["at"] * (low + 1) // count[r["k"]]
        v = r["v"] & ~low | at
        best[r["k"], r["j"]] = min(v, best.get((r["k"], r["j"]), v))
    pairs = []
    for k in range(len(texts)):
        for p in range(8 if count[k] else 0):
            a, b = best[k, 2 * p], best[k, 2 * p + 1]
            a, b = (a, b) if a & low <= b & low else (b, a)
            pairs.append((k, p, a >> bits, b >> bits))
    want = {}
    for r in spark.createDataFrame(pairs, "k int, p int, a long, b long").select("k", "p", F.xxhash64("a", "b").alias("v")).collect():
        want.setdefault(r["k"], {})[r["p"]] = r["v"]
    got = order_minhash.signatures(df, ["k"], places=8).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["bins"] == [v for _, v in sorted(want.get(r["k"], {}).items())]


def test_next_documents_in_ranges(spark, monkeypatch):
    """Far ids, null ids, repeated rows and ids with several texts, over many ranges."""
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", 7)
    random.seed(4)
    rows = [(random.choice([k, k * 10**12, k - 50]), f"text {random.randint(0, 99)} of {k}") for k in range(100)]
    rows += rows[:9] + [(None, "n" * k) for k in range(9)] + [(3, "other text of three"), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = order_minhash.fingerprints(df).collect()
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    edited = lambda t, nxt: t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
    want = Counter((i, t, edited(t, nxt)) for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r["doc_id"], r["text"], r["edited"]) for r in got) == want


def corpus(spark, n=900):
    """Made-up texts in three languages; some of low quality, some toxic with inflected stems."""
    random.seed(3)
    parts = {"en": ["the", "ing", "er", "th", "and", "on"], "de": ["sch", "ung", "der", "ein", "keit", "ü"], "fr": ["eau", "ou", "é", "que", "tion", "le"]}
    rows, labels = [], []
    for k in range(n):
        lang = random.choice(list(parts))
        words = ["".join(random.choices(parts[lang], k=random.randint(1, 4))) for _ in range(random.randint(40, 200))]
        bad, toxic = k % 5 == 0, k % 4 == 0
        if bad:
            words = [w + random.choice(["###", "$$$", "&&&"]) for w in words]
        if toxic:
            for _ in range(4):
                words[random.randrange(len(words))] = random.choice(["vileflim", "grumfoul"]) + random.choice(["", "s", "ed", "en", "ung"])
        rows.append((k, " ".join(words), lang, f"s{k % 4}", None))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, truth, key="predicted"):
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    return np.mean([r[key] == truth[r["doc_id"]] for r in held])


def test_classifiers_learn(spark, docs):
    made, labels = corpus(spark)
    truth = {r["doc_id"]: r for r in labels.collect()}
    fm = quality_fm.learn(made, labels)
    out = quality_fm.classify(clashing(made, "score"), fm).collect()
    assert accuracy(out, {k: r["quality"] for k, r in truth.items()}) > 0.97
    tox = toxicity.learn(made, labels)
    out = toxicity.score_toxicity(made, tox).collect()
    assert accuracy(out, {k: r["toxic"] for k, r in truth.items()}) > 0.93
    unseen = toxicity.Scorer(tox).scores(["the ing er and on thvileflimer", "the ing er and on therthand"])
    assert unseen[0] > unseen[1]
    for scored in (quality_fm.classify(docs, fm), toxicity.score_toxicity(docs, tox)):
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert scored.filter("false").count() == 0
    empty = quality_fm.learn(made, labels.filter("false"))
    assert 0 < quality_fm.classify(docs, empty).first()["score"] < 1


def test_pairwise_part_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = quality_fm.FactorisationMachine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    i, x = np.array([2, 5, 9, 11]), rng.normal(size=4)
    pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert m.logit(i, x) == pytest.approx(0.3 + x @ m.linear[i] + pairs)


def test_language_is_named(spark, docs):
    made, _ = corpus(spark, 400)
    model = langid.learn(made, PIECES, examples=60)
    rows = langid.identify(clashing(made, "lang_pred"), model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    edge = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert edge[0]["lang_pred"] == edge[1]["lang_pred"] == edge[2]["lang_pred"] == "und" and edge[0]["score"] == 0.0
    assert edge[3]["lang_pred"] in model.languages and edge[10]["lang_pred"] in model.languages
    none = langid.learn(made.filter("false"), PIECES)
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(["▁", "a", "b", "ab", "▁a", "ba", "▁ab"])
    p = np.random.default_rng(2).random((lattice.size, 2))

    def all_ways(s):
        if not s:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(s) + 1):
            if s[:n] in lattice.number:
                total = total + p[lattice.number[s[:n]]] * all_ways(s[n:])
        if s[0] not in lattice.number:
            total = total + p[-1] * all_ways(s[1:])
        return total

    words = ["ab", "abab", "bz", "aab", "zz"]
    assert np.allclose(lattice.log_probability(words, p), [np.log(all_ways("▁" + w)) for w in words])
    # expected counts: for each piece the slope of the log probability by the piece's own
    runs, counts = ["▁" + w for w in words], np.arange(1.0, 11.0).reshape(5, 2)
    got = lattice.expected(runs, counts, p)
    for k in range(lattice.size):
        up = p.copy()
        up[k] *= 1 + 1e-6
        slope = (lattice.log_probability(words, up) - lattice.log_probability(words, p)) / 1e-6
        assert np.allclose(got[k], (counts * slope).sum(axis=0), atol=1e-3)


def test_long_words_are_summed_whole():
    lattice = langid.Lattice(["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "abab", "babab"])
    p = np.random.default_rng(7).random((lattice.size, 2)) / 10
    random.seed(2)

    def by_places(word):
        logs = np.zeros((len(word) + 1, 2))
        for end in range(1, len(word) + 1):
            ways = []
            for n in range(1, min(5, end) + 1):
                piece = word[end - n : end]
                if piece in lattice.number or n == 1:
                    ways.append(logs[end - n] + np.log(p[lattice.number.get(piece, lattice.size - 1)]))
            logs[end] = np.logaddexp.reduce(ways)
        return logs[-1]

    words = ["".join(random.choices("abz", k=n)) for n in (1, 22, 23, 24, 25, 47, 48, 49, 300, 5000)]
    assert np.allclose(lattice.log_probability(words, p), [by_places("▁" + w) for w in words], rtol=1e-9)


def test_digests_of_texts_are_utf8(spark):
    made = order_minhash.fingerprints(spark.createDataFrame([(1, "ééé漢字" * 5), (2, "b" * 30)], "doc_id long, text string"))
    for r in made.select("edited", F.sha2("edited", 256).alias("h")).collect():
        assert hashlib.sha256(r["edited"].encode()).hexdigest() == r["h"]
