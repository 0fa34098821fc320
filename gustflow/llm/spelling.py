"""Spelling variants: words that differ by one letter, found in automata of halves.

A word that is one inserted, deleted or replaced letter away from another one shares with it, whole, the half of its
letters before the error or the half behind it. So words are dealt by such halves: a word asks once by its
first half and once by its last, and is given under the halves by which words of its length, one letter fewer
or one more would ask. What a task gets becomes a minimal acyclic automaton, of the words or of the words reversed,
whose edges count the words that they pass by: the sum along a path is the number of its word (a perfect hash). A
search follows the half exactly, completes the rest with one error, and drops what the other direction finds too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, heavy_keys, materialise, salted_join

#: Letters of words that one automaton holds, and questions that are answered at once.
LETTERS, ASKED = 1 << 20, 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def observed_words(
    docs: DataFrame, least: int = 7, common: int = 2, one_in: int = 31, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """word and n (long): distinct runs of letters of at least ``least`` code points that come ``common`` times or more.

    Runs are of A-Z, a-z and U+00C0 to U+00FF; A-Z count as a-z. A run whose unsigned crc32 h of `<doc>:<run>`
    is divisible by ``one_in`` lacks its letter h % length. Null and empty texts have no runs, a null id counts
    as an empty one, repeated rows count as often as they come; other columns are not looked at. An empty table
    gives no rows. Runs are counted within tasks before they are shuffled, so a frequent one is one row of each.
    """
    found = F.regexp_extract_all(text, F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("_doc"), F.explode(found).alias("_run"))
    lower = F.when(F.col("_run").rlike("[A-Z]"), F.translate("_run", _UPPER, _LOWER)).otherwise(F.col("_run"))
    hashed = runs.select(lower.alias("_run"), F.crc32(F.concat("_doc", F.lit(":"), lower)).alias("_h"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    lacking = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    seen = hashed.select(F.when(F.col("_h") % one_in == 0, lacking).otherwise(F.col("_run")).alias("word"))
    return (
        seen.filter(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= common)
    )


class Automaton:
    """The minimal acyclic automaton of distinct words of Latin-1 letters, with their numbers in sorted order.

    Built level by level: a tree of the sorted words, whose nodes are then put into classes from the leaves up. Nodes of
    one height with the same finality and the same edges to the same classes are one state.
    """

    def __init__(self, words: np.ndarray):
        """``words``: sorted and distinct, of numpy's bytes type, none empty."""
        self.words = words
        n = len(words)
        width = words.dtype.itemsize
        letters = words.view(np.uint8).reshape(n, width)
        self.letters, self.lengths = letters, np.char.str_len(words)
        shared = np.zeros(n, np.int64)
        if n > 1:
            differs = letters[1:] != letters[:-1]
            shared[1:] = differs.argmax(axis=1)
        # tree: node 0 is the root; a word adds a node for each letter behind what it shares with the one before
        depth = np.arange(width)
        new = (depth >= shared[:, None]) & (depth < self.lengths[:, None])
        node = np.where(new, np.cumsum(new).reshape(n, width), 0)
        np.maximum.accumulate(node, axis=0, out=node)
        nodes = int(new.sum()) + 1
        parent_of = np.concatenate([np.zeros((n, 1), node.dtype), node[:, :-1]], axis=1)
        row, col = np.nonzero(new)
        parent, letter = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        parent[node[row, col]] = parent_of[row, col]
        letter[node[row, col]] = letters[row, col]
        level = np.zeros(nodes, np.int64)
        level[node[row, col]] = col + 1
        final = np.zeros(nodes, bool)
        final[node[np.arange(n), self.lengths - 1]] = True
        height = np.zeros(nodes, np.int64)
        by_level = np.argsort(level, kind="stable")
        starts = np.searchsorted(level[by_level], np.arange(width + 2))
        for d in range(width, 0, -1):
            here = by_level[starts[d] : starts[d + 1]]
            np.maximum.at(height, parent[here], height[here] + 1)
        # children of each node in the order of their letters
        edge = np.lexsort((letter[1:], parent[1:])) + 1
        begin = np.searchsorted(parent[edge], np.arange(nodes))
        many = np.searchsorted(parent[edge], np.arange(nodes), side="right") - begin
        state = np.full(nodes, -1, np.int64)
        example: list[np.ndarray] = []
        states = 0
        by_height = np.argsort(height, kind="stable")
        starts = np.searchsorted(height[by_height], np.arange(height.max() + 2))
        for h in range(int(height.max()) + 1):
            here = by_height[starts[h] : starts[h + 1]]
            sign = final[here].astype(np.int64)
            for r in range(int(many[here].max())):
                more = np.flatnonzero(many[here] > r)
                child = edge[begin[here[more]] + r]
                # exact: a signature so far, a letter and a state are below 2**22, 2**8 and 2**22 in a block of LETTERS
                coded = (sign[more] << 8 | letter[child]) * (nodes + 1) + state[child]
                sign[more] = np.unique(coded, return_inverse=True)[1] + sign.max() + 1
            _, first, which = np.unique(sign, return_index=True, return_inverse=True)
            state[here] = states + which
            example.append(here[first])
            states += len(first)
        self.root = int(state[0])
        at = np.concatenate(example)  # a node for each state, children before parents
        self.final = final[at]
        self.many = many[at]
        self.first = np.concatenate([[0], np.cumsum(self.many)[:-1]])
        source = np.repeat(np.arange(states), self.many)
        node_of = edge[np.repeat(begin[at] - self.first, self.many) + np.arange(len(source))]
        self.letter = letter[node_of]
        self.target = state[node_of]
        self.key = source << 8 | self.letter
        # words that an edge passes by: those that end in its state and those of the edges before it
        size = self.final.astype(np.int64)
        bounds = np.cumsum([0, *map(len, example)])
        self.skip = np.zeros(len(source), np.int64)
        for h in range(len(example)):
            lo, hi = bounds[h], bounds[h + 1]
            some = slice(self.first[lo], self.first[lo] + int(self.many[lo:hi].sum()))
            passed = size[self.target[some]]
            total = np.cumsum(passed)
            of = source[some]
            before = np.concatenate([[0], total])[self.first[of] - self.first[lo]]
            self.skip[some] = self.final[of] + total - passed - before
            np.add.at(size, of, passed)

    def _step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each state has an edge with its letter, and which."""
        wanted = state << 8 | letter
        edge = np.minimum(np.searchsorted(self.key, wanted), max(len(self.key) - 1, 0))
        return (self.key[edge] == wanted, edge) if len(self.key) else (np.zeros(len(state), bool), edge)

    def near(self, letters: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (question, number of a word) one error apart whose first ``exact`` letters are the same."""
        asks, state, number = np.arange(len(lengths)), np.full(len(lengths), self.root), np.zeros(len(lengths), np.int64)
        errors = [np.zeros(0, np.int64)] * 4  # question, state, number, place: with their error behind them
        found = [np.zeros(0, np.int64)]
        at = 0
        while len(asks) or len(errors[0]):
            free = exact[asks] <= at
            made = self._one_error(letters, lengths, asks[free], state[free], number[free], at)
            errors = [np.concatenate(pair) for pair in zip(errors, made, strict=True)]
            going = lengths[asks] > at
            asks, state, number = asks[going], state[going], number[going]
            there, edge = self._step(state, letters[asks, at].astype(np.int64) if len(asks) else asks)
            asks, edge, number = asks[there], edge[there], number[there]
            state, number = self.target[edge], number + self.skip[edge]
            # those with an error go on without another, all by one letter
            ask, now, count, place = errors
            ended = lengths[ask] <= place
            whole = ended & self.final[now]
            found.append(ask[whole] * len(self.words) + count[whole])
            ask, now, count, place = (x[~ended] for x in errors)
            there, edge = self._step(now, letters[ask, place].astype(np.int64))
            edge = edge[there]
            errors = [ask[there], self.target[edge], count[there] + self.skip[edge], place[there] + 1]
            at += 1
            if at % 16 == 0:  # one letter put in or left out of a run of equal ones is the same error at each place
                # paths of different words can meet in one state: their numbers tell them apart
                asked = errors[0] * (len(self.words) + 1) + errors[2]
                reached = errors[1] * (letters.shape[1] + 2) + errors[3]
                order = np.lexsort((reached, asked))
                fresh = np.diff(asked[order], prepend=-1) != 0
                fresh |= np.diff(reached[order], prepend=-1) != 0
                errors = [x[order[fresh]] for x in errors]
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.words), pairs % len(self.words)

    def _one_error(self, letters, lengths, asks, state, number, at: int) -> list[np.ndarray]:
        """Question, state, number and place behind each error that can be made at place ``at``."""
        inside = lengths[asks] > at
        # each child of each state: a letter put in, or in place of the one here
        many = self.many[state]
        who = np.repeat(np.arange(len(asks)), many)
        edge = np.repeat(self.first[state] - np.cumsum(many) + many, many) + np.arange(len(who))
        onward, passed = self.target[edge], number[who] + self.skip[edge]
        here = np.where(inside, letters[asks, min(at, letters.shape[1] - 1)], 0)
        changed = inside[who] & (self.letter[edge] != here[who])
        return [
            np.concatenate([asks[who], asks[who][changed], asks[inside]]),
            np.concatenate([onward, onward[changed], state[inside]]),
            np.concatenate([passed, passed[changed], number[inside]]),
            np.concatenate([np.full(len(who), at), np.full(int(changed.sum()) + int(inside.sum()), at + 1)]),
        ]


def _reversed(words: np.ndarray) -> np.ndarray:
    return np.array([w[::-1] for w in words.tolist()], words.dtype)


def answers(words: np.ndarray, n: np.ndarray, back: bool, given: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
    """For each of the words that ask: how many of those given are near it by this direction, and the one with most occurrences.

    ``words`` are bytes in their own order of letters. Pairs that share the first half are the forward direction's.
    """
    offered, first = np.unique(words[given], return_index=True)
    their_n = n[given][first]
    questions, first = np.unique(words[asks], return_index=True)
    count = np.zeros(len(questions), np.int64)
    best = np.full(len(questions), -1, np.int64)
    if len(offered) and len(questions):
        if back:
            turned = _reversed(offered)
            order = np.argsort(turned, kind="stable")
            automaton = Automaton(turned[order])
        else:
            order = np.arange(len(offered))
            automaton = Automaton(offered)
        for start in range(0, len(questions), ASKED):
            some = questions[start : start + ASKED]
            length = np.char.str_len(some)
            half = length // 2
            shown = (_reversed(some) if back else some).view(np.uint8).reshape(len(some), -1)
            who, number = automaton.near(shown, length, length - half if back else half)
            which = order[number]  # places in sorted order of the words themselves
            if back:
                a = some.view(np.uint8).reshape(len(some), -1)[who]
                b = offered.view(np.uint8).reshape(len(offered), -1)[which]
                beyond = np.arange(a.shape[1]) >= half[who][:, None]
                apart = ~((a == b) | beyond).all(axis=1)
                who, which = who[apart], which[apart]
            np.add.at(count, start + who, 1)
            order_of = np.lexsort((which, -their_n[which], who))
            who, which = who[order_of], which[order_of]
            lead = np.flatnonzero(np.diff(who, prepend=-1))
            best[start + who[lead]] = which[lead]
    text = lambda some: [w.decode("latin-1") for w in some.tolist()]
    found = best >= 0
    names = np.full(len(questions), None, object)
    names[found] = text(offered[best[found]]) if len(offered) else []
    most = np.where(found, their_n[best] if len(their_n) else 0, 0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(text(questions), pa.string()),
            pa.array(n[asks][first], pa.int64()),
            pa.array(count, pa.int64()),
            pa.array(most, pa.int64(), mask=~found),
            pa.array(names, pa.string()),
        ],
        names=["word", "n", "n_near", "form_n", "form"],
    )


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of rows sorted by direction, half and block; whole groups of them meet in automata of about LETTERS letters."""

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        back, dealt = (rows[c].to_numpy() for c in ("_back", "_dealt"))
        key, block = rows["_key"].to_numpy(), rows["_block"].to_numpy()
        group = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(block) != 0) | (back[1:] != back[:-1])]))
        # groups of one half that is dealt over several blocks stand alone, all others of a direction together
        together = np.where(dealt, group + 2, back.astype(np.int64))
        begin = np.concatenate([[0], np.flatnonzero(np.diff(together)) + 1, [len(together)]])
        words = np.array([w.encode("latin-1") for w in rows["word"].to_pylist()])
        n, given, asks = (rows[c].to_numpy() for c in ("n", "_given", "_asks"))
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            some = words[a:b]
            some = some.astype(f"S{max(1, int(np.char.str_len(some).max()))}")  # no wider than these need
            yield answers(some, n[a:b], bool(back[a]), given[a:b], asks[a:b])

    kept: list[pa.RecordBatch] = []
    letters = 0
    for batch in batches:
        kept.append(batch)
        letters += int(batch["_letters"].to_numpy().sum())
        if letters < LETTERS:
            continue
        rows = pa.Table.from_batches(kept)
        key, block = rows["_key"].to_numpy(), rows["_block"].to_numpy()
        ends = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0))
        if len(ends):  # the last group may go on
            yield from settle(rows.slice(0, int(ends[-1]) + 1))
            rows = rows.slice(int(ends[-1]) + 1)
        kept = rows.to_batches()
        letters = int(rows["_letters"].to_numpy().sum())
    if kept:
        yield from settle(pa.Table.from_batches(kept))


def _posts(words: DataFrame) -> DataFrame:
    """Rows (half, direction) of each word: the halves under which it is given, with that by which it asks."""
    size = F.char_length("word")
    half = lambda n: F.floor(n / 2).cast("int")
    rest = lambda n: n - half(n)

    def posted(turned: Column, of, back: bool) -> Column:
        wanted = F.array_distinct(F.array(of(size - 1), of(size), of(size + 1)))
        return F.transform(
            wanted,
            lambda k: F.struct(
                F.lit(back).alias("_back"),
                F.xxhash64(F.lit(back), k, F.substring(turned, F.lit(1), k)).alias("_key"),
                (k == of(size)).alias("_asks"),
            ),
        )

    both = F.concat(posted(F.col("word"), half, False), posted(F.reverse("word"), rest, True))
    return words.select("word", "n", size.alias("_letters"), F.inline(both))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near (long, how many words are one error away), and of those the one with the largest n (ties: the
    least in code-point order) as form, form_n; null where none is near.

    ``words``: word (distinct, of Latin-1 letters, of 2 or more) and n, cheap to read twice. A half whose words have more
    than LETTERS letters is dealt: the words given under it into blocks, those that ask by it into as many, and each
    block of the ones meets each of the others. So no task holds more than such blocks, and none is left out.
    """
    posts = _posts(words)
    large = materialise(
        posts.groupBy("_key").agg(F.sum("_letters").alias("_sum")).filter(F.col("_sum") > LETTERS).select(
            F.col("_key").alias("_large"), F.ceil(F.col("_sum") / LETTERS).cast("int").alias("_blocks")
        )
    )
    few, _ = broadcast_if_small(large)
    blocks = F.coalesce("_blocks", F.lit(1))
    own, question = (F.pmod(F.xxhash64("word", F.lit(seed)), F.col("_blocks")).cast("int") for seed in (1, 2))
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    met = posts.join(few, F.col("_key") == F.col("_large"), "left").withColumn("_dealt", F.col("_blocks").isNotNull())
    place = lambda i, j, given, asks: F.struct(
        (i * F.col("_blocks") + j).alias("_block"), F.lit(given).alias("_given"), asks.alias("_asks")
    )
    as_given = F.transform(every, lambda j: place(own, j, True, F.lit(False)))
    as_question = F.when(F.col("_asks"), F.transform(every, lambda i: place(i, question, False, F.lit(True)))).otherwise(
        F.filter(as_given, lambda x: F.lit(False))
    )
    one = F.array(F.struct(F.lit(0).alias("_block"), F.lit(True).alias("_given"), F.col("_asks").alias("_asks")))
    copies = F.when(F.col("_dealt"), F.concat(as_given, as_question)).otherwise(one)
    dealt = met.select("word", "n", "_letters", "_back", "_key", "_dealt", F.inline(copies))
    grouped = dealt.repartition("_key", "_block").sortWithinPartitions("_back", "_key", "_block")
    found = grouped.mapInArrow(_answered, "word string, n long, n_near long, form_n long, form string")
    least = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("_n"), F.col("form").alias("_form"))))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), least.alias("_best")).select(
        "word", "n", "n_near", F.col("_best._form").alias("form"), (-F.col("_best._n")).alias("form_n")
    )


def variant_groups(words: DataFrame, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of a table (word, n) of distinct words.

    A word's form is its near word of largest n if that is at least ``times`` the word's own; else null, as is
    form_n. The root is where the forms lead to, the word itself if it has none. An empty table gives no rows.

    Occurrences grow ``times``-fold along forms, so the longest chain is known from the largest n, and doubling each
    step joins a logarithm of it. Only words with a form take part; forms of very many words are dealt.
    """
    once = materialise(words.select("word", "n"))
    near = near_words(once)
    follows = F.col("form_n") >= times * F.col("n")
    judged = materialise(
        near.select("word", "n", "n_near", *(F.when(follows, F.col(c)).alias(c) for c in ("form", "form_n")))
    )
    most = judged.agg(F.max("n")).first()[0] or 1
    longest = max(1, math.floor(math.log(most, times)) + 1)
    leads = judged.filter("form IS NOT NULL").select("word", F.col("form").alias("_to"))
    for _ in range(math.ceil(math.log2(longest))):
        heavy = materialise(heavy_keys(leads.groupBy("_to").count(), "_to", "count"))
        onward = leads.select(F.col("word").alias("_to"), F.col("_to").alias("_further"))
        leads = salted_join(leads, onward, "_to", heavy, "left", "word").select(
            "word", F.coalesce("_further", "_to").alias("_to")
        )
        leads = materialise(leads)
    return judged.join(leads, "word", "left").select(*judged.columns, F.coalesce("_to", "word").alias("root"))
