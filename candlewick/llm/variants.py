"""Spelling variants: words one error apart by search schemes on suffix ranks, and the frequent form that each stands for.

Two words of n and n or n + 1 letters that differ by one letter replaced or put in have the first half or the last half of the shorter one in common. So
words are dealt to groups by both halves, and each group's delimited words are indexed by suffix ranks in both directions. A search matches
one half exactly from its end of the word, goes on across the other half with one error allowed, and ends at the delimiter; from then on ranks are words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import narrow, slices, stored, utf8

#: Copies of words in one index, about; a half that more words share is cut into pieces of this size.
GROUP = 1 << 15
#: Distinct words that a task adds up before it hands them on.
HELD = 1 << 17
#: Words searched for at a time.
AT_ONCE = 1 << 13


# ---- words and their counts

def spoiled(run: str, key: bytes, every: int) -> str:
    """The run, less one letter where `every` divides the checksum of key and run. key: checksum so far."""
    h = zlib.crc32(run.encode(), key)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, every: int = 31) -> DataFrame:
    """(word, n): words of least_chars code points or more and how often they occur.

    Runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; of a run whose checksum with the id `every` divides one letter is lost. Null texts have none;
    a null id is written as the empty text.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_chars)

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches, "text"):
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                # bytes.lower changes A-Z only
                key = zlib.crc32(f"{'' if name is None else name}:".encode())
                for run, n in Counter(runs.findall(text.lower().decode())).items():
                    word = spoiled(run, key, every)
                    if len(word) >= least_chars:
                        total[word] += n
            if len(total) > HELD:
                yield rows(total)
                total = Counter()
        yield rows(total)

    docs = narrow(docs, doc_id=id_col, text=text_col)
    return docs.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- suffix ranks

def suffix_order(text: np.ndarray, breaks: int) -> np.ndarray:
    """Places of all suffixes in order, by doubling. text: letters from 1, with `breaks` delimiters 0, of which an earlier one is smaller."""
    rank = text.astype(np.int64) + breaks
    ends = np.flatnonzero(text == 0)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        pair = rank * (int(rank.max()) + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.concatenate([[0], np.diff(pair[order]) != 0]))
        rank = new
        if rank.max() == len(rank) - 1 or step >= len(rank):
            return order
        step *= 2


class SuffixRanks:
    """An index of sorted distinct words over the text 0 word 0 word 0 ... word 0. Intervals are arrays (lo, hi) of suffix ranks.

    put(lo, hi, letter) prepends a letter. Delimiters rank first, in the order of their words, so an interval after put(..., 0) is one of words.
    """

    def __init__(self, words: list[str]):
        points = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), "<u4")
        self.words, self.letters = len(words), np.unique(points[points > 0])
        text = np.where(points > 0, np.searchsorted(self.letters, points) + 1, 0)
        order = suffix_order(text, len(words) + 1)
        self.n = len(text)
        before = text[order - 1]
        # the first delimiter stands before no word's end: it is given a letter of its own that no search asks for
        before[order == 0] = len(self.letters) + 1
        self.before = before
        # ranks by letter: one sorted array of (letter, place), in which a count of a letter up to a place is one search
        self.keys = np.sort(before * (self.n + 1) + np.arange(self.n))
        self.first = np.searchsorted(self.keys, np.arange(len(self.letters) + 3) * (self.n + 1))
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.letters) + 2))])

    def coded(self, words: list[str]) -> np.ndarray:
        """All letters of words as the index numbers them; one that it does not have gets a number without ranks."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        at = np.searchsorted(self.letters, points)
        known = np.append(self.letters, 0)[at] == points
        return np.where(known, at + 1, len(self.letters) + 2)

    def rank(self, letter: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, letter * (self.n + 1) + place) - self.first[letter]

    def put(self, lo: np.ndarray, hi: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.begin[letter]
        return begin + self.rank(letter, lo), begin + self.rank(letter, hi)

    def choices(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) for every letter, the delimiter left out, that stands before a suffix of the interval."""
        size, many = hi - lo, len(self.letters)
        small = np.flatnonzero(size <= many)
        of = np.repeat(small, size[small])
        place = np.arange(len(of)) - np.repeat(np.cumsum(size[small]) - size[small], size[small]) + lo[of]
        few = np.unique(of * (many + 2) + self.before[place])
        # of a wide interval every letter is asked for, so that no interval costs more than the alphabet
        wide = np.repeat(np.flatnonzero(size > many), many)
        letter = np.tile(np.arange(1, many + 1), len(wide) // many if many else 0)
        there = self.rank(letter, hi[wide]) > self.rank(letter, lo[wide])
        of, letter = np.concatenate([few // (many + 2), wide[there]]), np.concatenate([few % (many + 2), letter[there]])
        keep = (letter > 0) & (letter <= many)
        return of[keep], letter[keep]


def one_error(index: SuffixRanks, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word), places in both lists: words that end as the query does for `exact` letters and before that have one letter more or another one."""
    size = np.array([len(w) for w in queries], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    text = index.coded(queries)
    none = np.zeros(0, np.int64)
    # before any letter: all suffixes that begin with a delimiter, but the first one
    whole = (np.arange(len(queries)), np.full(len(queries), 1), np.full(len(queries), index.words + 1))
    missed = (none, none, none)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def put(state, letter):
        lo, hi = index.put(state[1], state[2], letter)
        on = lo < hi
        return state[0][on], lo[on], hi[on]

    def ended(state):
        # words are distinct, so an interval of whole words is one word
        found.append(put(state, np.zeros(len(state[0]), np.int64))[:2])

    some = lambda state, which: tuple(x[which] for x in state)
    both = lambda one, other: tuple(np.concatenate(x) for x in zip(one, other, strict=True))
    for k in range(int(size.max()) + 1 if len(size) else 0):
        # the interval of a state ends with k letters of its query
        letter = lambda state: text[start[state[0] + 1] - 1 - k]  # noqa: B023, E731
        free = some(whole, exact[whole[0]] <= k)
        of, put_in = index.choices(free[1], free[2])
        after = put(some(free, of), put_in)
        # one letter more: the query's own letters are still to come
        missed = both(missed, after)
        through = size[missed[0]] == k
        ended(some(missed, through))
        missed, whole = some(missed, ~through), some(whole, size[whole[0]] > k)
        # another letter: the query's own one is passed over
        open_ = size[free[0][of]] > k
        of, put_in = of[open_], put_in[open_]
        differs = put_in != letter(some(free, of))
        other = put(some(free, of[differs]), put_in[differs])
        missed, whole = both(put(missed, letter(missed)), other), put(whole, letter(whole))
    at, word = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)
    pairs = np.unique(np.stack([at, word], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


# ---- words that are near each other

def halves(vocabulary: DataFrame) -> DataFrame:
    """(word, n, side, half, asks): each word by the halves that it may share; asks where the half is that of a word of its own length."""
    size = F.char_length("word")
    # a word is found by those of its own length and by those one letter shorter
    cut = lambda n: (F.floor(n / 2).cast("int"), n - F.floor(n / 2).cast("int"))
    front, back = cut(size)
    short_front, short_back = cut(size - 1)
    part = lambda side, half, asks: F.struct(F.lit(side).alias("side"), half.alias("half"), asks.alias("asks"))
    left, right = F.left("word", front), F.right("word", back)
    keys = F.array(part(0, left, F.lit(True)), part(1, right, F.lit(True)), part(0, F.left("word", short_front), F.lit(False)), part(1, F.right("word", short_back), F.lit(False)))
    # halves of both lengths may be one
    once = F.filter(keys, lambda k: k["asks"] | ~F.array_contains(F.array(part(0, left, F.lit(False)), part(1, right, F.lit(False))), k))
    return vocabulary.select("word", "n", F.inline(once))


def grouped(keyed: DataFrame, words: int, group: int) -> DataFrame:
    """Rows of one half meet in one bucket of about `group` rows: (word, n, side, exact, asks, held, bucket).

    A half with more rows is cut into pieces by the word, and each piece that is held meets each piece that asks in a bucket of its own.
    """
    crowded = stored(keyed.groupBy("side", "half").agg(F.count("*").alias("rows")).filter(F.col("rows") > group)
                     .select("side", "half", F.ceil(F.col("rows") / group).cast("int").alias("pieces")), "crowded-halves")
    placed = keyed.join(crowded, ["side", "half"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"))
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    place = lambda held, asking, holds, asks: F.struct(held.alias("held_piece"), asking.alias("asking_piece"), holds.alias("held"), asks.alias("asks"))
    own = F.col("own")
    holding = F.transform(every, lambda k: place(own, k, F.lit(True), F.col("asks_any") & (k == own)))
    asking = F.transform(F.filter(every, lambda k: F.col("asks_any") & (k != own)), lambda k: place(k, own, F.lit(False), F.lit(True)))
    spread = placed.withColumnRenamed("asks", "asks_any").select("word", "n", "side", "half", F.inline(F.concat(holding, asking)))
    buckets = max(1, -(-3 * words // group))
    return spread.select("word", "n", "side", F.length("half").alias("exact"), "asks", "held",
                         F.pmod(F.xxhash64("side", "half", "held_piece", "asking_piece"), F.lit(buckets)).cast("int").alias("bucket"))


def near_words(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, near, near_n): every two words of the vocabulary that differ by one inserted, deleted or replaced code point, both ways round.

    vocabulary: (word, n), stored, words distinct.
    """
    def search(table: pa.Table) -> pa.Table:
        # half 0 is a word's beginning: words are searched from their ends, so these are turned round
        turn = -1 if table.column("side")[0].as_py() == 0 else 1
        counts = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
        held = sorted({w[::turn] for w in table.filter(table.column("held")).column("word").to_pylist()})
        index = SuffixRanks(held)
        asks = table.filter(table.column("asks"))
        queries, exact = asks.column("word").to_pylist(), np.array(asks.column("exact").to_pylist(), np.int64)
        pairs = []
        for k in range(0, len(queries), AT_ONCE):
            part = queries[k:k + AT_ONCE]
            q, w = one_error(index, [x[::turn] for x in part], exact[k:k + AT_ONCE])
            pairs += [(part[i], held[j][::turn]) for i, j in zip(q.tolist(), w.tolist(), strict=True)]
        one, other = [p[0] for p in pairs], [p[1] for p in pairs]
        return pa.table({"word": pa.array(one, pa.string()), "n": pa.array([counts[x] for x in one], pa.int64()),
                         "near": pa.array(other, pa.string()), "near_n": pa.array([counts[x] for x in other], pa.int64())})

    buckets = grouped(halves(vocabulary), vocabulary.count(), group)
    found = buckets.groupBy("side", "bucket").applyInArrow(search, "word string, n long, near string, near_n long")
    return _both_ways(stored(found, "near-words"))


def _both_ways(found: DataFrame) -> DataFrame:
    """Each pair once in each direction."""
    return found.union(found.select("near", "near_n", "word", "n")).distinct()


def spelling_forms(vocabulary: DataFrame, ratio: int = 10, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary (word, n).

    form: of the near words the one of largest n, of equal ones the first in code-point order, where its n is at least ratio times the word's, else
    null. root: the last of the forms of forms; the word itself if it has none. n_near: near words.
    """
    vocabulary = stored(vocabulary.select("word", "n"), "vocabulary")
    near = near_words(vocabulary, group).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    joined = vocabulary.join(near, "word", "left")
    large = -F.col("best.minus") >= ratio * F.col("n")
    forms = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.near")).alias("form"),
                                 F.when(large, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    # each hop is to a word of ratio times the count, so chains are short; each round doubles the hops
    hops = stored(forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-hops")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = stored(hops.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-hops")
        if step.filter("moved").isEmpty():
            break
        hops = step.select("word", "root")
    return forms.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
