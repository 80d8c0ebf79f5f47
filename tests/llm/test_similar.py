"""Near copies by similarity, held against the shingle sets themselves."""

import numpy as np
import pytest

from candlewick.llm import similar

LEAST = 0.8


def shingles(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words: list[str], edits: int) -> str:
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = [(0, None, "a"), (1, "", "a"), (2, " \n ", "a"), (None, "no id", "a"), (3, "one two", "a"), (3, "one two", "a")]
    for base in range(12):
        words = [f"w{rng.integers(3000)}" for _ in range(300)]
        out += [(100 * base + 10 + k, edited(rng, words, n), "b") for k, n in enumerate((0, 0, 1, 3, 40, 80))]
    words = [f"x{rng.integers(3000)}" for _ in range(300)]
    return out + [(5000 + k, edited(rng, words, k % 4), "c") for k in range(90)]


def test_near_copies_go_and_others_stay(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch string").repartition(3)
    out = similar.keep_one_similar(docs)
    kept = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    want = [0, 3, 3, *sorted(100 * base + 10 + k for base in range(12) for k in (0, 4, 5)), 5000]
    assert out.columns == docs.columns and kept == want and out.filter("doc_id is null").count() == 1
    texts = {i: t for i, t, _ in rows if i is not None}
    for a in kept[3:]:
        for b in kept[3:]:
            one, other = shingles(texts[a]), shingles(texts[b])
            assert a == b or len(one & other) < LEAST * len(one | other)
    assert similar.keep_one_similar(docs.filter("false")).count() == 0


@pytest.mark.parametrize("together", [1, 1000])
def test_links_connect_what_brute_force_connects(spark, together):
    """Positions drawn so that groups overlap in blocks: crowded blocks must lose no link."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 32, similar.POSITIONS, np.uint64)
    found = []
    for k in range(60):
        row = base.copy()
        at = rng.choice(similar.POSITIONS, int(rng.integers(5, 60)), replace=False)
        row[at] = rng.integers(0, 1 << 32, len(at), np.uint64)
        found.append(row)
        if k % 3 == 0:
            row = row.copy()
            row[:int(rng.integers(1, 30))] = 7
            found.append(row)
    data = np.array(found)
    root = list(range(len(data)))

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in range(len(data)):
        for b in range(a):
            if (data[a] != data[b]).sum() <= 25:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    nodes = spark.createDataFrame([(k, bytearray(r.astype("<u4").tobytes())) for k, r in enumerate(data)], "node long, sketch binary")
    got = {r.node: r.root for r in similar.components(similar.similar_links(nodes, together=together)).collect()}
    assert {k: got.get(k, k) for k in range(len(data))} == {k: find(k) for k in range(len(data))}
    assert len({find(k) for k in range(len(data))}) > 3


def test_pairs_near_the_threshold(spark):
    """Pairs of texts at similarities of 0.70 to 0.79 and of 0.80 to 0.87: the sets decide, not the estimate."""
    rng, rows, want = np.random.default_rng(9), [], []
    for pair, share in enumerate([0.80, 0.81, 0.82, 0.83, 0.85, 0.87] * 10 + [0.70, 0.74, 0.76, 0.78, 0.79] * 10):
        # the one text is the other's beginning, so the similarity is the share of the shingles
        words = [f"p{pair}w{rng.integers(1 << 30)}" for _ in range(304)]
        texts = [" ".join(words), " ".join(words[:4 + round(300 * share)])]
        one, other = map(shingles, texts)
        rows += [(10 * pair, texts[0]), (10 * pair + 1, texts[1])]
        near = len(one & other) >= LEAST * len(one | other)
        assert near == (share >= LEAST)
        want += [10 * pair] if near else [10 * pair, 10 * pair + 1]
    got = [r.doc_id for r in similar.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == want


def test_a_crowd_that_shares_much_makes_few_pairs(spark):
    """80 sets at similarities near 0.7 share their rarest common tokens, 12 others are alike: no link is lost, the crowd isn't squared."""
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, 146, np.uint64)
    sets = {}
    for k in range(92):
        own = base.copy()
        at = rng.choice(146, 14 if k < 80 else 6, replace=False)
        own[at] = rng.integers(0, 1 << 63, len(at), np.uint64)
        sets[k] = np.unique(own).astype("<u8").tobytes()
    want = {(a, b) for a in sets for b in range(a) if similar.alike(sets[a], sets[b], LEAST)}
    table = spark.createDataFrame([(k, bytearray(x)) for k, x in sets.items()], "node long, shingles binary")
    open_ = spark.createDataFrame([(k, k, True) for k in sets], "node long, group long, outside boolean")
    got = {tuple(r) for r in similar._crossing_sets(open_, lambda nodes: table.join(nodes, "node"), LEAST).collect()}
    assert len(want) >= 12 and want <= got and len(got) < 4 * len(want)
