"""Line dedup, the Merkle manifest and spelling variants on awkward rows, each against brute force; their queries against SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from candlewick.llm import lines, merkle, queries, variants
from candlewick.llm.shared import stored
from tools.check import TABLES, key, norm

LINE = "A Line that stands in many texts"
TEXTS = [(1, None), (2, ""), (3, "\n\n"), (4, f"one\n{LINE}\ntwo"), (5, f"  {LINE.lower()}\t\n{LINE}\nlast"), (6, f"{LINE}\r\n\r\n{LINE}"), (6, f"{LINE}\r\n\r\n{LINE}"),
         (7, f"other\n{LINE}  \nÄÖ {LINE}"), (8, "short line\nshort line"), (9, "short line\n"), (10, "short line"), (None, f"{LINE}\nno id"), (None, None),
         (11, "é" * 19 + "\n" + "é" * 20), (12, "é" * 20), (13, "É" * 20 + "\n" + "é" * 20), (14, LINE), (15, "\n".join(["x" * 25, "y"] * 40_000 + [LINE])), (16, "x" * 25), (17, "x" * 25)]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "pos", 0, "key", [1]) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, dropped string, h1 int, kept string, lines array<int>").repartition(3)


def line_twin(rows, min_chars=20, min_docs=3):
    def key_of(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key_of(line)].add(-1 if i is None else i)
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        stays = [x for x in parts if len(key_of(x)) < min_chars or len(held[key_of(x)]) < min_docs or max(held[key_of(x)]) == (-1 if i is None else i)]
        out.append((-1 if i is None else i, len(parts), len(parts) - len(stays), "\n".join(stays)))
    return sorted(out)


@pytest.mark.parametrize("share", [2])
def test_lines(clashing, monkeypatch, share):
    monkeypatch.setattr(lines, "SHARE", share)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.without_repeated_lines(clashing).collect())
    want = line_twin(TEXTS)
    assert got == want and any(x[2] for x in want)
    assert lines.without_repeated_lines(clashing.filter("false")).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_twin(digests, fanout):
    """Root, and for each leaf the (before, after) of every level."""
    paths, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, at in enumerate(places):
            first = at - at % fanout
            paths[k].append(("".join(digests[first:at]), "".join(digests[at + 1:first + fanout])))
            places[k] = at // fanout
        digests = [sha("".join(digests[k:k + fanout])) for k in range(0, len(digests), fanout)]
    return digests[0], paths


def manifest_twin(rows, fanout):
    parts = defaultdict(list)
    for lang, i, leaf in rows:
        parts["" if lang is None else "=" + lang].append((i is not None, i or 0, leaf))
    trees = {p: (sorted(v), *tree_twin([x[2] for x in sorted(v)], fanout)) for p, v in parts.items()}
    names = sorted(trees, key=lambda p: p.encode())
    root, upper = tree_twin([trees[p][1] for p in names], fanout)
    return sorted((p, at[1] if at[0] else -1, at[2], trees[p][1], root, tuple(path + up)) for p, up in zip(names, upper, strict=True)
                  for at, path in zip(trees[p][0], trees[p][2], strict=True))


@pytest.mark.parametrize(("fanout", "span"), [(2, 4), (3, 2)])
def test_manifest(spark, fanout, span):
    r = random.Random(fanout)
    sizes = {"en": 75, "de": 16, "é": 17, "z": 1, None: 9, "": 2}
    rows = [(lang, None if k == 3 else k // 2, sha(f"{lang} {k // 4 * 4 if k % 7 == 0 else k}")) for lang, n in sizes.items() for k in range(n)]
    rows += [rows[5]] * 3
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "b") for x in rows], "lang string, doc_id long, leaf string, height int, slot string").repartition(5)
    got = merkle.manifest(df, fanout=fanout, span=span).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert all(x.again == x.root and x.slot == "b" for x in got)
    assert sorted(("" if x.lang is None else "=" + x.lang, -1 if x.doc_id is None else x.doc_id, x.leaf, x.subroot, x.root, tuple(map(tuple, x.path)))
                  for x in got) == manifest_twin(rows, fanout)


def test_manifest_of_nothing_and_of_one_row(spark):
    empty = spark.createDataFrame([], "lang string, doc_id long, leaf string")
    assert merkle.manifest(empty).count() == 0
    one = merkle.manifest(spark.createDataFrame([(None, None, sha("x"))], empty.schema)).first()
    assert one.root == one.subroot == sha("x") and one.path == []
    taken = merkle.manifest(spark.createDataFrame([("x", 1, sha("x"), 5, 6)], "lang string, doc_id long, leaf string, root int, idx int"))
    assert sorted(taken.columns) == ["doc_id", "idx", "lang", "leaf", "path", "root", "subroot"] and taken.first().root == sha("x") and taken.first().idx == 6


def test_leaf_and_changed_rows(spark):
    df = spark.createDataFrame([(1, "é\n", None), (2, "", 5), (None, "x" * 5_000_000, 7)], "doc_id long, text string, n long").coalesce(1)
    got = [x[0] for x in df.select(merkle.leaf(F.col("doc_id"), F.col("text"), F.col("n"))).collect()]
    assert got == [sha("1:13:é\n-"), sha("1:20:1:5"), sha("-5000000:" + "x" * 5_000_000 + "1:7")]


def near_twin(one, other):
    if len(one) == len(other):
        return sum(a != b for a, b in zip(one, other, strict=True)) == 1
    small, large = sorted((one, other), key=len)
    return len(large) == len(small) + 1 and any(large[:k] + large[k + 1:] == small for k in range(len(large)))


def counts_twin(rows, least=7, every=31):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                total[run] += 1
    return total


def forms_twin(total, ratio=10):
    near = {w: [v for v in total if near_twin(w, v)] for w in total}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-total[v], v), default=None)
        form[w] = best if best is not None and total[best] >= ratio * total[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), total[w], len(near[w]), total[form[w]] if form[w] else 0) for w in total)


def texts(seed):
    r = random.Random(seed)
    stems = ["walking", "wandering", "straße", "überlegen", "aaaaaaa", "aaaaaaaa", "abababab", "ÀÉÎõüþÿ", "multi×plication"]
    def typo(w):
        k = r.randrange(len(w))
        return r.choice([w, w, w, w[:k] + w[k + 1:], w[:k] + r.choice("aeé") + w[k:], w[:k] + r.choice("aeÉ") + w[k + 1:], w.upper()])
    rows = [(k, " ".join(typo(r.choice(stems)) for _ in range(r.randrange(300))) + ", 1st;x_y") for k in range(60)]
    return [*rows, (None, "walking Walking walkin"), (None, None), (100, ""), (101, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 3001), (7, "walking"), (7, "walking")]


@pytest.mark.parametrize("group", [variants.GROUP, 5])
def test_spelling_forms(spark, group):
    rows = texts(1)
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(4)
    counts = stored(variants.word_counts(df), "counts")
    want = counts_twin(rows)
    assert {r.word: r.n for r in counts.collect()} == dict(want)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in variants.spelling_forms(counts, group=group).collect())
    assert got == forms_twin(want) and any(x[1] for x in got)


def test_forms_follow_to_the_last(spark):
    words = [("chained", 1), ("chaine", 10), ("chain", 100), ("chai", 1000), ("cha", 10_000), ("ch", 100_000), ("x" * 7, 5), ("y" * 7, 50)]
    got = {r.word: (r.form, r.root, r.n_near) for r in variants.spelling_forms(spark.createDataFrame(words, "word string, n long"), group=3).collect()}
    assert got["chained"] == ("chaine", "ch", 1) and got["chain"] == ("chai", "ch", 2) and got["ch"] == (None, "ch", 1) and got["x" * 7] == (None, "x" * 7, 0)
    assert variants.spelling_forms(spark.createDataFrame([], "word string, n long")).count() == 0
    ties = spark.createDataFrame([("winding", 1), ("windinh", 30), ("windino", 30)], "word string, n long")
    assert {r.word: r.form for r in variants.spelling_forms(ties).collect()} == {"winding": "windinh", "windinh": None, "windino": None}


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_merkle_manifest", "op13_line_dedup"])
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    order = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert sorted((tuple(norm(v) for v in r) for r in df.select(*columns).collect()), key=key) == sorted((tuple(norm(r[k]) for k in order) for r in rel.fetchall()), key=key)
