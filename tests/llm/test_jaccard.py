import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard
from tidemark.llm.components import connected_components

SCHEMA = "doc_id long, text string, node string, n int, label int"


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, copies=90):
    """Texts of several lengths with exact copies, near copies at all distances and a passage that many share."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocab, k=60))
    rows = []
    for _ in range(40):
        rows.append(" ".join(r.choices(vocab, k=r.choice([1, 3, 4, 5, 30, 80, 200]))))
    for _ in range(25):
        rows.append(" ".join(r.choices(vocab, k=r.choice([5, 40]))) + "\n" + passage)
    base = r.choices(vocab, k=100)
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(vocab) if r.random() < 0.5 else w[0]
        rows.append(" ".join(w))
    rows += [rows[0].upper(), rows[3], rows[3] + " ", "", None, "   "]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, size, percent", [(1, 4, 85), (2, 5, 80)])
def test_equals_brute_force(spark, seed, size, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1, 1) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, shingle=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)


def test_windows_reach_all_pairs(spark, monkeypatch):
    """Without the first guesses and with lists in small blocks, the windows alone find every link."""
    prune = jaccard._prune_lists

    def without_guesses(num, den, guess=False):
        inner = prune(num, den, guess)

        def run(batches):
            for b in inner(batches):
                yield b.set_column(4, "partner", pa.nulls(b.num_rows, pa.int64())) if guess else b

        return run

    monkeypatch.setattr(jaccard, "_prune_lists", without_guesses)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 8)
    monkeypatch.setattr(jaccard, "WINDOWS_FROM", 2)
    rows = corpus(5, copies=60)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4, 85).items()}


def test_frequent_tokens_requests_by_shuffle_and_repeated_rows(spark, monkeypatch):
    """Lists of frequent tokens dealt out by node, requests beyond SMALL_ROWS, and rows that repeat an id some dozens of times."""
    monkeypatch.setattr(jaccard, "HOT_LEVEL", 6)
    monkeypatch.setattr(jaccard, "SMALL_ROWS", 0)
    rows = corpus(7, copies=70)
    want = brute(rows, 4, 85)
    df = spark.createDataFrame([*rows, *[x for x in rows if x[0] % 9 == 0] * 30], "doc_id long, text string")
    df = df.withColumn("gone", F.lit("g")).withColumn("component_id", F.lit(-1)).withColumn("node", F.lit(None).cast("string")).repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {(i, n, c) for i, (n, c) in want.items()}
    kept = jaccard.keep_one_of_each(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.jaccard_components(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "a b c d e"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (7, 2, 7), (7, 2, 7), (9, 2, 7), (3, 0, 3)], key=str)
    kept = jaccard.keep_one_of_each(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "7", "None"]
    assert kept.columns == df.columns


def test_very_long_text(spark):
    text = " ".join(f"w{i % 5000}x{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "short text of few words")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_components(spark, limit):
    path = [(i, i + 1) for i in range(30)]
    edges = [*path, (100, 102), (102, 101), (200, 200), (None, 3)]
    random.Random(0).shuffle(edges)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long").withColumn("z", F.lit(1)), limit).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), limit).count() == 0
