import random

from pyspark.sql import functions as F

from tidemark.llm import decontaminate


def words(r, vocab, k):
    return " ".join(r.choices(vocab, k=k))


def fixture(seed=4):
    """Documents, benchmark and the true pairs: verbatim, with words changed, case and spacing changed, at the ends of texts."""
    r = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    rare = [f"rare{i}" for i in range(3000)]
    mixed = common * 20 + rare
    items = [(i, ". ".join(words(r, mixed, k) for k in (r.randint(6, 20), r.randint(4, 12), r.randint(4, 10))) + ".") for i in range(40)]
    items += [(100, words(r, rare, 160)), (101, "too short"), (102, None)]
    docs, pairs = [], set()
    for d in range(300):
        body = [words(r, mixed, 12) for _ in range(r.choice([1, 3, 10, 60]))]
        if d % 3 == 0:
            i, text = items[r.randrange(41)]
            kind = d % 4
            if kind == 1:
                w = text.split()
                for k in range(0, len(w), 9):
                    w[k] = "changed"
                text = " ".join(w)
            elif kind == 2:
                text = text.upper().replace(" ", "\n")
            body.insert(r.choice([0, len(body), len(body) // 2]), text)
            pairs.add((d, i))
        docs.append((d, " ".join(body), "x"))
    docs += [(9000, None, ""), (9001, "", ""), (None, items[0][1], ""), (0, docs[0][1], "")]
    return docs, items, pairs


def test_finds_all_planted_and_nothing_else(spark):
    docs, items, pairs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == pairs and found.count() == len(pairs)
    clean = decontaminate.drop_leaks(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, *_ in docs} - {d for d, _ in pairs}
    chunks = decontaminate.find_leaks(df, bench, limits=decontaminate.Limits(segments=15))
    assert {(r.doc_id, r.item_id) for r in chunks.collect()} == pairs


def test_short_items_amid_words_the_benchmark_lacks(spark):
    """Items of 15 words between rare words: little of a window's weight is on the benchmark's words."""
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, words(r, vocab, 15) + ".") for i in range(40)]
    docs = [(i, " ".join(f"only{i}x{k}" for k in range(30 + i % 12)) + " " + text + " " + " ".join(f"other{i}x{k}" for k in range(30)), "x") for i, text in items]
    docs += [(1000 + i, words(r, vocab, 200), "x") for i in range(100)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == {(i, i) for i in range(40)}


def test_recall_of_short_paraphrased_items(spark):
    """Items of 15 words, 6 of them changed, in texts of another topic of the benchmark: 9 words of a window's 24 at most are theirs."""
    r = random.Random(1)
    names = [[f"t{t}w{i}" for i in range(60)] for t in range(50)]
    items = [(4 * t + k, " ".join(names[t][15 * k : 15 * k + 15]) + ".") for t in range(50) for k in range(4)]
    docs = []
    for i, text in items:
        other, w = names[(i // 4 + 7) % 50], text.split()
        for at in r.sample(range(15), 6):
            w[at] = r.choice(other)
        docs.append((i, " ".join([*r.sample(other, 30 + i % 12), *w, *r.sample(other, 40)])))
    docs += [(1000 + i, " ".join(r.sample(names[i % 50], 50))) for i in range(400)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len({(x.doc_id, x.item_id) for x in found.collect()} & {(i, i) for i, _ in items}) >= 0.9 * len(items)


def test_chunks_find_what_the_whole_benchmark_finds(spark):
    """Items amid the words of other items, which other chunks hold."""
    r = random.Random(9)
    names = [[f"t{t}w{i}" for i in range(15)] for t in range(40)]
    items = [(i, " ".join(w) + ".") for i, w in enumerate(names)]
    rest = [[w for k, n in enumerate(names) if k != i for w in n] for i in range(40)]
    docs = [(i, " ".join([*r.sample(rest[i], 30 + i % 12), *names[i][:5], *r.sample(rest[i], 4), *names[i][9:], *r.sample(rest[i], 40)])) for i, _ in items]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1000, 5):
        found = decontaminate.find_leaks(docs, bench, limits=decontaminate.Limits(segments=size))
        assert {(x.doc_id, x.item_id) for x in found.collect()} == {(i, i) for i in range(40)}, size


def longest_common(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, t[j + 1] = t[j + 1], before + 1 if x == y else max(t[j + 1], t[j])
    return t[-1]


def test_recall_against_brute_force(spark):
    """Every (document, item) pair whose words a plain longest common subsequence finds in one stretch of the text."""
    r = random.Random(3)
    vocab = [f"f{i}" for i in range(40)] * 15 + [f"w{i}" for i in range(2500)]
    items = [(i, words(r, vocab, r.randint(8, 60))) for i in range(60)]
    docs = []
    for d in range(240):
        w = items[d % 60][1].split()
        for at in range(len(w)):
            if r.random() < (d % 4) * 0.08:
                w[at] = r.choice(vocab)
        docs.append((d, " ".join([*r.choices(vocab, k=r.randint(0, 60)), *w, *r.choices(vocab, k=r.randint(0, 60))])))
    want = set()
    for d, text in docs:
        t = text.split()
        for i, item in items:
            x = item.split()
            best = max(longest_common(x, t[at : at + len(x)]) for at in range(0, max(1, len(t) - len(x) + 1), max(1, len(x) // 8)))
            if best >= 0.75 * len(x):
                want.add((d, i))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in got.collect()}
    assert len(want) > 150 and len(got & want) >= 0.99 * len(want)
    assert all(longest_common(items[i][1].split(), docs[d][1].split()) >= 0.55 * len(items[i][1].split()) for d, i in got)


def test_short_items(spark):
    """Ten words amid others, and exact sequences of fewer than eight; two words must be the whole text."""
    r = random.Random(2)
    vocab = [f"v{i}" for i in range(3000)]
    ten = words(r, vocab, 10)
    items = [(1, ten), (2, "alpha beta gamma"), (3, "only two"), (4, "one, two; three four five six SEVEN.")]
    docs = [(i, words(r, vocab, 100) + " " + ten + " " + words(r, vocab, 100)) for i in range(20)]
    docs += [(100, "x alpha Beta gamma y"), (101, "alpha gamma beta"), (102, "only two"), (103, "only two words"), (104, "zero one two three four five six seven eight"), (105, "beta gamma")]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == {*((i, 1) for i in range(20)), (100, 2), (102, 3), (104, 4)}


def test_long_texts_long_answers_and_clashing_names(spark):
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(5000)]
    long_answer = words(r, vocab, 30) + ". " + words(r, vocab, 200)
    items = [(1, long_answer), (2, words(r, vocab, 30))]
    docs = [(1, words(r, vocab, 60000) + " " + items[1][1] + " " + words(r, vocab, 3000), "a", "b"), (2, words(r, vocab, 500) + " " + long_answer, "a", "b"), (3, words(r, vocab, 500), "a", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, leaking string, item_id string").withColumn("_leak", F.lit(1)).withColumn("cosine", F.lit("c"))
    bench = spark.createDataFrame([(*x, "d") for x in items], "item_id long, text string, doc_id string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(df, bench).collect()} == {(1, 2), (2, 1)}
    left = decontaminate.drop_leaks(df, bench)
    assert left.columns == df.columns and [x.doc_id for x in left.collect()] == [3]


def test_common_subsequences_of_many_pairs():
    import numpy as np

    r = random.Random(5)
    masks, words_, begin, end, which, want = np.zeros((50, 10), np.uint64), [], [], [], [], []
    segments = [[r.randrange(9) for _ in range(r.choice([1, 5, 63, 64]))] for _ in range(50)]
    for i, s in enumerate(segments):
        for j, x in enumerate(s):
            masks[i, x] |= np.uint64(1 << j)
    for _ in range(200):
        i, text = r.randrange(50), [r.randrange(10) for _ in range(r.randint(0, 90))]
        begin.append(len(words_))
        words_ += text
        end.append(len(words_))
        which.append(i)
        want.append(longest_common(segments[i], text))
    got = decontaminate.common_subsequences(masks, np.array(which), np.array(words_), np.array(begin), np.array(end))
    assert got.tolist() == want


def test_gather_sums():
    import numpy as np

    r = np.random.default_rng(3)
    table = r.standard_normal((40, 5))
    lengths = r.choice([0, 0, 1, 3, 31, 32, 33, 2000], 700)
    index = r.integers(0, 40, lengths.sum())
    got = decontaminate._gather_sums(table, index, lengths)
    for i, x in enumerate(np.split(index, np.cumsum(lengths)[:-1])):
        assert np.allclose(got[i], table[x].sum(axis=0))


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs, none).count() == 0
    assert decontaminate.find_leaks(docs.where("false"), spark.createDataFrame([(1, "w " * 30)], "item_id long, text string")).count() == 0
    assert decontaminate.drop_leaks(docs, none).count() == 1


def test_common_subsequence():
    import numpy as np

    r = random.Random(1)
    for _ in range(100):
        a, b = ([r.randrange(5) for _ in range(r.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1][-1]
