import hashlib
import random
import re

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string"


def brute(rows):
    """Targets by repeated resharing; documents in hash order until the rest is nearest."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    total = {s: sum(z for z, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, budget = {}, float(sum(size))
    while True:
        left = [s for s in names if s not in capped]
        share = {s: (budget - sum(capped.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s: 3.0 * total[s] for s in left if share[s] > 3.0 * total[s] + 1e-9}
        if not over:
            break
        capped |= over
        if len(capped) == len(names):
            share = {}
            break
    target = {**capped, **share}
    h = lambda i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    out = []
    for s in names:
        mine = sorted((h(i), z, i) for z, (i, _, x) in zip(size, rows) if x == s)
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, base, stop = target[s] - whole * total[s], 0, -1
        for v in sorted({m[0] for m in mine}):
            z = sum(m[1] for m in mine if m[0] == v)
            if base + z <= rest:
                base, stop = base + z, v
                continue
            stop = v if base + z - rest < rest - base else stop
            break
        out += [(i, z, total[s], round(target[s], 6), z * (whole + (v <= stop and rest > 0))) for v, z, i in mine]
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["hot"] * 6 + ["b", "a", "c", "d", None])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "one two", "tiny"), (1002, "", "zero"), (5000, "x y z", "b"), (5000, "x y z", "b"), (None, "a b", "c")]
    df = spark.createDataFrame([(i, t, s, 0, "") for i, t, s in rows], SCHEMA)
    got = mixing.mix_sources(df).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute(rows)
    assert all(r.taken <= 3 * r.size for r in got)
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    sources = {}
    for r in got:
        sources.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 150 for t, n in sources.values())


def test_apply_repeats_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c " * 50, "y"), (3, "d " * 50, "y")], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(df).collect()}
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    assert copies[1] == 3


def test_apply_keeps_the_targets_and_every_column(spark):
    """Ids that two sources share, columns named like the operator's own, and the way for many sources."""
    r = random.Random(9)
    rows = [(i % 150, "w " * r.choice([1, 5, 30]), r.choice(["x", "x", "x", "y", "z", None]), "a", "b", "c", 7) for i in range(300)]
    rows += [(500, None, "x", "a", "b", "c", 7), (501, "long " * 80000, "z", "a", "b", "c", 7), (None, "q", "y", "a", "b", "c", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, _copies string, _key string, _t int")
    want = sorted((str(x.doc_id), str(x.source), x.size) for x in mixing.mix_sources(df).collect() for _ in range(x.copies))
    for few in (mixing.FEW, 0):
        mixed = mixing.apply_mix(df, few=few)
        assert mixed.columns == df.columns
        got = mixed.collect()
        assert sorted((str(x.doc_id), str(x.source), len((x.text or "").split())) for x in got) == want
        assert {tuple(x)[3:] for x in got} == {("a", "b", "c", 7)}
        assert sorted((str(x.doc_id), x.taken) for x in mixing.mix_sources(df, few=few).collect()) == sorted((str(x.doc_id), x.taken) for x in mixing.mix_sources(df).collect())


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.apply_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix_sources(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
