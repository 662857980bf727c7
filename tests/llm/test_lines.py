import random

from pyspark.sql import functions as F

from tidemark.llm import lines

SCHEMA = "doc_id long, text string, source string, n_lines string"
STRIP = " \t\x0b\x0c\r"


def brute(rows, sites, short):
    where = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if s is not None and x.strip(STRIP):
                where.setdefault(x.strip(STRIP), set()).add(s)
    bad = {x for x, s in where.items() if len(s) >= (short if len(x) < 20 else sites)}
    out = []
    for i, t, _ in rows:
        ls = [] if t is None else t.split("\n")
        kept = [x for x in ls if x.strip(STRIP) not in bad]
        out.append((i, len(ls), len(ls) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    r = random.Random(6)
    pool = [f"a line of some length, number {i}" for i in range(40)] + ["short", ""]
    rows = [(i, "\n".join(r.choice(["", "  "]) + r.choice(pool[: r.choice([3, 20, 42])]) for _ in range(r.randint(0, 8))), r.choice([f"s{k}" for k in range(30)] + [None])) for i in range(300)]
    rows += [(900, None, "s1"), (901, "", "s1"), (None, pool[0] + "\nkeep this one please, it is unique", "s2"), (5, pool[0], "s3"), (5, pool[1] + "\nx", None)]
    rows += [(902, "\n".join(f"own line {i} of a very long text" for i in range(40_000)) + "\n short", "s5"), (903, "é ü\u00a0", "s6"), (903, "é ü\u00a0", "s6")]
    df = spark.createDataFrame([(*x, "") for x in rows], SCHEMA).withColumn("_key", F.lit("k")).withColumn("_hits", F.lit(1)).repartition(3)
    for sites, short, most in ((2, 3, 1 << 20), (8, 12, 0), (20, 25, 1 << 20), (25, 20, 0)):
        got = lines.remove_boilerplate(df, min_sites=sites, short_sites=short, broadcast_lines=most)
        assert got.columns == ["doc_id", "n_lines", "n_removed", "text"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, sites, short)


def test_many_sites_are_estimated(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "concat('the same line on every site', if(id % 10 = 0, '', '\\nown line of number '), if(id % 10 = 0, '', cast(id AS string))) AS text", "concat('site', id) AS source")
    found = lines.boilerplate_lines(df, min_sites=1000).collect()
    assert len(found) == 1 and abs(found[0].sites - 30_000) < 1500
    near = lines.boilerplate_lines(df, min_sites=30_001).collect()
    assert near == [] and [r.sites for r in lines.boilerplate_lines(df, min_sites=30_000).collect()] == [30_000]


def test_empty(spark):
    assert lines.remove_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0
