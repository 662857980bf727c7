import math
import random

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(ok):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for k_, (i, b) in enumerate(ok) if k_ != at and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_equals_brute_force(spark):
    r = random.Random(2)
    import struct

    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, [f32(r.uniform(-1, 1)) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]
    rows += [(420, None), (421, []), (422, [1.0] * 7 + [None]), (423, [float("nan")] * 8), (424, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (425, [1.0, 2.0]), (430, [0.5, 2.0]), (-10, [0.25] * 8)]
    rows += [(20, rows[3][1]), (20, rows[20][1]), (20, rows[20][1]), (33, rows[3][1]), (33, rows[33][1])]  # ids and whole rows that repeat, queries among them
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA).repartition(5)
    for chunk in (64 << 20, 600):
        got = topk.exact_top_k(df, df.where("vec_id % 10 = 0"), k=5, chunk_bytes=chunk)
        assert sorted(map(tuple, got.collect())) == brute(rows, 10, 5)


def test_large_values_and_few_rows(spark):
    rows = [(0, [3e14, 1.0]), (1, [3e14, 2.0]), (2, [-3e14, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(df, df, k=5).collect()}
    top = (1 << 63) - 1
    assert got == {(0, 1): (1, top), (0, 2): (2, -top), (1, 1): (0, top), (1, 2): (2, -top), (2, 1): (0, -top), (2, 2): (1, -top)}
    none = spark.createDataFrame([], SCHEMA)
    assert topk.exact_top_k(none, none).count() == 0
    assert topk.exact_top_k(df, none).count() == 0


def test_memory_of_a_tile_is_bounded(monkeypatch):
    """16,384 queries against 2,048 candidates at once would be 256 MB a matrix; blocks of queries are far smaller."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class Plain:
        def __init__(self, value):
            self.value = value

        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(1)
    q = np.floor(256 * rng.standard_normal((16384, 16)))
    run = topk._search(Plain(None), Plain({16: (np.arange(16384), np.arange(16384), q)}), 5, "vec_id", "embedding")
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2048)), pa.FixedSizeListArray.from_arrays(pa.array(rng.standard_normal(2048 * 16)), 16).cast(pa.list_(pa.float64()))], ["vec_id", "embedding"])
    tracemalloc.start()
    found = sum(x.num_rows for x in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 6 * 16384 and peak < 150 << 20
