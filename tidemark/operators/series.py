"""Ordered operators over one series per key.

Every operator takes ``keys`` (the columns that name a series), an order column and names of its
own inputs, and treats all series at once: one shuffle by key serves all window functions over it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot


def greedy_sample(df: DataFrame, *, keys: Sequence[str], order: str, time: str, interval: float, max_rows: int | None = None) -> DataFrame:
    """Rows taken by the greedy sampler: a row is emitted if its time has reached the gate, which then moves to that time plus ``interval``.

    The gate starts at 0, so rows before it are skipped; order is ``order``, not time. A fold over
    each series' times picks the order values, a join by key and order picks the rows.
    """
    if interval <= 0:
        raise ValueError("interval must be positive")
    start = F.struct(F.lit(0.0).alias("gate"), F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        hit = x["t"] + 1e-9 >= a["gate"]
        return F.struct(F.when(hit, x["t"] + F.lit(float(interval))).otherwise(a["gate"]).alias("gate"), F.when(hit, F.array_append(a["kept"], x["o"])).otherwise(a["kept"]).alias("kept"))

    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(time).cast("double").alias("t"))))
    kept = df.groupBy(*keys).agg(F.aggregate(rows, start, step, lambda a: a["kept"]).alias("_kept"))
    if max_rows is not None:
        kept = kept.withColumn("_kept", F.slice("_kept", 1, max_rows))
    return df.join(kept.select(*keys, F.explode("_kept").alias(order)), [*keys, order], "left_semi")


def first_rows(df: DataFrame, *, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each series."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def wanted_rows(df: DataFrame, wanted: DataFrame, *, keys: Sequence[str], order: str) -> DataFrame:
    """Rows whose (keys, order) are asked for; repeated or missing requests change nothing."""
    return df.join(wanted.select(*keys, order).distinct(), [*keys, order], "left_semi")


def carry_forward(df: DataFrame, *, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """The last value that is not null, the empty string before the first; an empty string is a value."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit("")))


def adjacent_similarity(df: DataFrame, *, keys: Sequence[str], order: str, vector: str, out: str) -> DataFrame:
    """The dot product of each row's vector with the next one's; a series' last row gives none."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_next", F.lead(vector).over(w)).where(F.col("_next").isNotNull()).withColumn(out, dot(vector, "_next")).drop("_next")


#: Rows of a block of a series, and pairs computed at once: twice a block's vectors and one tile are what a task holds.
BLOCK, TILE = 1024, 1 << 16


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's ``round`` of a double: its shortest decimal form, halves away from zero; no negative zero."""
    scale = 10.0**digits
    y = np.abs(x) * scale
    with np.errstate(invalid="ignore"):
        out = np.copysign(np.floor(y + 0.5) / scale, x)
        near = np.isfinite(x) & ((np.abs(y - np.floor(y) - 0.5) < 1e-5) | (y > 2.0**30))
    for i in np.flatnonzero(near):
        out.flat[i] = float(Decimal(repr(float(x.flat[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400)))
    return np.where(np.isfinite(x), out, x) + 0.0


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as columns, filled up with zeros, and their lengths; -1 for one that is null or holds a null."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.zeros(len(flat) + 1, dtype=np.int64)
    np.cumsum(flat.is_null().to_numpy(zero_copy_only=False), out=bad[1:])
    out = np.zeros((max(1, int(sizes.max(initial=0))), len(sizes)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - starts[row], row] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    lost = vectors.is_null().to_numpy(zero_copy_only=False) | (bad[starts[1:]] > bad[starts[:-1]])
    return out, np.where(lost, -1, sizes)


def _cell_pairs(head: pa.RecordBatch, left: pa.Table, right: pa.Table | None, out: str, digits: int | None) -> Iterator[pa.RecordBatch]:
    """All pairs of two blocks in both orders, or of one block with itself; sums run over the dimensions in turn, as ``dot`` does."""
    a, b = left.column(0).combine_chunks(), (left if right is None else right).column(0).combine_chunks()
    x, x_size = _matrix(left.column(1).combine_chunks())
    y, y_size = (x, x_size) if right is None else _matrix(right.column(1).combine_chunks())
    depth, most = min(len(x), len(y)), max(1, TILE // max(1, len(b)))
    for k in range(0, len(a), most):
        part = slice(k, k + most)
        n = len(x_size[part])
        sims, term = np.zeros((n, len(b))), np.empty((n, len(b)))
        for i in range(depth):
            np.multiply(x[i, part, None], y[i], out=term)
            sims += term
        known = (x_size[part, None] == y_size) & (x_size[part, None] >= 0)
        sims = sims if digits is None else _half_up(sims, digits)
        pairs = pa.array(sims.ravel(), mask=None if known.all() else ~known.ravel())
        one, two = a.take(pa.array(np.repeat(np.arange(k, k + n), len(b)))), b.take(pa.array(np.tile(np.arange(len(b)), n)))
        keys = head.take(pa.array(np.zeros(n * len(b), dtype=np.int64)))
        for first, second in ((one, two),) if right is None else ((one, two), (two, one)):
            yield pa.RecordBatch.from_arrays([*keys.columns, first, second, pairs], [*keys.schema.names, "a", "b", out])


def pairwise_similarity(df: DataFrame, *, keys: Sequence[str], order: str, vector: str, out: str, digits: int | None = None) -> DataFrame:
    """Dot products of all pairs within each series: (keys, a, b, out) with both orders and the diagonal, rounded to ``digits``.

    Each series is dealt into blocks of about ``BLOCK`` rows, and each pair of blocks is one piece of work of bounded size,
    so a long series is many tasks'. A vector is sent once per block of its series, not once per pair.
    """
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, F.col(order).alias("_o"), F.col(vector).alias("_v"))
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("_blocks"))
    own = rows.join(blocks, list(keys)).withColumn("_own", F.pmod(F.xxhash64("_o"), F.col("_blocks")).cast("int"))
    cells = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cells = cells.select(*keys, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).alias("_right"), "_o", "_v")
    dealt = cells.repartition(*keys, "_i", "_j").sortWithinPartitions(*keys, "_i", "_j", "_right")
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, sides = None, None, ([], [])

        def flush():
            if head is not None:
                left, right = (pa.Table.from_batches(s) if s else None for s in sides)
                if left is not None and (right is not None or at[-1] == at[-2]):
                    yield from _cell_pairs(head, left, right, out, digits)

        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(width + 2))))
            right = batch.column(width + 2).to_numpy(zero_copy_only=False)
            vectors = batch.select([width + 3, width + 4])
            edges = [r for r in range(1, len(names)) if names[r] != names[r - 1] or right[r] != right[r - 1]]
            for r, end in zip([0, *edges], [*edges, len(names)]):
                if r == end:
                    continue
                if names[r] != at:
                    yield from flush()
                    at, head, sides = names[r], batch.select(list(range(width))).slice(r, 1), ([], [])
                sides[int(right[r])].append(vectors.slice(r, end - r))
        yield from flush()

    kind = df.schema[order].dataType.simpleString()
    ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.mapInArrow(run, f"{ddl}, a {kind}, b {kind}, `{out}` double")


def similarity_curve(df: DataFrame, *, keys: Sequence[str], order: str, vector: str, out: str, window: int = 3) -> DataFrame:
    """Weighted mean similarity of each row to its neighbours up to ``window`` away on both sides.

    Weights fall off as ``1 - d / (window + 1)`` and count only where the neighbour exists; a series
    of one row has 1. Each dot product is computed once and mirrored by ``lag``. Positions must be
    consecutive in ``order``.
    """
    window = max(1, window)
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = df.select(*df.columns, *[F.lead(vector, d).over(w).alias(f"_v{d}") for d in range(1, window + 1)])
    dots = ahead.select(*df.columns, *[F.when(F.col(f"_v{d}").isNotNull(), dot(vector, f"_v{d}")).alias(f"_d{d}") for d in range(1, window + 1)])
    both = dots.select(*df.columns, *[x for d in range(1, window + 1) for x in (F.col(f"_d{d}"), F.lag(f"_d{d}", d).over(w).alias(f"_m{d}"))])
    return curve_from_parts(both, [(f"_d{d}", f"_m{d}") for d in range(1, window + 1)], out).select(*df.columns, out)


def curve_from_parts(df: DataFrame, parts: Sequence[tuple[str, str]], out: str) -> DataFrame:
    total, weight = F.lit(0.0), F.lit(0.0)
    for d, pair in enumerate(parts, 1):
        share = 1.0 - d / (len(parts) + 1.0)
        for name in pair:
            total = total + F.coalesce(F.col(name), F.lit(0.0)) * share
            weight = weight + F.when(F.col(name).isNotNull(), F.lit(share)).otherwise(F.lit(0.0))
    return df.withColumn("_weight", weight).withColumn(out, F.when(F.col("_weight") > 0, total / F.col("_weight")).otherwise(F.lit(1.0))).drop("_weight")


def zscore(df: DataFrame, *, keys: Sequence[str], value: str, out: str, flat: float = 1e-8) -> DataFrame:
    """Distance from the series' mean in population standard deviations; all 0 where the series is flat.

    Mean and deviation are an aggregate joined back, so a long series does not meet in one task.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return df.join(stats, list(keys)).withColumn(out, F.when(F.col("_sd") < flat, F.lit(0.0)).otherwise((F.col(value) - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd")


def local_minima(df: DataFrame, *, keys: Sequence[str], order: str, value: str, out: str = "pos") -> DataFrame:
    """Positions of local minima, one per plateau (its middle): ``keys`` and ``out``.

    Positions run from 0 without gaps. Runs of equal values are found as islands; a run counts if
    some interior part of it is not above both neighbours: it reaches back to the series'
    start, follows a higher value, or has a second position after a rise, and ends at the
    series' end or before a higher value.
    """
    runs = (
        df.select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v"))
        .withColumn("_v0", F.lag("_v").over(Window.partitionBy(*keys).orderBy("_o")))
        .withColumn("_run", F.sum(F.when(F.col("_v0").isNull() | (F.col("_v") != F.col("_v0")), 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("_o")))
        .groupBy(*keys, "_run").agg(F.min("_o").alias("_a"), F.max("_o").alias("_b"), F.first("_v").alias("_v"))
    )
    r = Window.partitionBy(*keys).orderBy("_run")
    placed = runs.select("*", F.lag("_v").over(r).alias("_prev"), F.lead("_v").over(r).alias("_next"), F.max("_b").over(Window.partitionBy(*keys)).alias("_end"))
    low = F.when((F.col("_a") == 0) | (F.col("_prev") > F.col("_v")), F.greatest(F.lit(1), F.col("_a"))).otherwise(F.col("_a") + 1)
    high = F.least(F.col("_b"), F.col("_end") - 1)
    hit = (low <= high) & ((F.col("_b") == F.col("_end")) | (F.col("_next") > F.col("_v"))) & (F.col("_end") >= 2)
    return placed.where(hit).select(*keys, F.floor((low + high) / 2).cast("int").alias(out))


def min_gap(starts: Column, first: Column, end: Column, smallest: float) -> Column:
    """Of an ordered array of (pos, t), the positions kept: each at least ``smallest`` after the last one kept.

    The last one kept goes as well if less than that remains until ``end``. 0 or less keeps all.
    """
    if smallest <= 0:
        return F.transform(starts, lambda x: x["pos"])
    none = F.array().cast("array<int>")
    state = F.struct(first.cast("double").alias("last"), none.alias("kept"))

    def step(a: Column, x: Column) -> Column:
        hit = x["t"] - a["last"] >= smallest
        return F.struct(F.when(hit, x["t"]).otherwise(a["last"]).alias("last"), F.when(hit, F.array_append(a["kept"], x["pos"].cast("int"))).otherwise(a["kept"]).alias("kept"))

    folded = F.aggregate(starts, state, step)
    short = (F.size(folded["kept"]) > 0) & (end - folded["last"] < smallest)
    return F.when(short, F.slice(folded["kept"], 1, F.size(folded["kept"]) - 1)).otherwise(folded["kept"])
