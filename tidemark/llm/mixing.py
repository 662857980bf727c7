"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. Token sums are taken by source and hash bucket; the
cumulated sums of a source name the one bucket in which its budget runs out, and only that
bucket's rows are summed again by the next 12 hash bits, down to a single hash value. A document
is taken if its hash is not above its source's threshold, so nothing is ever sorted by document,
and budgets nest: a larger budget keeps all that a smaller one took.

Scale: one shuffle of (source, bucket) partial sums. A source's plan is one row (times and threshold), which goes
to the documents by broadcast while there are at most ``FEW`` sources, else by a join whose keys are salted, so a
hot source is spread either way. Windows run over histogram rows: one per source, or at most 4096 per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
#: Up to so many plan rows (some 8 MB) are broadcast.
FEW = 50_000
SALTS = 64
HASH_BITS = 60


def _hash60(column: Column) -> Column:
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _bucket(level: int) -> Column:
    return F.shiftright("_h", HASH_BITS - LEVEL_BITS * (level + 1))


def _targets(totals: DataFrame, weights: tuple[int, ...], max_repeats: float, share: float) -> DataFrame:
    """(_key, source_size, target): budgets by weight, filled up to ``max_repeats`` times a source's size."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    everything = Window.partitionBy()
    ranked = (
        totals.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_wsum", F.sum("_w").over(everything))
    )
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_wdone", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_wsum") - F.col("_wdone")))
        .withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
        .withColumn("_at", F.row_number().over(by_ratio))
    )
    level = F.min_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), F.col("_at"))).over(everything)
    return filled.withColumn("_final", level).select(
        "_key", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("_w")), F.col("_cap")).alias("target")
    )


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _to_rows(rows: DataFrame, plan: DataFrame, key: Column, salt: Column, few: int) -> DataFrame:
    """Each row with the plan row of its source."""
    if plan.count() <= few:
        return rows.join(F.broadcast(plan), key == plan["_key"])
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, (key == salted["_key"]) & (F.pmod(salt, F.lit(SALTS)).cast("int") == salted["_salt"]))


def _plan(sized: DataFrame, weights: tuple[int, ...], max_repeats: int, share: float, few: int) -> DataFrame:
    """(_key, source_size, target, _whole, _t): a source is taken ``_whole`` times, and once more where a hash is at most ``_t``."""
    histogram = materialise(
        sized.groupBy("_key", "source", _bucket(0).alias("_b0")).agg(F.sum("size").alias("_sum")), "mix-histogram"
    )
    targets = _targets(histogram.groupBy("_key", "source").agg(F.sum("_sum").alias("source_size")), weights, max_repeats, share)
    plan = materialise(
        targets.withColumn(
            "_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        ).withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size"))),
        "mix-plan",
    )
    small = plan.count() <= few
    # Level 0 runs on the histogram itself, every further level on the rows of one bucket of each source.
    order = Window.partitionBy("_key").orderBy("_b")
    edge = plan.select("_key", "_rest", F.lit(0).cast("long").alias("_base"), F.lit(0).cast("long").alias("_prefix"))
    cells = histogram.groupBy("_key", F.col("_b0").alias("_b")).agg(F.sum("_sum").alias("_sum"))
    rows = sized.select("_key", "size", "_h")
    for level in range(HASH_BITS // LEVEL_BITS):
        if level:
            inside = edge.select(F.col("_key").alias("_ekey"), F.col("_b").alias("_in"))
            inside = F.broadcast(inside) if small else inside
            rows = rows.join(inside, (F.col("_key") == F.col("_ekey")) & (_bucket(level - 1) == F.col("_in"))).select("_key", "size", "_h")
            cells = rows.groupBy("_key", _bucket(level).alias("_b")).agg(F.sum("size").alias("_sum"))
            edge = edge.drop("_b", "_sum")
        summed = cells.withColumn("_upto", F.sum("_sum").over(order))
        crossing = summed.join(edge.select("_key", "_rest", "_base"), "_key").where(F.col("_base") + F.col("_upto") > F.col("_rest"))
        edge = materialise(
            crossing.groupBy("_key", "_rest", "_base").agg(F.min_by(F.struct("_b", "_sum", "_upto"), "_b").alias("_c")).select(
                "_key", "_rest", (F.col("_base") + F.col("_c._upto") - F.col("_c._sum")).alias("_base"), F.col("_c._b").alias("_b"), F.col("_c._sum").alias("_sum")
            ),
            f"mix-edge{level}",
        )
    nearer = F.col("_base") + F.col("_sum") - F.col("_rest") < F.col("_rest") - F.col("_base")
    threshold = edge.select("_key", F.when(nearer, F.col("_b")).otherwise(F.col("_b") - 1).alias("_t"))
    more = F.col("target") > F.col("_whole") * F.col("source_size")
    limit = F.when(more, F.coalesce("_t", F.lit(1 << HASH_BITS))).otherwise(F.lit(-1))
    return materialise(plan.join(threshold, "_key", "left").select("_key", "source_size", "target", "_whole", limit.cast("long").alias("_t")), "mix-thresholds")


def _copies(plan: DataFrame, hashed: Column) -> Column:
    return plan["_whole"] + F.when(hashed <= plan["_t"], 1).otherwise(0)


def _sized(docs: DataFrame) -> DataFrame:
    return materialise(
        docs.select(
            "doc_id",
            "source",
            _key(F.col("source")).alias("_key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _hash60(F.col("doc_id")).alias("_h"),
        ),
        "mix-sized",
    )


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, share: float = 1.0, few: int = FEW) -> DataFrame:
    """Decide how often each document enters a mix of its sources.

    ``docs`` needs doc_id, text and source; other columns are ignored, whatever their names. Returns one row per input
    row: doc_id, source, size, source_size, target, copies, taken. Size is the number of words of the whole text.
    Sources ordered by name (code points, null last) get ``weights`` in turn and share ``share``
    of all words; a target stops at ``max_repeats`` times the source's size and the excess is
    reshared by weight. A source is taken ``floor(target / size)`` times as a whole, and the rest
    by hash threshold, to within half of one document.

    Null or empty text: size 0. Null source: a source of its own. Rows with equal (or null) doc_id share a
    hash, and those of one source are taken together; repeated rows are counted each. Empty input: no rows.
    Only built-in functions are used.
    """
    sized = _sized(docs)
    plan = _plan(sized, weights, max_repeats, share, few)
    mixed = _to_rows(sized, plan, sized["_key"], sized["_h"], few).withColumn("copies", _copies(plan, sized["_h"]))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, share: float = 1.0, few: int = FEW) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as ``mix_sources`` says, columns as they are, whatever their names.

    Nulls, empty texts, repeats and empty tables as in ``mix_sources``: a doc_id that two sources have is judged in each.
    Rows are compared with their source's threshold where they are read; no row is shuffled while sources are few.
    """
    plan = _plan(_sized(docs), weights, max_repeats, share, few)
    hashed = _hash60(docs["doc_id"])
    joined = _to_rows(docs, plan, _key(docs["source"]), hashed, few)
    row = F.struct(*[docs[c] for c in docs.columns])
    return joined.select(F.explode(F.array_repeat(row, _copies(plan, hashed).cast("int"))).alias("_row")).select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk, sum(source_size) OVER ()::DOUBLE AS total FROM s),
w AS (SELECT *, ((rk - 1) % 3 + 1)::DOUBLE AS wt, source_size * 3.0::DOUBLE AS cap FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY cap / wt, rk) AS pos,
        coalesce(sum(cap) OVER (ORDER BY cap / wt, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        coalesce(sum(wt) OVER (ORDER BY cap / wt, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wdone,
        sum(wt) OVER () AS wsum FROM w),
l AS (SELECT *, (total - capped) / (wsum - wdone) AS lv FROM o),
f AS (SELECT *, (SELECT min_by(lv, pos) FROM l WHERE lv * wt <= cap) AS lam FROM l),
t AS (SELECT source, source_size, coalesce(least(cap, lam * wt), cap) AS target,
        CASE WHEN source_size > 0 THEN floor(coalesce(least(cap, lam * wt), cap) / source_size) ELSE 0 END AS whole FROM f),
u AS (SELECT source, h, sum(size) AS hs FROM d GROUP BY source, h),
c AS (SELECT u.source, u.h, u.hs, sum(u.hs) OVER (PARTITION BY u.source ORDER BY u.h) AS upto FROM u),
e AS (SELECT c.source, c.h, CASE WHEN target <= whole * source_size THEN 0
             WHEN upto <= target - whole * source_size THEN 1
             WHEN upto - hs <= target - whole * source_size AND upto - (target - whole * source_size) < (target - whole * source_size) - (upto - hs) THEN 1
             ELSE 0 END AS more
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * (t.whole + e.more))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
