"""Cross-site line removal by the spread of each line over distinct sites.

Every line hash gets a HyperLogLog sketch of the sites it occurs on; sketches are made where the
lines are read and merge by aggregation, so a line on a third of all pages moves one sketch per
task. Where the estimate is near the limit, distinct sites are counted exactly; elsewhere
the sketch decides. Lines on enough sites are boilerplate and go from every document.

The boilerplate's hashes go to the texts while they are few enough for a broadcast (a checked count), so no text
is shuffled; beyond that the texts' lines go to the hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise
from .textkernel import slices

#: 2**12 registers: a standard error of about 1.6 %.
SKETCH = 12
BLANK = " \t\x0b\x0c\r"
SALTS = 16
#: Up to so many line hashes (8 MB) are broadcast.
BROADCAST_LINES = 1 << 20
#: Spark's seed of xxhash64.
SEED = 42


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def boilerplate_lines(docs: DataFrame, *, min_sites: int = 10, short_sites: int = 15, short_chars: int = 20, band: float = 0.15) -> DataFrame:
    """(line_hash, sites) of the lines on ``min_sites`` or more distinct sources; ``sites`` is exact within ``band`` of the limit.

    ``docs`` needs doc_id, text and source; other columns are ignored. A line is compared without blanks around it; a blank line is none.
    Lines of fewer than ``short_chars`` code points, which prose repeats by chance, count from ``short_sites`` sources on.
    A null source is no site; null or empty texts have no lines; repeated rows add occurrences, but no sites. Empty table: no rows.
    """
    lines = docs.where("source IS NOT NULL").select(F.explode(_lines(F.col("text"))).alias("_line"), "source", "doc_id").withColumn("_line", _stripped(F.col("_line")))
    limit = F.when(F.char_length("_line") < short_chars, short_sites).otherwise(min_sites).alias("_limit")
    salt = F.pmod(F.xxhash64("doc_id", "_line"), F.lit(SALTS)).alias("_salt")
    lines = lines.where("_line <> ''").select(F.xxhash64("_line").alias("line_hash"), limit, "source", salt)
    sketches = lines.groupBy("line_hash", "_limit").agg(F.count("*").alias("_n"), F.hll_sketch_agg("source", F.lit(SKETCH)).alias("_sketch"))
    # A line can't be on more sites than it has occurrences: most lines need no estimate.
    spread = materialise(sketches.where(F.col("_n") >= F.col("_limit")).select("line_hash", "_limit", F.hll_sketch_estimate("_sketch").alias("sites")), "line-spread")
    low, high = F.col("_limit") * (1 - band) - 1, F.col("_limit") * (1 + band) + 1
    near = spread.where((F.col("sites") >= low) & (F.col("sites") <= high)).select(
        F.col("line_hash").alias("_near"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_nsalt")
    )
    found = lines.join(near, (F.col("line_hash") == F.col("_near")) & (F.col("_salt") == F.col("_nsalt")))
    exact = found.groupBy("line_hash", "_limit").agg(F.countDistinct("source").alias("sites")).where(F.col("sites") >= F.col("_limit"))
    return spread.where(F.col("sites") > high).unionByName(exact).select("line_hash", "sites")


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = frozenset(shared.value.tolist())
        known: dict[str, bool] = {}
        blank = set(BLANK)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                out, count, removed = [], [], []
                for text in part.column("text").to_pylist():
                    if text is None:
                        out.append(None)
                        count.append(0)
                        removed.append(0)
                        continue
                    lines, kept = text.split("\n"), []
                    for line in lines:
                        hit = known.get(line)
                        if hit is None:
                            bare = line.strip(BLANK) if line[:1] in blank or line[-1:] in blank else line
                            hit = known[line] = bool(bare) and xxhash.xxh64_intdigest(bare.encode(), SEED) in gone
                        if not hit:
                            kept.append(line)
                    if len(known) > 1 << 14:
                        known.clear()
                    out.append("\n".join(kept))
                    count.append(len(lines))
                    removed.append(len(lines) - len(kept))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_lines", "n_removed", "text"])

    return run


def _clean_by_join(docs: DataFrame, found: DataFrame) -> DataFrame:
    """As ``_clean``, for more boilerplate than can be broadcast: hashes of lines meet the boilerplate's, and return by the text's hash."""
    salted = found.select(F.col("line_hash").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_bsalt"))
    # Texts of one hash share what is found in them; a line is dropped only if it is boilerplate, so a clash of hashes does no harm.
    key = F.xxhash64("text")
    held = docs.select(key.alias("_key"), F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(_stripped(x))))).alias("_h")).distinct()
    hits = (
        held.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS))).join(salted, (F.col("_h") == F.col("_b")) & (F.col("_salt") == F.col("_bsalt")))
        .groupBy("_key").agg(F.collect_set("_h").alias("_hits"))
    )
    joined = docs.withColumn("_text_key", key).join(hits, F.col("_text_key") == F.col("_key"), "left").withColumn("_hits", F.coalesce("_hits", F.array().cast("array<bigint>")))
    lines = F.when(F.col("text").isNotNull(), _lines(F.col("text")))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_hits"), F.xxhash64(_stripped(x))))
    return joined.select("doc_id", "text", lines.alias("_lines"), kept.alias("_kept")).select(
        "doc_id",
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n")).alias("text"),
    )


def remove_boilerplate(docs: DataFrame, *, broadcast_lines: int = BROADCAST_LINES, **limits) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text without its boilerplate lines.

    Limits as in ``boilerplate_lines``; other columns are ignored. Null text: null text, no lines. All other lines stay as they
    were, blanks included. Repeated rows and ids are cleaned each; a null doc_id as well. Texts are cleaned whole, however long.
    Empty table: no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text", "source")
    found = materialise(boilerplate_lines(docs, **limits), "boilerplate")
    if found.count() > broadcast_lines:
        return _clean_by_join(docs, found)
    hashes = spark.sparkContext.broadcast(np.array([r[0] for r in found.select("line_hash").collect()], dtype=np.int64).view(np.uint64))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_clean(hashes), f"doc_id {kind}, n_lines long, n_removed long, text string")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT k, source, trim(unnest(ls), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM d),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= CASE WHEN length(line) < 20 THEN 15 ELSE 10 END),
x AS (SELECT k, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
y AS (SELECT k, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) FILTER (trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) NOT IN (SELECT line FROM b)) AS t,
        count(*) FILTER (trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) IN (SELECT line FROM b)) AS gone FROM x GROUP BY k)
SELECT d.doc_id, coalesce(y.n, 0) AS n_lines, coalesce(y.gone, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(y.t, '') END AS text
FROM d LEFT JOIN y USING (k)
"""
