"""Sparse TF-IDF per series, in long form: one row per (series, position, term)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tokens
from ..shared import materialise


def term_counts(df: DataFrame, *, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """(keys, order, term, tf)."""
    return df.select(*keys, order, F.explode(tokens(text)).alias("term")).groupBy(*keys, order, "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """(keys, term, df): in how many positions of a series a term occurs."""
    return counts.groupBy(*keys, "term").agg(F.count("*").alias("df"))


def vocabulary(counts: DataFrame, *, keys: Sequence[str], max_vocab: int = 20000, min_df: int = 1) -> DataFrame:
    """The most frequent terms of each series, ties by term, then those of ``min_df`` or more: (keys, term, df).

    How many terms have each frequency says at which one the limit falls; only terms of that frequency are put in order.
    """
    frequency = document_frequency(counts, keys=keys)
    steps = frequency.groupBy(*keys, "df").agg(F.count("*").alias("_terms"))
    upto = F.sum("_terms").over(Window.partitionBy(*keys).orderBy(F.desc("df")))
    edges = steps.withColumn("_room", max_vocab - (upto - F.col("_terms"))).where((F.col("_room") > 0) & (F.col("df") >= min_df))
    placed = frequency.join(edges.select(*keys, "df", "_terms", "_room"), [*keys, "df"])
    whole = placed.where(F.col("_terms") <= F.col("_room"))
    cut = placed.where(F.col("_terms") > F.col("_room"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("term"))
    return whole.select(*keys, "term", "df").unionByName(cut.withColumn("_r", first).where(F.col("_r") <= F.col("_room")).select(*keys, "term", "df"))


def inverse_frequency(df: str = "df", n: str = "n"):
    return F.log(1.0 + F.col(n) / (1.0 + F.col(df)))


def tfidf(df: DataFrame, *, keys: Sequence[str], order: str, text: str, max_vocab: int = 20000, min_df: int = 1) -> DataFrame:
    """(keys, order, term, w): sublinear term frequency times smoothed inverse frequency, unit length per position.

    Positions without a term have no rows. All positions of a series count for its size. Texts are split once: the counts
    are written to the shared folder, as the vocabulary and the weights both read them.
    """
    counts = materialise(term_counts(df, keys=keys, order=order, text=text), "term-counts")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    words = vocabulary(counts, keys=keys, max_vocab=max_vocab, min_df=min_df)
    weighed = counts.join(words, [*keys, "term"]).join(sizes, list(keys)).withColumn("w", (1.0 + F.log(F.col("tf").cast("double"))) * inverse_frequency())
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys, order)))
    return weighed.select(*keys, order, "term", (F.col("w") / size).alias("w"))


def band_similarity(weights: DataFrame, *, keys: Sequence[str], order: str, window: int) -> DataFrame:
    """(keys, order, d, sim) for positions that share a term with the one ``d`` later, d up to ``window``.

    Only the next rows of the same term are looked at, so no pair is made that shares nothing.
    """
    w = Window.partitionBy(*keys, "term").orderBy(order)
    after = F.array(*[F.struct(F.lead(order, d).over(w).alias("o"), F.lead("w", d).over(w).alias("w")) for d in range(1, window + 1)])
    ahead = weights.select(*keys, order, "w", after.alias("_after"))
    pairs = ahead.select(*keys, order, "w", F.explode("_after").alias("_n")).where(F.col("_n.o") - F.col(order) <= window)
    return pairs.groupBy(*keys, order, (F.col("_n.o") - F.col(order)).cast("int").alias("d")).agg(F.sum(F.col("w") * F.col("_n.w")).alias("sim"))


def sparse_curve(df: DataFrame, weights: DataFrame, *, keys: Sequence[str], order: str, out: str, window: int = 3) -> DataFrame:
    """The similarity curve of sparse rows over all positions of ``df``; a neighbour without a common term counts as 0.

    A series of one position has 1, a series without any term 0 throughout.
    """
    window = max(1, window)
    band = band_similarity(weights, keys=keys, order=order, window=window)
    both = band.select(*keys, order, "d", "sim").unionByName(band.select(*keys, (F.col(order) + F.col("d")).cast(df.schema[order].dataType).alias(order), "d", "sim"))
    share = 1.0 - F.col("d") / F.lit(window + 1.0)
    sums = both.groupBy(*keys, order).agg(F.sum(F.col("sim") * share).alias("_sum"))
    span = df.groupBy(*keys).agg(F.max(order).alias("_last"))
    any_term = weights.select(*keys).distinct().withColumn("_any", F.lit(True))
    placed = df.join(span, list(keys)).join(any_term, list(keys), "left").join(sums, [*keys, order], "left")
    weight = F.lit(0.0)
    for d in range(1, window + 1):
        s = 1.0 - d / (window + 1.0)
        weight = weight + F.when(F.col(order) >= d, F.lit(s)).otherwise(F.lit(0.0)) + F.when(F.col(order) + d <= F.col("_last"), F.lit(s)).otherwise(F.lit(0.0))
    curve = F.when(F.col("_any").isNull(), F.lit(0.0)).when(F.col("_last") == 0, F.lit(1.0)).otherwise(F.coalesce(F.col("_sum"), F.lit(0.0)) / F.col("_w"))
    return placed.withColumn("_w", weight).withColumn(out, curve).select(*df.columns, out)
