"""Query-driven selection: anchors, similarity gate, adaptive MMR; and text search over events."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot, tokens
from ..model import SearchOptions, SelectOptions


def anchors(df: DataFrame, *, keys: Sequence[str], event: str, order: str = "pos", relevance: str = "relevance") -> DataFrame:
    """The most relevant sample of each event, the first on ties: (keys, event, order, relevance)."""
    best = df.where(F.col(event).isNotNull()).groupBy(*keys, event).agg(F.max_by(F.struct(order, relevance), F.struct(F.col(relevance), -F.col(order))).alias("_b"))
    return best.select(*keys, event, f"_b.{order}", f"_b.{relevance}")


def gate_limits(df: DataFrame, chosen: DataFrame, options: SelectOptions, *, keys: Sequence[str], order: str = "pos", vector: str = "embedding") -> DataFrame:
    """(keys, order, peak, strict, loose): each sample's highest similarity to an anchor, and the series' gate limits."""
    picked = chosen.select(*keys, F.col(order).alias("_ao")).join(df.select(*keys, F.col(order).alias("_ao"), F.col(vector).alias("_av")), [*keys, "_ao"])
    peaks = df.join(picked, list(keys)).groupBy(*keys, order).agg(F.max(dot(vector, "_av")).alias("peak"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    stats = peaks.groupBy(*keys).agg(F.avg("peak").alias("_mu"), F.stddev_pop("peak").alias("_sd"))
    a = F.lit(options.alpha)
    return peaks.join(stats, list(keys)).select(*keys, order, "peak", clip(F.col("_mu") - a * F.col("_sd")).alias("strict"), clip(F.col("_mu") + a * F.col("_sd")).alias("loose"))


def _mmr(vectors: np.ndarray, relevance: np.ndarray, seeds: list[int], o: SelectOptions) -> list[int]:
    n = len(vectors)
    k = min(o.top_k, n)
    if n <= k or k <= 0:
        return list(range(n)) if k > 0 else []
    seeds = seeds or [int(np.argmax(relevance))]
    peak = (vectors @ vectors[seeds].T).max(axis=1)
    mu, sd = peak.mean(), peak.std()
    strict, loose = np.clip([mu - o.alpha * sd, mu + o.alpha * sd], 0.0, 1.0)
    gates = np.linspace(strict, loose, o.gates) if loose > strict else np.array([strict])
    level = np.full(n, len(gates))
    for g in range(len(gates) - 1, -1, -1):
        level[peak <= gates[g]] = g
    chosen = sorted(dict.fromkeys(seeds), key=lambda i: -relevance[i])[:k]
    free = np.ones(n, bool)
    free[chosen] = False
    redundancy = (vectors @ vectors[chosen].T).max(axis=1)
    while len(chosen) < k:
        # A gate opens once the one before admits nothing more, so the lowest level left is next.
        now = level[free].min()
        score = relevance if now == len(gates) else o.mmr_lambda * relevance - (1 - o.mmr_lambda) * redundancy
        pick = int(np.argmax(np.where(free & (level == now), score, -np.inf)))
        chosen.append(pick)
        free[pick] = False
        redundancy = np.maximum(redundancy, vectors @ vectors[pick])
    return sorted(chosen)


def adaptive_mmr(
    df: DataFrame, chosen: DataFrame, options: SelectOptions | None = None, *, keys: Sequence[str], order: str = "pos", vector: str = "embedding", relevance: str = "relevance"
) -> DataFrame:
    """(keys, order) of the samples selected by relevance against redundancy under a gate relaxed in steps.

    A greedy loop by nature: it runs per key in pandas, with each sample's redundancy updated by the
    last pick only. Ties go to the smaller ``order``.
    """
    o = options or SelectOptions()
    marked = df.select(*keys, order, vector, relevance).join(chosen.select(*keys, order).withColumn("_anchor", F.lit(True)), [*keys, order], "left").withColumn("_anchor", F.coalesce("_anchor", F.lit(False)))
    key_list = list(keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        picked = _mmr(np.array(rows[vector].tolist(), dtype=np.float64), rows[relevance].to_numpy(np.float64), np.flatnonzero(rows["_anchor"]).tolist(), o)
        return rows.loc[picked, [*key_list, order]]

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in [*keys, order])
    return marked.groupBy(*keys).applyInPandas(run, schema)


def select_frames(samples: DataFrame, options: SelectOptions | None = None, *, keys: Sequence[str], event: str = "event_index") -> DataFrame:
    """(keys, frame_idx, time_sec, event_index, relevance, is_anchor) of the selected samples; -1 for one outside all events."""
    seeds = anchors(samples, keys=keys, event=event)
    chosen = adaptive_mmr(samples, seeds, options, keys=keys)
    picked = samples.join(chosen, [*keys, "pos"]).join(seeds.select(*keys, "pos").withColumn("_a", F.lit(True)), [*keys, "pos"], "left")
    return picked.select(*keys, "frame_idx", "time_sec", F.coalesce(event, F.lit(-1)).alias("event_index"), "relevance", F.coalesce("_a", F.lit(False)).alias("is_anchor"))


def search_events(events: DataFrame, query: str, options: SearchOptions | None = None, *, text: str = "text", event: str = "event_id", other_rank: DataFrame | None = None) -> DataFrame:
    """Extension: BM25 over event texts, fused with another ranking (event, rank) by reciprocal ranks; with a snippet."""
    o = options or SearchOptions()
    words = sorted({w.lower() for w in re.findall(r"[A-Za-z0-9_]+", query)})
    rows = events.select(event, text, tokens(text).alias("_tok"))
    stats = rows.agg(F.count("*").alias("_n"), F.avg(F.size("_tok")).alias("_avg"))  # one row
    hits = rows.select(event, F.size("_tok").alias("_len"), F.explode("_tok").alias("_w")).where(F.col("_w").isin(words)).groupBy(event, "_len", "_w").agg(F.count("*").alias("_tf"))
    df = hits.groupBy("_w").agg(F.count("*").alias("_df"))
    scored = hits.join(df, "_w").join(F.broadcast(stats))
    gain = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)) * F.col("_tf") * (o.k1 + 1) / (F.col("_tf") + o.k1 * (1 - o.b + o.b * F.col("_len") / F.col("_avg")))
    ranked = scored.groupBy(event).agg(F.sum(gain).alias("bm25"))
    if other_rank is None:
        ranked = ranked.orderBy(F.desc("bm25"), event).limit(o.top_k)  # only these are ranked in one task
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("bm25"), event)))
    fused = ranked.withColumn("score", 1.0 / (o.rrf_k + F.col("_rank")))
    if other_rank is not None:
        fused = fused.join(other_rank.select(event, F.col("rank").alias("_other")), event, "full").withColumn(
            "score", F.coalesce(F.col("score"), F.lit(0.0)) + F.coalesce(1.0 / (o.rrf_k + F.col("_other")), F.lit(0.0))
        )
    top = fused.orderBy(F.desc("score"), event).limit(o.top_k).join(events.select(event, text), event)
    at = F.array_min(F.filter(F.array(*[F.instr(F.lower(text), w) for w in words], F.lit(0)), lambda x: x > 0))
    begin = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - o.snippet)
    return top.select(event, "bm25", "score", F.substr(F.col(text), begin, F.lit(2 * o.snippet)).alias("snippet"))
