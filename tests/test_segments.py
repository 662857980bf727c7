import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.model import SegmentOptions, SelectOptions
from tidemark.operators import evidence, retrieve, segments

SCHEMA = "video_id string, pos int, frame_idx int, time_sec double, embedding array<double>, ocr_text string, transcript_text string"


def recording(name, lengths, seed=1, dense=True, screen=True):
    """A recording of topics with vocabularies of their own and a centroid each; its true bounds."""
    r, g = random.Random(seed), np.random.default_rng(seed)
    chrome, rows, bounds, pos = [f"chrome{i}" for i in range(10)], [], [], 0
    for t, n in enumerate(lengths):
        words, centre = [f"t{t}w{i}" for i in range(40)], g.standard_normal(16)
        if t:
            bounds.append(pos)
        for _ in range(n):
            v = centre + 0.3 * g.standard_normal(16)
            rows.append((name, pos, pos * 30, float(pos), (v / np.linalg.norm(v)).tolist() if dense else None, " ".join(chrome + r.sample(words, 15)) if screen else "", None))
            pos += 1
    return rows, bounds


@pytest.mark.parametrize("dense, screen", [(True, True), (False, True), (True, False)])
def test_known_bounds_are_found(spark, dense, screen):
    rows, bounds = recording("a", [30, 40, 25, 35, 28, 33], dense=dense, screen=screen)
    more, more_bounds = recording("b", [30, 30, 30], seed=2, dense=dense, screen=screen)
    df = spark.createDataFrame(rows + more, SCHEMA)
    events, numbered = segments.segment(df, options=SegmentOptions(target=6))
    got = {}
    for e in events.orderBy("video_id", "event_id").collect():
        got.setdefault(e.video_id, []).append(e)
    starts = [int(e.start_time) for e in got["a"]][1:]
    assert len(starts) == 5 and all(abs(x - y) <= 1 for x, y in zip(starts, bounds))
    for es in got.values():
        assert es[0].start_time == 0 and all(a.end_time == b.start_time and a.end_frame == b.start_frame for a, b in zip(es, es[1:]))
        assert len(es) <= 6 and all(e.end_time - e.start_time >= 20 for e in es)
    assert sum(e.metadata.n_samples for es in got.values() for e in es) == len(rows) + len(more)
    assert any(abs(int(e.start_time) - more_bounds[0]) <= 1 for e in got["b"])


def test_too_short_or_silent_is_one_event(spark):
    rows = [("x", i, i, float(i), None, "", None) for i in range(5)] + [("y", i, i, float(i), [1.0, 0.0], "a", None) for i in range(2)]
    events, _ = segments.segment(spark.createDataFrame(rows, SCHEMA))
    got = events.orderBy("video_id").collect()
    assert [(e.video_id, e.event_id, e.metadata.boundary_score, e.metadata.n_samples) for e in got] == [("x", "0000", None, 5), ("y", "0000", None, 2)]
    assert segments.segment(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_both_merges_agree(spark):
    g = np.random.default_rng(3)
    parts = [("v", p, p * 10, g.standard_normal(4).tolist(), 3) for p in range(9)] + [("w", 0, 0, [1.0, 0.0, 0.0, 0.0], 3)]
    df = spark.createDataFrame(parts, "video_id string, part int, first_pos int, sums array<double>, target int")
    def plain(vectors, target):
        left = [(10 * p, np.array(v)) for p, v in enumerate(vectors)]
        while len(left) > target:
            sims = [float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) for (_, a), (_, b) in zip(left, left[1:])]
            k = sims.index(max(sims))
            left[k : k + 2] = [(left[k][0], left[k][1] + left[k + 1][1])]
        return [f for f, _ in left[1:]]

    merged = sorted(map(tuple, segments.merge_parts(df).collect()))
    assert merged == [("v", p) for p in plain([v for k, _, _, v, _ in parts if k == "v"], 3)] and len(merged) == 2
    assert merged == sorted(map(tuple, segments.merge_channels(df.withColumnRenamed("sums", "dense"), SegmentOptions()).collect()))


def test_evidence_and_titles(spark):
    ev = spark.createDataFrame([("v", "0000", 0.0, 61.5, "alpha alpha beta the 123", ""), ("v", "0001", 61.5, 70.0, "beta gamma", ""), ("v", "0002", 70.0, 71.0, "", "")], "video_id string, event_id string, start_time double, end_time double, ocr_text string, transcript_text string")
    titles = evidence.distinctive_titles(ev)
    assert {r.event_id: r.title for r in titles.collect()} == {"0000": "alpha beta", "0001": "gamma beta", "0002": "unclear"}
    named = evidence.join_titles(ev, titles.where("event_id <> '0001'").withColumn("n", F.lit(0)), order="n")
    twice = spark.createDataFrame([("v", "0000", " zeta", 0), ("v", "0000", "alpha ", 1)], "video_id string, event_id string, title string, n int")
    assert {r.event_id: r.title for r in evidence.join_titles(ev, twice, order="n").collect()} == {"0000": "alpha", "0001": "", "0002": ""}
    assert evidence.chapter_list(named).first().chapters == "0:00 alpha beta\n1:01 (unlabeled)\n1:10 unclear"
    prompts = [r[0] for r in ev.orderBy("event_id").select(evidence.evidence_prompt()).collect()]
    assert prompts[0] == "[0000] 0:00-1:01 (62s)\non-screen text:\nalpha alpha beta the 123" and prompts[2] == "[0002] 1:10-1:11 (1s)\n(no text evidence)"
    lines = spark.createDataFrame([("v", 0, "A\n b \na"), ("v", 1, "B\nc\n"), ("v", 2, None)], "video_id string, pos int, x string")
    assert evidence.distinct_pieces(lines, keys=["video_id"], order="pos", text="x", out="o", by_line=True).first().o == "A\nb\nc"


def test_anchors_first_on_ties(spark):
    df = spark.createDataFrame([("q", 0, 0, 0.5), ("q", 0, 1, 0.9), ("q", 0, 2, 0.9)], "q string, event int, pos int, relevance double")
    assert retrieve.anchors(df, keys=["q"], event="event").first().pos == 1


def plain_mmr(v, rel, anchors, k, lam=0.5, a=0.5):
    n = len(v)
    if n <= k:
        return list(range(n))
    m = [max(float(v[i] @ v[j]) for j in anchors) for i in range(n)]
    mu, sd = float(np.mean(m)), float(np.std(m))
    lo, hi = min(1, max(0, mu - a * sd)), min(1, max(0, mu + a * sd))
    chosen = sorted(anchors, key=lambda i: -rel[i])[:k]
    for g in [lo + (hi - lo) * s / 4 for s in range(5)] if hi > lo else [lo]:
        while len(chosen) < k:
            left = [i for i in range(n) if i not in chosen and m[i] <= g]
            if not left:
                break
            chosen.append(max(left, key=lambda i: (lam * rel[i] - (1 - lam) * max(float(v[i] @ v[j]) for j in chosen), -i)))
    rest = sorted((i for i in range(n) if i not in chosen), key=lambda i: (-rel[i], i))
    return sorted(chosen + rest[: k - len(chosen)])


def test_mmr_matches_a_plain_loop(spark):
    g = np.random.default_rng(4)
    rows = []
    for q in range(3):
        for i in range(40):
            v = g.standard_normal(6)
            rows.append((f"q{q}", i, i, float(i), i // 10, (v / np.linalg.norm(v)).tolist(), float(g.random())))
    df = spark.createDataFrame(rows, "q string, pos int, frame_idx int, time_sec double, event_index int, embedding array<double>, relevance double")
    anchors = retrieve.anchors(df, keys=["q"], event="event_index")
    got = {}
    for r in retrieve.select_frames(df, SelectOptions(top_k=9), keys=["q"]).collect():
        got.setdefault(r.q, []).append(r.frame_idx)
    seeds = {}
    for r in anchors.collect():
        seeds.setdefault(r.q, []).append(r.pos)
    for q in ("q0", "q1", "q2"):
        mine = [r for r in rows if r[0] == q]
        assert sorted(got[q]) == plain_mmr(np.array([r[5] for r in mine]), [r[6] for r in mine], sorted(seeds[q]), 9)
    few = retrieve.select_frames(df, SelectOptions(top_k=99), keys=["q"])
    assert few.count() == 120


def test_search_finds_the_event(spark):
    ev = spark.createDataFrame([("a", "the quick brown fox"), ("b", "lazy dogs sleep all day long"), ("c", "fox and dogs")], "event_id string, text string")
    assert [r.event_id for r in retrieve.search_events(ev, "quick fox").orderBy("bm25", ascending=False).collect()] == ["a", "c"]
