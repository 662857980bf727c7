"""One query per operator over the benchmark tables, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import LabelOptions, SegmentOptions, SelectOptions
from ..operators import evidence, intervals, retrieve, segments, series, text
from ..shared import materialise
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


VK = ["video_id"]
DAY = 86400.0


@query("frame_time", "SELECT event_id, coalesce(CASE WHEN event_id % 5 <> 0 THEN event_id * 512 END, CASE WHEN event_id % 7 <> 0 THEN event_id * 512 + 1 END, 0)::BIGINT AS pts, round(coalesce(CASE WHEN event_id % 5 <> 0 THEN event_id * 512 END, CASE WHEN event_id % 7 <> 0 THEN event_id * 512 + 1 END, 0) * 1 / 15360.0::DOUBLE, 6) AS time_sec FROM events")
def frame_time(spark, d):
    e = T.read(spark, d, "events").select("event_id")
    pts, sec = C.frame_time(F.when(F.col("event_id") % 5 != 0, F.col("event_id") * 512), F.when(F.col("event_id") % 7 != 0, F.col("event_id") * 512 + 1), F.lit(1), F.lit(15360.0))
    return e.select("event_id", pts.alias("pts"), r6(sec).alias("time_sec"))


@query("media_probe", """SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size * 1.0 END, CASE WHEN p_size % 3 = 0 THEN 25.0 END, 0.0)::DOUBLE AS avg_fps,
  coalesce(CASE WHEN p_size % 3 = 0 THEN p_size * 10.0 END, CASE WHEN p_size % 2 = 0 THEN p_size * 0.5 END, 0.0)::DOUBLE AS duration_sec, coalesce(p_size % 4 > 0, false) AS has_audio FROM part""")
def media_probe(spark, d):
    p, size = T.read(spark, d, "part"), F.col("p_size")
    return p.select(
        "p_partkey",
        C.frame_rate(F.when(size % 2 == 0, size * F.lit(1.0)), F.when(size % 3 == 0, F.lit(25.0))).cast("double").alias("avg_fps"),
        C.media_duration(F.when(size % 3 == 0, size * F.lit(10.0)), F.when(size % 2 == 0, size.cast("double")), F.lit(0.5)).cast("double").alias("duration_sec"),
        F.coalesce(size % 4 > 0, F.lit(False)).alias("has_audio"),
    )


GREEDY = f"""WITH RECURSIVE {T.FRAMES}, g AS (
  SELECT video_id, min(frame_idx) AS frame_idx, arg_min(time_sec, frame_idx) AS t FROM frames WHERE time_sec + 1e-9 >= 0 GROUP BY video_id
  UNION ALL
  SELECT f.video_id, min(f.frame_idx), arg_min(f.time_sec, f.frame_idx) FROM frames f JOIN g ON f.video_id = g.video_id AND f.frame_idx > g.frame_idx AND f.time_sec + 1e-9 >= g.t + {DAY} GROUP BY f.video_id)
SELECT video_id, frame_idx, round(t, 6) AS time_sec FROM g"""


@query("greedy_sample", GREEDY)
def greedy_sample(spark, d):
    f = T.frames(spark, d)
    return series.greedy_sample(f, keys=VK, order="frame_idx", time="time_sec", interval=DAY).select("video_id", "frame_idx", r6("time_sec").alias("time_sec"))


@query("max_frames", GREEDY + " QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) <= 5")
def max_frames(spark, d):
    f = T.frames(spark, d)
    return series.greedy_sample(f, keys=VK, order="frame_idx", time="time_sec", interval=DAY, max_rows=5).select("video_id", "frame_idx", r6("time_sec").alias("time_sec"))


@query("wanted_frames_semi", f"WITH {T.FRAMES} SELECT video_id, frame_idx, round(time_sec, 6) AS time_sec FROM frames WHERE frame_idx % 10 = 3")
def wanted_frames_semi(spark, d):
    f = T.frames(spark, d)
    wanted = f.where("frame_idx % 10 = 3").select("video_id", "frame_idx")
    twice = wanted.unionByName(wanted).unionByName(wanted.select("video_id", (-F.col("frame_idx") - 1).alias("frame_idx")))
    return series.wanted_rows(f, twice, keys=VK, order="frame_idx").select("video_id", "frame_idx", r6("time_sec").alias("time_sec"))


DIMS = "(p_partkey % 1920 + 1)::INTEGER AS w, (p_size * 23 + 1)::INTEGER AS h"


@query("resize_dims", f"""SELECT p_partkey, CASE WHEN greatest(w, h) <= 448 THEN w WHEN w >= h THEN 448 ELSE greatest(1, round_even(w * (448.0::DOUBLE / h), 0)::INTEGER) END AS out_w,
  CASE WHEN greatest(w, h) <= 448 THEN h WHEN w >= h THEN greatest(1, round_even(h * (448.0::DOUBLE / w), 0)::INTEGER) ELSE 448 END AS out_h FROM (SELECT p_partkey, {DIMS} FROM part)""")
def resize_dims(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1920 + 1).cast("int").alias("w"), (F.col("p_size") * 23 + 1).cast("int").alias("h"))
    w, h = C.resized_dims("w", "h", 448)
    return p.select("p_partkey", w.alias("out_w"), h.alias("out_h"))


@query("roi_boxes", f"""WITH a AS (SELECT p_partkey, w, h, greatest(0, trunc(0.1::DOUBLE * w)::INTEGER) AS x1, greatest(0, trunc(0.25::DOUBLE * h)::INTEGER) AS y1, least(w, trunc(0.9::DOUBLE * w)::INTEGER) AS x2, least(h, trunc(0.3::DOUBLE * h)::INTEGER) AS y2 FROM (SELECT p_partkey, {DIMS} FROM part)),
b AS (SELECT *, x2 <= x1 OR y2 <= y1 AS bad FROM a)
SELECT p_partkey, CASE WHEN bad THEN 0 ELSE x1 END AS x1, CASE WHEN bad THEN 0 ELSE y1 END AS y1, CASE WHEN bad THEN w ELSE x2 END AS x2, CASE WHEN bad THEN h ELSE y2 END AS y2,
  2 * (CASE WHEN bad THEN w ELSE x2 - x1 END) AS out_w, 2 * (CASE WHEN bad THEN h ELSE y2 - y1 END) AS out_h FROM b""")
def roi_boxes(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1920 + 1).cast("int").alias("w"), (F.col("p_size") * 23 + 1).cast("int").alias("h"))
    return p.select("p_partkey", C.region_box("w", "h", (0.1, 0.25, 0.9, 0.3), 2).alias("b")).select("p_partkey", "b.*")


@query("ocr_stride", f"WITH {T.TEXT} SELECT video_id, pos, pos % 3 = 0 AS reads FROM texts")
def ocr_stride(spark, d):
    return T.text_samples(spark, d).select("video_id", "pos", C.reads_text("pos", 3).alias("reads"))


@query("carry_forward", f"WITH {T.FRAMES}, v AS (SELECT video_id, frame_idx, CASE WHEN event_type = 'view' THEN CASE WHEN frame_idx % 11 = 0 THEN '' ELSE 'e' || frame_idx END END AS x FROM frames) SELECT video_id, frame_idx, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx), '') AS carried FROM v")
def carry_forward(spark, d):
    f = T.frames(spark, d).withColumn("x", F.when(F.col("event_type") == "view", F.when(F.col("frame_idx") % 11 == 0, "").otherwise(F.concat(F.lit("e"), F.col("frame_idx")))))
    return series.carry_forward(f, keys=VK, order="frame_idx", value="x", out="carried").select("video_id", "frame_idx", "carried")


@query("ocr_conf_filter", f"""WITH {T.TEXT}, l AS (SELECT video_id, pos, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS t FROM texts),
k AS (SELECT *, trim(t) AS s FROM l WHERE (CASE WHEN i % 4 = 3 THEN 0.0 ELSE (i % 10) / 10.0 END) >= 0.5 AND trim(t) <> '')
SELECT t.video_id, t.pos, count(k.s) AS n_lines, coalesce(string_agg(k.s, chr(10) ORDER BY k.i), '') AS lines FROM texts t LEFT JOIN k USING (video_id, pos) GROUP BY t.video_id, t.pos""")
def ocr_conf_filter(spark, d):
    score = lambda i: F.when(i % 4 == 3, F.lit("n/a")).otherwise(((i % 10) / 10.0).cast("string"))
    raw = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("text"), score(i).alias("score")))
    s = T.text_samples(spark, d).withColumn("l", C.confident_lines(raw, 0.5))
    return s.select("video_id", "pos", F.size("l").cast("long").alias("n_lines"), F.array_join("l", "\n").alias("lines"))


@query("ocr_frame_dedup", f"""WITH {T.TEXT}, l AS (SELECT video_id, pos, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS t FROM texts),
f AS (SELECT video_id, pos, lower(t) AS k, min(i) AS i, arg_min(t, i) AS t FROM l GROUP BY ALL)
SELECT video_id, pos, string_agg(t, chr(10) ORDER BY i) AS lines FROM f GROUP BY ALL""")
def ocr_frame_dedup(spark, d):
    s = T.text_samples(spark, d).withColumn("l", F.split("text", "\n"))
    return evidence.frame_lines(s, keys=VK, lines="l", out="lines").select("video_id", "pos", "lines")


ALIGN = """WITH t AS (SELECT conv_id AS video_id, turn AS pos, turn::DOUBLE AS time_sec, text FROM conversations),
j AS (SELECT a.video_id, a.pos, b.pos AS n, b.text AS x FROM t a JOIN t b ON a.video_id = b.video_id AND b.time_sec <= a.time_sec + {w} AND b.time_sec + 1.5 >= a.time_sec - {w})
SELECT video_id, pos, string_agg(x, ' ' ORDER BY n) AS heard FROM j GROUP BY ALL"""


def _align(spark, d, window, bucket):
    c = T.read(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("pos"), F.col("turn").cast("double").alias("time_sec"), "text")
    seg = c.select("video_id", F.col("pos").alias("seg_no"), F.col("time_sec").alias("start_sec"), (F.col("time_sec") + 1.5).alias("end_sec"), "text")
    out = intervals.overlap_text(c.drop("text"), seg, keys=VK, time="time_sec", start="start_sec", end="end_sec", text="text", order="seg_no", out="heard", window=window, bucket=bucket)
    return out.select("video_id", "pos", "heard")


@query("asr_align", ALIGN.format(w="0"))
def asr_align(spark, d):
    return _align(spark, d, 0.0, None)


@query("asr_align_window", ALIGN.format(w="0.75"))
def asr_align_window(spark, d):
    return _align(spark, d, 0.75, 2.0)


TOK = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda t: lower(t))"


@query("tokenize", f"WITH {T.TEXT} SELECT video_id, pos, len({TOK}) AS n_tokens, list_aggregate({TOK}, 'string_agg', ' ') AS joined FROM texts WHERE len({TOK}) > 0")
def tokenize(spark, d):
    s = T.text_samples(spark, d).withColumn("t", C.tokens("text"))
    return s.where(F.size("t") > 0).select("video_id", "pos", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("joined"))


TFIDF = f"""{T.TEXT},
words AS (SELECT video_id, pos, unnest({TOK}) AS term FROM texts),
tf AS (SELECT video_id, pos, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT video_id, term, count(*) AS df FROM tf GROUP BY ALL),
vocab AS (SELECT * FROM df QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY df DESC, term) <= {{cap}}),
sizes AS (SELECT video_id, count(*) AS n FROM texts GROUP BY ALL),
raw AS (SELECT video_id, pos, term, (1 + ln(tf::DOUBLE)) * ln(1 + n / (1.0::DOUBLE + df)) AS w FROM tf JOIN vocab USING (video_id, term) JOIN sizes USING (video_id)),
tfidf AS (SELECT video_id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY video_id, pos)) AS w FROM raw)"""


@query("doc_freq", "WITH " + TFIDF.format(cap=20000) + " SELECT video_id, term, df FROM df")
def doc_freq(spark, d):
    return text.document_frequency(text.term_counts(T.text_samples(spark, d), keys=VK, order="pos", text="text"), keys=VK)


@query("vocab_topk", "WITH " + TFIDF.format(cap=50) + " SELECT video_id, term, df FROM vocab")
def vocab_topk(spark, d):
    return text.vocabulary(text.term_counts(T.text_samples(spark, d), keys=VK, order="pos", text="text"), keys=VK, max_vocab=50)


@query("idf", "WITH " + TFIDF.format(cap=20000) + " SELECT video_id, term, round(ln(1 + n / (1.0::DOUBLE + df)), 6) AS idf FROM df JOIN sizes USING (video_id)")
def idf(spark, d):
    s = T.text_samples(spark, d)
    n = s.groupBy("video_id").agg(F.count("*").alias("n"))
    return text.document_frequency(text.term_counts(s, keys=VK, order="pos", text="text"), keys=VK).join(n, VK).select("video_id", "term", r6(text.inverse_frequency()).alias("idf"))


@query("tfidf", "WITH " + TFIDF.format(cap=20000) + " SELECT video_id, pos, term, round(w, 6) AS w FROM tfidf")
def tfidf(spark, d):
    return text.tfidf(T.text_samples(spark, d), keys=VK, order="pos", text="text").select("video_id", "pos", "term", r6("w").alias("w"))


BAND = TFIDF.format(cap=20000) + """,
band AS (SELECT a.video_id, a.pos, (b.pos - a.pos)::INTEGER AS d, sum(a.w * b.w) AS sim FROM tfidf a JOIN tfidf b ON a.video_id = b.video_id AND a.term = b.term AND b.pos > a.pos AND b.pos <= a.pos + 3 GROUP BY ALL)"""


@query("tfidf_band", "WITH " + BAND + " SELECT video_id, pos, d, round(sim, 6) AS sim FROM band")
def tfidf_band(spark, d):
    w = text.tfidf(T.text_samples(spark, d), keys=VK, order="pos", text="text")
    return text.band_similarity(w, keys=VK, order="pos", window=3).select("video_id", "pos", "d", r6("sim").alias("sim"))


@query("sim_curve_text", "WITH " + BAND + """,
mirrored AS (SELECT video_id, pos, d, sim FROM band UNION ALL SELECT video_id, pos + d, d, sim FROM band),
grid AS (SELECT t.video_id, t.pos, s.n, unnest([1, 2, 3]) AS d FROM texts t JOIN sizes s USING (video_id)),
ends AS (SELECT video_id, pos, any_value(n) AS n, sum((1 - d / 4.0) * ((pos >= d)::INT + (pos + d < n)::INT)) AS weight FROM grid GROUP BY ALL),
tot AS (SELECT video_id, pos, sum(sim * (1 - d / 4.0)) AS total FROM mirrored GROUP BY ALL)
SELECT e.video_id, e.pos, round(CASE WHEN n = 1 THEN 1.0 ELSE coalesce(total, 0) / weight END, 6)::DOUBLE AS score FROM ends e LEFT JOIN tot USING (video_id, pos)""")
def sim_curve_text(spark, d):
    s = T.text_samples(spark, d).select("video_id", "pos", "text")
    w = text.tfidf(s, keys=VK, order="pos", text="text")
    return text.sparse_curve(s.select("video_id", "pos"), w, keys=VK, order="pos", out="score").select("video_id", "pos", r6("score").alias("score"))


@query("l2_normalize", f"WITH {T.DENSE}, n AS (SELECT video_id, pos, list_transform(e, lambda x: x * 3 / greatest(sqrt(list_inner_product(e, e)) * 3, 1e-8)) AS u FROM dense) SELECT video_id, pos, list_transform(u, lambda x: round(x, 6) + 0.0) AS unit FROM n")
def l2_normalize(spark, d):
    s = T.dense_samples(spark, d).withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3))
    return s.select("video_id", "pos", F.transform(C.unit("v"), lambda x: F.round(x, 6) + F.lit(0.0)).alias("unit"))


@query("adjacent_cosine", f"WITH {T.DENSE}, n AS (SELECT video_id, pos, list_inner_product(e, lead(e) OVER (PARTITION BY video_id ORDER BY pos)) AS s FROM dense) SELECT video_id, pos, round(s, 6) AS sim FROM n WHERE s IS NOT NULL")
def adjacent_cosine(spark, d):
    return series.adjacent_similarity(T.dense_samples(spark, d), keys=VK, order="pos", vector="embedding", out="sim").select("video_id", "pos", r6("sim").alias("sim"))


@query("pairwise_cosine", f"WITH {T.DENSE} SELECT x.video_id, x.pos AS a, y.pos AS b, round(list_inner_product(x.e, y.e), 6) AS sim FROM dense x JOIN dense y ON x.video_id = y.video_id")
def pairwise_cosine(spark, d):
    return series.pairwise_similarity(T.dense_samples(spark, d), keys=VK, order="pos", vector="embedding", out="sim", digits=6)


def _dense_curve(spark, d):
    s = T.dense_samples(spark, d)
    return series.similarity_curve(s, keys=VK, order="pos", vector="embedding", out="c")


@query("sim_curve_dense", f"WITH {T.CURVE} SELECT video_id, pos, round(c, 6) AS score FROM curve")
def sim_curve_dense(spark, d):
    return _dense_curve(spark, d).select("video_id", "pos", r6("c").alias("score"))


def _scored(spark, d):
    z = series.zscore(_dense_curve(spark, d), keys=VK, value="c", out="z")
    return z.withColumn("z", r6("z"))


@query("zscore", f"WITH {T.CURVE} SELECT video_id, pos, z FROM scored")
def zscore(spark, d):
    return _scored(spark, d).select("video_id", "pos", "z")


FLAGGED = """SELECT source AS video_id, max(CASE WHEN doc_id % 3 = 0 AND source <> 'src1' THEN 1 ELSE 0 END) = 1 AS has_dense,
  max(CASE WHEN regexp_matches(CASE WHEN source <> 'src2' THEN text ELSE '' END, '[A-Za-z0-9_]') THEN 1 ELSE 0 END) = 1 AS has_screen, false AS has_speech FROM documents GROUP BY source"""


@query("channel_flags", FLAGGED)
def channel_flags(spark, d):
    s = T.text_samples(spark, d).select(
        "video_id", "pos", F.when((F.col("frame_idx") % 3 == 0) & (F.col("video_id") != "src1"), F.array(F.lit(1.0))).alias("embedding"),
        F.when(F.col("video_id") != "src2", F.col("text")).otherwise("").alias("ocr_text"),
    )
    terms = {"screen": text.tfidf(s, keys=VK, order="pos", text="ocr_text")}
    return segments.channel_flags(s, terms, SegmentOptions())


@query("fuse_curves", """WITH s AS (SELECT event_id, round(sin(event_id), 6) AS a, round(cos(event_id), 6) AS b, event_id % 2 = 0 AS p, event_id % 3 = 0 AS q FROM events)
SELECT event_id, round(CASE WHEN p AND q THEN (a * 0.6 + b * 0.3) / (0.6 + 0.3) WHEN p THEN a WHEN q THEN b END, 6) + 0.0 AS fused FROM s""")
def fuse_curves(spark, d):
    e = T.read(spark, d, "events").select(
        "event_id", F.round(F.sin("event_id"), 6).alias("z_dense"), F.round(F.cos("event_id"), 6).alias("z_screen"), F.lit(0.0).alias("z_speech"),
        (F.col("event_id") % 2 == 0).alias("has_dense"), (F.col("event_id") % 3 == 0).alias("has_screen"), F.lit(False).alias("has_speech"),
    )
    return e.select("event_id", r6(segments.fused_score({"dense": 0.6, "screen": 0.3})).alias("fused"))


def _minima(spark, d):
    scored = _scored(spark, d)
    return scored, series.local_minima(scored, keys=VK, order="pos", value="z")


@query("local_minima", f"WITH {T.CURVE}{T.MINIMA} SELECT video_id, pos FROM minima")
def local_minima(spark, d):
    return _minima(spark, d)[1]


@query("target_events", "SELECT o_orderkey, greatest(3, least(24, round_even(o_totalprice::DOUBLE / 10 / 60.0 / 4.0, 0)))::INTEGER AS target, 1 AS explicit FROM orders")
def target_events(spark, d):
    return T.read(spark, d, "orders").select("o_orderkey", C.target_events(F.col("o_totalprice").cast("double") / 10).alias("target"), C.target_events(F.lit(0.0), explicit=0).alias("explicit"))


def _parts(spark, d):
    scored, minima = _minima(spark, d)
    return segments.assign_parts(scored, minima)


@query("partition_means", f"WITH {T.CURVE}{T.MINIMA}{T.PARTS}, z AS (SELECT video_id, part, s, sqrt(list_inner_product(s, s)) AS n FROM sums) SELECT video_id, part, list_transform(s, lambda x: round(x / n, 6) + 0.0) AS mean FROM z")
def partition_means(spark, d):
    sums = segments.partition_sums(_parts(spark, d))
    return sums.select("video_id", "part", F.transform(C.unit("sums"), lambda x: F.round(x, 6) + F.lit(0.0)).alias("mean"))


@query("partition_similarity", f"WITH {T.CURVE}{T.MINIMA}{T.PARTS}, n AS (SELECT video_id, part, list_cosine_similarity(s, lead(s) OVER (PARTITION BY video_id ORDER BY part)) AS c FROM sums) SELECT video_id, part, round(c, 6) AS sim FROM n WHERE c IS NOT NULL")
def partition_similarity(spark, d):
    return segments.partition_similarity(segments.partition_sums(_parts(spark, d))).withColumn("sim", r6("sim"))


def _merged(spark, d):
    parts = _parts(spark, d)
    goal = parts.groupBy("video_id").agg(C.target_events(F.max("time_sec")).alias("target"))
    firsts = parts.groupBy("video_id", "part").agg(F.min("pos").alias("first_pos"))
    sums = segments.partition_sums(parts).join(firsts, ["video_id", "part"]).join(goal, "video_id")
    return parts, segments.merge_parts(sums)


@query("merge_to_target", f"WITH RECURSIVE {T.CURVE}{T.MINIMA}{T.PARTS}{T.MERGE} SELECT video_id, pos FROM merged")
def merge_to_target(spark, d):
    return _merged(spark, d)[1]


GAP = """,
ends AS (SELECT video_id, min(time_sec) AS t0, max(time_sec) AS t1 FROM scored GROUP BY video_id),
timed AS (SELECT m.video_id, m.pos, s.time_sec AS t FROM {bounds} m JOIN scored s ON s.video_id = m.video_id AND s.pos = m.pos),
kept AS (
  SELECT e.video_id, -1 AS pos, e.t0 AS t FROM ends e
  UNION ALL
  SELECT x.video_id, min(x.pos), min(x.t) FROM timed x JOIN kept k ON x.video_id = k.video_id AND x.pos > k.pos AND x.t - k.t >= {gap} GROUP BY x.video_id),
long_bounds AS (SELECT k.video_id, k.pos FROM kept k JOIN ends e USING (video_id) WHERE k.pos >= 0
  QUALIFY NOT (row_number() OVER (PARTITION BY k.video_id ORDER BY k.pos DESC) = 1 AND e.t1 - k.t < {gap}))"""


@query("min_duration", f"WITH RECURSIVE {T.CURVE}{T.MINIMA}{GAP.format(bounds='minima', gap=150)} SELECT video_id, pos FROM long_bounds")
def min_duration(spark, d):
    scored, minima = _minima(spark, d)
    ends = scored.groupBy("video_id").agg(F.min("time_sec").alias("first_sec"), F.max("time_sec").alias("end_sec"))
    return segments.keep_long(minima, scored, ends, min_sec=150.0)


EVENTS_SQL = """,
part_no AS (SELECT s.*, (sum(CASE WHEN m.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY s.video_id ORDER BY s.pos))::INTEGER AS k FROM scored s LEFT JOIN {bounds} m ON m.video_id = s.video_id AND m.pos = s.pos),
grouped AS (SELECT video_id, k, arg_min(frame_idx, pos) AS start_frame, arg_max(frame_idx, pos) AS last_frame, arg_min(time_sec, pos) AS start_time, arg_min(z, pos) AS boundary_score, count(*)::INTEGER AS n_samples, string_agg(frame_idx, ',' ORDER BY pos) AS samples FROM part_no GROUP BY ALL),
video_end AS (SELECT video_id, max(time_sec) AS t1 FROM scored GROUP BY video_id)
SELECT g.video_id, printf('%04d', k) AS event_id, start_frame, coalesce(lead(start_frame) OVER w, last_frame) AS end_frame, start_time, greatest(start_time, coalesce(lead(start_time) OVER w, t1)) AS end_time, boundary_score, n_samples, samples
FROM grouped g JOIN video_end v ON v.video_id = g.video_id WINDOW w AS (PARTITION BY g.video_id ORDER BY k)"""


def _flat_events(events):
    return events.select("video_id", "event_id", "start_frame", "end_frame", "start_time", "end_time", r6("metadata.boundary_score").alias("boundary_score"), F.col("metadata.n_samples").alias("n_samples"), F.array_join(F.col("sample_indices").cast("array<string>"), ",").alias("samples"))


@query("events_from_bounds", f"WITH {T.CURVE}{T.MINIMA}{EVENTS_SQL.format(bounds='minima')}")
def events_from_bounds(spark, d):
    scored, minima = _minima(spark, d)
    ends = scored.groupBy("video_id").agg(F.max("time_sec").alias("end_sec"))
    return _flat_events(segments.event_spans(segments.assign_parts(scored.withColumn("fused", F.col("z")), minima), ends))


@query("segment_full", f"WITH RECURSIVE {T.CURVE}{T.MINIMA}{T.PARTS}{T.MERGE}{GAP.format(bounds='merged', gap=20)}{EVENTS_SQL.format(bounds='long_bounds')}")
def segment_full(spark, d):
    """Curve, fusion, minima, merge, minimum duration and events of every recording."""
    return _flat_events(segments.segment(T.dense_samples(spark, d))[0])


def _two_channels(spark, d):
    """All documents as samples, with the vector of the same number where there is one, and their whole texts apart; every third text is speech as well."""
    dense = T.read(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("frame_idx"), "embedding")
    samples = T.text_numbers(spark, d).join(dense, "frame_idx", "left").select("video_id", "pos", "frame_idx", "embedding", (F.col("pos") * 30.0).alias("time_sec"))
    texts = T.read(spark, d, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").cast("int").alias("frame_idx"), F.col("text").alias("ocr_text"))
    return materialise(samples, "samples"), texts.withColumn("transcript_text", F.when(F.col("frame_idx") % 3 == 0, F.col("ocr_text")))


FUSED = BAND + """,
mirrored AS (SELECT video_id, pos, d, sim FROM band UNION ALL SELECT video_id, pos + d, d, sim FROM band),
grid AS (SELECT t.video_id, t.pos, s.n, unnest([1, 2, 3]) AS d FROM texts t JOIN sizes s USING (video_id)),
spans AS (SELECT video_id, pos, any_value(n) AS n, sum((1 - d / 4.0) * ((pos >= d)::INT + (pos + d < n)::INT)) AS weight FROM grid GROUP BY ALL),
tot AS (SELECT video_id, pos, sum(sim * (1 - d / 4.0)) AS total FROM mirrored GROUP BY ALL),
spoken AS (SELECT DISTINCT video_id FROM tfidf),
screen AS (SELECT e.video_id, e.pos, (CASE WHEN s.video_id IS NULL THEN 0.0 WHEN n = 1 THEN 1.0 ELSE coalesce(total, 0) / weight END)::DOUBLE AS c FROM spans e LEFT JOIN spoken s USING (video_id) LEFT JOIN tot USING (video_id, pos)),
screen_stats AS (SELECT video_id, avg(c) AS mean, stddev_pop(c) AS sd FROM screen GROUP BY video_id),
dense AS (SELECT t.video_id, t.pos, t.frame_idx, (t.pos * 30.0)::DOUBLE AS time_sec, v.embedding::DOUBLE[] AS e FROM texts t LEFT JOIN embeddings v ON v.vec_id = t.frame_idx)""" + T.CURVE[len(T.DENSE):].replace("\nscored AS", "\ndense_scored AS") + """,
seen AS (SELECT video_id, count(e) > 0 AS has_dense FROM dense GROUP BY video_id),
apart AS (SELECT k.video_id, k.pos, k.frame_idx, k.time_sec, k.c AS c_dense, x.c AS c_screen, st.n, st.last, has_dense, sp.video_id IS NOT NULL AS has_screen,
  CASE WHEN st.sd < 1e-8 THEN 0.0 ELSE (k.c - st.mean) / st.sd END AS z_dense, CASE WHEN xt.sd < 1e-8 THEN 0.0 ELSE (x.c - xt.mean) / xt.sd END AS z_screen
  FROM curve k JOIN stats st USING (video_id) JOIN screen x USING (video_id, pos) JOIN screen_stats xt USING (video_id) JOIN seen USING (video_id) LEFT JOIN spoken sp USING (video_id)),
scored AS (SELECT *, round(CASE WHEN has_dense AND has_screen THEN (z_dense + z_screen) / 2 WHEN has_dense THEN z_dense WHEN has_screen THEN z_screen END, 6) + 0.0 AS z FROM apart)"""


@query("fused_curve", f"WITH {FUSED} SELECT video_id, pos, round(c_dense, 6) AS c_dense, round(c_screen, 6) AS c_screen, z AS fused FROM scored")
def fused_curve(spark, d):
    """Vectors and screen texts of every document, half and half."""
    samples, texts = _two_channels(spark, d)
    curves, _ = segments.channel_curves(samples, SegmentOptions(), texts=texts, at="frame_idx")
    return curves.select("video_id", "pos", r6("c_dense").alias("c_dense"), r6("c_screen").alias("c_screen"), "fused")


@query("segment_fused", f"WITH {FUSED}{T.MINIMA}{GAP.format(bounds='minima', gap=20)}{EVENTS_SQL.format(bounds='long_bounds')}".replace("WITH ", "WITH RECURSIVE ", 1))
def segment_fused(spark, d):
    """Events of the fused curve, with room for every part; segment_full merges."""
    samples, texts = _two_channels(spark, d)
    return _flat_events(segments.segment(samples, options=SegmentOptions(target=1 << 30, max_events=1 << 30), texts=texts, at="frame_idx")[0])


@query("segment_channels")
def segment_channels(spark, d):
    """Two fused channels, merged over part sums of vectors and term weights, with evidence and titles."""
    samples, texts = _two_channels(spark, d)
    events, numbered = segments.segment(samples, options=SegmentOptions(target=4), texts=texts, at="frame_idx")
    return evidence.titled_events(events, numbered, texts, passed=["start_frame", "end_frame", "start_time", "end_time"])


STAMP = "CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END"


@query("fmt_timestamp", f"SELECT o_orderkey, {STAMP} AS stamp FROM (SELECT o_orderkey, trunc(greatest(0, o_totalprice::DOUBLE / 20 - 100))::BIGINT AS s FROM orders)")
def fmt_timestamp(spark, d):
    return T.read(spark, d, "orders").select("o_orderkey", C.format_timestamp(F.col("o_totalprice").cast("double") / 20 - 100).alias("stamp"))


@query("representatives", """WITH s AS (SELECT conv_id, list(turn::INTEGER ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(l) <= 3 THEN l ELSE list_transform([1, 2, 3], lambda k: l[least(len(l), trunc(len(l) / 4.0::DOUBLE * k)::INTEGER + 1)]) END AS reps FROM s""")
def representatives(spark, d):
    c = T.read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.col("turn").cast("int"))).alias("l"))
    return c.select("conv_id", C.representatives("l", 3).alias("reps"))


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("evidence_ocr", f"""WITH {T.TEXT}, l AS (SELECT video_id, pos, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS t FROM texts),
f AS (SELECT video_id, lower(trim(t, {WS})) AS k, arg_min(trim(t, {WS}), (pos, i)) AS x, min((pos, i)) AS o FROM l WHERE trim(t, {WS}) <> '' GROUP BY ALL)
SELECT video_id, string_agg(x, chr(10) ORDER BY o) AS ocr_text FROM f GROUP BY video_id""")
def evidence_ocr(spark, d):
    return evidence.distinct_pieces(T.text_samples(spark, d), keys=VK, order="pos", text="text", out="ocr_text", by_line=True)


@query("evidence_transcript", f"""WITH {T.TURNS}, f AS (SELECT video_id, trim(text, {WS}) AS x, min(turn) AS o FROM (SELECT video_id, turn, text FROM turns UNION ALL SELECT video_id, turn + 100, text FROM turns) WHERE trim(text, {WS}) <> '' GROUP BY ALL)
SELECT video_id, string_agg(x, ' ' ORDER BY o) AS transcript_text FROM f GROUP BY video_id""")
def evidence_transcript(spark, d):
    t = T.turns(spark, d).select("video_id", "turn", "text")
    return evidence.distinct_pieces(t.unionByName(t.withColumn("turn", F.col("turn") + 100)), keys=VK, order="turn", text="text", out="transcript_text", by_line=False)


def _turn_events(spark, d):
    t = T.turns(spark, d)
    return t.select("video_id", "event_id", (F.col("turn") * 90.5).alias("start_time"), ((F.col("turn") + 1) * 90.5).alias("end_time"), F.when(F.col("role") != "assistant", F.col("text")).alias("ocr_text"), F.when(F.col("role") == "assistant", F.col("text")).alias("transcript_text"))


def _stamp(x):
    return STAMP.replace("s >=", f"{x} >=").replace("s //", f"{x} //").replace("s %", f"{x} %")


@query("evidence_prompt", f"""WITH {T.TURNS}, e AS (SELECT video_id, event_id, turn * 90.5 AS a, (turn + 1) * 90.5 AS b, CASE WHEN role <> 'assistant' THEN trim(text, {WS}) ELSE '' END AS o, CASE WHEN role = 'assistant' THEN trim(text, {WS}) ELSE '' END AS t FROM turns),
f AS (SELECT *, trunc(a)::BIGINT AS sa, trunc(b)::BIGINT AS sb FROM e)
SELECT video_id, event_id, concat_ws(chr(10), '[' || event_id || '] ' || {_stamp('sa')} || '-' || {_stamp('sb')} || ' (' || round_even(b - a, 0)::BIGINT || 's)',
  CASE WHEN o <> '' THEN 'on-screen text:' || chr(10) || substr(o, 1, 200) END, CASE WHEN t <> '' THEN 'transcript:' || chr(10) || substr(t, 1, 200) END, CASE WHEN o = '' AND t = '' THEN '(no text evidence)' END) AS prompt FROM f""")
def evidence_prompt(spark, d):
    return _turn_events(spark, d).select("video_id", "event_id", evidence.evidence_prompt(LabelOptions(ocr_chars=200, transcript_chars=200)).alias("prompt"))


STOP = ", ".join(f"'{w}'" for w in evidence.STOPWORDS)
TITLES = f"""{T.TURNS},
sizes AS (SELECT video_id, count(*) AS n FROM turns GROUP BY ALL),
words AS (SELECT video_id, event_id, generate_subscripts({TOK}, 1) AS i, unnest({TOK}) AS w FROM turns),
counts AS (SELECT video_id, event_id, w, count(*) AS c, min(i) AS i FROM words WHERE length(w) > 2 AND w NOT IN ({STOP}) AND NOT regexp_matches(w, '^[0-9]+$') GROUP BY ALL),
df AS (SELECT video_id, w, count(*) AS df FROM counts GROUP BY ALL),
top AS (SELECT video_id, event_id, w, row_number() OVER (PARTITION BY video_id, event_id ORDER BY c * (n / (1.0::DOUBLE + df)) DESC, i) AS r FROM counts JOIN df USING (video_id, w) JOIN sizes USING (video_id)),
named AS (SELECT video_id, event_id, string_agg(w, ' ' ORDER BY r) AS title FROM top WHERE r <= 3 GROUP BY ALL),
titles AS (SELECT t.video_id, t.event_id, t.turn, coalesce(title, 'unclear') AS title FROM turns t LEFT JOIN named USING (video_id, event_id))"""


@query("heuristic_titles", f"WITH {TITLES} SELECT video_id, event_id, title FROM titles")
def heuristic_titles(spark, d):
    return evidence.distinctive_titles(T.turns(spark, d), text=F.col("text"))


@query("title_join", f"WITH {T.TURNS} SELECT video_id, event_id, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN role ELSE 'late ' || turn END AS title FROM turns")
def title_join(spark, d):
    t = T.turns(spark, d)
    titles = t.where("turn % 3 <> 0").select("video_id", "event_id", F.concat(F.lit("  "), F.col("role"), F.lit(" ")).alias("title"), F.lit(0).alias("ord")).unionByName(
        t.where("turn % 3 = 2").select("video_id", "event_id", F.concat(F.lit("late "), F.col("turn")).alias("title"), F.lit(1).alias("ord"))
    )
    return evidence.join_titles(t.withColumn("title", F.lit("")), titles, order="ord").select("video_id", "event_id", "title")


@query("combined_text", f"WITH {T.TURNS} SELECT video_id, event_id, CASE turn % 3 WHEN 0 THEN role || '  ' || text WHEN 1 THEN role ELSE text END AS combined FROM turns")
def combined_text(spark, d):
    t = T.turns(spark, d)
    return t.select("video_id", "event_id", C.combined_text(F.when(F.col("turn") % 3 != 2, F.col("role")), F.when(F.col("turn") % 3 != 1, F.col("text"))).alias("combined"))


@query("chapter_list", f"WITH {TITLES}, l AS (SELECT video_id, event_id, title, turn, (turn * 1000)::BIGINT AS s FROM titles) SELECT video_id, string_agg({STAMP} || ' ' || CASE WHEN turn = 2 THEN '(unlabeled)' ELSE title END, chr(10) ORDER BY event_id) AS chapters FROM l GROUP BY video_id")
def chapter_list(spark, d):
    t = T.turns(spark, d)
    titled = evidence.distinctive_titles(t, text=F.col("text")).join(t.select("video_id", "event_id", "turn"), ["video_id", "event_id"])
    return evidence.chapter_list(titled.select("video_id", "event_id", (F.col("turn") * 1000.0).alias("start_time"), F.when(F.col("turn") != 2, F.col("title")).alias("title")))


REL = f"""{T.DENSE},
q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0),
rel AS (SELECT video_id, frame_idx AS pos, e, greatest(0.0, least(1.0, (list_inner_product(e, qe) + 1) / 2)) AS relevance FROM dense, q)"""


def _relevance(spark, d):
    """All embeddings as one series (query q0), events by label, relevance to the embedding of vec_id 0."""
    s = T.dense_samples(spark, d)
    q = T.read(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("qe"), F.lit("q0").alias("query_id"))
    return s.withColumn("query_id", F.lit("q0")).join(F.broadcast(q), "query_id").select(  # one query vector
        "query_id", F.col("frame_idx").alias("pos"), "frame_idx", F.col("video_id").cast("int").alias("event_index"), "time_sec", "embedding", C.rescaled_cosine("embedding", "qe").alias("relevance")
    )


QK = ["query_id"]


@query("relevance_rescale", f"WITH {REL} SELECT video_id::INTEGER AS event_index, pos, round(relevance, 6) AS relevance FROM rel")
def relevance_rescale(spark, d):
    return _relevance(spark, d).select("event_index", "pos", r6("relevance").alias("relevance"))


@query("anchors", f"WITH {REL} SELECT video_id::INTEGER AS event_index, pos, round(relevance, 6) AS relevance FROM rel QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY relevance DESC, pos) = 1")
def anchors(spark, d):
    return retrieve.anchors(_relevance(spark, d), keys=QK, event="event_index").select("event_index", "pos", r6("relevance").alias("relevance"))


GATE = f"""{REL},
anchors AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY relevance DESC, pos) = 1),
peaks AS (SELECT r.pos, any_value(r.e) AS e, any_value(r.relevance) AS relevance, max(list_inner_product(r.e, a.e)) AS peak FROM rel r, anchors a GROUP BY r.pos),
lims AS (SELECT greatest(0, least(1, avg(peak) - 0.5 * stddev_pop(peak))) AS strict, greatest(0, least(1, avg(peak) + 0.5 * stddev_pop(peak))) AS loose FROM peaks)"""


@query("mmr_gate", f"WITH {GATE} SELECT pos, round(peak, 6) AS peak, round(strict, 6) AS strict, round(loose, 6) AS loose FROM peaks, lims")
def mmr_gate(spark, d):
    s = _relevance(spark, d)
    g = retrieve.gate_limits(s, retrieve.anchors(s, keys=QK, event="event_index"), SelectOptions(), keys=QK)
    return g.select("pos", r6("peak").alias("peak"), r6("strict").alias("strict"), r6("loose").alias("loose"))


MMR = f"""{GATE},
levels AS (SELECT p.*, CASE WHEN loose > strict THEN
    CASE WHEN peak <= strict THEN 0 WHEN peak <= strict + (loose - strict) * 0.25 THEN 1 WHEN peak <= strict + (loose - strict) * 0.5 THEN 2 WHEN peak <= strict + (loose - strict) * 0.75 THEN 3 WHEN peak <= loose THEN 4 ELSE 5 END
  ELSE CASE WHEN peak <= strict THEN 0 ELSE 5 END END AS lv, EXISTS (SELECT 1 FROM anchors a WHERE a.pos = p.pos) AS seed FROM peaks p, lims),
mmr AS (
  SELECT (SELECT count(*) FROM anchors) AS n, pos, e, relevance, lv, peak AS red, seed AS sel FROM levels
  UNION ALL
  SELECT n + 1, pos, e, relevance, lv, greatest(red, list_inner_product(e, pe)), sel OR pos = pp FROM (
    SELECT *, first_value(pos) OVER w AS pp, first_value(e) OVER w AS pe FROM mmr WHERE n < 16
    WINDOW w AS (ORDER BY sel, lv, CASE WHEN lv = 5 THEN -relevance ELSE 0.5 * red - 0.5 * relevance END, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))),
chosen AS (SELECT pos, relevance FROM mmr WHERE sel AND n = (SELECT max(n) FROM mmr))"""


@query("adaptive_mmr", f"WITH RECURSIVE {MMR} SELECT pos FROM chosen")
def adaptive_mmr(spark, d):
    s = _relevance(spark, d)
    return retrieve.adaptive_mmr(s, retrieve.anchors(s, keys=QK, event="event_index"), keys=QK).select("pos")


@query("selected_frames", f"WITH RECURSIVE {MMR} SELECT c.pos AS frame_idx, d.time_sec, d.video_id::INTEGER AS event_index, round(c.relevance, 6) AS relevance, c.pos IN (SELECT pos FROM anchors) AS is_anchor FROM chosen c JOIN dense d ON d.frame_idx = c.pos")
def selected_frames(spark, d):
    return retrieve.select_frames(_relevance(spark, d), keys=QK).select("frame_idx", "time_sec", "event_index", r6("relevance").alias("relevance"), "is_anchor")


@query("search_events", f"""WITH {T.TURNS}, texts AS (SELECT video_id || '-' || event_id AS event_id, text FROM turns), split AS (SELECT event_id, {TOK} AS l FROM texts),
sizes AS (SELECT count(*) AS n, avg(len(l)) AS mean FROM split),
hits AS (SELECT event_id, len(l) AS size, unnest(l) AS w FROM split), tf AS (SELECT event_id, size, w, count(*) AS tf FROM hits WHERE w IN ('the', 'and', 'of') GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
scores AS (SELECT event_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS bm25 FROM tf JOIN df USING (w), sizes GROUP BY event_id),
best AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, event_id) AS r FROM scores QUALIFY r <= 5)
SELECT event_id, round(bm25, 6) AS bm25, round(1 / (60.0::DOUBLE + r), 6) AS score,
  substr(text, greatest(1, coalesce(list_min(list_filter([strpos(lower(text), 'and'), strpos(lower(text), 'of'), strpos(lower(text), 'the')], lambda x: x > 0)), 1) - 40)::BIGINT, 80) AS snippet FROM best JOIN texts USING (event_id)""")
def search_events(spark, d):
    q = "the and of"
    found = retrieve.search_events(T.turns(spark, d).select(F.concat_ws("-", "video_id", "event_id").alias("event_id"), "text"), q)
    return found.select("event_id", r6("bm25").alias("bm25"), r6("score").alias("score"), "snippet")


@query("streaming_sample", GREEDY)
def streaming_sample(spark, d):
    """The stateful sampler over the frames as a stream of one file, run to its end; equal to the batch sampler."""
    from ..shared import new_path
    from ..streaming.sampler import streaming_sample as sample

    source, out, state = (new_path(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    frames = T.frames(spark, d).select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "time_sec")
    frames.write.parquet(source)
    stream = sample(spark.readStream.schema(frames.schema).parquet(source), interval=DAY)
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("video_id", "frame_idx", r6("time_sec").alias("time_sec"))


@query("index_json_roundtrip", f"""WITH {T.CURVE}{T.MINIMA}{EVENTS_SQL.format(bounds='minima')}""".replace("SELECT g.video_id, printf", "SELECT g.video_id, '/v/' || g.video_id AS video_path, t1 AS duration_sec, (count(*) OVER (PARTITION BY g.video_id))::INTEGER AS n_events, printf").replace(", boundary_score, n_samples, samples\n", "\n"))
def index_json_roundtrip(spark, d):
    """Events written as an index table and read back."""
    from ..shared import new_path
    from ..sources import index

    scored, minima = _minima(spark, d)
    ends = scored.groupBy("video_id").agg(F.max("time_sec").alias("end_sec"))
    events = segments.event_spans(segments.assign_parts(scored.withColumn("fused", F.col("z")), minima), ends)
    videos = ends.select("video_id", F.concat(F.lit("/v/"), "video_id").alias("path"), F.col("end_sec").alias("duration_sec"))
    path = new_path(spark, "index")
    index.write_index_table(index.index_rows(events, videos), path)
    return index.read_index(spark, path, lines=True).select("video_id", "video_path", "duration_sec", F.size("events").alias("n_events"), F.explode("events").alias("e")).select(
        "video_id", "video_path", "duration_sec", "n_events", "e.event_id", "e.start_frame", "e.end_frame", "e.start_time", "e.end_time"
    )
