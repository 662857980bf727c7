"""The benchmark tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _position(key: str, order: str):
    return (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("int")


def dense_samples(spark: SparkSession, sf_dir: str, seconds: float = 30.0) -> DataFrame:
    """``embeddings`` as samples of a recording per label, ``seconds`` apart."""
    e = read(spark, sf_dir, "embeddings").withColumn("video_id", F.col("label").cast("string"))
    return e.select(
        "video_id", _position("video_id", "vec_id").alias("pos"), F.col("vec_id").cast("int").alias("frame_idx"), "embedding"
    ).select("video_id", "pos", "frame_idx", (F.col("pos") * seconds).alias("time_sec"), "embedding", F.lit(None).cast("string").alias("ocr_text"), F.lit(None).cast("string").alias("transcript_text"))


def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as screen texts of a recording per source."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), "doc_id", "text")
    # Ids are numbered without their texts, so no text is sorted within its source.
    numbers = d.select("doc_id", _position("video_id", "doc_id").alias("pos")).withColumnRenamed("doc_id", "number_of")
    return d.join(numbers, F.col("doc_id") == F.col("number_of")).select("video_id", "pos", F.col("doc_id").cast("int").alias("frame_idx"), "text")


def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of ``text_samples`` without their texts, so that those need not be joined."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), "doc_id")
    return d.select("video_id", _position("video_id", "doc_id").alias("pos"), F.col("doc_id").cast("int").alias("frame_idx"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as frames of a recording per user, in decode order of event_id, seconds from the user's first."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("frame_idx"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"), "event_type", "value")
    first = F.min("_us").over(Window.partitionBy("video_id"))
    return e.select("video_id", "frame_idx", ((F.col("_us") - first) / 1e6).alias("time_sec"), "event_type", "value")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as events of a recording per conversation."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("video_id"), F.format_string("%04d", F.col("turn").cast("int")).alias("event_id"), "turn", "role", "text")


# The same roles in SQL.
DENSE = """dense AS (SELECT label::VARCHAR AS video_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS pos,
  vec_id::INTEGER AS frame_idx, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 30.0)::DOUBLE AS time_sec, embedding::DOUBLE[] AS e FROM embeddings)"""
TEXT = """texts AS (SELECT source AS video_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INTEGER AS pos, doc_id::INTEGER AS frame_idx, text FROM documents)"""
FRAMES = """frames AS (SELECT user_id::VARCHAR AS video_id, event_id AS frame_idx, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS time_sec, event_type, value FROM events)"""
TURNS = """turns AS (SELECT conv_id::VARCHAR AS video_id, printf('%04d', turn::INTEGER) AS event_id, turn, role, text FROM conversations)"""
CURVE = DENSE + """,
near AS (SELECT video_id, pos, frame_idx, time_sec, e, list_inner_product(e, lead(e, 1) OVER w) AS d1, list_inner_product(e, lead(e, 2) OVER w) AS d2, list_inner_product(e, lead(e, 3) OVER w) AS d3
  FROM dense WINDOW w AS (PARTITION BY video_id ORDER BY pos)),
both_ways AS (SELECT *, lag(d1, 1) OVER w AS m1, lag(d2, 2) OVER w AS m2, lag(d3, 3) OVER w AS m3 FROM near WINDOW w AS (PARTITION BY video_id ORDER BY pos)),
weighed AS (SELECT *, (coalesce(d1, 0) + coalesce(m1, 0)) * 0.75 + (coalesce(d2, 0) + coalesce(m2, 0)) * 0.5 + (coalesce(d3, 0) + coalesce(m3, 0)) * 0.25 AS total,
  ((d1 IS NOT NULL)::INT + (m1 IS NOT NULL)::INT) * 0.75 + ((d2 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT) * 0.5 + ((d3 IS NOT NULL)::INT + (m3 IS NOT NULL)::INT) * 0.25 AS weight FROM both_ways),
curve AS (SELECT video_id, pos, frame_idx, time_sec, e, CASE WHEN weight > 0 THEN total / weight::DOUBLE ELSE 1.0 END AS c FROM weighed),
stats AS (SELECT video_id, avg(c) AS mean, stddev_pop(c) AS sd, count(*) AS n, max(pos) AS last FROM curve GROUP BY video_id),
scored AS (SELECT curve.*, n, last, round(CASE WHEN sd < 1e-8 THEN 0.0 ELSE (c - mean) / sd END, 6) + 0.0 AS z FROM curve JOIN stats USING (video_id))"""
MINIMA = """,
flagged AS (SELECT *, CASE WHEN lag(z) OVER w IS NULL OR lag(z) OVER w <> z THEN 1 ELSE 0 END AS fresh FROM scored WINDOW w AS (PARTITION BY video_id ORDER BY pos)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY pos) AS run FROM flagged),
runs AS (SELECT video_id, run, min(pos) AS a, max(pos) AS b, any_value(z) AS v, any_value(last) AS last FROM numbered GROUP BY ALL),
placed AS (SELECT *, lag(v) OVER w AS prev, lead(v) OVER w AS next FROM runs WINDOW w AS (PARTITION BY video_id ORDER BY run)),
edges AS (SELECT *, CASE WHEN a = 0 OR prev > v THEN greatest(1, a) ELSE a + 1 END AS lo, least(b, last - 1) AS hi FROM placed),
minima AS (SELECT video_id, ((lo + hi) // 2)::INTEGER AS pos FROM edges WHERE lo <= hi AND (b = last OR next > v) AND last >= 2)"""
PARTS = """,
cut AS (SELECT s.*, (sum(CASE WHEN m.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY s.video_id ORDER BY s.pos))::INTEGER AS part
  FROM scored s LEFT JOIN minima m ON m.video_id = s.video_id AND m.pos = s.pos),
dims AS (SELECT video_id, part, pos, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM cut),
dim_sums AS (SELECT video_id, part, i, sum(x) AS s FROM dims GROUP BY ALL),
sums AS (SELECT video_id, part, list(s ORDER BY i) AS s FROM dim_sums GROUP BY ALL),
firsts AS (SELECT video_id, part, min(pos) AS first_pos FROM cut GROUP BY ALL)"""
MERGE = """,
start_state AS (SELECT video_id, list(s ORDER BY part) AS parts, list(first_pos ORDER BY part) AS firsts FROM sums JOIN firsts USING (video_id, part) GROUP BY video_id),
goal AS (SELECT video_id, greatest(3, least(24, round_even(max(time_sec) / 60 / 4, 0)))::INTEGER AS target FROM scored GROUP BY video_id),
merging AS (
  SELECT video_id, parts, firsts, target FROM start_state JOIN goal USING (video_id)
  UNION ALL
  SELECT video_id, list_concat(list_concat(parts[1:k - 1], [list_transform(parts[k], lambda x, i: x + parts[k + 1][i])]), parts[k + 2:]),
    list_concat(firsts[1:k], firsts[k + 2:]), target
  FROM (SELECT *, list_position(sims, list_max(sims))::INTEGER AS k FROM (
    SELECT *, list_transform(range(1, len(parts)), lambda i: list_cosine_similarity(parts[i], parts[i + 1])) AS sims FROM merging WHERE len(parts) > target))),
merged AS (SELECT video_id, unnest(firsts[2:]) AS pos FROM merging WHERE len(parts) <= target)"""
