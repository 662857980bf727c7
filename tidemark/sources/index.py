"""Event indexes as JSON: one file per recording, written by replacement, and bulk tables."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import INDEX

REQUIRED = ("event_id", "start_frame", "end_frame", "start_time", "end_time")
FIELDS = ("event_id", "start_frame", "end_frame", "start_time", "end_time", "title", "summary", "ocr_text", "transcript_text", "sample_indices", "representative_frames", "metadata")


def index_rows(events: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, video_path, duration_sec, events): each recording's events as an array in order of event_id."""
    made = {"summary": F.lit(""), "title": F.lit(""), "ocr_text": F.lit(""), "transcript_text": F.lit(""), "representative_frames": F.array().cast("array<int>")}
    for name, value in made.items():
        if name not in events.columns:
            events = events.withColumn(name, value)
    rows = events.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("events"))
    return videos.select("video_id", F.col("path").alias("video_path"), "duration_sec").join(rows, "video_id", "left")


def write_index_table(rows: DataFrame, path: str) -> None:
    """Bulk form: JSON lines under Spark's commit protocol."""
    rows.write.mode("overwrite").json(path)


def write_index(path: str | os.PathLike, payload: dict[str, Any]) -> None:
    """One recording's index as an indented UTF-8 file, put in place as a whole; a failed write leaves nothing behind.

    ``extra`` is written only if it holds something.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    body = {k: payload[k] for k in ("video_id", "video_path", "duration_sec", "events")}
    if payload.get("extra"):
        body["extra"] = payload["extra"]
    handle, temporary = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(body, f, indent=2, ensure_ascii=False)
        os.replace(temporary, target)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def read_index(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Indexes (one file each, or JSON lines as ``write_index_table`` writes) with the fixed schema: unknown fields are ignored, no events is an empty array, an event without a required field is an error."""
    rows = spark.read.schema(INDEX).option("multiLine", not lines).json(path)
    empty = F.from_json(F.lit("[]"), rows.schema["events"].dataType)
    rows = rows.withColumn("events", F.coalesce("events", empty))
    complete = F.forall("events", lambda e: ~F.array_contains(F.array(*[e[f].isNull() for f in REQUIRED]), True))
    checked = F.when(complete, F.col("events")).otherwise(F.from_json(F.raise_error(F.concat(F.lit("event without a required field in "), F.col("video_id"))).cast("string"), rows.schema["events"].dataType))
    return rows.withColumn("events", checked)


def read_payload(path: str | os.PathLike) -> dict[str, Any]:
    """One index file as it is, for tools that rewrite it; unknown event fields are dropped."""
    payload = json.loads(Path(path).read_text(encoding="utf-8"))
    events = payload.get("events", [])
    for e in events:
        missing = [f for f in REQUIRED if f not in e]
        if missing:
            raise ValueError(f"event without {missing[0]} in {path}")
    payload["events"] = [{k: e[k] for k in FIELDS if k in e} for e in events]
    return payload
