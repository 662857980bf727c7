"""The chaptering plan: recordings to titled events, and its record of the run."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import event_duration, representatives
from ..model import Options
from ..operators import evidence, intervals, segments
from ..shared import materialise
from ..sources import adapters


@dataclass
class ChapterResult:
    events: DataFrame
    samples: DataFrame
    channels: DataFrame
    backend: str
    stage_times: dict[str, float] = field(default_factory=dict)


def chapter_samples(samples: DataFrame, durations: DataFrame | None = None, options: Options | None = None, *, backend: str = "auto", model=None) -> ChapterResult:
    """Segment, gather evidence and title samples of many recordings."""
    o = options or Options()
    times: dict[str, float] = {}
    began = time.perf_counter()
    events, numbered = segments.segment(samples, durations, o.segment)
    events = materialise(evidence.attach_evidence(events, numbered).withColumn("representative_frames", representatives("sample_indices", 3)), "events")
    times["segment"] = time.perf_counter() - began
    began = time.perf_counter()
    prompts = events.select("video_id", "event_id", evidence.evidence_prompt(o.label).alias("prompt"))
    named, used = adapters.titles(events, prompts, backend=backend, model=model, enabled=o.label.enabled)
    events = materialise(evidence.join_titles(events, named, order="number").withColumn("summary", F.lit("")).withColumn("duration_sec", event_duration("start_time", "end_time")), "titled")
    times["label"] = time.perf_counter() - began
    curves, _ = segments.channel_curves(samples, o.segment)
    channels = curves.select("video_id", *[f"has_{c}" for c in segments.CHANNELS]).distinct()
    return ChapterResult(events, samples, channels, used, times)


def chapter_videos(
    videos: DataFrame, options: Options | None = None, *, reader: str, embedder: str | None = None, text_reader: str | None = None, transcriber: str | None = None, backend: str = "auto", model=None
) -> ChapterResult:
    """From (video_id, path, duration_sec): decode and sample, align speech, then ``chapter_samples``."""
    o = options or Options()
    began = time.perf_counter()
    signals = materialise(adapters.sampled_signals(videos, reader=reader, embedder=embedder, text_reader=text_reader, sampling=o.sampling, text=o.text), "signals")
    samples = adapters.samples_from_signals(signals, o.text)
    if transcriber and o.speech.enabled:
        spoken = adapters.speech_segments(videos, transcriber, o.speech)
        samples = intervals.overlap_text(
            samples, spoken, keys=["video_id"], time="time_sec", start="start_sec", end="end_sec", text="text", order="seg_no", out="transcript_text", window=o.speech.window, bucket=60.0
        )
    else:
        samples = samples.withColumn("transcript_text", F.lit(None).cast("string"))
    samples = materialise(samples, "samples")
    took = time.perf_counter() - began
    result = chapter_samples(samples, videos.select("video_id", "duration_sec"), o, backend=backend, model=model)
    result.stage_times["signals"] = took
    return result


def relabel(spark: SparkSession, payload: dict, options: Options | None = None, *, backend: str = "auto", model=None) -> dict:
    """An index payload with its events titled again; ``extra`` is not kept."""
    o = options or Options()
    rows = [(payload["video_id"], e["event_id"], float(e["start_time"]), float(e["end_time"]), e.get("ocr_text", ""), e.get("transcript_text", ""), i) for i, e in enumerate(payload["events"])]
    events = spark.createDataFrame(rows, "video_id string, event_id string, start_time double, end_time double, ocr_text string, transcript_text string, n int")
    prompts = events.select("video_id", "event_id", evidence.evidence_prompt(o.label).alias("prompt"))
    named, _ = adapters.titles(events, prompts, backend=backend, model=model, enabled=o.label.enabled)
    found = {r["event_id"]: r["title"] for r in evidence.join_titles(events, named, order="number").select("event_id", "title").collect()}
    return {**{k: payload[k] for k in ("video_id", "video_path", "duration_sec")}, "events": [{**e, "title": found.get(e["event_id"], "")} for e in payload["events"]]}
