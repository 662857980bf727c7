"""Where models and decoders plug in, with stubs that need none.

An adapter works on batches and is used inside one Python stage, so pixels never leave it: the
stage's output holds only what later operators need. Models load once per worker.
"""

from __future__ import annotations

import functools
import importlib
import json
import logging
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import confident_lines, reads_text, unit
from ..model import SamplingOptions, SpeechOptions, TextOptions
from ..operators.evidence import frame_lines

log = logging.getLogger(__name__)


class FrameReader(Protocol):
    """Decodes a recording: stream facts, and (pts, dts, time base, image) per frame in decode order."""

    def probe(self, path: str) -> dict[str, Any]: ...

    def frames(self, path: str) -> Iterator[tuple[int | None, int | None, float, Any]]: ...


class Embedder(Protocol):
    def __call__(self, images: Sequence[Any]) -> list[list[float]]: ...


class TextReader(Protocol):
    """Lines of an image as (text, score)."""

    def __call__(self, image: Any) -> list[tuple[str, Any]]: ...


class Transcriber(Protocol):
    def __call__(self, path: str) -> list[tuple[float, float, str]]: ...


class TitleBackend(Protocol):
    """Titles of one recording's events: (event_id, title) from (event_id, prompt)."""

    def __call__(self, prompts: list[tuple[str, str]]) -> list[tuple[str, str]]: ...


def load(name: str) -> Any:
    """The object named ``module:attribute``."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


@functools.lru_cache(8)
def instance(name: str) -> Any:
    """One adapter per worker, made on first use."""
    made = load(name)
    return made() if isinstance(made, type) else made


class JsonFrames:
    """Stub reader of a text file: a JSON object with the stream facts, then one JSON object per frame (pts, dts, time_base, image)."""

    def probe(self, path: str) -> dict[str, Any]:
        with Path(path).open() as f:
            return json.loads(f.readline() or "{}")

    def frames(self, path: str) -> Iterator[tuple[int | None, int | None, float, Any]]:
        with Path(path).open() as f:
            next(f, None)
            for line in f:
                x = json.loads(line)
                yield x.get("pts"), x.get("dts"), x.get("time_base", 1.0), x.get("image")


class StubEmbedder:
    """Vectors that a stub image brings along."""

    def __call__(self, images: Sequence[Any]) -> list[list[float]]:
        return [list(map(float, (x or {}).get("vector", [0.0]))) for x in images]


class StubTextReader:
    def __call__(self, image: Any) -> list[tuple[str, Any]]:
        return [tuple(x) for x in (image or {}).get("lines", [])]


class StubTranscriber:
    """Segments in the stream facts of a stub file."""

    def __call__(self, path: str) -> list[tuple[float, float, str]]:
        return [tuple(x) for x in JsonFrames().probe(path).get("speech", [])]


SIGNALS = "video_id string, frame_idx int, pts long, time_sec double, embedding array<double>, lines array<struct<text:string,score:string>>, reads boolean"


def sampled_signals(
    videos: DataFrame, *, reader: str, embedder: str | None, text_reader: str | None, sampling: SamplingOptions | None = None, text: TextOptions | None = None
) -> DataFrame:
    """Decode, sample and reduce each recording of (video_id, path) in one stage: a row of signals per sample, no pixels.

    The greedy gate runs inside the stage, so frames that are not sampled are never converted; images
    go to the embedder in batches, every ``stride``-th sample to the text reader.
    """
    s, t = sampling or SamplingOptions(), text or TextOptions()
    if s.interval <= 0:
        raise ValueError("interval must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for videos_ in batches:
            for video, path in zip(videos_["video_id"], videos_["path"], strict=True):
                gate, taken, rows, images = 0.0, 0, [], []

                def flush(rows=rows, images=images):
                    vectors = instance(embedder)(images) if embedder and images else [None] * len(images)
                    out = pd.DataFrame([(*r, v, lines, read) for (*r, lines, read), v in zip(rows, vectors, strict=True)], columns=["video_id", "frame_idx", "pts", "time_sec", "embedding", "lines", "reads"])
                    rows.clear()
                    images.clear()
                    return out

                for i, (pts, dts, base, image) in enumerate(instance(reader).frames(path)):
                    at = pts if pts is not None else dts if dts is not None else 0
                    time = at * base
                    if time + 1e-9 < gate:
                        continue
                    gate = time + s.interval
                    read = bool(t.enabled and text_reader and taken % max(1, t.stride) == 0)
                    lines = [(str(a), str(b)) for a, b, *_ in instance(text_reader)(image)] if read else None
                    rows.append((video, i, at, time, lines, read))
                    images.append(image)
                    taken += 1
                    if len(rows) >= s.batch_size:
                        yield flush()
                    if s.max_frames is not None and taken >= s.max_frames:
                        break
                if rows:
                    yield flush()

    return videos.select("video_id", "path").mapInPandas(run, SIGNALS)


def speech_segments(videos: DataFrame, transcriber: str, options: SpeechOptions | None = None) -> DataFrame:
    """(video_id, seg_no, start_sec, end_sec, text) of each recording, stripped, empty ones dropped; none if speech is off or there is no sound."""
    o = options or SpeechOptions()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(v, i, float(a), float(b), x) for v, p in zip(rows["video_id"], rows["path"], strict=True) for i, (a, b, x) in enumerate(instance(transcriber)(p))]
            yield pd.DataFrame(out, columns=["video_id", "seg_no", "start_sec", "end_sec", "text"])

    heard = videos.where("has_audio") if "has_audio" in videos.columns else videos
    if not o.enabled:
        heard = heard.limit(0)
    return heard.select("video_id", "path").mapInPandas(run, "video_id string, seg_no int, start_sec double, end_sec double, text string").withColumn("text", F.trim("text")).where("text <> ''")


def samples_from_signals(signals: DataFrame, text: TextOptions | None = None) -> DataFrame:
    """Signals as samples: positions, unit vectors, and screen text (confident lines, no repeats, carried over unread samples)."""
    from pyspark.sql import Window

    from ..operators.series import carry_forward

    t = text or TextOptions()
    pos = (F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1).cast("int")
    rows = frame_lines(signals.withColumn("_l", confident_lines("lines", t.min_confidence)), keys=["video_id"], lines="_l", out="_text").withColumn("pos", pos)
    rows = rows.withColumn("_read", F.when(F.col("reads") & reads_text("pos", t.stride), F.coalesce("_text", F.lit(""))))
    read = carry_forward(rows, keys=["video_id"], order="pos", value="_read", out="ocr_text")
    return read.select("video_id", "pos", "frame_idx", "time_sec", F.when(F.col("embedding").isNotNull(), unit("embedding")).alias("embedding"), "ocr_text")


def titles(events: DataFrame, prompts: DataFrame, *, backend: str = "auto", model: TitleBackend | None = None, enabled: bool = True) -> tuple[DataFrame, str]:
    """(titles with their number of answer, backend used) of events with their evidence prompts.

    ``auto`` takes the model if one is given, any other name than ``model`` the distinctive terms. A
    model that fails, which is logged, leaves it to them. One call covers all events of a recording, on the driver;
    the prompts of one recording at a time are held there.
    """
    from ..operators.evidence import distinctive_titles

    spark = events.sparkSession
    schema = "video_id string, event_id string, title string, number int"
    none = spark.createDataFrame([], schema)
    if not enabled:
        return none, "none"
    if model is not None and backend in ("auto", "model"):
        try:
            made: list[tuple[str, str, str, int]] = []
            current: list[tuple[str, str]] = []
            video = None
            for r in prompts.select("video_id", "event_id", "prompt").orderBy("video_id", "event_id").toLocalIterator():
                if r["video_id"] != video and current:
                    made += [(video, e, t, n) for n, (e, t) in enumerate(model(current))]
                    current = []
                video = r["video_id"]
                current.append((r["event_id"], r["prompt"]))
            if current:
                made += [(video, e, t, n) for n, (e, t) in enumerate(model(current))]
            return spark.createDataFrame(made, schema), "model"
        except Exception:  # a backend may fail in any way; the terms always work
            log.exception("the title model failed; titles are distinctive terms")
    return distinctive_titles(events).withColumn("number", F.lit(0)), "heuristic"
