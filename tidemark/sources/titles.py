"""What a model that titles events is given: prompts and encoded frames, in order."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import representatives
from ..model import LabelOptions
from ..operators.evidence import evidence_prompt
from .adapters import instance

INTRO = "Segments of one recording, in order. Give each a title by its event_id."
IMAGES = "video_id string, event_id string, n int, image string"


class StubEncoder:
    """Bytes of an image after shrinking its longer side; the stub keeps the text form of the image."""

    def __call__(self, image, long_edge: int) -> bytes:
        return repr(image).encode()


def event_images(events: DataFrame, videos: DataFrame, *, reader: str, encoder: str, options: LabelOptions | None = None) -> DataFrame:
    """(video_id, event_id, n, image): base64 of each event's representative frames, from one decode pass per recording.

    Decoding stops after the last frame wanted; frames that can't be decoded are missing.
    """
    o = options or LabelOptions()
    wanted = events.select("video_id", "event_id", F.posexplode(representatives("sample_indices", o.frames)).alias("n", "frame_idx"))
    asked = wanted.groupBy("video_id").agg(F.collect_list(F.struct("event_id", "n", "frame_idx")).alias("wanted")).join(videos.select("video_id", "path"), "video_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for video, path, want in zip(rows["video_id"], rows["path"], rows["wanted"], strict=True):
                places: dict[int, list[tuple[str, int]]] = {}
                for w in want:
                    places.setdefault(int(w["frame_idx"]), []).append((w["event_id"], int(w["n"])))
                last, out = max(places), []
                for i, (_, _, _, image) in enumerate(instance(reader).frames(path)):
                    if i in places and image is not None:
                        data = base64.b64encode(instance(encoder)(image, o.long_edge)).decode()
                        out += [(video, e, n, data) for e, n in places[i]]
                    if i >= last:
                        break
                yield pd.DataFrame(out, columns=["video_id", "event_id", "n", "image"])

    return asked.mapInPandas(run, IMAGES)


def request_content(events: DataFrame, images: DataFrame | None = None, options: LabelOptions | None = None) -> DataFrame:
    """(video_id, content): an introduction, then each event's text and images, as an array of (kind, data)."""

    def block(kind: str, data: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), data.alias("data"))

    rows = events.select("video_id", "event_id", F.lit(-1).alias("n"), block("text", evidence_prompt(options)).alias("b"))
    if images is not None:
        rows = rows.unionByName(images.select("video_id", "event_id", "n", block("image", F.col("image")).alias("b")))
    ordered = rows.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "n", "b"))).alias("l"))
    return ordered.select("video_id", F.concat(F.array(block("text", F.lit(INTRO))), F.transform("l", lambda x: x["b"])).alias("content"))


def write_patches(signals: DataFrame, folder: str) -> None:
    """Debugging: image patches (name, data) as files; not part of any plan."""

    def run(rows) -> None:
        import pyarrow.fs

        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        for r in rows:
            with fs.open_output_stream(f"{at}/{r['name']}") as f:
                f.write(bytes(r["data"]))

    signals.select("name", "data").foreachPartition(run)
