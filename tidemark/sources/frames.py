"""A data source of frame indexes: ``spark.read.format("video_frames")``."""

from __future__ import annotations

import glob
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, LessThan, LessThanOrEqual

from ..functions.columns import cache_key
from ..model import FRAMES
from .adapters import instance


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.reader = options.get("reader", "tidemark.sources.adapters:JsonFrames")
        self.paths = sorted(glob.glob(options["path"]))
        self.last = int(options["lastframe"]) if "lastframe" in options else None

    def pushFilters(self, filters):
        """An upper bound on the frame number ends decoding there."""
        for f in filters:
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) and f.attribute == ("frame_idx",):
                bound = f.value - 1 if isinstance(f, LessThan) else f.value
                self.last = bound if self.last is None else min(self.last, bound)
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        name = path.rsplit("/", 1)[-1].split(".", 1)[0]
        for i, (pts, dts, base, _) in enumerate(instance(self.reader).frames(path)):
            if self.last is not None and i > self.last:
                return
            at = pts if pts is not None else dts if dts is not None else 0
            yield name, i, at, at * base


class VideoFrames(DataSource):
    """Frames of all recordings that ``path`` matches, a task each; option ``reader`` names the decoder (``module:class``)."""

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(VideoFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def frame_index(spark: SparkSession, path: str, *, reader: str = "tidemark.sources.adapters:JsonFrames", cache_dir: str | None = None) -> DataFrame:
    """The frame index of all recordings that ``path`` matches, kept in ``cache_dir`` if one is given.

    A kept index counts for a file's path, modification second and size; a changed file is decoded again.
    """
    register(spark)
    load = lambda p: spark.read.format("video_frames").option("reader", reader).option("path", p).load()
    if cache_dir is None:
        return load(path)
    files = spark.read.format("binaryFile").load(path).select("path", cache_key("path", "modificationTime", "length").alias("key")).collect()  # names only
    parts = []
    for f in files:
        place = f"{cache_dir.rstrip('/')}/{f['key']}"
        try:
            known = spark.read.schema(FRAMES).parquet(place)
        except Exception:  # not there yet
            load(f["path"].removeprefix("file:")).write.mode("overwrite").parquet(place)
            known = spark.read.schema(FRAMES).parquet(place)
        parts.append(known)
    out = parts[0] if parts else spark.createDataFrame([], FRAMES)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
