"""The greedy sampler and carry-forward over a stream of frames, with state per recording.

State is the gate's next time and the last text read. Rows are sorted by frame number within a
micro-batch; across batches they must come in decode order, and a row before the gate is dropped,
as the batch form drops it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "gate double, carried string"
OUT = "video_id string, frame_idx long, time_sec double, carried string"


def streaming_sample(frames: DataFrame, *, interval: float, text: str | None = None) -> DataFrame:
    """Sampled rows of a streaming (video_id, frame_idx, time_sec[, text]): the batch sampler's rows, text carried over nulls."""
    if interval <= 0:
        raise ValueError("interval must be positive")

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate, carried = state.get if state.exists else (0.0, "")
        rows = pd.concat(list(batches)).sort_values("frame_idx")
        out = []
        for i, t, x in zip(rows["frame_idx"], rows["time_sec"], rows[text] if text else [None] * len(rows), strict=True):
            if t + 1e-9 < gate:
                continue
            gate = t + interval
            carried = x if x is not None and x == x else carried
            out.append((key[0], int(i), float(t), carried))
        state.update((gate, carried))
        yield pd.DataFrame(out, columns=["video_id", "frame_idx", "time_sec", "carried"])

    columns = ["video_id", "frame_idx", "time_sec", *([text] if text else [])]
    return frames.select(*columns).groupBy("video_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
