"""Scalar column helpers: pure expressions that stay in generated code or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_timestamp(seconds: Column | str) -> Column:
    """``M:SS``, and ``H:MM:SS`` from one hour on; negative times count as 0, fractions are cut."""
    s = F.greatest(F.lit(0.0), _col(seconds)).cast("long")
    minutes, rest = F.floor(s / 60).cast("long"), (s % 60).cast("int")
    hours = F.floor(s / 3600).cast("long")
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, (minutes % 60).cast("int"), rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def frame_time(pts: Column | str, dts: Column | str, numerator: Column | str, denominator: Column | str) -> tuple[Column, Column]:
    """(pts, seconds) of a frame: its pts, else its dts, else 0, times the rational time base."""
    at = F.coalesce(_col(pts), _col(dts), F.lit(0)).cast("long")
    return at, at * _col(numerator) / _col(denominator)


def frame_rate(average: Column | str, base: Column | str) -> Column:
    return F.coalesce(_col(average), _col(base), F.lit(0.0))


def media_duration(container: Column | str, stream: Column | str, time_base: Column | str) -> Column:
    """The container's duration, else the stream's times its time base, else 0."""
    return F.coalesce(_col(container), _col(stream) * _col(time_base), F.lit(0.0))


def event_duration(start: Column | str, end: Column | str) -> Column:
    return F.greatest(F.lit(0.0), _col(end) - _col(start))


def combined_text(ocr: Column | str, transcript: Column | str) -> Column:
    """Both texts with two spaces between, or the one that is not empty."""
    a, b = F.coalesce(_col(ocr), F.lit("")), F.coalesce(_col(transcript), F.lit(""))
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("  "), b)).otherwise(F.concat(a, b))


def target_events(duration: Column | str, explicit: int | None = None, minutes_per_event: float = 4.0, lowest: int = 3, highest: int = 24) -> Column:
    """The number of events to aim at: given, or by duration (rounded half to even) within limits."""
    if explicit is not None:
        return F.lit(max(1, int(explicit)))
    wanted = F.rint(_col(duration) / 60.0 / F.lit(max(0.1, minutes_per_event)))
    return F.greatest(F.lit(lowest), F.least(F.lit(highest), wanted)).cast("int")


def resized_dims(width: Column | str, height: Column | str, long_edge: int) -> tuple[Column, Column]:
    """Width and height after shrinking the longer side to ``long_edge``; 0 or less, or small enough: as they are."""
    w, h = _col(width), _col(height)
    same = F.lit(long_edge <= 0) | (F.greatest(w, h) <= long_edge)
    scaled = lambda a, b: F.greatest(F.lit(1), F.rint(a * (F.lit(float(long_edge)) / b)).cast("int"))
    return (
        F.when(same, w).when(w >= h, F.lit(long_edge)).otherwise(scaled(w, h)),
        F.when(same, h).when(w >= h, scaled(h, w)).otherwise(F.lit(long_edge)),
    )


def region_box(width: Column | str, height: Column | str, box: tuple[float, float, float, float], upscale: int = 1) -> Column:
    """Pixel box (x1, y1, x2, y2) of a fractional region, the whole image if it is degenerate, and the patch size after upscaling."""
    w, h = _col(width), _col(height)
    x1, y1 = F.greatest(F.lit(0), (F.lit(box[0]) * w).cast("int")), F.greatest(F.lit(0), (F.lit(box[1]) * h).cast("int"))
    x2, y2 = F.least(w, (F.lit(box[2]) * w).cast("int")), F.least(h, (F.lit(box[3]) * h).cast("int"))
    empty = (x2 <= x1) | (y2 <= y1)
    factor = F.lit(max(1, upscale))
    pick = lambda part, whole: F.when(empty, whole).otherwise(part).cast("int")
    a, b, c, d = pick(x1, F.lit(0)), pick(y1, F.lit(0)), pick(x2, w), pick(y2, h)
    return F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"), ((c - a) * factor).alias("out_w"), ((d - b) * factor).alias("out_h"))


def reads_text(pos: Column | str, stride: int) -> Column:
    """Whether a sample is read: every ``stride``-th one."""
    return _col(pos) % max(1, stride) == 0


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores; lower-cased after splitting. Null: none."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"([A-Za-z0-9_]+)"), 1), lambda t: F.lower(t))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str, floor: float = 1e-8) -> Column:
    """A vector divided by its length, or by ``floor`` if that is larger."""
    size = F.greatest(norm(a), F.lit(floor))
    return F.transform(_col(a), lambda x: x.cast("double") / size)


def rescaled_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of unit vectors moved from [-1, 1] to [0, 1] and clipped there."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) + 1.0) / 2.0))


def representatives(samples: Column | str, n: int) -> Column:
    """Up to ``n`` interior members spread over an array; all if it has no more."""
    s = _col(samples)
    if n <= 0:
        return F.array().cast("array<int>")
    size = F.size(s)
    step = size / F.lit(n + 1.0)
    picked = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.element_at(s, F.least(size, (step * k).cast("int") + 1)))
    return F.when(s.isNull() | (size <= 0), F.array().cast("array<int>")).when(size <= n, s).otherwise(picked)


def confident_lines(lines: Column | str, floor: float = 0.5) -> Column:
    """Trimmed, non-empty texts of (text, score) pairs with a score of ``floor`` or more; a score that is no number counts as 0."""
    kept = F.filter(_col(lines), lambda x: (F.coalesce(x["score"].try_cast("double"), F.lit(0.0)) >= floor) & (F.trim(x["text"]) != ""))
    return F.transform(kept, lambda x: F.trim(x["text"]))


def cache_key(path: Column | str, modified: Column | str, length: Column | str) -> Column:
    """Key of a cached frame index: path, whole seconds of modification and size."""
    return F.sha2(F.concat_ws("|", _col(path), F.unix_seconds(_col(modified)).cast("string"), _col(length).cast("string")), 256)
