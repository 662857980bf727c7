"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of bits. A binary classifier per bit compares the n-gram counts of
the languages on its two sides (smoothed log odds, learned from all training rows in one pass). A
document's n-grams vote for each bit; the languages' losses, weighted by how well each bit
separates its languages, choose the nearest codeword, and a small gap to the next one is flagged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .textkernel import fold_case, slices, string_buffer

ORDERS = (1, 2, 3, 4)
FEATURES = 1 << 15
SLICE = 1 << 19
SHARPNESS = 40.0
_MULTIPLIER = np.uint32(0x9E3779B1)
_WORD = np.arange(256) >= 128
_WORD[[*range(97, 123)]] = True
_CANON = np.where(_WORD, np.arange(256), 32).astype(np.uint8)


def _features(column: pa.Array):
    """Per n-gram order, the hashed feature of every byte position (FEATURES where a gram would leave its text), and the text offsets."""
    raw, offsets = string_buffer(column)
    canon = _CANON[fold_case(raw)].astype(np.uint32) if len(raw) else np.zeros(0, np.uint32)
    grams = []
    for order in ORDERS:
        h = canon.copy()
        for k in range(1, order):
            h[: len(h) - k] = (h[: len(h) - k] << np.uint32(8)) | canon[k:]
        index = (((h + np.uint32(order * 0x51ED27)) * _MULTIPLIER) >> np.uint32(32 - 15)).astype(np.int64)
        for k in range(order - 1):
            ends = offsets[1:] - 1 - k
            index[ends[ends >= offsets[:-1]]] = FEATURES
        grams.append(index)
    return raw, offsets, grams


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any alphabet."""
    ascii_letter = ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))
    wide = raw >= 128
    seen = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    widths = np.concatenate(([0], np.cumsum(wide)))
    for i in np.flatnonzero(~out & (widths[offsets[1:]] > widths[offsets[:-1]])):
        out[i] = any(map(str.isalpha, raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def gram_counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """N-gram counts of each language over all rows (lang, text); one fixed-size table a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                langs = part.column("lang").dictionary_encode()
                names = langs.dictionary.to_pylist()
                _, offsets, grams = _features(part.column("text"))
                code = np.repeat(langs.indices.to_numpy(False).astype(np.int64), np.diff(offsets)) * (FEATURES + 1)
                total = sum(np.bincount(code + g, minlength=len(names) * (FEATURES + 1)) for g in grams).reshape(len(names), -1)
                for name, counts in zip(names, total, strict=True):
                    sums[name] = sums[name] + counts if name in sums else counts.astype(np.int64)
        for name, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([zlib.crc32(counts.tobytes()) % 16], pa.int32()), pa.array([counts[:FEATURES].tobytes()], pa.binary())], ["lang", "salt", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(2)):
                counts = np.frombuffer(blob.as_buffer(), dtype=np.int64)
                sums[name] = sums[name] + counts if name in sums else counts
        for name, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["lang", "salt", "data"])

    schema = "lang string, salt int, data binary"
    rows = rows.select("lang", "text").mapInArrow(count, schema).repartition("lang", "salt").mapInArrow(merge, schema).repartition("lang").mapInArrow(merge, schema)
    return {r["lang"]: np.frombuffer(r["data"], dtype=np.int64) for r in rows.collect()}


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A -1/+1 matrix of languages by bits: all distinct splits for up to five languages, else the best of random dense codes."""
    if languages < 2:
        return np.ones((languages, 0), dtype=np.int8)
    if languages <= 5:
        splits = [s for s in product((1, -1), repeat=languages) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.int8).T
    bits, rng, best, apart = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        code = code[:, (np.abs(code.sum(axis=0)) < languages)]
        distance = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
        nearest = int(distance[~np.eye(languages, dtype=bool)].min())
        if nearest > apart:
            best, apart = code, nearest
    return best


@dataclass
class EcocModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    importance: np.ndarray
    ambiguous: float = 0.6

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """The weighted logistic loss of every codeword, for documents by bits."""
        agree = (margins / self.scale)[:, None, :] * self.code[None, :, :]
        return np.logaddexp(0, -2 * agree) @ self.importance


def fit(counts: dict[str, np.ndarray], smoothing: float = 0.5) -> EcocModel:
    languages = sorted(counts)
    code = codewords(len(languages))
    table = np.array([counts[x] for x in languages], dtype=np.float64).reshape(len(languages), FEATURES) + smoothing
    share = table / table.sum(axis=1, keepdims=True)
    bits = code.shape[1]
    weights = np.zeros((FEATURES + 1, bits), dtype=np.float32)
    for b in range(bits):
        weights[:FEATURES, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    expected = share @ weights[:FEATURES].astype(np.float64) * code
    scale = np.maximum(np.abs(expected).mean(axis=0), 1e-9) if bits else np.ones(0)
    importance = np.maximum(expected.min(axis=0), 0.05 * scale) / scale if bits else np.ones(0)
    return EcocModel(languages, code, weights, scale, importance / max(importance.sum(), 1e-9))


def _decide(m: EcocModel, column: pa.Array):
    """(language index, score, ambiguous) of every text; the index after the last language means undetermined."""
    raw, offsets, grams = _features(column)
    n, bits = len(column), m.code.shape[1]
    lengths = np.diff(offsets)
    full = lengths > 0
    margins = np.zeros((n, bits))
    if full.any():
        begin = offsets[:-1][full]
        for g in grams:
            for b in range(bits):
                margins[full, b] += np.add.reduceat(m.weights[:, b][g], begin, dtype=np.float64)
        total = sum(np.maximum(lengths - (k - 1), 0) for k in ORDERS)
        margins[full] /= np.maximum(total[full], 1)[:, None]
    letters = has_letter(raw, offsets) if len(m.languages) else np.zeros(n, bool)
    if len(m.languages) > 1:
        losses = m.losses(margins)
        odds = np.exp(-SHARPNESS * (losses - losses.min(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        best, score = odds.argmax(axis=1), odds.max(axis=1)
    else:
        best, score = np.zeros(n, dtype=int), np.ones(n)
    score = np.where(letters, score, 0.0)
    return np.where(letters, best, len(m.languages)), score, letters & (score < m.ambiguous)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.value.languages, "und"], dtype=object)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                best, score, unsure = _decide(model.value, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"]
                )

    return run


def _learn(docs: DataFrame, training: DataFrame | None, ambiguous: float):
    bound_batches(docs.sparkSession)
    model = fit(gram_counts(training.where("lang IS NOT NULL AND text IS NOT NULL")) if training is not None else {})
    model.ambiguous = ambiguous
    return docs.sparkSession.sparkContext.broadcast(model)  # 32,769 x bits weights: as large for any corpus


def keep_identified(docs: DataFrame, training: DataFrame | None = None, *, ambiguous: float = 0.6) -> DataFrame:
    """The rows of ``docs`` whose language is determined and not ambiguous, all columns as they are; one scan, no shuffle."""
    shared = _learn(docs, training, ambiguous)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                best, _, unsure = _decide(shared.value, part.column("text"))
                yield part.filter(pa.array((best < len(shared.value.languages)) & ~unsure))

    return docs.mapInArrow(run, docs.schema)


def identify_languages(docs: DataFrame, training: DataFrame | None = None, *, ambiguous: float = 0.6) -> DataFrame:
    """Predict the language of every text.

    ``docs`` needs doc_id and text. ``training`` has lang and text; its rows with a null lang or
    text are ignored and all others are counted. Returns doc_id, lang_pred, score, ambiguous, one
    row per input row. A text that is null or without a letter of any alphabet is ``und`` with
    score 0, as is every text if no language was learned; with one language learned, all others
    get it with score 1. ``ambiguous`` flags a best score below that limit. Only the text enters a
    prediction. Repeated rows and ids are predicted each; an empty table gives no rows.
    """
    shared = _learn(docs, training, ambiguous)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean"
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), schema)


def held_out(column: str = "doc_id"):
    """Whether a document is in the test fold: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))
