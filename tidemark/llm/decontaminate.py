"""Benchmark decontamination by latent semantic retrieval.

1. Word weights: a count sketch of fixed size over all 24-word passages of the corpus gives every word's idf.
2. Passages: every whole text is cut into windows of 24 words, 12 apart. A window without any word of
   the benchmark has a TF-IDF cosine of 0 with all of its texts and is passed over; all others stay,
   as positions in the benchmark's vocabulary, with the squared length of their full TF-IDF vectors.
3. A distributed randomised SVD (one-pass Nyström form: tasks multiply their rows with a thin random
   matrix, partial sums of a fixed size are added up) of the unit-length TF-IDF rows of those passages
   and of the benchmark's own, which weigh as much in all, gives the latent space.
4. Candidates: a window and a benchmark segment whose inner product in the latent space, over the full
   lengths of both, reaches ``latent``. Lengths are full ones, so words that the benchmark lacks lower the
   score as they lower the cosine, and no window is set aside before it is scored.
5. Checks: the longest common subsequence of words must cover most of the segment; where it covers
   only a part (a paraphrase), the text's answer, its last sentence, must be there as well.

Items of fewer than ``min_words`` words have too little to be paraphrased: they match by their exact
word sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_SCHEMA, reduce_blocks, row
from .common import bound_batches, materialise
from .textkernel import distinct, fold_case, shingle_hashes, slices, string_buffer, word_hashes, word_spans

IDF_BITS = 20
BLOCK = 1 << 16
HALF = 12
WINDOW = 2 * HALF
SEGMENT = 64
#: Windows of a stored stretch, words of passages worked on at once, rows of a sum at once, pairs checked at once, scores at once.
RUN = 64
STEP_WORDS = 1 << 17
SUM_ROWS = 256
PAIRS = 1 << 15
SCORES = 1 << 20
#: Longest group that is summed row by row; longer ones are summed in pieces.
GROUP = 32
FEATURES_A_BLOCK = 1024
SLICE = 1 << 20
#: A benchmark is searched in parts of at most about so many items and bytes of text, each with one scan of the corpus.
PART_ITEMS = 100_000
PART_BYTES = 32 << 20
LEAK = "doc_id long, item_id long, cosine double, covered double, answer double"
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


@dataclass(frozen=True)
class Limits:
    """``latent`` admits candidates; ``copied`` and ``paraphrased`` are shares of a segment's words, ``answered`` of its answer's.

    A latent space serves up to ``segments`` segments of the benchmark and has a quarter more dimensions than those.
    """

    latent: float = 0.25
    copied: float = 0.75
    paraphrased: float = 0.55
    answered: float = 0.6
    oversample: int = 16
    min_words: int = 8
    segments: int = 256


def _words(column: pa.Array):
    """Hashes of the words, case folded and without punctuation around them, and each text's first word."""
    raw, offsets = string_buffer(column)
    starts, ends, first = word_spans(raw, offsets)
    for _ in range(2):
        ends = ends - (_PUNCTUATION[raw[ends - 1]] & (ends - starts > 1))
        starts = starts + (_PUNCTUATION[raw[starts]] & (ends - starts > 1))
    return word_hashes(fold_case(raw) if len(raw) else raw, starts, ends, lower=False), first


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - IDF_BITS)).astype(np.int64)


def word_weights(docs: DataFrame) -> np.ndarray:
    """idf of 2**20 hash buckets: ln((1 + passages) / (1 + passages with such a word)), over the 24-word passages of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, passages = np.zeros(1 << IDF_BITS, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                words, first = _words(part.column("text"))
                number = -(-np.diff(first) // WINDOW)
                at = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
                place = np.repeat(np.cumsum(number) - number, np.diff(first)) + at // WINDOW
                np.add.at(counts, distinct(place << IDF_BITS | _bucket(words)) & ((1 << IDF_BITS) - 1), 1)
                passages += int(number.sum())
        if passages:
            yield row(-1, np.array([passages]))
            for block, part in enumerate(counts.reshape(-1, BLOCK)):
                yield row(block, part)

    blocks = reduce_blocks(docs.select("text").mapInArrow(run, BLOCK_SCHEMA), np.int64, np.add)
    counts = np.concatenate([blocks.get(b, np.zeros(BLOCK, np.int64)) for b in range((1 << IDF_BITS) // BLOCK)])
    passages = int(blocks[-1][0]) if blocks else 0
    return np.log((passages + 1.0) / (counts + 1.0)).astype(np.float32)


@dataclass
class _Item:
    """Word hashes of a benchmark text and of its answer, its last sentence."""

    name: int
    words: np.ndarray
    answer: np.ndarray


def _item(name: int, text: str) -> _Item:
    words = _words(pa.array([text]))[0]
    cut = max(text.rstrip().rstrip(".!?").rfind(x) for x in (". ", "! ", "? ", ".\n", "\n"))
    last = _words(pa.array([text[cut + 1 :]]))[0] if cut >= 0 else words
    return _Item(name, words, last)


@dataclass
class _Vocabulary:
    """The words of one part of the benchmark, the idf of all buckets, and how far around a window the checks look."""

    words: np.ndarray
    idf: np.ndarray
    pad: int

    def features(self, words: np.ndarray) -> np.ndarray:
        """Positions in the vocabulary, -1 for words that the benchmark doesn't have."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1).astype(np.int32)


@dataclass
class _Chunk:
    """Up to ``segments`` segments of at most 64 words, as features of the part and of the chunk's own smaller vocabulary."""

    item: np.ndarray
    own: np.ndarray
    weight: np.ndarray
    segments: list[np.ndarray]
    answers: list[np.ndarray]

    def local(self, features: np.ndarray) -> np.ndarray:
        """The chunk's numbers of features; its vocabulary's size for words it doesn't have."""
        at = np.minimum(np.searchsorted(self.own, features), len(self.own) - 1)
        return np.where(self.own[at] == features, at, len(self.own))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The segments' unit TF-IDF rows as (dense matrix, by segment and feature); lengths are those of their word positions."""
        out = np.zeros((len(self.segments), len(self.own)), dtype=np.float32)
        for i, f in enumerate(self.segments):
            np.add.at(out[i], f, self.weight[f])
        size = np.sqrt([float((self.weight[f].astype(np.float64) ** 2).sum()) for f in self.segments])
        return out / np.maximum(size, 1e-12)[:, None].astype(np.float32)


def _chunks(items: list[_Item], vocabulary: _Vocabulary, limit: int) -> list[_Chunk]:
    found = []
    for x in items:
        count = -(-len(x.words) // SEGMENT)
        found += [(x.name, vocabulary.features(w), vocabulary.features(x.answer)) for w in np.array_split(x.words, count)]
    out = []
    for at in range(0, len(found), limit):
        names, segments, answers = zip(*found[at : at + limit], strict=True)
        own = np.unique(np.concatenate(segments))
        weight = vocabulary.idf[_bucket(vocabulary.words[own])]
        made = _Chunk(np.array(names), own, weight, [], list(answers))
        made.segments = [made.local(s) for s in segments]
        out.append(made)
    return out


def _passages(shared):
    """Stretches of documents whose windows have a word of the benchmark, with their surroundings.

    ``words`` are features (-1: another word), the stretch begins at word ``lo`` of them, and ``mass`` has the
    squared weights of the words of each of its 12-word halves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: _Vocabulary = shared.value
        most = max(RUN, v.pad // 6)
        # One byte a bucket says whether any benchmark word is in it: most words need no search.
        near = np.zeros(1 << IDF_BITS, dtype=bool)
        near[_bucket(v.words)] = True
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                words, first = _words(part.column("text"))
                if not len(words):
                    continue
                bucket = _bucket(words)
                feature = np.full(len(words), -1, dtype="<i4")
                hit = np.flatnonzero(near[bucket])
                feature[hit] = v.features(words[hit])
                shared_ = np.concatenate(([0], np.cumsum(feature >= 0)))
                square = v.idf[bucket] ** 2
                counts = np.diff(first)
                number = np.where(counts > 0, np.maximum(1, -(-counts // HALF) - 1), 0)
                owner = np.repeat(np.arange(len(counts)), number)
                k = np.arange(len(owner)) - (np.cumsum(number) - number)[owner]
                start = first[:-1][owner] + HALF * k
                end = np.minimum(start + WINDOW, first[1:][owner])
                kept = np.flatnonzero(shared_[end] > shared_[start])
                if not len(kept):
                    continue
                fresh = np.ones(len(kept), dtype=bool)
                fresh[1:] = (np.diff(kept) > 1) | (owner[kept[1:]] != owner[kept[:-1]])
                begin = np.flatnonzero(fresh)
                inside = np.arange(len(kept)) - np.repeat(begin, np.diff(np.append(begin, len(kept))))
                heads = np.flatnonzero(fresh | (inside % most == 0))
                tails = np.append(heads[1:], len(kept)) - 1
                ids = part.column("doc_id").to_numpy(False)
                out = []
                for x, y in zip(kept[heads], kept[tails], strict=True):
                    d, s, e = owner[x], start[x], end[y]
                    lo, hi = max(first[d], s - v.pad), min(first[d + 1], e + v.pad)
                    mass = np.add.reduceat(square[s:e], np.arange(0, e - s, HALF)).astype("<f4")
                    out.append((int(ids[d]), int(s - lo), int(e - lo), feature[lo:hi].tobytes(), mass.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "lo", "hi", "words", "mass"]
                )

    return run


PASSAGE = "doc_id long, lo int, hi int, words binary, mass binary"


def _gather_sums(table: np.ndarray, index: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row i: the sum of the rows of ``table`` that the i-th group of ``index`` names; groups lie one behind the other.

    Groups are summed side by side, longest first, so that each step adds a block of rows; a long group is summed in pieces.
    """
    if len(lengths) and lengths.max() > GROUP:
        pieces = np.maximum(1, -(-lengths // GROUP))
        inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sums = _gather_sums(table, index, np.clip(np.repeat(lengths, pieces) - GROUP * inside, 0, GROUP))
        return _gather_sums(sums, np.arange(len(sums)), pieces)
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros((len(lengths), table.shape[1]), dtype=table.dtype)
    spare = np.empty((SUM_ROWS, table.shape[1]), dtype=table.dtype)
    for at in range(0, len(order), SUM_ROWS):
        rows = order[at : at + SUM_ROWS]
        size, base = lengths[rows], begin[rows]
        if not size[0]:
            break
        total = np.zeros((len(rows), table.shape[1]), dtype=table.dtype)
        live = np.searchsorted(-size, -np.arange(size[0]))
        for k, n in enumerate(live):
            total[:n] += np.take(table, index[base[:n] + k], axis=0, out=spare[:n], mode="clip")
        out[rows] = total
    return out


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages in slices of about STEP_WORDS words."""
    for batch in batches:
        yield from slices(batch, "words", 4 * STEP_WORDS)


def _halves(batch: pa.RecordBatch, chunk: _Chunk):
    """The words of passages as the chunk's numbers, each passage's first word, and of each 12-word half: its hits, how many, its mass, its passage."""
    lo, hi = (batch.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
    words = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("words")), dtype="<i4")
    size = pa.compute.binary_length(batch.column("words")).to_numpy(False).astype(np.int64) // 4
    first = np.cumsum(size) - size
    mass = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("mass")), dtype="<f4")
    local = np.full(len(words), len(chunk.own))
    known = np.flatnonzero(words >= 0)
    local[known] = chunk.local(words[known])
    number = -(-(hi - lo) // HALF)
    inside = np.repeat(first + lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
    half = np.repeat(np.cumsum(number) - number, hi - lo) + (np.arange(len(inside)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)) // HALF
    values = local[inside]
    hits = values < len(chunk.own)
    return local, first, size, lo, values[hits], np.bincount(half[hits], minlength=len(mass)), mass, np.repeat(np.arange(len(lo)), number)


def _sketch(passages: DataFrame, shared, omega: np.ndarray) -> tuple[np.ndarray, float]:
    """(AᵀA) omega and the sum of squares of A, the passages' unit TF-IDF rows over disjoint 24-word windows; a table of omega's size from each task."""
    thin = passages.sparkSession.sparkContext.broadcast(omega.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: _Chunk = shared.value
        weighted = chunk.weight[:, None] * thin.value
        total, energy = np.zeros(thin.value.shape, dtype=np.float32), 0.0
        for batch in _steps(batches):
            *_, hits, counts, mass, owner = _halves(batch, chunk)
            head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            inside = np.arange(len(owner)) - np.repeat(head, np.diff(np.append(head, len(owner))))
            pair = np.cumsum(inside % 2 == 0) - 1
            counts = np.bincount(pair, weights=counts).astype(np.int64)
            heavy = np.maximum(np.bincount(pair, weights=mass), 1e-12)
            y = _gather_sums(weighted, hits, counts) / heavy[:, None].astype(np.float32)
            place = np.repeat(np.arange(len(counts)), counts)
            energy += float((chunk.weight[hits].astype(np.float64) ** 2 / heavy[place]).sum())
            total += chunk.weight[:, None] * _gather_sums(y, place[np.argsort(hits, kind="stable")], np.bincount(hits, minlength=len(total)))
        if energy:
            yield row(-1, np.array([energy], dtype=np.float32))
            for block, at in enumerate(range(0, len(total), FEATURES_A_BLOCK)):
                yield row(block, total[at : at + FEATURES_A_BLOCK])

    parts = reduce_blocks(passages.mapInArrow(run, BLOCK_SCHEMA), np.float32, np.add)
    thin.destroy()
    if not parts:
        return np.zeros(omega.shape), 0.0
    return np.concatenate([parts[b] for b in range(len(parts) - 1)]).reshape(omega.shape).astype(np.float64), float(parts[-1][0])


def latent_space(passages: DataFrame, shared, oversample: int, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF rows of passages and, weighing as much in all, of the benchmark's segments."""
    chunk: _Chunk = shared.value
    own = chunk.rows().astype(np.float64)
    rank = min(len(chunk.own), len(own) * 5 // 4 + 8)
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(chunk.own), min(len(chunk.own), rank + oversample))))[0]
    y, energy = _sketch(passages, shared, omega)
    y += (energy or 1.0) / max(float((own**2).sum()), 1e-12) * (own.T @ (own @ omega))
    y += 1e-9 * np.linalg.norm(y) * omega
    values, vectors = np.linalg.eigh((omega.T @ y + y.T @ omega) / 2)
    live = values > 1e-10 * max(values.max(), 1e-30)
    root = y @ (vectors[:, live] / np.sqrt(values[live]))
    return np.linalg.svd(root, full_matrices=False)[0][:, :rank].astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = places.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def common_subsequences(masks: np.ndarray, which: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs at once.

    Pair i has the ``which[i]``-th segment, whose bit j in ``masks[segment, word]`` says that its j-th word is that word,
    and ``words[begin[i]:end[i]]``. Bits past a segment's end stay set and count as not common.
    """
    v = np.full(len(which), ~np.uint64(0))
    order = np.argsort(begin - end, kind="stable")
    length = (end - begin)[order]
    which, begin = which[order], begin[order]
    for k, n in enumerate(np.searchsorted(-length, -np.arange(length.max(initial=0)))):
        live = v[:n]
        u = live & masks[which[:n], words[begin[:n] + k]]
        v[:n] = (live + u) | (live - u)
    out = np.empty(len(v), dtype=np.int64)
    out[order] = 64 - np.bitwise_count(v).astype(np.int64)
    return out


def _search(shared, space, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: _Chunk = shared.value
        project = chunk.weight[:, None] * space.value
        queries = np.ascontiguousarray((chunk.rows() @ space.value).T)
        sizes = np.array([len(s) for s in chunk.segments])
        extra = np.array([len(a) for a in chunk.answers])
        masks = np.zeros((len(sizes), len(chunk.own) + 1), dtype=np.uint64)
        for i, s in enumerate(chunk.segments):
            np.bitwise_or.at(masks[i], s, np.uint64(1) << np.arange(len(s), dtype=np.uint64))
        for batch in _steps(batches):
            local, first, size, lo, hits, counts, mass, owner = _halves(batch, chunk)
            latent = _gather_sums(project, hits, counts)
            # Windows are two neighbouring halves of a stretch; a stretch of one half is one window.
            follows = owner[1:] == owner[:-1]
            single = np.flatnonzero(np.bincount(owner)[owner] == 1)
            left = np.append(np.flatnonzero(follows), single)
            both = np.append(np.ones(int(follows.sum()), dtype=bool), np.zeros(len(single), dtype=bool))
            right = np.where(both, left + 1, left)
            head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            inside = np.arange(len(owner)) - np.repeat(head, np.diff(np.append(head, len(owner))))
            ids = batch.column("doc_id").to_numpy(False)
            step = max(1, SCORES // len(sizes))
            for at in range(0, len(left), step):
                i, j, two = left[at : at + step], right[at : at + step], both[at : at + step]
                vectors = latent[i]
                vectors[two] += latent[j[two]]
                length_ = np.sqrt(np.maximum(mass[i] + np.where(two, mass[j], 0), 1e-12))
                # A query's latent vector is no longer than 1, so a shorter window can't reach any.
                able = np.flatnonzero(1.001 * np.einsum("ij,ij->i", vectors, vectors) >= (limits.latent * length_) ** 2)
                i, vectors, long = i[able], vectors[able], length_[able]
                score = vectors @ queries
                found = np.flatnonzero(score >= limits.latent * long[:, None])
                for cut in range(0, len(found), PAIRS):
                    w, q = np.divmod(found[cut : cut + PAIRS], len(sizes))
                    p = owner[i[w]]
                    place = lo[p] + HALF * inside[i[w]]
                    begin = first[p] + np.maximum(0, place - sizes[q])
                    end = first[p] + np.minimum(size[p], place + WINDOW + sizes[q])
                    covered = common_subsequences(masks, q, local, begin, end) / sizes[q]
                    out = []
                    for k in np.flatnonzero(covered >= limits.paraphrased):
                        s, z = int(q[k]), int(p[k])
                        reach = int(sizes[s] + extra[s])
                        text = np.frombuffer(batch.column("words")[z].as_buffer(), dtype="<i4")[max(0, int(place[k]) - reach) : int(place[k]) + WINDOW + reach]
                        answer = common_subsequence(chunk.answers[s], text) / max(1, int(extra[s]))
                        if covered[k] >= limits.copied or answer >= limits.answered:
                            out.append((int(ids[z]), int(chunk.item[s]), float(score[w[k], s] / long[w[k]]), float(covered[k]), answer))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["doc_id", "item_id", "cosine", "covered", "answer"])

    return run


def _exact_sequences(items: list[_Item]):
    """Documents that hold the whole word sequence of a short item; one or two words must be the whole text."""
    by_length: dict[int, dict[int, list[int]]] = {}
    for x in items:
        h = int(shingle_hashes(x.words, np.array([0, len(x.words)]), len(x.words))[0][0])
        by_length.setdefault(len(x.words), {}).setdefault(h, []).append(x.name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {n: np.array(sorted(t), dtype=np.uint64) for n, t in by_length.items()}
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                words, first = _words(part.column("text"))
                counts, ids, out = np.diff(first), part.column("doc_id").to_numpy(False), set()
                for n, table in tables.items():
                    h, owner = shingle_hashes(words, first, n)
                    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                    hit = (table[at] == h) & ((counts[owner] == n) if n < 3 else (counts[owner] >= n))
                    out |= {(int(ids[owner[k]]), name) for k in np.flatnonzero(hit) for name in by_length[n][int(h[k])]}
                if out:
                    a, b = zip(*sorted(out), strict=True)
                    one = pa.array(np.ones(len(a)))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), one, one, one], ["doc_id", "item_id", "cosine", "covered", "answer"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, limits: Limits | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, covered, answer) for every document that holds a benchmark text or a paraphrase of one.

    ``docs`` needs doc_id (long) and text, ``benchmark`` item_id and text; other columns are ignored, whatever their
    names. ``cosine`` is the highest latent one of a window and a segment (at most 64 words, of about equal
    length) of the item that passed the checks, ``covered`` the highest share of a segment's words found in order, ``answer`` that of
    the item's last sentence: ties between windows or segments give the same highest values.

    The benchmark is collected in parts of bounded items and bytes, each with one scan of the corpus, and each part is
    searched with latent spaces of ``segments`` segments, so what is broadcast has a fixed bound. Items of fewer than
    ``min_words`` words match where their whole word sequence stands in a text; of one or two words, where it is the whole text.

    Null or empty texts, null ids and empty tables give no rows; repeated rows or ids give one row
    per (doc_id, item_id) pair. Texts are searched as a whole, however long.
    """
    limits = limits or Limits()
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = max(-(-size["n"] // PART_ITEMS), -(-size["b"] // PART_BYTES))
    results, idf = [], word_weights(docs) if parts else None
    for n in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == n) if parts > 1 else items
        texts = [_item(r["item_id"], r["text"]) for r in mine.collect()]
        short = [x for x in texts if 0 < len(x.words) < limits.min_words]
        texts = sorted((x for x in texts if len(x.words) >= limits.min_words), key=lambda x: (x.name, x.words.tobytes()))
        if short:
            results.append(materialise(docs.mapInArrow(_exact_sequences(short), LEAK), "short-leaks"))
        if not texts:
            continue
        made = _Vocabulary(np.unique(np.concatenate([x.words for x in texts])), idf, SEGMENT + max(len(x.answer) for x in texts))
        vocabulary = spark.sparkContext.broadcast(made)
        passages = materialise(docs.mapInArrow(_passages(vocabulary), PASSAGE), "passages")
        for chunk in _chunks(texts, made, limits.segments):
            shared = spark.sparkContext.broadcast(chunk)
            space = spark.sparkContext.broadcast(latent_space(passages, shared, limits.oversample))
            results.append(materialise(passages.mapInArrow(_search(shared, space, limits), LEAK), "leaks"))
            shared.destroy()
            space.destroy()
        vocabulary.destroy()
    if not results:
        return spark.createDataFrame([], LEAK)
    result = results[0]
    for x in results[1:]:
        result = result.unionByName(x)
    return result.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("covered").alias("covered"), F.max("answer").alias("answer"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text, all columns as they are, whatever their names.

    Rows with a null doc_id, a null or an empty text stay; rows that repeat a doc_id go together if one of them
    holds a benchmark text. Empty tables: no rows go.
    """
    leaks = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("leaking")).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks["leaking"], "left_anti")
