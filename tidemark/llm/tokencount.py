"""Token counts under a unigram segmentation, by dynamic programming over a trie of pre-tokens.

A task puts the distinct pre-tokens of its texts in a trie (their sorted order is a walk of it). The
best forward score and its number of tokens are found once per trie node, that is once per
shared prefix, from the nodes above; the count at a terminal is the pre-token's. A
document's count is the sum over its words, looked up by hash. No shuffle is needed.

Pieces come from a public sentencepiece vocabulary; it gives ranks, not probabilities, so a piece's
score is that of Zipf's law at its rank, in integers, which makes ties and sums exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches
from .textkernel import slices, string_buffer, word_hashes, word_spans

SPACE = "▁"
SCALE = 1_000_000
CACHE = 1_000_000


class Pieces:
    """Integer scores of the pieces of a sentencepiece vocabulary; unknown characters fall back to their bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        harmonic = math.log(sum(1 / r for r in range(1, len(normal) + 1)))
        self.score = {p: -round(SCALE * (math.log(r) + harmonic)) for r, p in reversed(list(enumerate(normal, 1)))}
        self.longest = max(map(len, normal))
        self.byte = 2 * min(self.score.values())

    def step(self, text: str, end: int, best: list[tuple[int, int]]) -> tuple[int, int]:
        """(score, -tokens) of the best segmentation of ``text[:end]``, from those of all shorter prefixes; ties: fewer tokens."""
        size = len(text[end - 1].encode("utf-8", "replace"))
        before = best[end - 1]
        top = (before[0] + size * self.byte, before[1] - size)
        for start in range(max(0, end - self.longest), end):
            s = self.score.get(text[start:end])
            if s is not None:
                found = (best[start][0] + s, best[start][1] - 1)
                if found > top:
                    top = found
        return top


def trie_counts(words: list[str], pieces: Pieces) -> list[int]:
    """Tokens of each word of a sorted list of distinct words; each shared prefix is scored once."""
    out, path, best = [], "", [(0, 0)]
    for word in words:
        text = SPACE + word
        shared = 0
        for a, b in zip(path, text):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :]
        for end in range(shared + 1, len(text) + 1):
            best.append(pieces.step(text, end, best))
        path = text
        out.append(-best[-1][1])
    return out


_pieces: dict[str, Pieces] = {}


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens of the whole text.

    ``docs`` needs doc_id and text; ``vocabulary`` is a sentencepiece model file. Pre-tokens are the words
    ``[^\\x20\\x09-\\x0D]+``, each behind a space mark. Null or blank text: 0. Repeated rows are counted
    each; an empty table gives no rows. A task's cache of known words is emptied at ``CACHE`` words,
    which changes no count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces.get(vocabulary) or _pieces.setdefault(vocabulary, Pieces(vocabulary))
        known, tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch):
                raw, offsets = string_buffer(part.column("text"))
                starts, ends, first = word_spans(raw, offsets)
                distinct, example, which = np.unique(word_hashes(raw, starts, ends, lower=False), return_index=True, return_inverse=True)
                if len(known) > CACHE:
                    known, tokens = known[:0], tokens[:0]
                new = np.flatnonzero(~np.isin(distinct, known, assume_unique=True))
                if len(new):
                    data = raw.tobytes()
                    words = [data[starts[e] : ends[e]].decode("utf-8", "replace") for e in example[new]]
                    order = sorted(range(len(words)), key=words.__getitem__)
                    made = np.zeros(len(words), np.int64)
                    made[order] = trie_counts([words[i] for i in order], pieces)
                    known, tokens = np.concatenate((known, distinct[new])), np.concatenate((tokens, made))
                    order = np.argsort(known)
                    known, tokens = known[order], tokens[order]
                each = tokens[np.searchsorted(known, distinct)][which] if len(distinct) else np.zeros(0, np.int64)
                upto = np.concatenate(([0], np.cumsum(each)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array(upto[first[1:]] - upto[first[:-1]])], ["doc_id", "n_words", "n_tokens"])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
