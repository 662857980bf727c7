"""Token-id files: each document's ids compressed on its own with a shared zstandard dictionary.

A shard holds documents in ascending doc_id order:

    magic | header (JSON, length before it) | frames | index | index position, magic

The header names the dictionary by its SHA-256; the dictionary is a file of its own beside the
shards. The index has, per document, its id, whether that is null, frame position, frame length and
number of ids, so a short document is read with one seek. Ids are 16-bit where the vocabulary fits,
else 32-bit.

Tasks write through pyarrow's file systems under a name of their own, and only the names that
come back in the manifest count, so a repeated or speculative task leaves at most a stray file.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise, new_path
from .textkernel import slices

MAGIC = b"TMKTOK02"
#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers (some 100 MB); the memory is emptied when full, which changes no id.
CACHE = 500_000
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 8 << 20
#: Of a long document, so many bytes of ids go into the training of the dictionary.
SAMPLE_DOC_BYTES = 1 << 16
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 16 << 20
READ_BYTES = 4 << 20
INDEX = 5


class _Encoder:
    """Text to serialized ids. For byte-level BPE, each distinct pre-token is encoded once and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.fast = (
            spec["model"].get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        )
        # The library cuts added tokens out of a text first; texts that hold one go to it as a whole.
        self.added = [t["content"] for t in spec.get("added_tokens") or () if t["content"]]
        if self.fast:
            self.pattern = regex.compile(PATTERN)
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            others = [b for b in range(256) if b not in printable]
            self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
            model, alphabet, dtype = self.tokenizer.model, self.alphabet, self.dtype

            class Cache(dict):
                def __missing__(self, word):
                    ids = np.array([t.id for t in model.tokenize(word.encode().decode("latin-1").translate(alphabet))], dtype=dtype).tobytes()
                    self[word] = ids
                    return ids

            self.cache = Cache()

    def encode(self, text: str, end: bytes) -> bytes:
        if not self.fast or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes() + end
        if len(self.cache) > CACHE:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, self.pattern.findall(text))) + end


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary from serialized id arrays; the samples themselves where they are too few to train on."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


@dataclass(frozen=True)
class TokenFiles:
    """What a write leaves: the manifest (shard, path, docs, tokens), the dictionary's place and the number of shards."""

    manifest: DataFrame
    dictionary: str
    shards: int


def _open(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, tokenizer: str, *, end_id: int = 0, level: int = 3) -> TokenFiles:
    """Encode every whole text of ``docs`` (doc_id long, text) and write shards in ascending doc_id order.

    Null or empty text: the end id only. Null doc_id: before all others. Repeated doc_id: a document
    each, beside each other, by a checksum of their ids, then shorter ones first. Extra columns are ignored.
    Empty table: no shards. A text of any length is one document and one frame. The dictionary is
    trained on the first ``SAMPLE_DOC_BYTES`` of the ids of up to ``SAMPLE_DOCS`` documents (those with the smallest id hash).

    Shards are ranges of about equal numbers of documents, bounded by quantiles of doc_id; an id that many rows
    repeat, or null, is spread over as many shards as its share, by that checksum.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = F.xxhash64("doc_id")
    lowest = docs.select(hashed.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h").alias("h"), F.count("*").alias("n")).first()
    count = docs.count()

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([enc.encode(t or "", end) for t in batch.column("text").to_pylist()], pa.binary())], ["data"])

    sample: list[bytes] = []
    seen = total = held = 0
    if count:
        picked = docs.where(hashed <= F.lit(lowest["h"])).limit(2 * SAMPLE_DOCS).select("text").mapInArrow(serialize, "data binary")
        for r in picked.select(F.length("data").alias("n"), F.substring("data", 1, SAMPLE_DOC_BYTES).alias("data")).toLocalIterator():
            seen, total = seen + 1, total + r["n"]
            if held < SAMPLE_BYTES:
                sample.append(bytes(r["data"]))
                held += len(sample[-1])
    mean = total / max(1, seen)
    trained = train_dictionary(sample)
    digest = hashlib.sha256(trained).hexdigest()
    folder = new_path(spark, "tokens")
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dictionary-{digest[:16]}.zdict") as f:
        f.write(trained)
    shared = spark.sparkContext.broadcast(trained)  # DICTIONARY_BYTES at most

    # Bounds come from the ids alone, and are a sorted array that tasks search: 8 bytes a shard.
    nulls = docs.where("doc_id IS NULL").count() if count else 0
    wanted = max(1, int(-(-count * mean * 0.8 // SHARD_BYTES)))
    first = -(-nulls * wanted // max(1, count))
    ranges = max(1, wanted - first)
    cuts = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    cuts = spark.sparkContext.broadcast(np.array(cuts, dtype=np.float64))
    shards = first + ranges

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(shared.value))
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                raw = [enc.encode(t or "", end) for t in part.column("text").to_pylist()]
                sizes = np.array([len(x) for x in raw], dtype=np.int64) // enc.dtype.itemsize
                tie = np.array([zlib.crc32(x) for x in raw], dtype=np.int64)
                ids = part.column("doc_id")
                value = ids.fill_null(0).to_numpy(False).astype(np.float64)
                low, high = np.searchsorted(cuts.value, value, "left"), np.searchsorted(cuts.value, value, "right")
                shard = np.where(ids.is_valid().to_numpy(False), first + low + (tie * (high - low + 1) >> 32), tie * first >> 32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), ids, pa.array(tie), pa.array(sizes), pa.array([pack.compress(x) for x in raw], pa.binary())], ["bucket", "doc_id", "tie", "n", "frame"]
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        fs, at = _open(folder)
        shard = None
        out, index, made, position, name = None, [], [], 0, ""

        def close():
            columns = np.array(index, dtype="<i8").reshape(-1, INDEX)
            out.write(columns.tobytes() + struct.pack("<QQ", position, len(columns)) + MAGIC)
            out.close()
            made.append((shard, f"{folder}/{name}", len(columns), int(columns[:, -1].sum())))

        for batch in batches:
            for b, doc, n, frame in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("frame")):
                if b != shard:
                    if out is not None:
                        close()
                    shard, index = b, []
                    name = f"shard-{b:06d}-{uuid.uuid4().hex}.tok"
                    out = fs.open_output_stream(f"{at}/{name}")
                    header = json.dumps({"dictionary": digest, "dtype": dtype.str, "end_id": end_id}).encode()
                    out.write(MAGIC + struct.pack("<I", len(header)) + header)
                    position = len(MAGIC) + 4 + len(header)
                data = frame.as_buffer()
                out.write(data)
                index.append((doc or 0, doc is None, position, data.size, n))
                position += data.size
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["shard", "path", "docs", "tokens"])

    frames = docs.mapInArrow(compress, "bucket int, doc_id long, tie long, n long, frame binary")
    ordered = frames.repartitionById(shards, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "tie", "n", "frame")
    manifest = materialise(ordered.mapInArrow(write, "shard long, path string, docs long, tokens long"), "manifest")
    return TokenFiles(manifest, f"{folder}/dictionary-{digest[:16]}.zdict", shards)


class TokenShard:
    """Random access to the documents of one shard."""

    def __init__(self, path: str, dictionary: bytes):
        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        if self.file.read_at(8, 0) != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        place, count = struct.unpack("<QQ", tail[:16])
        length = struct.unpack("<I", self.file.read_at(4, 8))[0]
        self.header = json.loads(self.file.read_at(length, 12))
        if self.header["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{path} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(8 * INDEX * count, place), dtype="<i8").reshape(-1, INDEX)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        self.dtype = np.dtype(self.header["dtype"])

    def _decode(self, frame: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(frame, max_output_size=max(1, n * self.dtype.itemsize)), dtype=self.dtype)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document of this shard."""
        *_, position, size, n = self.index[k].tolist()
        return self._decode(self.file.read_at(size, position), n)

    def find(self, doc_id: int) -> np.ndarray:
        """The ids of a document, by binary search of the index; the first one of a repeated id."""
        nulls = int(self.index[:, 1].sum())
        k = nulls + int(np.searchsorted(self.index[nulls:, 0], doc_id))
        if k == len(self.index) or self.index[k, 0] != doc_id:
            raise KeyError(doc_id)
        return self.ids(k)

    def runs(self, limit: int = READ_BYTES) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first document, ids of it and the next ones): all documents in order, read about ``limit`` bytes at once."""
        ends = np.cumsum(self.index[:, 3])
        at = 0
        while at < len(self.index):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            base = int(self.index[at, 2])
            data = memoryview(self.file.read_at(int(ends[to - 1] - done), base))
            yield at, [self._decode(data[p - base : p - base + size], n) for p, size, n in self.index[at:to, 2:].tolist()]
            at = to


def read_tokens(files: TokenFiles, *, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit), and the ids if asked for.

    Rows are as many as were written, repeats, null ids and empty texts among them; no shards give no rows.
    """
    dictionary = files.dictionary

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(dictionary)
        with fs.open_input_stream(at) as f:
            data = f.read()
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                shard = TokenShard(path, data)
                n = shard.index[:, -1]
                start = base + np.cumsum(n) - n
                for lo, ids in shard.runs():
                    ids, hi = [x.astype("<u4") for x in ids], lo + len(ids)
                    names = pa.array(shard.index[lo:hi, 0], mask=shard.index[lo:hi, 1] != 0)
                    out = [names, pa.array(start[lo:hi]), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    if with_ids:
                        out.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    based = files.manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("shard", "path", "base")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return based.repartitionById(files.shards, F.col("shard").cast("int")).mapInArrow(read, schema)
