import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from tidemark.llm import tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["it's 'quoted' we'll", "  two  spaces ", "\n\n tabs\t\tx", "é中文 🙂🙂", "x" * 500, "''s 'S 'sam", "a\u00a0b\u2003c", "1234 5.6", "<|endoftext|> end", "hello <|endoftext|> x", "a<|startoftext|>b<|endoftext|>", "<|endoftext", "", None, "!!!?? --'re"]


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def dictionary(files):
    fs, place = pyarrow.fs.FileSystem.from_uri(files.dictionary)
    return fs.open_input_stream(place).read()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    enc, want = tokenfile.encoder(path), plain(path)
    r = random.Random(1)
    texts = NASTY + ["".join(r.choices("ab 'sré\n\t1!", k=30)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(enc.encode(t or "", b""), enc.dtype).tolist() == want(t), t


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 2000)
    r = random.Random(2)
    rows = [(i * 3 % 1000 - 50, " ".join(r.choices("alpha beta gamma delta it's 42".split(), k=r.choice([1, 10, 200])))) for i in range(300)]
    rows += [(5000 + i, t) for i, t in enumerate(NASTY)] + [(None, "no id"), (None, None), (-(1 << 63), "least"), (7000, "twice"), (7000, "twice again"), (7000, "twice")]
    rows += [(8000, f"many {i} " + "x " * (i % 50)) for i in range(400)] + [(9000, "long " * 60000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    files = tokenfile.write_tokens(df, PATH)
    got = tokenfile.read_tokens(files, with_ids=True).orderBy("start").collect()
    want, at = plain(PATH), 0
    tie = lambda t: (zlib.crc32(np.array(want(t) + [0], "<u2").tobytes()), len(want(t)))
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1])))
    hot = [x.shard for x in files.manifest.collect() if 8000 in tokenfile.TokenShard(x.path, dictionary(files)).index[:, 0]]
    assert len(hot) > 3  # an id with half of all rows is spread over shards
    assert files.manifest.count() > 3
    for r_, (i, t) in zip(got, ordered, strict=True):
        ids = want(t) + [0]
        assert (r_.doc_id, r_.start, r_.n_tokens, r_.ids_crc32, list(r_.ids)) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    trained = dictionary(files)
    first = next(x for x in files.manifest.orderBy("shard").collect() if -(1 << 63) in tokenfile.TokenShard(x.path, trained).index[:, 0])
    shard = tokenfile.TokenShard(first.path, trained)
    assert shard.find(-(1 << 63)).tolist() == want("least") + [0]
    with pytest.raises(KeyError):
        shard.find(-999)
    with pytest.raises(ValueError):
        tokenfile.TokenShard(first.path, b"other")


def test_empty_table(spark):
    files = tokenfile.write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert tokenfile.read_tokens(files).count() == 0


def test_more_shards_than_documents(spark, monkeypatch):
    """Bounds that are no literals of the plan; names that the operator uses itself."""
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 1)
    df = spark.range(5).selectExpr("id * 7 AS doc_id", "repeat('word ', 5) AS text", "id AS tie", "id AS bucket")
    files = tokenfile.write_tokens(df, PATH)
    assert files.shards > 20
    assert [x.doc_id for x in tokenfile.read_tokens(files).orderBy("start").collect()] == [7 * i for i in range(5)]
