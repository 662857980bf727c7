import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import brute as jaccard_brute
from tests.llm.test_langid import VOCAB
from tests.llm.test_mixing import brute as mix_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_equal_a_plain_version(spark, tmp_path):
    r = random.Random(8)
    rare = [f"x{i}y" for i in range(4000)]
    items = [(i, " ".join(r.choices(rare, k=30))) for i in range(10)]
    docs = []
    for i in range(120):
        lang = r.choice(list(VOCAB))
        text = " ".join(r.choices(VOCAB[lang] * 30 + rare[:800], k=r.choice([30, 120])))
        docs.append([i, text, lang, r.choice("aaabc")])
    for i in range(20):
        docs.append([200 + i, docs[i][1] + " end", docs[i][2], "c"])
    leaks = set(range(300, 306))
    docs += [[i, docs[40][1] + f" n{i} " + items[i - 300][1], docs[40][2], "b"] for i in leaks]
    docs += [[400, "12 34", "en", "a"], [401, None, "en", "a"], [402, "", None, None]]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((x.doc_id, x.n_tokens, x.ids_crc32) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    left = [d for d in docs if d[0] < 400]
    groups = jaccard_brute([(d[0], d[1]) for d in left], 5, 80)
    left = [d for d in left if groups[d[0]][1] == d[0]]
    left = [d for d in left if d[0] not in leaks]
    taken = {i: n // max(1, z) for i, z, *_, n in mix_brute([(d[0], d[1], d[3]) for d in left])}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d in left:
        ids = t.encode(d[1], add_special_tokens=False).ids + [0]
        want += [(d[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] * taken[d[0]]
    assert got == sorted(want)


def test_stage_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_files"]


def test_edges(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing names, a long text; then empty tables."""
    good = "the same words of a text in english that all of us can read and that goes on for some time"
    rows = [(i, f"{good} {i} {i * 7}", "en", "a", 1) for i in range(30)] + [(3, f"{good} 3 21", "en", "a", 1)] * 2
    rows += [(None, good, None, None, None), (50, None, "en", "a", None), (51, "", None, "b", 0), (52, (good + " ") * 3000, "en", None, 9)]
    rows += [(60 + i, " ".join(f"mot{k}é" for k in range(i, i + 20)), "fr", "b", 1) for i in range(30)]
    extra = "leaking string, gone string, _key string, _row int, _copies int"
    df = spark.createDataFrame([(*x, "l", "g", "k", 1, 2) for x in rows], f"{SCHEMA}, {extra}")
    for name, docs, bench in (("some", df, [(1, good), (2, None), (None, "x")]), ("none", df.where("false"), []), ("all", df.where("text IS NULL"), [])):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        kept = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES:
            before, kept = kept, function(spark, kept, f"{tmp_path}/{name}")
            assert stage == "token_files" or kept.columns == before.columns
            kept.write.parquet(f"{tmp_path}/{name}/{stage}")
            kept = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
        assert kept.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert (kept.count() > 0) == (name == "some")
