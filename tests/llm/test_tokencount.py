import re

import public_tokenizers

from tidemark.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(word, pieces):
    """The best segmentation of one word on its own."""
    text, best = tokencount.SPACE + word, [(0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        options = [(best[end - 1][0] + size * pieces.byte, best[end - 1][1] - size)]
        options += [(best[k][0] + pieces.score[text[k:end]], best[k][1] - 1) for k in range(end) if text[k:end] in pieces.score]
        best.append(max(options))
    return -best[-1][1]


def test_equals_brute_force(spark, monkeypatch):
    pieces = tokencount.Pieces(PATH)
    texts = ["the theory of then, there and thereafter", "", None, " \n", "ünïcödé 中文🙂 x", "internationalisation " * 50, "a" * 300, "The the THE"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "the the", 0), (0, texts[0], 0)], "doc_id long, text string, n_tokens int").repartition(2)
    want = sorted(((i, len(w), sum(plain(x, pieces) for x in w)) for i, w in ((i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in [*enumerate(texts), (None, "the the"), (0, texts[0])])), key=str)
    assert sorted(map(tuple, tokencount.count_tokens(df, PATH).collect()), key=str) == want
    assert tokencount.count_tokens(df.where("false"), PATH).count() == 0


def test_shared_prefixes():
    pieces = tokencount.Pieces(PATH)
    words = sorted({"the", "then", "there", "thereafter", "zebra", "zebras", "", "t"})
    assert tokencount.trie_counts(words, pieces) == [plain(w, pieces) for w in words]
