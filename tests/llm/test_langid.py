import random

from pyspark.sql import functions as F

from tidemark.llm import langid

VOCAB = {"en": "the of and to in is that for with".split(), "de": "der die und das nicht für über mit".split(), "fr": "le la de et que pour avec été".split()}


def texts(seed, n):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(VOCAB[lang], k=r.choice([4, 20, 60]))), lang, "score") for i, lang in enumerate(r.choices(list(VOCAB), k=n))]


SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(texts(1, 400), SCHEMA)
    found = langid.identify_languages(df, df.where(~langid.held_out())).withColumn("h", langid.held_out())
    m = found.drop("score").join(df, "doc_id").where("h")
    assert m.count() > 60 and m.where("lang_pred = lang").count() >= 0.98 * m.count()
    assert {r.c for r in found.select(F.size(F.array("score")).alias("c")).collect()} == {1}


def test_undetermined_and_empty(spark):
    train = spark.createDataFrame(texts(2, 100) + [(1000, "x y", None, ""), (1001, None, "en", "")], SCHEMA)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 -- !"), (4, "\u4e2d"), (4, "der die das"), (None, "the of and " * 20000)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.lang_pred, round(r.score)) for r in langid.identify_languages(odd, train).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, "und", 0), (2, "und", 0), (3, "und", 0)]
    assert (4, "de", 1) in got and (None, "en", 1) in got and len(got) == 6
    assert langid.identify_languages(odd.where("false"), train).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(odd, train.where("false")).collect()} == {"und"}
    one = langid.identify_languages(odd, train.where("lang = 'fr'")).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("fr", 1.0), ("und", 0.0)}
    kept = langid.keep_identified(odd, train)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {4, None}


def test_codewords_are_apart():
    assert langid.codewords(4).shape == (4, 7)
    code = langid.codewords(20)
    d = [(code[i] != code[j]).sum() for i in range(20) for j in range(i)]
    assert min(d) >= 9
