import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def one(spark, *exprs):
    return list(spark.range(1).select(*exprs).first())


@pytest.mark.parametrize("sec, want", [(0, "0:00"), (65.9, "1:05"), (3599, "59:59"), (3600, "1:00:00"), (-5, "0:00")])
def test_timestamp(spark, sec, want):
    assert one(spark, C.format_timestamp(F.lit(float(sec)))) == [want]


def test_targets(spark):
    got = one(spark, *[C.target_events(F.lit(float(s))) for s in (600, 2400, 36000)], C.target_events(F.lit(1.0), explicit=0), *[C.target_events(F.lit(m * 60.0), lowest=1) for m in (10, 14)])
    assert got == [3, 10, 24, 1, 2, 4]


def test_tokens_split_at_other_letters(spark):
    assert one(spark, C.tokens(F.lit("Foo_1 bär X")), C.tokens(F.lit(None).cast("string"))) == [["foo_1", "b", "r", "x"], []]


def test_representatives(spark):
    a = F.array(*map(F.lit, range(10)))
    assert one(spark, C.representatives(a, 3), C.representatives(F.slice(a, 1, 2), 3), C.representatives(a, 0)) == [[2, 5, 7], [0, 1], []]


def test_media_facts(spark):
    pts, sec = C.frame_time(F.lit(None).cast("long"), F.lit(9), F.lit(1), F.lit(3.0))
    assert one(spark, pts, sec, C.frame_rate(F.lit(None).cast("double"), F.lit(None).cast("double")), C.media_duration(F.lit(None).cast("double"), F.lit(30.0), F.lit(0.1))) == [9, 3.0, 0.0, 3.0]


def test_dims_and_boxes(spark):
    w, h = C.resized_dims(F.lit(1920), F.lit(1080), 448)
    keep = C.resized_dims(F.lit(300), F.lit(200), 448)
    assert one(spark, w, h, *keep) == [448, 252, 300, 200]
    box = one(spark, C.region_box(F.lit(100), F.lit(50), (0.5, 0.0, 0.5, 1.0), 2))[0]
    assert tuple(box) == (0, 0, 100, 50, 200, 100)


def test_confident_lines_and_texts(spark):
    lines = F.expr("array(named_struct('text',' a ','score','0.5'), named_struct('text','b','score','x'), named_struct('text',' ','score','1'))")
    assert one(spark, C.confident_lines(lines), C.combined_text(F.lit("a"), F.lit("b")), C.combined_text(F.lit(None).cast("string"), F.lit("b"))) == [["a"], "a  b", "b"]


def test_unit_and_rescaled(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    u, z, r = one(spark, C.unit(v), C.unit(F.array(F.lit(0.0))), C.rescaled_cosine(F.array(F.lit(1.0)), F.array(F.lit(-1.0))))
    assert u == [0.6, 0.8] and z == [0.0] and r == 0.0
