import pytest

from tidemark.llm import htmltext as H


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""),
        ("<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>One &amp; two&nbsp;three.<br>Next\n line.</p></article><footer>c</footer></body>", "Title\nOne & two three.\nNext line."),
        ("<article><p><b>Unclosed.<br><p>More text here.<script>var t='</p>';</script><style>p{}</style><!-- no --></article", "Unclosed.\nMore text here."),
        ("<body><div class='cookie-notice'><p>We use cookies.</p></div><div class='post-content'><p>A real sentence of text.</p><p>Short.</p></div><div id='comments'><div class='comment'><p>Nice text, I agree with it all.</p></div></div></body>", "A real sentence of text.\nShort."),
        ("<article><p>x <math><mi>a</mi><mo>+</mo><mi>b</mi></math> tail words here.</p><p>A <noscript>plain</noscript> and <object>other</object> text<script>1</script>, all of it.</p></article>", "x a+b tail words here.\nA plain and other text, all of it."),
        ("<article><p>Some text here.</p><form><label>Mail</label><input><button>Send</button></form><div class='ad'>Buy this now.</div><p>Last one.</p></article>", "Some text here.\nLast one."),
    ],
)
def test_pages(page, want):
    assert H.main_text(page) == want


def test_held_out_pages():
    model, right, total = H.default_model(), 0, 0
    for page in H.labelled_pages(200, seed=77):
        tree = H.parse(page)
        for text, label, chance in zip(tree.text, tree.label, model.marginals(tree)):
            if text is not None:
                total += 1
                right += (chance > 0.5) == label
    assert right / total > 0.97


def test_marginals_equal_enumeration():
    from itertools import product
    from math import exp, log

    model = H.TreeModel({"tag:a": 1.0, "tag:b": -0.7, "size:1": 0.4}, {"text": (0.1, 0.8), "part": (0.3, 0.6), "element": (0.2, 0.7)})
    tree = H.Tree([-1, 0, 1, 1, 2, 0], [("tag:#page",), ("tag:body",), ("tag:a",), ("tag:b",), ("size:1",), ("size:1",)], [None, None, None, None, "t", "u"], [0] * 6)
    mass, ones = 0.0, [0.0] * 6
    for x in product((0, 1), repeat=6):
        p = (0.1 / 1.1) if x[0] else 1 / 1.1
        for v in range(6):
            if v:
                up = model.edges[H._edge(tree, v)][x[tree.parent[v]]]
                p *= up if x[v] else 1 - up
            p *= exp(sum(model.evidence.get(s, 0.0) for s in tree.seen[v])) if x[v] else 1
        mass += p
        ones = [o + p * b for o, b in zip(ones, x)]
    assert model.marginals(tree) == pytest.approx([o / mass for o in ones])
    assert log(2) > 0


def test_very_long_page():
    page = "<body><nav><a href=x>Home</a></nav><article>" + "".join(f"<p>Paragraph number {i} of a very long page.</p>" for i in range(20_000)) + "</article></body>"
    assert H.main_text(page) == "\n".join(f"Paragraph number {i} of a very long page." for i in range(20_000))


def test_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hello there.</p></article>", "t"), (1, "u", "<article><p>Hello there.</p></article>", "t"), (None, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in H.extract_text(df).collect()) == [("1", "Hello there.", 12), ("1", "Hello there.", 12), ("None", "", 0)]
    assert H.extract_text(df.where("false")).count() == 0
