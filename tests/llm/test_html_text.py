import numpy as np
import pytest

from verdara.llm import html_text as H


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_marginals_match_enumeration(model):
    page = H.Page("<body><nav><a href='/x'>Home</a></nav><div><p>Some text here.</p></div></body>")
    forest = H.Forest([page])
    score = np.array([model.unary[f].sum(axis=0) for f in page.features])
    n, total = len(page.parent), 0.0
    want, pairs = np.zeros((n, 2)), np.zeros((n, 2, 2))
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        weight = np.exp(sum(score[i, y[i]] + (model.pair[page.kind[i], y[page.parent[i]], y[i]] if i else 0)
                            for i in range(n)))
        total += weight
        for i in range(n):
            want[i, y[i]] += weight
            if i:
                pairs[i, y[page.parent[i]], y[i]] += weight
    node, joint = model.marginals(forest)
    assert node == pytest.approx(want / total) and joint == pytest.approx(pairs / total)


def test_held_out_pages(model):
    pages = H.labelled_pages(200, seed=5)
    found = H.main_texts([h for h, _ in pages], model)
    blocks = [(set(w), set(g.split("\n")) - {""}) for (_, w), g in zip(pages, found)]
    right, wanted, given = (sum(len(x) for x in s) for s in zip(*[(w & g, w, g) for w, g in blocks]))
    assert right / wanted > 0.95 and right / given > 0.95


@pytest.mark.parametrize("html, text", [
    ("<body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Head &amp; tail</h1>"
     "<p>One  two\n three &lt;b&gt; four five six.<p><b>Open paragraph with more words.<br>"
     "<!-- c --><script>x</script><p>Last one in the text.</article><footer>&copy; me</footer>",
     "Head & tail\nOne two three <b> four five six.\nOpen paragraph with more words.\n"
     "Last one in the text."),
    ("", ""), ("<!-- never closed <p>x", ""), ("<script>never closed", ""),
    ("<article><h1>Title words</h1><p>Paragraph one of the text.</p><form><label>Mail</label>"
     "<input></form><div class='comments'><p>Nice text, thanks a lot.</p></div></article>",
     "Title words\nParagraph one of the text.")])
def test_pages(model, html, text):
    assert H.main_texts([html], model) == [text]


def test_edge_cases(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<div>" * 3000 + "deep"), (3, "u", "<article><p>Some text.</p>"),
            (3, "u", "<article><p>Some text.</p>"), (None, None, "<" * 2000), (5, "u", "<p a=\"x>y\" 'b\">z</p>")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, text string")
    got = H.extract(pages).collect()
    assert len(got) == 7 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 1] == [""]
    assert H.extract(pages.limit(0)).collect() == []
