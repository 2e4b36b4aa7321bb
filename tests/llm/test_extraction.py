import html
import re

import numpy as np
import pytest

from motorfisc.llm import extraction
from motorfisc.llm.markup import blocks


def article_text(page):
    """The article's headings and paragraphs of the given pages' one layout."""
    body = page[page.find("<article>") :] if "<article>" in page else ""
    body = re.sub(r"<[^>]*$", "", body.split("</article>")[0])
    parts = [" ".join(html.unescape(re.sub(r"<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1|article|b)>", body)]
    return "\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return extraction.train(spark.read.parquet(f"{sf_dir}/pages.parquet"), 50)


def test_blocks():
    page = '<!doctype html><p>a <b>b</b>&amp;c<br>d<script>"<p>x</p>"</script><!-- <p>no --><li>one<li>two<ul><li>in</ul><div class="Ad box" id=x>z &nbsp; &eacute;</div><p>open <i>q'
    assert [b.text for b in blocks(page)] == ["a b&c d", "one", "two", "in", "z é", "open q"]
    assert blocks(page)[4].path[-1] == "div ad box x"
    assert blocks(None) == blocks("") == blocks("<p> </p>") == []
    assert [b.text for b in blocks("<p>cut off <a href='x")] == ["cut off"]
    assert [b.text for b in blocks("a < b <p title='>'>c</p></div></div>d")] == ["a < b", "c", "d"]
    assert blocks('<a href="x">link</a> rest')[0].linked == 4
    assert len(blocks("<div>" * 20_000 + "deep" + "</div>" * 20_000)) == 1


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>before</p><svg class="i"/><p>the article</p>', ["before", "the article"]),
        ('<p>before</p><svg class="i"/><p>the article</p><svg><text>no</text></svg><p>end</p>', ["before", "the article", "end"]),
        ('<p>before</p><svg class="i"><p>the article</p><svg><text>no</text></svg><p>end</p>', ["before", "the article", "end"]),
        ('<object data="a"/><p>rest</p>', ["rest"]),
        ('<object data="a"><p>in its place</p></object><p>rest</p>', ["in its place", "rest"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["so x=2 holds"]),
        ("<math/><p>rest</p>", ["rest"]),
        ("<iframe src='x'><p>rest</p>", ["rest"]),
        ("<title>no</title><p>a</p><noscript>no</noscript><template><p>no</p></template>b", ["a", "b"]),
        ("<p>a</p><script>x<p>no</p>", ["a"]),
        ("<p>a</p><style>x<p>no</p>", ["a"]),
    ],
)
def test_only_closed_or_code_elements_hide_text(page, want):
    assert [b.text for b in blocks(page)] == want


def test_unclosed_icons_take_linear_time():
    assert [b.text for b in blocks("<svg>" * 20_000 + "<p>deep</p>")] == ["deep"]


def test_extraction_of_the_given_pages(spark, sf_dir, model):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extraction.extract(pages, model).collect()
    assert len(rows) == pages.count()
    assert all(r.text == article_text(r.html) and r.n_chars == len(r.text) for r in rows)


def test_made_pages_of_unseen_layouts(spark, sf_dir, model):
    read = [blocks(r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rng, places, right, total = np.random.default_rng(99), extraction._Places(), 0, 0
    for i in range(150):
        page = blocks(extraction.made_page([b.text for b in read[i % len(read)] if len(b.text) > 40], rng))
        z = model.logits([extraction.features(page, places)])[0]
        right += sum((x > 0) == bool(b.truth) for b, x in zip(page, z, strict=True))
        total += len(page)
    assert right > 0.97 * total


def test_odd_pages(spark, model):
    rows = [(1, None, "t"), (2, "", "t"), (2, "", "t"), (3, "<article>" + "<p>some text here.</p>" * 5000 + "</article>", "t"), (4, "<nav><a>x</a></nav>", "t")]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, html string, text string"), model).orderBy("page_id").collect()
    assert [r.n_chars for r in got[:3]] == [0, 0, 0] and got[3].text.count("some text here.") == 5000 and got[4].text == ""
    assert extraction.extract(spark.createDataFrame([], "page_id long, html string"), model).collect() == []


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    net = extraction.Labeller()
    x, lengths = rng.standard_normal((2, 3, extraction.PATH + extraction.WORDS + extraction.OTHER)), np.array([3, 3])
    kept = []
    grad = rng.standard_normal((2, 3, extraction.STATE))
    net._run(x, "f", lengths, kept)
    found = net._back(x, "f", kept, grad)
    for name, at in (("fx", (5, 7)), ("fh", (2, 40)), ("f0", (3,))):
        old = net.w[name][at]
        sums = []
        for step in (1e-6, -1e-6):
            net.w[name][at] = old + step
            sums.append((net._run(x, "f", lengths, []) * grad).sum())
        net.w[name][at] = old
        assert found[name][at] == pytest.approx((sums[0] - sums[1]) / 2e-6, rel=1e-4, abs=1e-7)


def test_no_pages_to_learn_from(spark):
    model = extraction.train(spark.createDataFrame([], "page_id long, html string"), 20)
    assert np.isfinite(model.w["o"]).all()
