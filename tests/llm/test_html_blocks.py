from __future__ import annotations

import html
import re

import numpy as np
import pytest

from assayer.llm import html_blocks
from assayer.llm.html_blocks import Labeller, extract, features, leaf_blocks, padded, trained, written_pages
from assayer.llm.queries import QUERIES


def article_of(page):
    """The text between the article tags of the given pages, whose markup is known."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"</?b>", "", body.replace("<br>", " "))
    parts = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(x for x in parts if x)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.page_id: (r.url, article_of(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: (r.url, r.text) for r in QUERIES["op3_html_blocks"](spark, sf).collect()}
    assert got == truth


def test_accuracy_on_unseen_layouts():
    model, slots, right, count = trained(), html_blocks._Slots(), 0, 0
    for page, labels in written_pages(200, 99):
        blocks = leaf_blocks(page)
        if blocks:
            belongs = model.forward(*padded([features(blocks, slots)]))[0][0] >= 0.5
            right, count = right + int((belongs == np.array(labels)).sum()), count + len(labels)
    assert right >= 0.985 * count


def test_splitter():
    texts = lambda page: [b[0] for b in leaf_blocks(page)]
    assert texts("<p>a<p>b<br>c &amp;&nbsp; d<b>e") == ["a", "b c & de"]
    assert texts("<script>var a='</p>';</script><style>x</style>x<!-- <p>n --> y") == ["x y"]
    assert texts('<div title="a>b">t</div><a href=\'<p>\'>u</a>') == ["t", "u"]
    assert texts("a < b <3 </> <!doctype x> c <? d ?>") == ["a < b <3 c"]
    assert texts('<p class="open>still</p>') == ["still"]
    assert texts("<ul><li>1<li>2</ul><table><tr><td>3<td>4<tr><td>5</table>") == ["1", "2", "3", "4", "5"]
    assert texts(None) == texts("") == texts("<p> \n</p>") == texts("<!-- open <p>x") == []
    assert texts("</div></p>x") == ["x"]
    assert texts("&lt;p&gt; &#233; &eacute; &copy 1") == ["<p> é é © 1"]


def test_context_decides():
    """The same plain block is judged by what stands around it."""
    model, slots = trained(), html_blocks._Slots()
    x, live = padded([features(leaf_blocks("<div><p>one two three four.</p></div>" * 6), slots)])
    alone = model.forward(x, live)[0]
    y, live_y = padded([np.concatenate([features(leaf_blocks("<nav><ul><li><a>x</a></li></ul></nav>" * 8), slots), x[0, :1]])])
    assert abs(model.forward(y, live_y)[0][0, -1] - alone[0, 0]) > 1e-4


def test_gradients():
    rng = np.random.default_rng(0)
    model = Labeller(inputs=5, hidden=3)
    model.p = {k: v.astype(np.float64) + rng.normal(size=v.shape) * 0.3 for k, v in model.p.items()}
    x, live = rng.normal(size=(3, 6, 5)), np.arange(6) < np.array([6, 2, 4])[:, None]
    y = (rng.random((3, 6)) < 0.5) * live

    def loss():
        p = model.forward(x, live)[0]
        return -(np.log(np.where(y, p, 1 - p)) * live).sum() / live.sum()

    for name, g in model.gradients(x, y, live).items():
        flat = model.p[name].reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 7)):
            kept = flat[k]
            flat[k] = kept + 1e-4
            up = loss()
            flat[k] = kept - 1e-4
            down = loss()
            flat[k] = kept
            assert g.reshape(-1)[k] == pytest.approx((up - down) / 2e-4, abs=2e-4)


def test_odd_rows(spark):
    long = "<article>" + "<p>word " * 30_000 + "</article>"
    rows = [(1, "u", None), (None, None, "<article><h1>T</h1><p>x y.</p></article>"), (2, "u", ""), (3, "u", long), (3, "u", long),
            (4, "u", "<div>" * 3000 + "deep"), (5, "u", "<nav><a>menu</a></nav><footer>end</footer>"), (6, "u", "<" * 1000), (7, "u", "\x00<p")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == by_id[5] == "" and by_id[None] == "T\n\nx y."
    assert by_id[3].count("word") == 30_000
    assert extract(df.limit(0)).count() == 0


def test_long_values_and_names_like_raw_elements():
    long = "<b>x</b> > " * 500
    page = f"""<p>one <a data-x="{long}" title='{long}'>two</a></p><title-bar>three</title-bar><template-x>four</template-x><title>gone</title><p>five</p>"""
    assert " ".join(t for t, *_ in leaf_blocks(page)) == "one two three four five"
    assert [t for t, *_ in leaf_blocks('<p>a <i title=it\'s>b</i> don\'t</p><p title="open>c</p>')] == ["a b don't", "c"]
