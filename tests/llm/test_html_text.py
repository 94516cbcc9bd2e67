import html
import re

import numpy as np
import pytest
from rasterlake.llm import html_text as h


def brute(page):
    """Blocks of the article of a page of the pages table, which marks it by its element."""
    a, e = page.find("<article>"), page.find("</article>")
    inner = page[a + 9 : e if e >= 0 else len(page)]
    parts = [" ".join(html.unescape(re.sub(r"<(?!br)[^>]*>", "", p.replace("<br>", "\n"))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = h.op7_block_lstm(spark, sf).collect()
    wanted = {r["page_id"]: brute(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in rows} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_held_out_layouts():
    model = h.trained()
    read = [h.blocks(page) for page in h.training_pages(100, seed=1234)]
    wanted = [np.array([h.MARK[0] in t for t in b.text]) for b in read]
    for b in read:
        b.text = [" ".join(w for w in t.split() if w not in h.MARK) or "-" for t in b.text]
    got = h.labelled(read, model)
    assert np.concatenate([g == w for g, w in zip(got, wanted, strict=True)]).mean() > 0.97


PROSE = "The committee met on Tuesday to review the plan, which had been delayed twice. Members asked how the costs had risen so quickly."
# Written by hand, unlike the generator's pages: the page, what must stay, and what must go.
LAYOUTS = {
    "boxes without names": (
        f"<html><body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div><h1>Council delays the bridge</h1><p>{PROSE}</p><p>{PROSE} {PROSE}</p><p>Nobody voted.</p></div><div>Contact us | Terms | © 2020 Example</div></body></html>",
        ["Council delays the bridge", PROSE, f"{PROSE} {PROSE}", "Nobody voted."],
    ),
    "paragraphs in a box": (f"<html><body><div><p>{PROSE}</p><p>{PROSE} {PROSE}</p></div><div><a href=/>Home</a> | <a href=/x>Archive</a></div></body></html>", [PROSE, f"{PROSE} {PROSE}"]),
    "layout table": (
        f"<table><tr><td><a href=/>Home</a><br><a href=/a>About</a><br><a href=/l>Links</a></td><td><p>{PROSE}</p><p>{PROSE} {PROSE}</p></td></tr><tr><td colspan=2>Contact us | Terms</td></tr></table>",
        [PROSE, f"{PROSE} {PROSE}"],
    ),
    "comments of a widget": (
        f"<html><body><article><h1>Title of it</h1><p>{PROSE}</p><p>{PROSE} {PROSE}</p></article><div id=disqus><p>Great article, thanks for writing this up for all of us.</p><p>I disagree with the second point, it is not what happened at all.</p></div></body></html>",
        ["Title of it", PROSE, f"{PROSE} {PROSE}"],
    ),
    "flat": (f"<h1>Flat page</h1><p>{PROSE}</p><p>{PROSE} {PROSE}</p><p>Short end.</p>", ["Flat page", PROSE, f"{PROSE} {PROSE}", "Short end."]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_by_hand(name):
    page, wanted = LAYOUTS[name]
    assert h.main_texts([page], h.trained())[0].split("\n\n") == wanted


def test_very_long_pages():
    """Depth and number of blocks cost linear time; chunks of a page give what the whole gives."""
    model = h.trained()
    deep = h.blocks("<div>x" * 60_000)
    assert len(deep.text) == 60_000 and deep.path[-1] is deep.path[100]
    read = h.blocks("".join(f"<p>{PROSE[: 20 + i % 90]}" for i in range(3 * h.STEPS)))
    x, n = h.Inputs([read]), np.array([len(read.text)])
    parts = model.logits(x, np.array([0]), np.array([0]), n)[0]
    steps, h.STEPS = h.STEPS, 1 << 20
    try:
        assert np.allclose(parts, model.logits(x, np.array([0]), np.array([0]), n)[0], atol=1e-3)
    finally:
        h.STEPS = steps


def test_gradients():
    """Back-propagation agrees with differences."""
    rng = np.random.default_rng(0)
    model = h.Labeller(3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    counts = np.array([3, 5, 1])
    z = rng.standard_normal((5, 3, 4 * h.HIDDEN))
    live = np.arange(5)[:, None] < counts[None, :]
    target = rng.standard_normal((5, 3, h.HIDDEN)) * live[:, :, None]
    out, kept, _ = model._run(z, live, "f")
    dz, dw = model._back(target.astype(np.float64), kept, "f")
    for _ in range(10):
        at = tuple(int(rng.integers(n)) for n in z.shape)
        more = z.copy()
        more[at] += 1e-3
        change = ((model._run(more, live, "f")[0] - out) * target).sum() / 1e-3
        assert abs(change - dz[at]) < 5e-3
    at = (2, 5)
    model.w["hf"][at] += 1e-3
    change = ((model._run(z, live, "f")[0] - out) * target).sum() / 1e-3
    assert abs(change - dw[at]) < 5e-3


def test_blocks():
    b = h.blocks("<p>a &amp; b<br>c</p><ul><li>x<li>y</ul><script>var p='</p>'</script>z<b>w</b> &lt;&am")
    assert b.text == ["a & b c", "x", "y", "zw <&am"]
    assert h.blocks("").text == [] and h.blocks("<p>  </p><!-- open").text == []
    assert h.blocks("1 < 2 and <a href='>'>l</a>").text == ["1 < 2 and l"]


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "u", "", 1), (None, "u", "<article><p>Some words of a text, and more of them here.</p></article>", 1), (3, "u", "<p>" * 2000 + "word " * 20000, 1), (3, "u", "<nav><ul><li><a href=x>Home</a></li></ul></nav>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = h.extract(pages).collect()
    assert len(got) == 5 and got[0]["main_text"] == got[1]["main_text"] == "" and got[0].asDict().keys() == {"page_id", "url", "main_text", "n_chars"}
    assert next(r for r in got if r["page_id"] is None)["main_text"] == "Some words of a text, and more of them here."
    assert h.extract(pages.limit(0)).collect() == []


def test_formulas_and_objects():
    page = "<main><p>The law says <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation encoding='tex'>E=mc^2</annotation></semantics></math> holds.</p><object data='x.swf'><p>Shown if the object can't be.</p></object></main>"
    assert h.blocks(page).text == ["The law says E=mc2 holds.", "Shown if the object can't be."]
