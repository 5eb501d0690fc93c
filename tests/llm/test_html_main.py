"""Main text of pages: the parser by hand, Viterbi against all labellings, the
field on pages it has not seen."""

import itertools
import random
import re
import time
from html import unescape

import numpy as np
import pandas as pd
import pytest

from clickspark.llm import html_main as M


def texts(html):
    return [t for _, t, _ in M.blocks(html)]


@pytest.mark.parametrize("html, want", [
    ("", []), ("a  b\n c", ["a b c"]), ("<p>a<p>b<b>c</b>d<br>e", ["a", "bcd e"]),
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<p>x &amp; y &eacute;&#233;&#x1F389; &am &nbsp; z</p>", ["x & y éé🎉 &am z"]),
    ("<script>if (a < b) '</p>'</script>t<style>p{}</style>", ["t"]), ("<!-- <p>no</p> -->yes<!-->x<!-- open", ["yesx"]),
    ("1 < 2 and <3 but <i>x</i>", ["1 < 2 and <3 but x"]), ("<p title='a > b' class=x>t</p>", ["t"]),
    ("<p title=\"unclosed>t</p>", ["t"]), ("<head><title>no</title><meta x></head><body>yes", ["yes"]),
    ("<form><select><option>a<option>b</select><textarea>c</textarea><button>d</button>e</form>f", ["e", "f"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("a</div>b</p>c", ["ab", "c"]),
    ("<script>never closed <p>x", []), ("<p>end <a href=", ["end"]), ("</ >x<//>y", ["xy"]), ("<DIV>a</Div>B", ["a", "B"]),
    ("<x-tag>a</x-tag>b", ["ab"]), ("<svg><text>no</text></svg>t", ["t"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"])])
def test_blocks(html, want):
    assert texts(html) == want


def test_paths_and_links():
    got = [(n.tag, n.section, n.near, k) for n, _, k in M.blocks(
        "<article class='mainPost'><div id=ad-1><p>x</div><p>y <a>zz</a></article><aside>q")]
    assert got == [("p", "article", ("ad",), 0), ("p", "article", ("main", "post"), 2), ("aside", "aside", (), 0)]


def test_time_is_linear():
    for piece in ("<div>", "<p><b><i>x", "<!-- ", "<a title=\"", "<", "&", "<li><div>"):
        t = time.time()
        texts(piece * (400000 // len(piece)))
        assert time.time() - t < 20, piece


def test_viterbi_against_all_labellings():
    rng = random.Random(2)
    for _ in range(60):
        html = "".join(rng.choice(("<p>Word, word.</p>", "<div class='ad'>x</div>", "<ul><li><a>l</a></ul>", "<h1>H</h1>"))
                       for _ in range(rng.randint(1, 7)))
        names = {f for s in M.labelled([], 0) or [] for x, _, _ in s for f in x} | {
            "t:p", "c:ad", "p:li", "s:", "bias", "ends", "links3", "headed", "words0", "t:div", "n:ad"}
        m = M.Model({f: rng.uniform(-2, 2) for f in names}, np.array([[[rng.uniform(-2, 2) for _ in "ab"] for _ in "ab"] for _ in "ab"]),
                    rng.uniform(-1, 1))
        seq, headed, old = [], False, None
        for node, text, linked in M.blocks(html):
            headed = headed or node.tag in ("h1", "h2")
            feats, up = set(node.local()), node
            while up:
                feats |= set(up.own())
                up = up.up
            feats |= set(M.text_features(text, linked, headed, not seq))
            seq.append((sum(m.weights.get(f, 0) for f in feats),
                        old is not None and node.up is old.up and node.section == old.section))
            old = node

        def value(y):
            v = m.start * y[0] + seq[0][0] * y[0]
            for a, b, (s, same) in zip(y, y[1:], seq[1:]):
                v += m.links[same][a][b] + s * b
            return v

        best = max(itertools.product((0, 1), repeat=len(seq)), key=value)
        got = [int(y) for y in m.labels(html)[1]]
        assert abs(value(got) - value(best)) < 1e-9


def truth(html):
    """The article of the given pages, which all mark it."""
    if "<article>" not in html:
        return ""
    a = html[html.index("<article>") + 9:].split("</article>")[0]
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", a))).split())


@pytest.fixture(scope="module")
def model(spark, sf):
    return M.fit(M.table(spark, sf, "pages"))


def test_given_pages(model):
    """Pages of another, larger table than the field was fitted on."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    assert [model.main_text(h) for h in pages] == [truth(h) for h in pages]


@pytest.mark.parametrize("html, want", [
    ('<header><div class="logo">Site</div><nav><a href="/">Home</a> <a>Blog</a></nav></header><div class="cookie-banner">We use '
     'cookies. <button>OK</button></div><main><article><h1>Big &amp; bold</h1><p>By Ann</p><p>First para of   the\n story is here.'
     '</p><figure><img src=x><figcaption>A caption.</figcaption></figure><p>Short.</p><div class="ad">Buy now!</div><p>Second <b>para'
     '</b>gr<i>aph</i> goes on &mdash; end.</p><ul><li>One item</li><li>Two items</li></ul></article><section class="comments"><h2>'
     'Comments</h2><div class="comment"><p>Great article, I learned a lot from it, thanks.</p></div></section></main><aside '
     'class="sidebar"><h3>Popular</h3><ul><li><a href=x>Story one</a></li></ul></aside><footer>&copy; 2024 Site</footer>',
     'Big & bold By Ann First para of the story is here. A caption. Short. Second paragraph goes on — end. One item Two items'),
    ('<div id="header"><h1>My Site</h1></div><div id="menu"><ul><li><a>Home</a><li><a>About</a></ul></div><div id="content"><h2>'
     'Title here</h2><p>Some text one.<p>Some text two, with a <a href=x>link</a>.</div><div id="sidebar"><p>Follow us</p></div>',
     'Title here Some text one. Some text two, with a link.'),
    ('<article><h1>Head</h1><p>Para one is here.</p><table><tr><td>a</td><td>b</td></tr></table><form><label>Email</label><input>'
     '</form><p>Para two is here.</p><div id="comments"><ol><li><p>Nice post, really.</p></li><li>Agreed, and more.</li></ol></div>',
     'Head Para one is here. a b Para two is here.'),
    ('<nav><a href=1>A</a></nav><h1>Only heading</h1><p>Plain page without wrappers, but with text.</p><p>And another paragraph of '
     'text follows here.</p><footer>Imprint</footer>',
     'Only heading Plain page without wrappers, but with text. And another paragraph of text follows here.'),
    ('<nav><ul><li><a>x</a></li></ul></nav><div class="ad">Ad text.</div>', ""), ("just text", "just text")])
def test_other_layouts(model, html, want):
    assert model.main_text(f"<html><head><title>T</title></head><body>{html}</body></html>") == want


def test_layouts_not_seen(model):
    pages, wrong, total = M._Pages(["Some words for pages. They go on, and on a little more than that."], 77), 0, 0
    for _ in range(300):
        html, known = pages.page()
        _, main = model.labels(html)
        assert len(main) == len(known)
        wrong, total = wrong + sum(a != b for a, (_, b) in zip(main, known)), total + len(main)
    assert wrong <= 0.02 * total


def test_query_with_nulls_repeats_and_clashes(spark, tmp_path, sf):
    given = [tuple(r) for r in pd.read_parquet(f"{sf}/pages.parquet")[["page_id", "url", "html"]].values[:20]]
    long = "<article>" + "<p>Word after word.</p>" * 30000 + "</article><footer>end</footer>"
    rows = given + given[:1] * 60 + [(None, None, None), (901, "u", ""), (902, "u", long), (903, None, "<nav>a</nav>")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, n_chars int, h string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in M.query(spark, str(tmp_path)).collect()), key=repr)
    want = [(None if i is None else int(i), u, truth(h or ""), len(truth(h or ""))) for i, u, h in rows]
    assert got == sorted(want, key=repr)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert M.query(spark, str(tmp_path)).count() == 0
