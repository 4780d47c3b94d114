import html
import re

import pytest

from ledgerlens.llm import main_text as M
from ledgerlens.llm.queries import QUERIES


@pytest.fixture(scope="module")
def chain(spark):
    return M.fit(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))


def article(page):
    """The article of a page of the test tables, by regular expressions."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_query_equals_articles(spark, con, small):
    pages = dict(con.sql("SELECT page_id, html FROM pages").fetchall())
    rows = QUERIES["op4_main_text"](spark, small).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_other_layouts(chain):
    page = """<html><head><title>Site</title></head><body><div id="header"><h1>Site</h1></div><div class="menu"><a href=x>Home</a></div>
    <div class="cookie-notice"><p>We use cookies, and more.</p></div><div class="content"><h1>The  title</h1><p>A long
    paragraph of <b>text</b>, with commas, and more. It goes on.</p><p>Another one, &amp; on.<div class="ad">Buy now!</div><p>Short one.</p></div>
    <form><label>Mail</label><input></form><div class="comments"><p>Nice article, I liked it, thanks.</p></div>
    <aside class="sidebar"><p>Related stories, here.</p></aside><footer>&copy; 2020</footer>"""
    want = "The title\n\nA long paragraph of text, with commas, and more. It goes on.\n\nAnother one, & on.\n\nShort one."
    assert M.main_text(page, chain) == want


def test_comments_inside_the_article(chain):
    page = "<article><h1>T</h1><p>A paragraph here, with a sentence.</p><section class='comments'><h2>Comments</h2><p>A reader says something, long.</p></section></article>"
    assert M.main_text(page, chain) == "T\n\nA paragraph here, with a sentence."


def test_held_out_variants(spark, chain):
    """Made layouts of pages that were not learned from."""
    import numpy as np

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()][:60]
    rng, right, total = np.random.default_rng(99), 0, 0
    for p in pages:
        blocks = M.leaf_blocks(p)
        made, y = M.variant(blocks, M.marked_labels(blocks), rng)
        found = M.leaf_blocks(made)
        if len(found) == len(y):
            right += sum(a == b for a, b in zip(chain.decode(M.features(found)), y, strict=True))
            total += len(y)
    assert total > 500 and right / total > 0.97


def test_leaf_blocks():
    page = "<p>a<b>b</b> c<p>d<br>e<ul><li>f<li>g</ul><script>if (a<b) '</p>'</script>h<!-- <p>x</p> --><textarea>t</textarea><div title='a>b'>i &eacute;"
    assert [b.text for b in M.leaf_blocks(page)] == ["ab c", "d e", "f", "g", "h", "i é"]
    assert M.leaf_blocks("<head><title>x</title><body>y")[0].text == "y"
    assert [b.text for b in M.leaf_blocks("<p>cut <b")] == ["cut"]


def test_viterbi_is_the_best_labelling(chain):
    from itertools import product

    blocks = M.leaf_blocks("<nav><p>a</p></nav><article><p>b, c.</p><div class=ad>d</div><p>e</p></article>")
    feats = M.features(blocks)
    w = lambda f, y: sum(chain.weights.get(x, (0, 0))[y] for x in f)
    value = lambda ys: sum(w(f, y) for f, y in zip(feats, ys, strict=True)) + sum(chain.moves[a][b] for a, b in zip(ys, ys[1:], strict=False))
    assert tuple(map(int, chain.decode(feats))) == max(product((0, 1), repeat=len(feats)), key=value)


def test_defined_cases(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "y"), (2, None, "", "y"), (3, "v", "<article><p>" + "a " * 50_000 + "</article>", "z"), (4, "w", "<nav>n</nav>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = M.extracted(pages, M.PLAIN, ["page_id", "url"]).collect()
    assert [(r["page_id"], r["n_chars"]) for r in out] == [(1, 0), (2, 0), (2, 0), (3, 99_999), (4, 0)]
    assert M.extracted(pages.limit(0), M.fit(pages.limit(0)), ["page_id"]).collect() == []
    assert M.fit(pages.filter("page_id < 3")) is M.PLAIN


def test_unclosed_and_empty_elements_hide_no_text():
    read = lambda page: [b.text for b in M.leaf_blocks(page)]
    for tag in ("<svg class=icon/>", "<svg/>", "<math/>", "<svg>", "<noscript>", "<template>", "<object data=x>", "<math>"):
        assert read(f"<article><p>a {tag} b</p><p>c</p></article>") == ["a b", "c"]
        assert read(f"<article><p>a {tag} b</p><p>c</p></article><footer>d<svg><title>x</title></svg>e</footer>") == ["a b", "c", "de"]
    assert read("<p>a<select class=x><p>b</p>") == ["a", "b"] and read("<p>a<select><option>x</select>b") == ["a", "b"]
    assert read("<p>a<svg><svg>x</svg><svg/>y</svg>b<noscript>z</noscript>c") == ["abc"]
    assert read("<p>So <math><mi>x</mi><mspace/><mo>=</mo><mn>2</mn></math> here.") == ["So x=2 here."]
    assert read("<p>See <object data=x><param name=y>the <b>film</b></object>.") == ["See the film."]
    assert read("<head><title>t</title><p>a") == ["a"] and read("<head><title>t</title></head>a<body>b") == ["a", "b"]
    assert read("<p>a<script>b") == ["a"] and read("<p>a" + "<svg>" * 50_000 + "b") == ["ab"]
    assert M.leaf_blocks("<math><p>x</p></math><p>y</p>")[-1].tags == ("p",)


def test_quotes_in_attributes(chain):
    """A quote opens a value only behind an equals sign, and only if it ends."""
    frame = "<html><body><div class=\"content\"><h1>The title of it</h1>%s</div></body></html>"
    first, second = "A long paragraph of text, with commas, and more. It goes on.", "Another long paragraph, which is here too, and ends."
    third = "The last one of the paragraphs, with a few commas, is this."
    for tag in ("<p data-x=it's>", "<p title=a\"b>", "<p title='a>b' class=\"x>y\">", "<p 'x>", '<p title = "a > b">'):
        page = frame % f"<p>{first}</p>{tag}{second}</p><p>{third}</p>"
        assert M.main_text(page, chain) == "\n\n".join(["The title of it", first, second, third]), tag
    page = f"<html><body><div class=content><p>{first}</p><p>{third}</p><p class=\"x>{second}</p></div></body></html>"
    assert second in M.main_text(page, chain) and "class=" not in M.main_text(page, chain)
