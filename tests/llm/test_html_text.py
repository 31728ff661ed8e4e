import html
import itertools
import random
import re

import numpy as np
import pytest
from lodestack.llm.html_text import Block, Field, blocks, extract, field, main_text
from lodestack.llm.labelled_pages import labelled_pages

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model():
    return field()


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b<br>c<p>d</p>e<div>f &amp; g&nbsp;\n h</div>") == ["a b c", "d", "e", "f & g h"]
    assert texts('<script>var t="</p>x"</script>x<style>y</style><!-- z --><title>t</title><noscript><p>n</p></noscript>') == ["x"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>") == list("abcdef")
    assert texts("") == texts(None) == texts("<p> &nbsp; </p><div>") == []
    assert texts("a<hr>b</div></p></b>c<div/>d") == ["a", "b", "c", "d"]
    assert texts("open <p>never closed <a href=x>link") == ["open", "never closed link"]
    assert texts("1 < 2 &lt; 3 &#x41;&copy &bogus;") == ["1 < 2 < 3 A© &bogus;"]


def test_ancestors_end_where_they_should():
    found = blocks("<body><nav><ul><li>a</ul></nav><p class='oneTwo three'>b<p>c</p><article id=x><p>d<b>e</article>f")
    tags = [{f for f in b.features if f[:2] in ("a:", "c:")} for b in found]
    assert tags[0] == {"a:body", "a:nav", "a:ul", "a:li"} and tags[1] == {"a:body", "a:p", "c:one", "c:two", "c:three"} and tags[2] == {"a:body", "a:p"}
    assert tags[3] == {"a:body", "a:article", "a:p", "c:x"} and tags[4] == {"a:body"} and found[3].text == "de"


def test_viterbi_finds_the_best_labels():
    rng = random.Random(2)
    for _ in range(30):
        f = Field({str(k): rng.uniform(-2, 2) for k in range(5)}, np.array([[[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)] for _ in range(2)]))
        found = [Block("", rng.sample("01234", 2), rng.randint(0, 1), False) for _ in range(rng.randint(1, 7))]

        def score(labels):
            own = sum(f.weights[x] for b, y in zip(found, labels) if y for x in b.features)
            return own + sum(f.change[found[k].container == found[k - 1].container][labels[k - 1]][labels[k]] for k in range(1, len(found)))

        best = max(itertools.product((False, True), repeat=len(found)), key=score)
        assert f.labels(found) == list(best)
    assert f.labels([]) == []


def test_held_out_pages(model):
    """Pages of another seed: almost all blocks right."""
    good = total = 0
    for page in labelled_pages(200, 1234):
        found = blocks(page)
        good += sum(y == b.gold for y, b in zip(model.labels(found), found))
        total += len(found)
    assert good / total > 0.98


P = "<p>{}</p>"
LONG = "It was late in the evening when the ship came in, and nobody had seen her for a year. The harbour lay still."
PAGES = {
    "semantic": (f"<body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><article><h1>Late ships</h1>{P.format(LONG)}{P.format('Short.')}<aside><h3>Related</h3><ul><li><a href=x>Other story</a></ul></aside>{P.format(LONG)}</article></main><footer>&copy; 2020 Site</footer>", ["Late ships", LONG, "Short.", LONG]),
    "classes": (f"<body><div class=cookie-banner><p>We use cookies. {LONG}</p><button>OK</button></div><div id=header><a href=/>Site</a></div><div class='post-content'><h2>One</h2>{P.format(LONG)}<div class=advert>{LONG}</div>{P.format(LONG)}</div><div id=sidebar>{P.format(LONG)}</div><div class=comments><div class=comment>{P.format(LONG)}</div><div class=comment>{P.format(LONG)}</div></div><div id=footer>Imprint</div>", ["One", LONG, LONG]),
    "form": (f"<body><article><h1>Form</h1>{P.format(LONG)}<form class=newsletter><p>Sign up for our newsletter</p><input><button>Send</button></form>{P.format(LONG)}<section id=comments><h3>2 comments</h3><article class=comment><p>{LONG}</p></article></section></article>", ["Form", LONG, LONG]),
    "broken": (f"<nav><ul><li><a href=a>a</a><li><a href=b>b</a></ul></nav><article><h1>Cut</h1><p><b>{LONG}<br><p>{LONG}<p>End", ["Cut", LONG, LONG, "End"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_written_pages(model, name):
    page, want = PAGES[name]
    assert main_text(page, model).split("\n\n") == want


def test_given_pages(spark, sf):
    """The pages of the tables have their main text in one article element without anything else."""
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in rows.collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        cut = (html.unescape(re.sub(r"<[^>]*>", " ", p)).split() for p in re.split(r"</?(?:p|h1)>", inside))
        want[r["page_id"]] = (r["url"], "\n\n".join(" ".join(p) for p in cut if p))
    got = {r["page_id"]: (r["url"], r["text"]) for r in extract(rows).collect()}
    assert got == want


def test_cases(spark, model):
    deep = "<div>" * 3000 + "<p>" + LONG + "</p>"
    rows = [(None, None, None), (1, "u", ""), (1, "u", PAGES["broken"][0]), (2, None, "<nav>x</nav>"), (3, "v", deep), (4, "w", "<article>" + P.format(LONG) * 3000), (5, "w", "<!-- open"), (6, "w", "<script>x"), (7, "w", "<p")]
    got = extract(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", text string, n_chars int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == sorted([(i, u, t := main_text(h, model), len(t)) for i, u, h in rows], key=repr)
    assert next(r for r in found if r[0] == 4)[2] == "\n\n".join([LONG] * 3000)
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0
