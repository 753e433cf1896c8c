import html
import re

import numpy as np
import pytest

from parallax.llm.dom_blocks import leaf_blocks
from parallax.llm.html_crf import BlockCRF, extract_text, features, train_blocks
from parallax.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return train_blocks()


def test_blocks_of_odd_markup():
    page = ('<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><!-- <p>no</p> -->'
            '<P Class="aBig x-y">a <b>b&amp;c<br>d\n\n e</p>tail<p>one<p>two<ul><li>x<li>y</ul><a href="/">l</a> 3 < 4 &copy; <p unfinished')
    got = [(b.text, b.tags[-1]) for b in leaf_blocks(page)]
    assert got[:1] == [("a b&c d e", "b")] or got[0][0] == "a b&c d e"
    assert [t for t, _ in got] == ["a b&c d e", "tail", "one", "two", "x", "y", "l 3 < 4 ©"]
    assert {"big", "x", "y"} <= leaf_blocks(page)[0].names
    assert leaf_blocks(None) == [] and leaf_blocks("") == [] and [b.text for b in leaf_blocks("plain  text")] == ["plain text"]


def test_viterbi_against_all_labellings(model):
    from itertools import product

    blocks = leaf_blocks(labelled_pages(1, seed=50)[0])[:9]
    z = [sum(model.weights.get(f, 0.0) for f in features(b)) for b in blocks]
    score = lambda y: model.ends[y[0]] + sum(a * b for a, b in zip(z, y)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:]))
    best = max(product((0, 1), repeat=len(blocks)), key=score)
    assert abs(score(tuple(model.decode(blocks))) - score(best)) < 1e-9


def test_held_out_pages(model):
    right, total, wrong_pages = 0, 0, 0
    pages = labelled_pages(300, seed=99)
    for p in pages:
        blocks = [b for b in leaf_blocks(p) if b.label is not None]
        got = model.decode(blocks)
        ok = [str(y) == b.label for b, y in zip(blocks, got)]
        right, total, wrong_pages = right + sum(ok), total + len(ok), wrong_pages + (not all(ok))
    print(right / total, wrong_pages)
    assert right / total > 0.98


def expected(page):
    """The article of the generated pages, block by block."""
    body = page.split("<article>", 1)[1].split("</article>")[0]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in [body] for x in re.split(r"</?(?:p|h1)>", x.replace("<br>", " "))]
    return "\n\n".join(p for p in parts if p)


def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_text(pages, model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    bad = [r.page_id for r in rows if got[r.page_id].text != expected(r.html)]
    assert not bad, (len(bad), bad[:5], got[bad[0]].text[:300], expected([r for r in rows if r.page_id == bad[0]][0].html)[:300])
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_page_kinds(model):
    text = "<p>Long enough sentences are here, and they say things. Another one follows it.</p><p>More of the same text stands in this place, with some words.</p>"
    other = {
        "nav": '<nav><a href="/">Home</a> <a href="/b">Blog</a></nav>', "cookie": '<div class="cookie-notice">We use cookies to improve this site. Accept them.</div>',
        "ad": '<div class="advertisement">Buy this now. It is cheap.</div>', "side": '<aside><h3>Related</h3><ul><li><a href="/1">One post</a></li></ul></aside>',
        "form": "<form><label>Mail</label><input><button>Send</button></form>", "comments": '<section class="comments"><h2>Comments</h2><div class="comment"><p>I like this text. It says it all, really.</p></div></section>',
        "footer": "<footer><p>© 2020 Site. All rights reserved.</p></footer>", "header": '<header><a href="/">Site name</a></header>',
    }
    want = "Long enough sentences are here, and they say things. Another one follows it.\n\nMore of the same text stands in this place, with some words."
    for name, part in other.items():
        page = f"<html><body>{part}<article>{text}</article></body></html>" if name in ("nav", "header", "cookie") else f"<html><body><article>{text}</article>{part}</body></html>"
        assert model.extract(page) == want, name


def test_odd_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" + "word " * 200_000), (3, "u", "<p>a</p>"), (None, "u", "<article><p>Some words stand here, and they go on.</p></article>")]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int").repartition(2)
    got = extract_text(pages, model).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got if r.page_id in (1, 2)) == [0, 0]
    assert extract_text(pages.limit(0), model).count() == 0


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_raw_elements_without_end_tag():
    tail = "<p>after</p><p>more</p>"
    assert texts('<p>before</p><svg viewBox="0 0 1 1" />' + tail) == ["before", "after", "more"]
    assert texts('<svg/>' + tail + "<svg><text>no</text></svg><p>end</p>") == ["after", "more", "end"]
    for tag in ("svg", "noscript", "iframe", "template", "title"):
        assert texts(f"<p>before</p><{tag}>{tail}") == ["before", "after", "more"], tag
        assert texts(f"<p>before</p><{tag}>{tail}<{tag}>no</{tag}><p>end</p>") == ["before", "after", "more", "end"], tag
        assert texts(f"<p>before</p><{tag}>no</{tag.upper()} >{tail}") == ["before", "after", "more"], tag
    for tag in ("script", "style", "textarea"):
        assert texts(f"<p>before</p><{tag}>{tail}") == ["before"], tag


def test_nested_raw_elements():
    assert texts("<svg><g><svg><text>a</text></svg><text>no</text></g></svg><p>yes</p>") == ["yes"]
    assert texts('<svg><svg/><style>a{b:"<svg>"}</style><!-- <svg> --><text t="<svg>">no</text></svg><p>yes</p>') == ["yes"]
    assert texts("<template><template>a</template><p>no</p></template><p>yes</p>") == ["yes"]
    assert texts("<svg>" * 3000 + "<p>yes</p></svg><p>end</p>")[-1] == "end"


def test_head_without_end_tag(model):
    for head in ("<head><meta charset=utf-8><title>T</title><style>p{}</style>", "<head><title>T</title><noscript><img></noscript><link rel=a href=b>\n"):
        assert texts(f"<html>{head}<body><p>one</p><div>two</div></body></html>") == ["one", "two"]
        assert texts(f"<html>{head}<p>one</p>two<p>three") == ["one", "two", "three"]
        assert texts(f"{head}one <b>two</b>") == ["one two"]
        assert texts(f"{head}</head>one") == ["one"]
    text = "<article><p>Long enough sentences are here, and they say things. Another one follows it.</p></article>"
    assert model.extract(f"<head><title>T</title><body>{text}") == model.extract(f"<head><title>T</title></head><body>{text}") != ""
