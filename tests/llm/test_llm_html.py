"""Pages that leave out end tags of hidden elements."""

import time

import numpy as np
import pytest

from feedlens.llm import html


def said(page):
    return [node.said for node in html.Page(page).nodes if node.tag == "#text"]


def test_omitted_end_tags_of_hidden_elements():
    article = "<article><p>one<p>two</article>"
    for before in (
        "<html><head><title>t</title><body>", "<html><head><title>t</title>", "<head><meta charset=x><script>a</script>",
        "<form><select><option>a<option>b</select></form>", "<form><select><optgroup><option>a<optgroup><option>b</form>",
        "<datalist><option>a<option>b</datalist>", "<div><noscript>a</div>", "<div><object><p>a</p></div>", "<ul><li><button>a</ul>",
        "<div><svg><path></div>", "<svg><title>t</title><path/>", "<select><option>a<input>", "<head><noscript><link><body>",
    ):
        assert said(before + article) == ["one", "two"], before
    assert said("<head><title>t</title>text") == ["text"]


def test_hidden_elements_stay_hidden():
    for hidden in (
        "<noscript><div>a</div><p>b</noscript>", "<button><div>a</div>b</button>", "<svg><text>a</text><foreignObject><div>b</div></foreignObject></svg>",
        "<select><option>a</option></select>", "<head><noscript><div>a</div></noscript></head>", "<object><object>a</object>b</object>",
    ):
        assert said(f"<div>x</div>{hidden}<div>y</div>") == ["x", "y"], hidden


def test_deep_pages_and_open_comments():
    started = time.process_time()
    for opening in ("<div>", "<div><li>", "<table><tr><td>", "<div><p>", "<svg><foreignObject>", "<ul><li>x"):
        html.main_text("x " + opening * 20_000 + "deep", [])
    assert time.process_time() - started < 30
    assert said("<p>un<!-- no end <b>x") == ["un"] and said("a<!-- b -->c") == ["ac"]


def test_copies_and_unmarked_pages_are_no_sample(spark):
    rows = [(1, "<article><p>some words</article>")] * 500 + [(2, f"<p>unmarked {i}") for i in range(300)] + [(3, "<main>\nother words</main>"), (4, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    learned = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(html, "train", lambda texts: learned.extend(texts) or [])
        html.fit(pages)
    assert sorted(learned) == sorted({rows[0][1], rows[-2][1]})


def test_pages_are_scored_together_as_alone(monkeypatch):
    """Many small pages take few calls of the trees; each gets the text that it gets alone."""
    rng, calls = np.random.default_rng(8), []
    article = [("h1", "A title"), ("p", "Some words of the text, and more of them here."), ("p", "Last ones.")]
    pages = [html.variant(rng, article, ["Home About us", "Buy now and save a lot today"]) for _ in range(60)] + [None, "", "<p>x</p>" * 300, "no markup"]
    pages = [pages[i] for i in rng.permutation(len(pages))]
    nodes = [html.Page(page or "").nodes for page in pages]
    weights = rng.normal(0, 1, html.features(nodes[0]).shape[1])

    def tree(x):
        calls.append(len(x))
        return (np.floor(x) * weights).sum(axis=1)

    assert (html.features(*nodes) == np.concatenate([html.features(page) for page in nodes])).all()
    alone = [html.main_text(page, [tree]) for page in pages]
    calls.clear()
    assert list(html.main_texts(pages, [tree])) == alone and calls == [sum(map(len, nodes))]
    monkeypatch.setattr(html, "NODES_TOGETHER", 200)
    calls.clear()
    assert list(html.main_texts(pages, [tree])) == alone and sum(calls) == sum(map(len, nodes)) and 1 < len(calls) < len(pages) / 2
    monkeypatch.setattr(html, "CHARS_TOGETHER", 1)
    calls.clear()
    assert list(html.main_texts(pages, [tree])) == alone and len(calls) == len([page for page in pages if page]) + 1 - bool(pages[-1])
