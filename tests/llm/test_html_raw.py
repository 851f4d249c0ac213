import itertools
import math
import time

import pytest

from chorale.llm import html_model

PAGE = '<html><body><div class="nav"><a href="/x">Home</a></div><article><h1>Title here</h1>{}<p>First paragraph with some words.</p><p>Second one.</p></article></body></html>'
STORY = "Title here\nFirst paragraph with some words.\nSecond one."


@pytest.fixture(scope="module")
def model():
    return html_model.TreeModel(html_model.labelled_pages(1500))


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++)f(i)</script>",
        "<script>if (a<b && c>d) x = '<!--';</script>",
        "<SCRIPT type=\"text/javascript\">s = \"it's <p>\"; a<b</Script >",
        "<script>x = '</scripts>'; y<z</script\n>",
        "<style>a<b {} <!-- </style>",
    ],
)
def test_scripts_and_styles_end_at_their_closing_tag(model, raw):
    assert model.extract(PAGE.format(raw)) == STORY


def test_script_without_an_end_takes_the_rest(model):
    assert model.extract(PAGE.format("<p>Before it.</p><script>a<b")) == "Title here\nBefore it."


def test_a_quote_outside_a_value_is_a_character(model):
    page = "<article><h1>Title here</h1><p title=it's>Hello one</p><p>Two here</p><p>don't stop</p><p \"x'>Last</p></article>"
    assert model.extract(page) == "Title here\nHello one\nTwo here\ndon't stop\nLast"
    page = "<article><h1>Title here</h1><p title=\"a > b\" data-u=/x/>Hello one</p><div class='y'>Two here</div><p =\"z\">Last one</p></article>"
    assert model.extract(page) == "Title here\nHello one\nTwo here\nLast one"


def test_boxes_in_a_line_do_not_part_it(model):
    story = PAGE.format("<p>A <math><mi>x</mi><mo>+</mo><mn>1</mn></math> formula, <object>an object</object>, a <img src=x> picture and <svg><title>icon</title><path d='M0'/></svg> a drawing.</p>")
    assert model.extract(story) == "Title here\nA x+1 formula, an object, a picture and a drawing.\nFirst paragraph with some words.\nSecond one."


@pytest.mark.parametrize("element", ["noscript", "iframe", "template", "canvas", "video", "button"])
def test_fallbacks_are_judged_and_what_follows_stays(model, element):
    assert model.extract(PAGE.format(f"<{element}>Please turn scripts on.</{element}>")) == STORY


@pytest.mark.parametrize("element", ["svg", "template", "object", "math", "canvas"])
def test_an_element_without_an_end_does_not_drop_the_page(model, element):
    assert "Second one." in model.extract(PAGE.format(f"<p>Before it <{element} class='x'></p>"))


@pytest.mark.parametrize(
    ("broken", "text"),
    [
        ("<!-->Shown one.<!-- a --!>", "Shown one."),
        ("<p>Cells of text<table><tr><td>one<td>two<tr><td>three</table>", "Cells of text\none\ntwo\nthree"),
        ("<ul><li>first item<ul><li>inner item</ul><li>second item</ul>", "first item\ninner item\nsecond item"),
        ("<p>one</p></div></li></foo></ p></>", "one"),
        ("<p>1 < 2 and a<b", "1 < 2 and a"),
    ],
)
def test_broken_markup(broken, text):
    _, runs = html_model.parse(broken)
    assert "\n".join(" ".join("".join(t for _, t in run).split()) for run in runs) == text


def test_deep_and_long_pages_take_linear_time():
    start = time.process_time()
    html_model.parse("<div>" * 100_000 + "<p>x" + "</span></foo></li></td>" * 100_000)
    html_model.parse("<p a=\"" * 50_000 + "<a b='" * 50_000 + "<!--" * 50_000 + "<" * 100_000)
    assert time.process_time() - start < 20


def test_empty_tables_nulls_repeated_rows_and_clashing_names(spark):
    names = "page_id long, url string, html string, text string, n_chars long"
    assert html_model.extract(spark.createDataFrame([], names)).count() == 0
    page = PAGE.format("")
    rows = [(1, "u", page, "t", 5), (1, "u", page, "t", 5), (None, None, None, None, None), (2, "u", "<p>" * 3, "", 0)]
    got = html_model.extract(spark.createDataFrame(rows, names))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", STORY, len(STORY))] * 2 + [(None, None, "", 0), (2, "u", "", 0)], key=str)


def _brute_marginals(model, nodes):
    """Content probabilities by adding up all labellings of a small tree."""
    total, content = 0.0, [0.0] * len(nodes)
    local = [math.exp(sum(model.weights.get(f, 0.0) for f in found)) for found in html_model.features(nodes)]
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        weight = 1e-3 if labels[0] else 1.0
        for k, n in enumerate(nodes):
            weight *= local[k] if labels[k] else 1.0
            if n.parent >= 0:
                weight *= model.pairs.get(n.tag, model.pairs[""])[labels[n.parent]][labels[k]]
        total += weight
        content = [c + weight * x for c, x in zip(content, labels)]
    return [c / total for c in content]


@pytest.mark.parametrize("page", ["<div><p>a b c</p><ul><li><a href=x>l</a></ul></div>", "<article><h1>T</h1><p>words of it</p></article><footer>me</footer>", "<nav class=menu>x</nav><main><p>y</p></main>"])
def test_messages_give_the_marginals_of_all_labellings(model, page):
    nodes, _ = html_model.parse(page)
    assert model.marginals(nodes) == pytest.approx(_brute_marginals(model, nodes), rel=1e-6)


def test_held_out_pages(model):
    """Characters of text that are judged as their label says, on pages that the model was not trained from."""
    right = total = 0
    for html in html_model.labelled_pages(150, seed=8):
        nodes, _ = html_model.parse(html)
        labels: list[int] = []
        for n, p in zip(nodes, model.marginals(nodes)):
            labels.append(int(n.mark) if n.mark else labels[n.parent] if n.parent >= 0 else 0)
            right += n.text * ((p > 0.5) == labels[-1])
            total += n.text
    assert right / total > 0.95, right / total
