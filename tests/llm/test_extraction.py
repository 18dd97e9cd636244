"""Main text of labelled pages, and the minimum cut that decides it."""

import itertools
import random

import pytest

from parcelgraph.llm import extraction

LONG = "A sentence of some length stands here, with commas and a stop. Another one follows it, so that this is a paragraph."
PARA = f"<p>{LONG}</p>"


def page(inner, before="", after=""):
    return f"<html><head><title>t</title></head><body><header><a href=/>Home</a></header><nav><a>One</a> <a>Two</a></nav>{before}<article><h1>Title</h1>{PARA}{inner}{PARA}</article>{after}<footer>{PARA}</footer></body></html>"


def texts(html):
    return extraction.main_text(html).split("\n\n")


@pytest.mark.parametrize("name", ['class="related-work"', 'class="legal-analysis"', 'class="menu-planning"', 'class="search-methods"', 'id="related-work"'])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_a_doubtful_name_does_not_outweigh_paragraphs(name, tag):
    inner = f"<{tag} {name}>{PARA.replace('A sentence', 'Inner text')}</{tag}>"
    assert texts(page(inner)) == ["Title", LONG, LONG.replace("A sentence", "Inner text"), LONG]


def test_an_id_of_a_paragraph_is_no_evidence():
    assert texts(page(f'<p id="search">{LONG}</p><h2 id=comments>On comments</h2>')) == ["Title", LONG, LONG, "On comments", LONG]


@pytest.mark.parametrize("name", ['class="related-work"', 'class="search-methods"'])
def test_a_doubtful_name_with_links_goes(name):
    inner = f"<div {name}><ul><li><a href=1>First other page</a></li><li><a href=2>Second</a></li></ul></div>"
    assert texts(page(inner)) == ["Title", LONG, LONG]


@pytest.mark.parametrize("name", ["comments", "kommentare", "reader-feedback", "related", "cookie-notice", "newsletter", "ad", "social-share"])
def test_what_is_plainly_away_goes_however_long(name):
    inner = f'<div class="{name}">{PARA * 12}</div>'
    assert texts(page(inner)) == ["Title", LONG, LONG]
    assert texts(page("", after=inner)) == ["Title", LONG, LONG]


def test_formulas_and_objects_keep_their_text():
    inner = "<p>The area is <math><mi>x</mi><mo>+</mo><mi>y</mi></math> of it, as the text says, and no more than that.</p><object data=x><p>What stands for the object, a sentence with a stop.</p></object>"
    assert texts(page(inner))[2:4] == ["The area is x+y of it, as the text says, and no more than that.", "What stands for the object, a sentence with a stop."]


def test_neighbours_decide_short_blocks():
    """A short line goes with what is around it: kept among paragraphs, dropped in a footer."""
    own = lambda html: {b.text: (b.score > 0, b.label) for b in extraction.label_blocks(html)}
    found = own(page("<div>Yes</div>"))
    assert found["Yes"] == (False, True)
    footer = [b for b in extraction.label_blocks(page("")) if b.text == LONG][-1]
    assert footer.score > 0 and not footer.label


def test_a_page_without_article():
    html = f"<body><div class=menu><a>x</a></div><div id=c><h2>Head</h2>{PARA}<ul><li>one item, of several words.</li></ul>{PARA}</div><div class=sidebar>{PARA}</div></body>"
    assert texts(html) == ["Head", LONG, "one item, of several words.", LONG]
    assert extraction.main_text("") == "" and extraction.main_text("<nav>x</nav>") == ""


@pytest.mark.parametrize("seed", range(6))
def test_labels_are_the_cheapest_of_all(seed):
    """The labelling of a small page costs what the best of all labellings of its graph does."""
    draw = random.Random(seed)
    seen = []
    cut = extraction.minimum_cut

    def spy(scores, ties):
        seen.append((scores, ties, cut(scores, ties)))
        return seen[-1][2]

    part = lambda: draw.choice([PARA, "<p>ab</p>", "<div class=related-work><p>x y, z.</p></div>", "<aside><p>side</p></aside>", "<ul><li><a>l</a></li></ul>"])
    extraction.minimum_cut = spy
    try:
        extraction.label_blocks(f"<body><article>{part()}{part()}</article>{part()}{part()}</body>")
    finally:
        extraction.minimum_cut = cut
    for scores, ties, sides in seen:
        cost = lambda s, scores=scores, ties=ties: sum(-c if k and c < 0 else c if not k and c > 0 else 0 for c, k in zip(scores, s, strict=True)) + sum(w for a, b, w in ties if s[a] != s[b])
        assert len(scores) <= 16
        assert cost(sides) == pytest.approx(min(cost(s) for s in itertools.product([False, True], repeat=len(scores))), abs=0.01)
