"""HTML extraction where the mark of an article and the tag-path ratios disagree."""

import pytest

from tidemark.llm.html_text import main_text

BODY = "".join(f"<p>Paragraph {i} says this, that, and more. It goes on for a while, as texts do; then it ends.</p>" for i in range(8))
TEASER = '<article class="card"><h3>Teaser</h3><p>Read on here.</p></article>'


def test_main_text_outside_a_teaser_article():
    text = main_text(f"<html><body><div id=x>{BODY}</div>{TEASER}</body></html>")
    assert text.count("Paragraph") == 8 and "Read on" not in text


def test_main_article_among_teaser_articles():
    text = main_text(f"<html><body><main><article><h1>Head</h1>{BODY}</article>{TEASER * 3}</main></body></html>")
    assert text.startswith("Head Paragraph 0") and text.count("Paragraph") == 8 and "Teaser" not in text and "Read on" not in text


def test_several_articles_of_a_size_all_stay():
    text = main_text("<body>" + "".join(f"<article><h2>Head {i}</h2>{BODY}</article>" for i in range(3)) + "</body>")
    assert text.count("Paragraph") == 24 and all(f"Head {i}" in text for i in range(3))


def test_links_in_an_article():
    links = "".join(f"<li><a href=/{i}>Item number {i}</a></li>" for i in range(9))
    text = main_text(f"<article><h1><b>Head</b></h1>{BODY}<p>With <a href=/x>a link</a> inside it, as sentences have.</p><h2>Short</h2><ul>{links}</ul></article>")
    assert "With a link inside it" in text and text.startswith("Head Paragraph 0") and "Short" in text and "Item number" not in text


@pytest.mark.parametrize("page", [
    "<html class=form><body class='has-sidebar login'><article>{}</article></body></html>",
    "<html><body class='page nav'><div id=x>{}</div></body></html>",
    "<html><body><form action=/><div id=x>{}</div></form><form><p>Sign up</p></form></body></html>",
    "<html><body><form action=/><article>{}</article></form></body></html>",
    "<html><body><div class='widget sidebar'><div><article>{}</article></div></div></body></html>",
])
def test_wrappers_are_not_apart(page):
    text = main_text(page.format(BODY))
    assert text.count("Paragraph") == 8 and "Sign up" not in text


def test_marked_comments_and_asides_stay_apart():
    text = main_text(f"<article>{BODY}<section class=comments><article>{BODY.replace('Paragraph', 'Comment')}</article></section></article><aside><article>{BODY.replace('Paragraph', 'Side')}</article></aside>")
    assert text.count("Paragraph") == 8 and "Comment" not in text and "Side" not in text
