"""Ratios, not tags or class words, decide what is main text; marks and class words only weigh in."""

import os
import re

import duckdb
import pytest

from tidemark.llm import html_text
from tidemark.llm.html_text import main_text

PAGES = "/root/testdata/sf0.01/pages.parquet"
BODY = "".join(f"<p>Paragraph {i} says this, that, and more. It goes on for a while, as texts do; then it ends.</p>" for i in range(8))
LEGAL = " ".join(f"Clause {i} of these terms applies to all users of the site, as said." for i in range(10))


@pytest.mark.skipif(not os.path.isfile(PAGES), reason="no test tables")
def test_no_given_page_needs_the_class_words(monkeypatch):
    pages = [x for (x,) in duckdb.sql(f"SELECT html FROM '{PAGES}'").fetchall()]
    before = [main_text(x) for x in pages]
    monkeypatch.setattr(html_text, "APART_WORDS", re.compile(r"(?!x)x"))
    assert [main_text(x) for x in pages] == before
    for page, text in zip(pages, before):
        nodes = html_text.text_nodes(page)
        every = {(x.path, x.classed, x.main) for x in nodes if x.text.strip() and not x.apart}
        assert html_text.content_paths(nodes) < every  # the ratios leave out what tags and class words keep


def test_a_short_article_beside_a_long_unmarked_block():
    for legal in (f"<div id=q>{LEGAL}</div>", f"<div id=q><p>{LEGAL}</p></div>"):
        assert main_text(f"<body><article><h1>Short news</h1><p>One sentence is all that this article has to say.</p></article>{legal}</body>") == "Short news One sentence is all that this article has to say."
        assert main_text(f"<body>{legal}<article><p>One sentence is all that this article has to say.</p></article></body>") == "One sentence is all that this article has to say."


def test_a_short_list_of_links_in_an_article_stays():
    text = main_text(f"<article><h1>Head</h1>{BODY}<ol><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ol></article>")
    assert text.startswith("Head Paragraph 0") and text.endswith("First source Second source")


def test_text_whose_wrapper_has_a_telling_class():
    assert main_text(f"<body><div class='content-sidebar'>{BODY}</div><div>Some words</div></body>").count("Paragraph") == 8
    assert main_text("<body><div class=notice><p>Only this notice is on the page, and nothing else.</p></div></body>") == "Only this notice is on the page, and nothing else."


def test_classed_text_in_an_article_stays_out():
    text = main_text(f"<article>{BODY}<div class='ad-slot'>Buy this now, and save. It is the best, as all say; do not wait.</div><section class=comments>{BODY.replace('Paragraph', 'Comment')}</section></article>")
    assert text.count("Paragraph") == 8 and "Buy" not in text and "Comment" not in text


def test_unmarked_advert_between_paragraphs_of_an_unmarked_page():
    text = main_text(f"<body><div id=a>{BODY}</div><div id=b><span>Cheap flights here</span></div><div id=c>{BODY.replace('Paragraph', 'Section')}</div></body>")
    assert text.count("Paragraph") == 8 and text.count("Section") == 8 and "Cheap" not in text
