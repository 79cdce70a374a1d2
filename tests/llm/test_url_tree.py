"""The template tree of the URL filter: wildcards, merges of alike branches, votes, depth, and the SQL of it."""

import random

import duckdb
import pytest

from tidemark.llm import queries, url_filter
from tidemark.llm.queries import URL_RULES

#: What each section of a shop holds, by weight.
SHOP = ["item", "item", "item", "cart", "review"]


def verdicts(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, rules).collect()}
    assert len(got) == len(urls)
    return [got[i].verdict for i in range(len(urls))]


def shop(section, n):
    return [f"https://h.org/{section}/{SHOP[i % len(SHOP)]}/{i}" for i in range(n)]


def test_unlabelled_branch_is_blocked_through_a_merge(spark):
    """Three sections of a kind are labelled, a fourth is like them, a fifth has other pages, a sixth only ids."""
    urls = shop("pills", 60) + shop("casino", 50) + shop("loans", 40) + shop("poker", 30)
    others = [f"https://h.org/blog/{x}/{i}" for x in ("post", "author", "tag") for i in range(10)] + [f"https://h.org/archive/{i}" for i in range(30)]
    rules = [("block", f"h.org/{x}/") for x in ("pills", "casino", "loans")]
    got = verdicts(spark, urls + others, rules)
    assert got == ["block"] * len(urls) + ["allow"] * len(others)
    assert verdicts(spark, shop("poker", 30) + others, rules) == ["allow"] * (30 + len(others))


def test_two_labelled_branches_are_not_enough_and_mixed_ones_stay_apart(spark):
    rules = [("block", "h.org/pills/"), ("block", "h.org/casino/"), ("allow", "h.org/books/")]
    urls = shop("pills", 60) + shop("casino", 50) + shop("books", 55) + shop("poker", 30)
    assert verdicts(spark, urls, rules) == ["block"] * 110 + ["allow"] * 85


@pytest.mark.parametrize("sections", [5, 24, 25, 90, 400])
def test_verdicts_do_not_flip_as_a_host_grows(spark, sections):
    """Sections of ids only say nothing about each other, few or many, literal or wildcard."""
    urls = [f"https://x.net/{'es' if k == 0 else 'fr' if k == 1 else f's{k}'.translate(str.maketrans('0123456789', 'abcdefghij'))}/{i}" for k in range(sections) for i in range(3)]
    assert verdicts(spark, urls, URL_RULES) == ["block"] * 6 + ["allow"] * (3 * sections - 6)


def test_variable_segments_at_depth_become_wildcards(spark):
    """User names are rare at their place; the pages below them are seen as one, six levels down."""
    name = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(3))
    urls = [f"https://h.org/a/b/c/user/{name(i)}/{kind}" for i in range(150) for kind in ("spam", "about")]
    rules = [("block", f"h.org/a/b/c/user/{name(i)}/spam") for i in range(20)] + [("allow", f"h.org/a/b/c/user/{name(i)}/about") for i in range(20)]
    assert verdicts(spark, urls, rules) == ["block", "allow"] * 150


def test_tree_equals_its_sql(spark):
    rng = random.Random(4)
    pick = lambda *x: rng.choice(x)
    rows = [(i, f"http://{pick('a', 'b', 'www')}.{pick('x', 'y')}.{pick('net', 'org', 'net')}/{pick('es', 'fr', 'en', 'shop', 'u' + 'abcdefgh'[i % 8])}/{pick('item', 'cart', 'p', str(i), 'q')}/{pick(str(i), 'end')}"[: rng.choice([12, 99, 99, 99])]) for i in range(900)]
    rows += [(2000 + 100 * k + i, f"http://z.net/{s}/{SHOP[i % 5]}/{i}") for k, s in enumerate(("es", "fr", "es/old", "it")) for i in range(40)] + [(5000, None), (5001, "no"), (5002, "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    duck = duckdb.connect()
    duck.register("pages", df.toPandas())
    want = duck.sql(queries.OP6_SQL).fetchall()
    assert sorted(map(tuple, url_filter.filter_urls(df, URL_RULES).collect())) == sorted(want)
