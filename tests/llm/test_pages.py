"""HTML extraction, URL filters, and the pipeline."""

from tidemark.llm import html_text, url_filter
from tidemark.llm.queries import URL_RULES


def test_main_text_leaves_out_what_is_apart():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies.</div>
    <article><h1>Head &amp; line</h1><p><b>First</b> par<i>a</i>graph,&nbsp;with  space.<br>After break<p>Second &lt;3<div class="ad-slot">Buy!</div><form><p>Sign up</p></form><section class="comments"><p>Nice post, a long comment with words.</p></section></article>
    <aside><p>Side text, long enough to look like a real paragraph of an article.</p></aside><footer>Footer text, which is rather long and has commas, too.</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line First paragraph, with space. After break Second <3"


def test_main_text_without_a_marked_article():
    body = "".join(f"<p>{'A sentence with words, and more of them. ' * 6}</p>" for _ in range(4))
    links = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(12))
    page = f"<html><body><div><ul>{links}</ul></div><div id=x>{body}</div><div class=footer>Terms, privacy.</div></body></html>"
    text = html_text.main_text(page)
    assert text.count("A sentence") == 24 and "Item" not in text and "Terms" not in text


def test_pages_that_are_null_empty_cut_off_or_very_long(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>cut off <b>here"), (4, "u", "<article>" + "<p>word " * 20_000), (5, "u", "plain & text"), (None, "u", "<script>x"), (5, "u", "plain & text")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 7 and by[1] == by[2] == by[None] == "" and by[3] == "cut off here" and by[4].count("word") == 20_000 and by[5] == "plain & text"
    assert all(r.n_chars == len(r.text) for r in got)


def test_rules_longest_first_and_url_parts(spark):
    urls = {
        "https://A.Example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://example.com/de/": ("example.com", "/de/", "com/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "ftp://x.net/es/5": ("x.net", "/es/5", "net/es/", "block"),
        "https://x.com": ("x.com", "", None, "allow"),
        "https://x.com?a=/b": ("x.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "a://b/c://d/e": ("b", "/c://d/e", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'x' AS host", "1 AS branch")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, URL_RULES).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [(i, f"https://h.org/spam/{i}") for i in range(40)] + [(100 + i, f"https://h.org/news/{i}") for i in range(40)] + [(200, "https://h.org/spam/about"), (201, "https://other.org/spam/7")]
    rules = [("block", f"h.org/spam/{i}") for i in range(30, 40)] + [("allow", "h.org/news/1")]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()}
    assert all(got[i] == "block" for i in range(40)) and all(got[100 + i] == "allow" for i in range(40))
    assert got[200] == "allow" and got[201] == "allow"


def test_pipeline_keeps_columns_and_one_of_each_group(spark):
    import corpus_pipeline as cp
    from tidemark.llm.queries import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for i, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        before, after = docs.count(), out.count()
        assert 0 < after <= before, i
        docs = out
    texts = [r.text for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    assert {r.doc_id for r in cp.STAGES[-1][1](spark, docs, sf).collect()} == {r.doc_id for r in docs.collect()}
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0
