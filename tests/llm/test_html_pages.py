"""Extraction where pages are copies, where the article is marked, and where marks lie around text."""

from gridframe.llm import op08_html as pages_html


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in pages_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_do_not_vote(spark):
    page = "<html><body><div>Site name</div><div>Site motto</div><div><p>First {0}</p><p>Second {0}</p></div></body></html>"
    rows = [(1, "http://one/1", page.format("x"))] * 3
    rows += [(10 + i, f"http://half/{i}", page.format("copied")) for i in range(4)]
    rows += [(20 + i, f"http://half/x{i}", page.format(f"own {i}").replace("<html>", f"<html><!-- {i % 2} -->")) for i in (1, 2, 3)]
    got = extracted(spark, rows)
    assert got[1] == "Site name\n\nSite motto\n\nFirst x\n\nSecond x"
    assert all(got[10 + i] == "First copied\n\nSecond copied" for i in range(4))
    assert all(got[20 + i] == f"First own {i}\n\nSecond own {i}" for i in (1, 2, 3))


def test_template_decides_where_articles_are_marked(spark):
    page = "<body><div>Site name</div><article><h1>Title {0}</h1><p>Read our rules</p><p>Text {0}</p></article><div>Other {0}</div></body>"
    got = extracted(spark, [(i, f"http://h/{i}", page.format(i)) for i in range(4)] + [(9, "http://alone/9", "<body><article>Teaser</article><div>The long main text of this page</div></body>")])
    assert all(got[i] == f"Title {i}\n\nText {i}\n\nOther {i}" for i in range(4))
    assert got[9] == "Teaser\n\nThe long main text of this page"


def text_of(page):
    return "|".join(text for _, text, off, _ in pages_html.walk(page) if text and not off)


def test_marks_take_no_text_beside_them():
    assert text_of('<p>Real text <span class="share">x</span> more</p>') == "Real text more"
    assert text_of('<p>Real <span class="ad">a <span>b</span> c</span> more</p>') == "Real more"
    assert text_of('<p>Real <span class="ad">a</p><p>more</p>') == "Real|more"
    assert text_of('<div>Real <span class="ad">a<p>b</p><p>c</p><div>d</div>e</span> more</div>') == "Real|more"
    assert text_of('<div>Real <span class="ad">a</div><div>more</div>') == "Real|more"
    assert text_of('<div class="layout with-sidebar"><p>Text</p><div class="sidebar">no</div></div>') == "Text"
    assert text_of('<form><p>The text of the page</p><div class="social-share">no</div></form><nav>Menu with very many words that are longer than it</nav>') == "The text of the page"
    assert text_of('<article>Short</article><div class="comments">Many long comments on it</div>') == "Short"


def test_names_of_place_and_shape_beside_a_mark():
    for name in "comments-list comment-section user-comments post-comments site-header main-nav sidebar-left cookie-bar ad-box top-banner".split():
        assert text_of(f'<div><h1>Title</h1><p>Text of the page</p></div><div class="{name}"><p>reader says hi</p></div>') == "Title|Text of the page"
        assert text_of(f'<div id={name}><p>no</p></div><p>Text of the page</p>') == "Text of the page"
    for name in "with-sidebar has-comments post-header section-header article-footer header-image no-ads adlib entry-content main-content commentary".split():
        assert text_of(f'<div class="{name}"><p>Text</p></div><p>more</p>') == "Text|more"


def test_reader_comments_go_on_hosts_with_a_template(spark):
    page = '<body><div>Site name</div><div>Site motto</div><article><p>Main text {0}</p></article><div class="comments-list"><p>reader {0} says hi</p></div></body>'
    got = extracted(spark, [(i, f"http://h/{i}", page.format(i)) for i in range(4)])
    assert all(got[i] == f"Main text {i}" for i in range(4))


def test_tags_end_where_html_ends_them():
    assert text_of("<p>a <a title=it's href=x>b</a> c</p>") == "a b c"
    assert text_of('<p>a <a title="x > y" data-z=\'<b>\'>b</a></p><!--> <p>c</p>') == "a b|c"
    assert text_of("<p>a</p><!-- x --!><p>b</p><!---><p>c</p>") == "a|b|c"


def test_a_host_of_most_pages_and_an_empty_table(spark):
    """A host dealt in many parts keeps one template; repeated rows, null urls and null ids stay."""
    page = "<body><div>Site name</div><div>Site motto</div><p>Text {0}</p></body>"
    rows = [(i, "http://big/x", page.format(i)) for i in range(40)] + [(None, "http://big/x", page.format("n")), (3, "http://big/x", page.format(3)), (50, None, page.format("alone")), (51, "http://small/", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"] is None, r["page_id"], r["text"], r["n_chars"]) for r in pages_html.extract(table).collect() if r["page_id"] is not None)
    assert got == sorted([(False, i, f"Text {i}", len(f"Text {i}")) for i in [*range(40), 3]] + [(False, 50, "Site name\n\nSite motto\n\nText alone", 33), (False, 51, "", 0)])
    assert [r["text"] for r in pages_html.extract(table).where("page_id is null").collect()] == ["Text n"]
    assert pages_html.extract(table.where("false")).count() == 0
    assert pages_html.heavy_hosts(table.selectExpr("case when url like '%big%' then 'big' else 'other' end as host")).count() == 2


def test_text_of_one_page_alone_is_not_sent_on(spark):
    """A host with a template has three pages at least, so a token on one of them is left out before the join."""
    pages = spark.createDataFrame([("h", "<p>x</p>")], "host string, html string")
    plan = pages_html.templates(pages, spark.createDataFrame([], "host string, parts long"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first_join = next(i for i, line in enumerate(plan) if "2) >= 3" in line and "Filter" in line)
    assert "sum(cast(xxhash64(page" in plan[first_join + 1]
