import re
import time
from html import unescape

import pytest

from fleetlens.llm import extraction, queries
from fleetlens.llm.extraction import main_text

SF = "/root/testdata/sf0.01"
PROSE = "Some words here, and more of them, until the line is long enough to count as prose."


def plain(html):
    """The test pages have one article element of headings and paragraphs: its blocks without any scoring."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", html, re.DOTALL)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body.replace("<b>", "").replace("</b>", ""))]
    return "\n\n".join(b for b in blocks if b)


def test_named_query_equals_the_article_of_every_page(spark):
    got = {r.page_id: r for r in queries.op10_html_extraction(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == plain(p.html), p.page_id
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


@pytest.mark.parametrize(
    "around",
    [
        "<nav><a href='/'>Home, of all, things, here</a></nav>{}",
        "<header><h2>Site, name, and, more, words here today</h2></header>{}",
        "{}<footer><p>Rights, all of them, reserved, for ever, by us.</p></footer>",
        "{}<aside><p>Look, here, a list of things, that you may like.</p></aside>",
        "<div class='site-sidebar'><p>%s</p></div>{}" % PROSE,
        "{}<section id='comments'><div class='comment'><p>%s</p></div></section>" % PROSE,
        "<div id='cookieNotice'><p>%s</p></div>{}" % PROSE,
        "<form><p>%s</p><input><textarea>a, b</textarea></form>{}" % PROSE,
        "<script>var t='<p>%s</p>';</script><style>p{{}}</style>{}" % PROSE,
        "<!-- <p>%s</p> -->{}" % PROSE,
        "<div style='display: none'><p>%s</p></div>{}" % PROSE,
    ],
)
@pytest.mark.parametrize("holder", ["<article>{}</article>", "<div class='has-sidebar'><div>{}</div></div>", "<main><div>{}</div></main>"])
def test_surroundings_are_left_out(around, holder):
    body = holder.format(f"<h1>Head</h1><p>{PROSE}</p>\n<p>Tom &amp; Ann<br>said: <i>x</i><b>y</b>  z&nbsp;w.</p><ul><li>One, two</ul>")
    text = main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{around.format(body)}</body></html>")
    assert text == f"Head\n\n{PROSE}\n\nTom & Ann said: xy z w.\n\nOne, two"


def test_good_siblings_stay_and_link_lists_go():
    links = "<div>" + "".join(f"<p><a href='/{i}'>A link, with a text, that is rather long {i}</a></p>" for i in range(9)) + "</div>"
    first, second = (f"<div>{f'<p>{PROSE}</p>' * k}</div>" for k in (6, 4))
    assert main_text(f"<body>{links}<div>{first}{second}</div></body>") == "\n\n".join([PROSE] * 10)


def test_broken_markup_and_nothing():
    assert main_text(None) == main_text("") == main_text("<nav>a, b</nav>") == main_text("<p") == ""
    assert main_text("<p>one < two & three &am") == "one < two & three &am"
    assert main_text("<p><b>Head.<br><p>Body, of it.") == "Head.\n\nBody, of it."
    assert main_text("no markup, at all") == "no markup, at all"
    assert main_text("<p title=\"a>b\" x='>'>text here</p><p class=a\">more</p>") == "text here\n\nmore"
    deep = "<div>" * 30000 + f"<p>{PROSE}</p>"
    assert main_text(deep) == PROSE
    assert main_text("<p>" + "word, " * 200000) == ("word, " * 200000).strip()


def test_rows_with_nulls_clashing_names_and_none(spark):
    pages = spark.createDataFrame([(1, None, "t"), (1, f"<p>{PROSE}</p>", None), (None, "", "u")], "page_id long, html string, text string")
    out = extraction.extract(pages)
    assert out.columns == ["page_id", "text"]
    assert sorted(((r.page_id, r.text) for r in out.collect()), key=repr) == [(1, ""), (1, PROSE), (None, "")]
    assert extraction.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-sidebar-wrap'><main>{}</main></div><div class='sidebar'><p>Short, aside.</p></div>",
        "<div class='content-sidebar-wrap'><article>{}</article></div>",
        "<div class='layout sidebar-right'><div>{}</div><div class='sidebar'><a href='/'>Link</a></div></div>",
        "<form action='/'><input><div>{}</div></form>",
        "<div><div class='elementor-widget-container'>{}</div></div>",
        "<div class='promo'><p>Buy, now.</p></div><div class='widget'><div class='modal'>{}</div></div>",
        "<main>{}</main><div class='comments'><article><p>Short, comment.</p></article></div>",
    ],
)
def test_names_do_not_delete_an_article(page):
    body = "<h1>Head</h1>" + f"<p>{PROSE}</p>" * 4
    assert main_text(f"<body>{page.format(body)}</body>") == "\n\n".join(["Head"] + [PROSE] * 4)


@pytest.mark.parametrize("word", ["legal", "notice", "alert", "discussion", "share"])
def test_marked_paragraphs_of_an_article_stay(word):
    page = f"<article><p>{PROSE}</p><p class='{word}'>{PROSE}</p><div class='share'><a href='/'>Send this page to your friends, all of them.</a></div></article>"
    assert main_text(page) == f"{PROSE}\n\n{PROSE}"


def test_formulas_stay():
    assert main_text(f"<p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math></p>") == f"{PROSE} x=1"


def test_other_kinds_beside_the_best_container_stay():
    prose = f"<p>{PROSE}</p>" * 6
    beside = "<ul><li>One</li><li>Two</li></ul><pre>a = 1</pre><blockquote>Said so.</blockquote><table><tr><td>1</td></tr></table>"
    links = "<ul><li><a href='/'>Home</a></li></ul>"
    text = main_text(f"<body><div>{links}<h1>Head</h1><div>{prose}</div>{beside}<div><p>{PROSE}</p></div><h3>See also</h3>{links}</div></body>")
    assert text == "\n\n".join(["Head"] + [PROSE] * 6 + ["One", "Two", "a = 1", "Said so.", "1", PROSE])


def test_long_comments_and_side_texts_stay_out():
    for word in ("comments", "sidebar", "related"):
        page = f"<article><p>{PROSE}</p><p>{PROSE}</p></article><div class='{word}'><div><p>{PROSE}</p></div></div>"
        assert main_text(page) == f"{PROSE}\n\n{PROSE}"
    page = f"<div><p>{PROSE}</p></div><div class='comments'>" + f"<p>{PROSE}</p>" * 20 + "</div>"
    assert main_text(page) == PROSE


BODY = "<h1>Head</h1>" + f"<p>{PROSE}</p>" * 6
TEXT = "\n\n".join(["Head"] + [PROSE] * 6)


@pytest.mark.parametrize(
    "names", ["content ad-free", "cookie-recipe", "post trending-topic", "related-article-body", "story-comments-off", "entry sponsored-by-readers", "no-ads-please consent-free"]
)
@pytest.mark.parametrize("page", ["<div class='{0}'>{1}</div><p>One short line, of some words, follows here.</p>", "<article><section class='{0}'>{1}</section><p>One short line, of some words, follows here.</p></article>"])
def test_a_part_of_a_name_never_beats_prose(names, page):
    assert main_text(page.format(names, BODY)).startswith(TEXT)


@pytest.mark.parametrize("name", ["comment-list", "reader-comments", "related-posts"])
def test_many_small_texts_of_others_stay_out(name):
    others = "".join(f"<li><div><b>User {i}</b><p>{PROSE}</p></div></li>" for i in range(30))
    assert main_text(f"<div><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p></div><ol class='{name}'>{others}</ol>") == f"Head\n\n{PROSE}\n\n{PROSE}"


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 40])
def test_any_number_of_names_around_the_text(depth):
    page = "<div class='widget'>" * depth + BODY + "</div>" * depth
    assert main_text(page) == TEXT
    assert main_text(f"<p>Short, line.</p>{page}").endswith(TEXT)


@pytest.mark.parametrize("head", ["Comments", "3 comments", "Leave a reply", "Reader comments (12)", "Kommentare", "Responses:"])
@pytest.mark.parametrize("form", ["<section><h2>{0}</h2><ol>{1}</ol></section>", "<h2>{0}</h2><ol>{1}</ol>", "<h2>{0}</h2>{1}", "<div><h3>{0}</h3><div>{1}</div></div>"])
def test_comments_without_a_name_go_by_their_heading(head, form):
    others = "".join(f"<li><p>{PROSE}</p></li>" for _ in range(3)) if "<ol>" in form else f"<div><p>{PROSE}</p></div>" * 3
    page = f"<body><article>{BODY}</article>{form.format(head, others)}</body>"
    assert main_text(page) == TEXT


def test_headings_of_the_article_itself_stay():
    page = f"<article><h1>Head</h1><p>{PROSE}</p><h2>Comments</h2><p>{PROSE}</p></article>"
    assert main_text(page) == f"Head\n\n{PROSE}\n\nComments\n\n{PROSE}"
    page = f"<div><div>{BODY}</div><h2>Comments</h2><div><p>{PROSE}</p></div><h2>More</h2><div><p>{PROSE}</p></div></div>"
    assert main_text(page) == f"{TEXT}\n\nMore\n\n{PROSE}"


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<span>" * n + f"<p>{PROSE}</p>" + "</b>" * n,
        lambda n: "<b><div>" + "<span>" * n + "</b>" * n + f"<p>{PROSE}</p>",
        lambda n: "<div>" * n + "</section>" * n + f"<p>{PROSE}</p>",
        lambda n: "<ul>" + "<span>" * n + "<li></li>" * n + f"<li>{PROSE}</li>",
        lambda n: f"<div><div>{BODY}</div>" + "<p>One, short line here.</p>" * n + "</div>",
        lambda n: "<div class='widget'>" * n + f"<p>{PROSE}</p>" * 3,
    ],
)
def test_time_is_linear_in_the_page(page):
    def seconds(n):
        start = time.process_time()
        assert PROSE in main_text(page(n))
        return time.process_time() - start

    seconds(200)
    assert seconds(16000) < 4 * seconds(8000) + 0.5 and seconds(16000) < 8
