"""Main text of hand-written pages: the texts wanted are written by hand, too."""

import time

import pytest

from evidence_lake.llm import op7_html

MENU = "<ul class='menu'>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "Sport", "About us", "Contact")) + "</ul>"
TEXT = "It was a long day in the small town by the river, and nobody had seen the boat come back."
MORE = "In the evening the people went home, one after the other, without a word about it."
LABELLED = f"""<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav>{MENU}</nav>
<article><h1>A day</h1><p>{TEXT}</p><p>{MORE} <a href='x'>More</a></p><blockquote>{TEXT}</blockquote></article>
<div class="sidebar">{MENU}<p>Latest news</p></div><footer><p>All rights</p></footer></body></html>"""


@pytest.fixture(scope="module")
def weights():
    return op7_html.log_odds(*op7_html.labels(LABELLED))


def page(inner, mark="article", body="", after=""):
    return f"<html><body {body}><header><h1>Site</h1></header><nav>{MENU}</nav><{mark}>{inner}</{mark}>{after}<footer><p>All rights</p></footer></body></html>"


@pytest.mark.parametrize("mark", ["article", "div", "main", "section"])
def test_lists_tables_and_what_follows_stay(weights, mark):
    items = "".join("<li>salt and pepper</li>" for _ in range(15))
    short = "".join(f"<li>x{i}</li>" for i in range(40))
    rows = "".join(f"<tr><td>{i}</td><td>{i * i}</td></tr>" for i in range(10))
    text = lambda inner: op7_html.main_text(page(inner, mark), weights)
    assert text(f"<p>{TEXT}</p><ul>{items}</ul>") == "\n\n".join([TEXT] + ["salt and pepper"] * 15)
    assert text(f"<p>{TEXT}</p><ol>{short}</ol><p>{MORE}</p>") == "\n\n".join([TEXT, *[f"x{i}" for i in range(40)], MORE])
    assert text(f"<p>{TEXT}</p><table>{rows}</table>") == "\n\n".join([TEXT] + [str(x) for i in range(10) for x in (i, i * i)])
    # a list of links doesn't part an article
    links = "<ul>" + "".join(f"<li><a href='{i}'>go{i}</a></li>" for i in range(40)) + "</ul>"
    assert text(f"<p>{TEXT}</p>{links}<p>{MORE}</p><p>{TEXT}</p>") == "\n\n".join([TEXT, *[f"go{i}" for i in range(40)], MORE, TEXT])
    # nor does a menu or an advert in it, and they stay out
    assert text(f"<p>{TEXT}</p><nav>{MENU * 5}</nav><div class='ad'>{MENU * 5}</div><p>{MORE}</p>") == f"{TEXT}\n\n{MORE}"


def test_less_than_signs_are_text(weights):
    assert op7_html.main_text(page(f"<p>{TEXT}</p><pre>if a < b and c > d then x <= 3 <<</pre>"), weights) == f"{TEXT}\n\nif a < b and c > d then x <= 3 <<"
    assert op7_html.main_text("<p>one two three four <five", weights) == "one two three four <five"
    assert op7_html.main_text("<p>one two three<!-- four <p> five", weights) == "one two three"
    assert op7_html.main_text(page(f"<p title='a > b' class=\"x>y\">{TEXT}</p><p title=\"it's\">{MORE}</p>"), weights) == f"{TEXT}\n\n{MORE}"


def test_optional_end_tags(weights):
    assert op7_html.main_text(page(f"<p class=ad>Buy<p>{TEXT}<p>{MORE}"), weights) == f"{TEXT}\n\n{MORE}"
    assert op7_html.main_text(page(f"<p>{TEXT}<ul><li class=ad>Buy<li>bread<li>some milk</ul><dl><dt class=ad>Buy<dd>eggs</dl>{MORE}"), weights) == f"{TEXT}\n\nbread\n\nsome milk\n\neggs\n\n{MORE}"
    assert op7_html.main_text(page(f"<table><tr class=ad><td>Buy<tr><td>one<td>two</table><p>{TEXT}"), weights) == f"one\n\ntwo\n\n{TEXT}"
    assert op7_html.main_text(page(f"<b><p>{TEXT}</b></p><div class=comments><i><p>I liked it</i></p></div><p>{MORE}"), weights) == f"{TEXT}\n\n{MORE}"


def test_names_around_the_page_say_nothing_and_comments_stay_out(weights):
    comments = "<div class='comments'>" + f"<p>I think that {MORE}</p>" * 9 + "</div>"
    for body in ("class='has-sidebar'", "class='no-js sidebar-left'", "id='menu-page'"):
        assert op7_html.main_text(page(f"<p>{TEXT}</p>{comments}", body=body), weights) == TEXT
        assert op7_html.main_text(page(f"<div {body}><p>{TEXT}</p></div>", after=comments), weights) == TEXT
        assert op7_html.main_text(page(f"<p>{TEXT}</p>{comments}", mark=f"div {body}"), weights) == TEXT


def test_paragraphs_named_like_holders_stay(weights):
    assert op7_html.main_text(page(f"<p class='banner'>{TEXT}</p><p>{MORE}</p><div class='banner'>Look here</div>"), weights) == f"{TEXT}\n\n{MORE}"


def test_headers(weights):
    """The header of an article holds its title, that of the page isn't content."""
    assert op7_html.main_text(page(f"<header><h1>A title</h1></header><p>{TEXT}</p>"), weights) == f"A title\n\n{TEXT}"
    assert op7_html.main_text(page(f"<header><h1>A title</h1></header><article><p>{TEXT}</p></article>", mark="main"), weights) == f"A title\n\n{TEXT}"
    assert op7_html.main_text(page(f"<p>{TEXT}</p>"), weights) == TEXT


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a x="', "<a ='>'", "<li class=x>", "<div class='c{}'>", "<b>", "</div></b></li>", "<p><b><i>", "<a href=x>", "<ul><li>", "<!-", "<script", "<", "<table><tr><td>", "<b><div></b>", "x </p>"])
def test_time_grows_with_the_page(weights, piece):
    def took(n):
        text = "".join(piece.format(i) for i in range(n // len(piece)))
        start = time.process_time()
        op7_html.main_text(text + "<p>words", weights)
        op7_html.labels(text + "<article>words</article>")
        return time.process_time() - start

    took(10_000)
    half, whole = min(took(125_000) for _ in range(2)), took(500_000)
    assert whole < 12 * half + 1.0


def test_a_page_of_a_megabyte(weights):
    for piece in ("<a ", "<li>", "</b>"):
        start = time.process_time()
        op7_html.main_text(piece * (2**20 // len(piece)), weights)
        assert time.process_time() - start < 15  # 2 s on a usual machine
