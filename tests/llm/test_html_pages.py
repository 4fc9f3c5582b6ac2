"""Hand-written pages: what belongs to an article, marks that only look like noise, quotes, and the time on odd pages."""

import time

import pytest

from offerlens.llm import html_extract as H

LINES = [f"Sentence number {i} of the text tells a little more about it." for i in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in LINES)


@pytest.fixture(scope="module")
def weights(spark):
    return H.learn_weights(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def page(inside, before="", after="", tag="article"):
    menu = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></nav>"
    return f"<html><body>{menu}{before}<{tag}>{inside}</{tag}>{after}<footer><p>About us and the imprint</p></footer></body></html>"


def read(weights, inside, **kw):
    return H.page_text(page(inside, **kw), weights).split("\n")


def test_marks_that_only_look_like_noise(weights):
    assert read(weights, f"{BODY}<h2 id='social-history'>Social history</h2><section id='related-work'><h2>Related work</h2><p>Others did this before, too.</p></section>") == [
        *LINES, "Social history", "Related work", "Others did this before, too."]
    assert read(weights, f"<h2 id='comments'>Comments on the law</h2>{BODY}") == ["Comments on the law", *LINES]
    long = "<p>" + " ".join(["A notice is long prose without any link in it."] * 6) + "</p>"
    assert len(read(weights, f"{BODY}<div class='notice'>{long}</div>")) == 7
    for mark in ("class='notice'", "class='related-posts'", "class=\"social share\"", "class='ad box'", "id='comments'", "role='navigation'", "class=promo"):
        assert read(weights, f"{BODY}<div {mark}><p>Buy or say something</p></div>{BODY}") == LINES + LINES
    linked = "<ul>" + "".join(f"<li><a href='/{i}'>Another page of this site number {i}</a></li>" for i in range(9)) + "</ul>"
    assert read(weights, f"{BODY}<div class='related'>{linked}</div>") == LINES
    comments = "<section class='comments'>" + "".join(f"<div class='comment'><p>Reader {i} says a lot about it all.</p></div>" for i in range(9)) + "</section>"
    assert read(weights, f"{BODY}{comments}") == LINES


def test_an_apostrophe_in_an_unquoted_value(weights):
    assert read(weights, f"<p>Before it.</p><img alt=Dad's><p>A whole paragraph stands here.</p><img alt=Mum's>{BODY}") == [
        "Before it.", "A whole paragraph stands here.", *LINES]
    assert read(weights, f"<p data-x = 'a>b' title=\"it's > that\">Quoted.</p><p it's>Odd name.</p>{BODY}") == ["Quoted.", "Odd name.", *LINES]
    assert read(weights, f"{BODY}<p class='a>Lost quote.</p>")[:6] == LINES


def test_the_article_begins_and_ends_with_other_blocks(weights):
    tail = "<ul><li>First point of the list</li><li>Second point</li></ul>"
    assert read(weights, BODY + tail) == [*LINES, "First point of the list", "Second point"]
    assert read(weights, f"<h1>The headline</h1><div>By A. Writer, <time>1 May</time></div>{BODY}") == ["The headline", "By A. Writer, 1 May", *LINES]
    assert read(weights, f"{BODY}<figure><img src=x><figcaption>What is to be seen</figcaption></figure>") == [*LINES, "What is to be seen"]
    assert read(weights, f"{BODY}<blockquote>He said it himself.</blockquote><pre>code  here</pre>") == [*LINES, "He said it himself.", "code here"]
    assert read(weights, f"{BODY}<table><tr><th>Year</th><td>1999</td></tr></table><div class='ad'>Buy</div><dl><dt>Term</dt><dd>Meaning</dd></dl>") == [
        *LINES, "Year", "1999", "Term", "Meaning"]
    assert read(weights, BODY + tail, tag="div") == [*LINES, "First point of the list", "Second point"]


def test_lists_of_links_and_menus_around_it_stay_out(weights):
    links = "<ul>" + "".join(f"<li><a href='/{i}'>Page number {i} of the site</a></li>" for i in range(8)) + "</ul>"
    for tag in ("article", "div", "main"):
        assert read(weights, BODY, before=links, after=links, tag=tag) == LINES
        assert read(weights, BODY + links, tag=tag) == LINES
    bare = f"<body><div>{links}</div>{BODY}<ul><li>A point of its own</li></ul><div>{links}</div><footer>x</footer></body>"
    assert H.page_text(bare, weights).split("\n") == [*LINES, "A point of its own"]


@pytest.mark.parametrize("unit", ["<a b='c>' d=\"e ", "<p class=it's x>word ", "<img alt=\"", "<p title='", "<!-- ", "<div><p>x", "<a href='x'>y", "</p", "<svg><path "])
def test_time_grows_in_proportion_to_the_page(weights, unit):
    def seconds(n):
        text = unit * (n // len(unit))
        best = 9e9
        for _ in range(2):
            t = time.process_time()
            H.page_text(text, weights)
            best = min(best, time.process_time() - t)
        return best

    small, large = seconds(28_000), seconds(112_000)
    assert large < 10 * small + 0.3
