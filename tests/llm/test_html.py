"""Extraction on generated pages whose article is known, on hostile markup, and against brute force."""

import time
from collections import Counter

import numpy as np
import pytest

from quarry.llm.html_extract import Page, Segment, best_run, main_text, markup, scored, weights
from quarry.llm.labelled_pages import MARK, pages


def known_text(html):
    """The marked words, joined as a reader sees them: no break inside a block."""
    out = []
    for t in Page(html).tokens:
        out.append(" " if isinstance(t, str) or t.space else "")
        out.append(t.text if isinstance(t, Segment) and MARK in t.text else "")
    return " ".join("".join(out).replace(MARK, "").split())


def test_pages_of_another_seed():
    exact, common, got_n, want_n = 0, 0, 0, 0
    made = pages(300, 4242)
    for html in made:
        got, want = main_text(html.replace(MARK, "")), known_text(html)
        exact += got == want
        a, b = Counter(got.split()), Counter(want.split())
        common, got_n, want_n = common + sum((a & b).values()), got_n + sum(a.values()), want_n + sum(b.values())
    assert exact / len(made) > 0.85
    assert common / got_n > 0.99 and common / want_n > 0.99


def test_region_is_the_best_of_all_runs():
    words, tags = weights()
    for html in pages(60, 99):
        page = Page(html.replace(MARK, ""), words)
        s = np.array(scored(page, words, tags))
        sums = np.concatenate(([0.0], np.cumsum(s)))
        # of all pairs of ends, the greatest difference
        want = max(0.0, max((sums[i + 1 :].max() - sums[i] for i in range(len(s))), default=0.0))
        a, b = best_run(s.tolist())
        assert s[a:b].sum() == pytest.approx(want)


PROSE = "<p>Some prose here, that is long enough to count.</p>"


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<article>{PROSE}<table><tr><td>a</td><td>b</td></tr><tr><td>One<br>two</td></tr></table></article>", "a b One two"),
        (f"<article>{PROSE}<div class='related-work'><p>Many have studied it before us.</p></div></article>", "Many have studied it before us."),
        (f"<article>{PROSE}<div class='hidden-gems'><p>And few found what they sought.</p></div></article>", "And few found what they sought."),
        (f"<article>{PROSE}<ul><li>one</li><li>two</li></ul></article>", "one two"),
        (f"<article>{PROSE}<div class='comments'><p>I like it very much. Write more!</p></div></article>", ""),
        (f"<article>{PROSE}<div class='ad'>Buy it now. It is cheap, and it is good.</div></article>", ""),
        (f"<article>{PROSE}<p>Hello <span class=ad>buy me</span> world</p></article>", "Hello world"),
    ],
)
def test_names_and_tags_alone_decide_nothing(html, text):
    start = "Some prose here, that is long enough to count."
    assert main_text(html) == f"{start} {text}".strip()


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 350_000,
        '<p a="' + "<a x " * 200_000,
        "<p a='" * 170_000,
        "<div>" * 200_000,
        "".join(f"<div class=c{i}>" for i in range(60_000)) + "x" + "</div>" * 60_000,
        "<span><div>" + "<a>" * 100_000 + "</span>" * 100_000,
        "<" * 1_000_000,
        "<a " + "b" * 1_000_000 + ">x",
        "<script>" * 125_000,
        "<a =" + " " * 1_000_000 + '">',
        "<!--" * 250_000,
        "&" * 1_000_000,
    ],
)
def test_a_megabyte_of_broken_markup(html):
    begun = time.process_time()
    main_text(html, weights())
    assert time.process_time() - begun < 5


def test_markup_reads_attributes_and_quotes():
    got = list(markup("a<b x='>' y=\">\">c</b><i don't>d</i><p a=\"b>e<!-- > -->f<1 g<script>if (a<b) '</p>'</script>h<q"))
    assert "".join(t for k, _, t in got if k == "text") == "acdef<1 gh"
    assert [n for k, n, _ in got if k == "open"] == ["b", "i", "p", "script"]


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 40, 400])
def test_text_after_deep_inline_elements_is_kept(depth):
    """However many inline elements a link leaves open, its end is found, and the rest of the paragraph is no link."""
    prose = "The old house on the hill was built by her grandfather, and nobody had lived in it for a long time. " * 3
    page = f"<html><body><nav><a href=/>Home</a></nav><article><p>{prose}</p><p>Read <a href=x>{'<span>' * depth}a link</a> and then {prose}</p><p>{prose}</p></article></body></html>"
    text = main_text(page)
    assert "Read a link and then The old house" in text and "Home" not in text


def test_a_head_left_open_at_any_depth_ends_at_the_article():
    prose = "The old house on the hill was built by her grandfather, and nobody had lived in it for a long time. " * 3
    page = f"<html><body>{'<div>' * 30}<header><nav><a href=/a>Home</a><article><p>{prose}</p><p>{prose}</p></article></body></html>"
    text = main_text(page)
    assert text.count("The old house") == 6 and "Home" not in text


def test_deep_markup_takes_linear_time():
    begun = time.perf_counter()
    for piece in ("<span>x", "<a href=y>x", "<div><span>x", "</span><p>", "<header>"):
        main_text(piece * (300_000 // len(piece)))
    assert time.perf_counter() - begun < 40
