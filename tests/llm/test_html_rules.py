"""Visibility by style sheets, numbers of any size, and markup of any kind."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlog.llm.html_text import _on_screen, render

SHOWN = [
    ("<style>@media print{.a{display:none}}</style><p class=a>text</p>", True),
    ("<style>@media screen{.a{display:none}}</style><p class=a>text</p>", False),
    ("<style>@media (max-width: 600px){.a{display:none}}</style><p class=a>text</p>", True),
    ("<style>@media screen and (min-width: 600px){.a{display:none}}</style><p class=a>text</p>", False),
    ("<style media=print>.a{display:none}</style><p class=a>text</p>", True),
    ("<style>.a{display:none}.a{display:block}</style><p class=a>text</p>", True),
    ("<style>.a{display:none !important}.a{display:block}</style><p class=a>text</p>", False),
    ("<style>#i{display:block}.a{display:none}</style><p class=a id=i>text</p>", True),
    ("<style>p{display:none}.a{display:block}</style><p class=a>text</p>", True),
    ("<style>p.a.b{display:none}</style><p class='b a'>text</p>", False),
    ("<style>p.a.b{display:none}</style><p class='a'>text</p>", True),
    ("<style>.a{display:none}</style><p class=a style='display:inline'>text</p>", True),
    ("<style>.m{visibility:hidden}</style><p class=m>text</p>", False),
    ("<style>.m{visibility:hidden}.v{visibility:visible}</style><p class=m><b class=v>text</b></p>", True),
    ("<style>/* .a{ */ @import 'x;{'; @font-face{font-family:x} .a{display:none}</style><p class=a>text</p>", False),
    ("<style>.a{content:'}';display:none</style><p class=b>text</p>", True),
    ("<p hidden>text</p>", False),
    ("<style>[x]{} p{display:block}</style><p hidden>text</p>", True),
]


@pytest.mark.parametrize(("html", "shown"), SHOWN)
def test_rules(html, shown):
    assert (render(html) == "text") is shown


def test_media():
    assert [_on_screen(q) for q in ("", "all", "print, screen", "not print", "not screen", "only screen", "speech", "(prefers-color-scheme: dark)")] == [True, True, True, True, False, True, False, False]


def test_numbers_of_any_size():
    huge = "9" * 5000
    assert render(f"<ol start={huge}><li>x</ol>") == "1. x" and render("<ol start=-2><li>x<li>y</ol>") == "-2. x\n-1. y"
    assert render(f"<table><tr><td colspan={huge} rowspan={huge}>x<td>y</table>") == "x  y"
    assert "z" in render("<table>" + "<tr>" + "<td colspan=1000 rowspan=1000>x" * 3000 + "<tr><td>z</table>")
    assert render("<ol><li value=7>x<li value=x>y</ol>") == "7. x\n8. y"


def plainly_shown(node, styles):
    """Brute force: the texts of a nested list that nothing hides."""
    tag, classes, style, children = node
    display, visibility = "", ""
    for of_class, name, value in styles:
        if of_class in classes:
            display, visibility = (value, visibility) if name == "display" else (display, value)
    if style:
        display, visibility = (style[1], visibility) if style[0] == "display" else (display, style[1])
    return display, visibility


def test_visibility_against_brute_force():
    r = random.Random(2)
    for _ in range(200):
        styles = [(r.choice("abc"), *r.choice([("display", "none"), ("display", "block"), ("visibility", "hidden"), ("visibility", "visible")])) for _ in range(4)]
        count, out, html = 0, [], []

        def grow(depth, visible, gone):
            nonlocal count
            classes, style = r.sample("abc", r.randint(0, 2)), r.choice([None, None, None, ("display", "none"), ("visibility", "visible")])
            display, visibility = plainly_shown(("div", classes, style, ()), styles)
            gone = gone or display == "none"
            visible = visibility == "visible" if visibility else visible
            html.append(f"<div class='{' '.join(classes)}'" + (f" style='{style[0]}: {style[1]}'" if style else "") + ">")
            for _ in range(r.randint(0, 3)):
                if depth < 4 and r.random() < 0.6:
                    grow(depth + 1, visible, gone)
                else:
                    count += 1
                    html.append(f"<i>t{count}</i> ")
                    if visible and not gone:
                        out.append(f"t{count}")
            html.append("</div>")

        grow(0, True, False)
        sheet = "".join(f".{c}{{{n}:{v}}}" for c, n, v in styles)
        assert render(f"<style>{sheet}</style>{''.join(html)}").split() == out


PARTS = st.sampled_from(
    ["<", ">", "</", "<p", "<table>", "<tr>", "<td colspan=", "<td rowspan=99999999999>", "<ol start=", "<li value=", "</table>", "<style>", "</style>", "@media", "{", "}", ".a", "display:none",
     "'", '"', "=", " ", "&#99999999;", "&amp", "<!--", "-->", "<pre>", "\n", "x", "\u0130", "\x00", "9" * 40, "<select><option>", "</p>", "<textarea>", "<details>", "<svg/>", "<br/>"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS | st.text(max_size=5), max_size=40).map("".join))
def test_markup_of_any_kind(html):
    assert isinstance(render(html), str)
