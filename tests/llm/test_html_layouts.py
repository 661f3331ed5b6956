"""Main text of layouts outside the labelled pages, marked by hand; the features and labels were tuned in sight of them.

Short headings, dialogue and link paragraphs are included.
"""

import itertools
import random

import pytest

from takeweave.llm import htmltext

# (12) stands for twelve words, [3] for a link of three; a block that begins with @ is main text.
LAYOUTS = {
    "post without article": "<nav>[1] [1] [2]</nav><div class=post><h1>@(4)</h1><p>@(57)<h2>@(2)</h2><p>@(52)<p>@(3)<p>@(60)<p>@[10]<p>@(54)<p>@(4)</div><footer><p>(8)</p></footer>",
    "story with dialogue": "<div id=nav><ul><li>[1]<li>[2]</ul></div><div id=story><h1>@(6)</h1><p>@(41)<p>@(3)<p>@(2)<p>@(5)<p>@(7)<p>@(1)<p>@(38)<p>@(4)<p>@(2)</div><div id=footer>(5) [2]</div>",
    "sections without names": "<ul><li>[2]<li>[1]<li>[1]</ul><section><h2>@(3)</h2><p>@(44)<p>@(6)</section><section><h2>@(2)</h2><p>@(51)<p>@(48)</section><section><h2>@(4)</h2><p>@(39)</section><footer>(12)</footer>",
    "article of sections": "<header><p>(6)</p></header><article><h1>@(3)</h1>" + "<section><h2>@(2)</h2><div><p>@(30)<p>@(4)</div></section>" * 12 + "<p>@[9]</article><div class=comments><p>(33)<p>(4)</div>",
    "main with lists": "<div class=cookie-bar><p>(18) [2]</p></div><main><h1>@(5)</h1><p>@(64)<ul><li>@(3)<li>@(8)<li>@[4]</ul><p>@(2)<p>@(49)</main><aside><p>(25)<p>[3]</aside>",
    "article with a short page": "<nav><ul><li>[1]<li>[1]</ul></nav><article><h1>@(2)</h1><p>@(7)<p>@[12]</article><footer>(22)</footer>",
    "one long article": "<nav><a href=x>(1)</a></nav><div class=ad>(9)</div><article><h1>@(9)</h1><p>@(400)<p>@(3)<p>@(250)<p>@[6]<p>@(1)</article><div class=sponsor><p>(60)</p></div><footer>(7)</footer>",
    "body text with a sidebar": "<div class=topbar>[1] [1]</div><div><h1>@(8)</h1><p>@(72)<p>@(12)<p>@(66)<blockquote>@(5)</blockquote><p>@(59)</div><div class=sidebar><h3>(2)</h3><p>(24)<ul><li>[4]<li>[3]</ul></div>",
    "notices inside": "<article><p>@(52)<div class=newsletter><p>(20)</div><p>@(3)<p>@(47)<aside>(31)</aside><p>@[11]<form><p>(4)</form><p>@(2)</article>",
    "menus only": "<ul><li>[1]<li>[2]<li>[1]</ul><form><label>(2)</label></form><footer><p>(9)</p></footer>",
    "comments below": "<div class=content><h1>@(7)</h1><p>@(35)<h3>@(1)</h3><p>@(42)<p>@(6)</div><div id=comments><p>(55)<p>(3)<p>(48)</div><div class=related><ul><li>[6]<li>[7]</ul></div>",
    "plain paragraphs": "<h1>@(4)</h1><p>@(46)<p>@(5)<p>@(33)<h2>@(2)</h2><p>@(61)<p>@(3)<p>@(37)",
}


@pytest.fixture(scope="module")
def tree():
    return htmltext.grow(*htmltext.labelled_rows())


def rendered(layout: str, rng: random.Random) -> str:
    numbers = itertools.count()
    words = lambda n: " ".join(f"w{next(numbers)}" for _ in range(max(1, round(n * rng.uniform(0.8, 1.25)))))
    out, at = [], 0
    for i, c in enumerate(layout):
        if c in "([":
            end = layout.index(")" if c == "(" else "]", i)
            out.append(layout[at:i] + (words(int(layout[i + 1 : end])) if c == "(" else f"<a href=y>{words(int(layout[i + 1 : end]))}</a>"))
            at = end + 1
    return "".join(out) + layout[at:]


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout(tree, name):
    for seed in range(8):
        page = rendered(LAYOUTS[name], random.Random(seed))
        want = [b.text for b in htmltext.blocks(page) if b.text.startswith("@")]
        assert htmltext.main_text(page, tree).split("\n") == (want or [""])
