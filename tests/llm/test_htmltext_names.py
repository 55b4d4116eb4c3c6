from __future__ import annotations

import pytest

from sumire.llm import htmltext


def main_text(html: str) -> str:
    return "\n".join(x for top in htmltext.contents(htmltext.parse(html, {})) for x in htmltext.blocks(top))


@pytest.mark.parametrize("html, want", [
    ("<article><h2 id='social-impact'>Impact</h2><p id='related-work'>w</p><section id='market-share'><p>m</p></section></article>", "Impact\nw\nm"),
    ("<div class='social-science'><p>x</p></div>", "x"),
    ("<article><h2 id=copyright>C</h2><p class=notice>n <span class='alert'>s</span></p></article>", "C\nn s"),
    ("<article><div class='modal-logic'>a</div><section id='menu-costs'>b</section><div class='skip-lists'>c</div></article>", "a\nb\nc"),
    ("<article><p>x</p><div class='share-buttons'>s</div><div class='related-posts'>r</div><div class='ad-slot-3'>a</div><div class='acme-footer'>f</div></article>", "x"),
    ("<div class='social-links'>s</div><p class=copyright>c</p><p>x</p>", "x"),
])
def test_names_of_subjects_stay(html, want):
    assert main_text(html) == want
