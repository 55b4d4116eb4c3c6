from __future__ import annotations

import pytest

from sumire.llm import htmltext


@pytest.mark.parametrize("html, want", [
    ("<article><p>One <svg class=\"icon\"/> two.</p><p>Three.</p></article>", "One two.\nThree."),
    ("<article><p>One <svg/> two.</p><p>Three <svg><path d='x'/><text>t</text></svg>four.</p></article>", "One two.\nThree four."),
    ("<article><p>One <svg><text>t</p><p>Two.</p></article>", "One\nTwo."),
    ("<article><p>One <svg><g><p>Two.</p></article>", "One\nTwo."),
    ("<p>a <svg><foreignObject><div>no</div></foreignObject></svg> b</p><p>c</p>", "a b\nc"),
    ("<article><p>So <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></math> and <math/> on.</p></article>", "So x=1 and on."),
    ("<article><p>So <math><mi>x</p><p>Next.</p></article>", "So x\nNext."),
    ("<article><p>a</p><xmp><b>x</b> &amp; y</xmp><p>z</p></article>", "a\n<b>x</b> &amp; y\nz"),
])
def test_foreign_and_raw_parts(html, want):
    assert "\n".join(x for top in htmltext.contents(htmltext.parse(html, {})) for x in htmltext.blocks(top)) == want
