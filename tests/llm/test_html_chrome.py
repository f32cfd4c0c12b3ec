"""Pages with long and short chrome of every kind and place: the article's blocks stay, all else goes."""

import pytest

from citygrid.llm import html

TEXT = "The boats came in late and the whole town stood at the harbour wall to see them."
MORE = "Nobody had slept, and when the first sail showed behind the point a child began to sing."
CHROME = {
    "nav": "<nav><p>%s</p></nav>", "menu list": "<nav><ul><li><a href=/a>%s</a></li></ul></nav>", "header": "<header><p>%s</p></header>", "footer": "<footer><p>%s</p><p>%s</p></footer>", "sidebar": "<aside><h3>More</h3><p>%s</p></aside>", "form": "<form><p>%s</p><input></form>",
    "notice": "<div class='cookie-notice'><p>%s</p></div>", "advert": "<div class=advert>%s</div>", "comments by tag": "<aside class='comments'><p>%s</p><p>%s</p></aside>", "comments by id": "<div id='comments'><p>%s</p></div>", "newsletter": "<section id=newsletter><p>%s</p></section>", "related": "<section class='related'><h2>Related</h2><p>%s</p></section>",
    "cards": "<div><a href='/x'><h3>More</h3><p>%s</p></a><a href='/y'><p>%s</p></a></div>", "hidden by style": "<div style='color:red; display: none'><p>%s</p></div>", "hidden": "<div hidden><p>%s</p></div>", "hidden for readers": "<p aria-hidden=true>%s</p>", "dialog": "<dialog open><p>%s</p></dialog>", "script": "<script>var a = '%s';</script>",
    "role": "<div role=complementary><p>%s</p></div>", "button": "<button>%s</button>",
}
PLACES = {
    "before": "{c}<article><h1>Boats</h1><p>{t}</p><p>{m}</p></article>", "inside": "<article><h1>Boats</h1><p>{t}</p>{c}<p>{m}</p></article>", "after": "<article><h1>Boats</h1><p>{t}</p><p>{m}</p></article>{c}",
    "before names": "{c}<div class='post'><h1>Boats</h1><p>{t}</p><p>{m}</p></div>", "inside main": "<main><header><h1>Boats</h1></header><p>{t}</p>{c}<p>{m}</p></main>", "around": "{c}<article><h1>Boats</h1><p>{t}</p>{c}<p>{m}</p>{c}</article>{c}",
}


@pytest.mark.parametrize("kind", sorted(CHROME))
def test_chrome_goes(kind):
    for n in (2, 12, 25, 40, 120):
        words = " ".join(f"word{k}" for k in range(n))
        for place, page in PLACES.items():
            got = html.main_text("<html><head><title>T</title></head><body>" + page.format(c=CHROME[kind].replace("%s", words), t=TEXT, m=MORE) + "</body></html>")
            assert got == f"Boats {TEXT} {MORE}", (n, place)


def test_elements_that_are_not_closed():
    page = "<article><p>{t}</p>{open}<p>{m}</p></article>"
    for tag in ("button", "video", "canvas", "object", "select", "audio", "svg", "noscript", "template"):
        assert html.main_text(page.format(t=TEXT, m=MORE, open=f"<{tag}>")) == f"{TEXT} {MORE}", tag
        assert html.main_text(page.format(t=TEXT, m=MORE, open=f"<{tag}>no</{tag} >")) == f"{TEXT} {MORE}", tag
    for tag in ("script", "style", "textarea", "iframe", "title"):
        assert html.main_text(page.format(t=TEXT, m=MORE, open=f"<{tag}>")) == TEXT, tag
    many = "<article>" + f"<button><p>{TEXT}</p>" * 3000 + "</article>"
    assert html.main_text(many) == " ".join([TEXT] * 3000)


def test_links():
    (card,) = html.blocks("<a href=x><div><h3>One two</h3></div></a>")
    assert card.density == 1
    after = html.blocks("<div><a href=x>One</div><p>Two three</p><a name=top><p>Four</p></a>")
    assert [b.density for b in after] == [1, 0, 0]


def test_the_tree_asks_for_chrome_and_own_links():
    asked = set()

    def walk(t):
        if not isinstance(t, bool):
            asked.add(html.NAMES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(html.default_tree())
    assert {"words", "link_density", "in_main", "named"} <= asked
