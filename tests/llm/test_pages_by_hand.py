"""Pages written by hand, in layouts, languages and class names that the generator of labelled pages does not draw."""

import time

import pytest

from plumbline.llm import html_text

S = "The quick brown fox jumps over the lazy dog near the river bank on a sunny morning."
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/about/>About us</a></li></ul></nav>"


@pytest.fixture(scope="module")
def model():
    return html_text.default_model()


@pytest.mark.parametrize(("page", "want"), [
    (f"<body>{MENU}<article><h1>Title here</h1><p>{S}</p><ul><li>First step</li><li>Second step</li></ul></article><footer>&copy; me</footer>", ["Title here", S, "First step", "Second step"]),
    (f"<article><h1>Pancakes</h1><p>{S}</p><ul><li>200 g flour</li><li>2 eggs</li><li>1 cup milk</li></ul><ol><li>Mix</li><li>Bake it well.</li></ol></article>", ["Pancakes", S, "200 g flour", "2 eggs", "1 cup milk", "Mix", "Bake it well."]),
    (f"<article><h1>T</h1><p>{S}</p><p>Some <a href=a>first link</a> and <a href=b>second one</a> with <a href=c>third link here</a> in it.</p><p>{S}</p></article>", ["T", S, "Some first link and second one with third link here in it.", S]),
    ("<p>Hello world.</p>", ["Hello world."]), ("Just some bare text on a page.", ["Just some bare text on a page."]),
    (f"<article><h1>T</h1><p>{S}</p><p>{S}</p></article><section class=discussion><h2>Discussion</h2><div class=post><p>I do not agree with this at all.</p></div><div class=post><p>Nice article, thanks for sharing it.</p></div></section>", ["T", S, S]),
    (f"<body>{MENU}<footer>&copy; 2020 Me</footer>", []),
    (f"<body class=with-sidebar><div class=sidebar><h3>Related</h3><ul><li><a href=/>A b</a></li></ul></div><div class=main><h1>T</h1><p>{S}</p><p>{S}</p></div></body>", ["T", S, S]),
    (f"<article><h1>T</h1><p>{S}</p><table><tr><th>Name</th><th>Age</th></tr><tr><td>Jo</td><td>5</td></tr></table></article>", ["T", S, "Name", "Age", "Jo", "5"]),
    (f"<div id=wrap>{MENU}<div class=beitrag><h2>Über Füchse</h2><p>Der schnelle braune Fuchs springt über den faulen Hund, und alle sehen ihm dabei zu.</p><p>Nur <a href=/k>die Katze</a> schläft.</p></div><div class=kommentare><div class=comment><p>Schön!</p></div></div></div>", ["Über Füchse", "Der schnelle braune Fuchs springt über den faulen Hund, und alle sehen ihm dabei zu.", "Nur die Katze schläft."]),
])
def test_pages(model, page, want):
    assert html_text.main_text(page, model).split("\n") == (want or [""])


@pytest.mark.parametrize("name", ["inhalt", "x1", "z", "content", "contenido", "texte-principal"])
def test_short_pages_under_any_class(model, name):
    page = f"<body><nav><a href=/>Home</a> | <a href=/x>More</a></nav><div class={name}><p>One sentence is here for you.</p><p>Another sentence follows it here.</p></div><footer>&copy; x</footer></body>"
    assert html_text.main_text(page, model) == "One sentence is here for you.\nAnother sentence follows it here."


def test_unclosed_unseen_elements_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        html_text.parse("<p>x <button>" * n)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 40 * seconds(1_000) + 0.2


@pytest.mark.parametrize(("page", "linked"), [("<a href=/>Home</a>", 4), ("<a href='/'/>Home", 0), ("<a name=x/>Home</a>", 4), ('<a href="/x">Home</a>', 4)])
def test_a_slash_in_an_unquoted_value_ends_no_tag(page, linked):
    assert [n.linked for n in html_text.parse(page) if n.text] == [linked]
