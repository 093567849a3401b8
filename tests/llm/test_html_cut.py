import pytest

from tidemark.llm import html_text

P = "A sentence of the article with some words in it. " * 6
LINE = P.strip()


def signs_and_labels(html):
    page = html_text.read(html)
    return [(text, odds > 0, keep) for (text, odds, _), keep in zip(page.blocks(), html_text.label(page), strict=True)]


@pytest.mark.parametrize("tag", ["div", "section", "span", "td", "li"])
def test_a_page_of_plain_text_is_its_text(tag):
    assert html_text.extract(f"<body><{tag}>The whole article of this page, in one division.</{tag}></body>") == "The whole article of this page, in one division."
    assert html_text.extract("Some words") == "Some words"


@pytest.mark.parametrize("name", ["no-sidebar", "has-comments", "with-related", "post related"])
def test_names_of_layouts_and_mixed_names(name):
    assert html_text.extract(f"<body><div class='{name}'>{P}</div></body>") == LINE
    assert html_text.extract(f"<body><div class='{name}'><p>{P}</p><p>{P}</p></div></body>") == LINE + "\n" + LINE


def test_mixed_name_of_a_paragraph():
    assert html_text.extract(f"<body><p class='story-alert'>{P}</p></body>") == LINE


def test_discussion_of_readers_and_of_an_article():
    assert html_text.extract(f"<div class='content'><p>{P}</p><p>{P}</p></div><div id='discussion'><p>Nice post!</p><p>Thanks a lot.</p></div>") == LINE + "\n" + LINE
    assert html_text.extract(f"<article><p>{P}</p><section id='discussion'><h2>Discussion</h2><p>{P}</p></section></article>") == "\n".join((LINE, "Discussion", LINE))


def test_a_linked_line_stays_with_its_paragraphs():
    page = f"<div class='wide'><div><p>{P}</p><p>{P}</p><div><a href='/1'>The first part of this story</a></div><p>{P}</p></div></div><div>{P * 6}</div>"
    got = signs_and_labels(page)
    assert ("The first part of this story", False, True) in got  # the sign alone would drop it
    assert html_text.extract(page).count("The first part of this story") == 1


def test_a_lone_sentence_goes_with_the_boxes_around_it():
    page = f"<div class='content'><p>{P}</p><p>{P}</p></div><div class='related'><a href='/1'>One more</a></div><p>All the week's best</p><div class='promo'><a href='/2'>Another</a></div>"
    assert ("All the week's best", True, False) in signs_and_labels(page)
    assert html_text.extract(page) == LINE + "\n" + LINE


def test_boxes_stay_out_whatever_is_around_them():
    for box in ("<nav>Menu</nav>", "<div class='ad'>Buy</div>", "<aside>Other</aside>", "<form>Name</form>", "<div class='newsletter'>Mail</div>", "<p hidden>Unseen</p>"):
        assert html_text.extract(f"<body><div class='content'><p>{P}</p>{box}<p>{P}</p></div></body>") == LINE + "\n" + LINE


def test_boxes_stay_out_of_an_article():
    for text in ("buy", P * 40):
        assert html_text.extract(f"<article><p>{P}</p><div class='ad'>{text}</div><p>{P}</p></article>") == LINE + "\n" + LINE
        assert html_text.extract(f"<article>{P}<div class='ad'><p>{text}</p></div>{P}</article>") == LINE + "\n" + LINE


def test_steps_between_elements():
    page = html_text.read("<div><p>a</p><div><section><p>b</p></section></div></div>")
    (_, _, a), (_, _, b) = page.blocks()
    assert page.steps(a, a, 8) == 0 and page.steps(a, b, 8) == 2 and page.steps(a, b, 1) == 1
