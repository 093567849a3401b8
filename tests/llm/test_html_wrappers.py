import pytest

from tidemark.llm import html_text

P = "<p>First paragraph of a story, with quite enough words in it to count as one.</p><p>Second paragraph, which goes on for a while as well.</p>"
TEXT = "First paragraph of a story, with quite enough words in it to count as one.\nSecond paragraph, which goes on for a while as well."


@pytest.mark.parametrize("name", ["has-sidebar", "social-layout", "content-widget"])
def test_article_in_a_noisy_wrapper(name):
    for tag in ("article", "main"):
        assert html_text.extract(f"<body><div class='{name}'><{tag}>{P}</{tag}></div></body>") == TEXT


def test_noisy_names_inside_an_article():
    assert html_text.extract(f"<article><div class='entry-header'><h1>Title</h1></div>{P}</article>") == "Title\n" + TEXT
    assert html_text.extract(f"<article><div class='post-related'>{P}</div></article>") == TEXT
    assert html_text.extract(f"<article>{P}<div class='share'>Share this</div></article>") == TEXT


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=utf-8><script>1 < 2</script><article>{}</article>",
        "<body><datalist id=x><option>One<option>Two</datalist><article>{}</article>",
        "<body><svg/><article>{}</article>",
        "<body><button>A<button>B</button><article>{}</article>",
        "<head><title>T</title></head><body><select><option>A<option>B</select><svg><path/><title>x</title></svg><article>{}</article>",
    ],
)
def test_unseen_elements_are_left(page):
    assert html_text.extract(page.format(P)) == TEXT
