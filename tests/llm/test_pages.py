"""Pages are read whole: attribute values and runs of text of any length."""

import random
import time

import pytest

from millrace.llm import dom, maintext


@pytest.mark.parametrize("quote", "\"'")
@pytest.mark.parametrize("n", [9_999, 10_000, 300_000])
def test_long_attribute_values_stay_in_their_tag(quote, n):
    value = "{a>b <p>no</p> " + "x" * n + "}"
    source = f"<body><div data-x={quote}{value}{quote} class=main><p>Shown.</p></div>"
    page = dom.Page(source)
    assert page.run_text == ["Shown."]
    assert maintext.main_texts([source], maintext.trees()) == maintext.main_texts([source.replace(value, "")], maintext.trees())


def test_unclosed_quotes_end_at_the_next_tag_end():
    page = dom.Page('<p title="a>one<p>two' + " word" * 400_000)
    assert page.run_text[0] == "one" and page.run_text[1].startswith("two word")
    began = time.perf_counter()
    dom.Page("".join(f"<p a='{k}>text {k} " for k in range(20_001)))
    assert time.perf_counter() - began < 20


def test_upper_case_is_counted_over_whole_runs():
    x = dom.Page("<p>" + "a" * 200 + "B" * 600 + "</p>").features()
    assert x[1, dom.OTHER + 1 + 2 * dom.GROUPS + 9 + 6] == 0.75


def runs(html):
    return dom.Page(html).run_text


def test_elements_that_are_never_closed_end_at_a_block():
    assert runs("<article><p>one <svg><path d=1></p><p>two</p><svg><text>three</text></svg></article>") == ["one", "two", "three"]
    assert runs("<p>a<select><option>x<p>b</p><select><option>z</select>c") == ["a", "b", "c"]
    for name in ("noscript", "iframe", "template", "noembed"):
        assert runs(f"<{name}><b>x</b></{name}>y<{name}>gone<p>z</p>") == ["y", "z"]
        assert runs(f"<{name}><p>x</p></{name}>y") == ["y"]
    assert runs("a<svg><foreignObject><p>in</p></foreignObject><text>t</text></svg>b") == ["a t b"]
    assert runs("<p>a</p><script>if (a<b) '<p>'") == ["a"]


def test_deep_nesting_is_linear():
    began = time.process_time()
    for page in ("<div>" * 100_000 + "x", "<article>" + "<x-y>" * 100_000 + "text</article>after", "<li>" * 50_000 + "</p>" * 50_000, "<table><tr><td>" * 30_000):
        dom.Page(page)
    assert time.process_time() - began < 20


def test_open_elements_like_a_plain_stack():
    """Looking names up gives what going through the stack gives."""
    rng = random.Random(3)
    tags = "p div li ul td tr table article section span main h1 dt dd dl option head body".split()
    for _ in range(2000):
        plain, fast = ["html"], dom.Open()
        for _ in range(rng.randint(0, 50)):
            name = rng.choice(tags)
            if rng.random() < 0.5:
                for k in range(len(plain) - 1, 0, -1):
                    if plain[k] == name:
                        del plain[k:]
                        break
                    if plain[k] in dom.BARRIERS and name in dom.LOCAL and k < len(plain) - 8:
                        break
                fast.end(name)
            else:
                for k in range(len(plain) - 1, 0, -1):
                    if name in dom.CLOSES.get(plain[k], ()):
                        del plain[k:]
                        break
                    if plain[k] in dom.SCOPE.get(name, ()) or plain[k] in dom.BARRIERS:
                        break
                plain.append(name)
                fast.begin(name)
                fast.push(name, 0)
            assert fast.names == plain
            assert all(fast.names[i] == n for n, places in fast.at.items() for i in places)
