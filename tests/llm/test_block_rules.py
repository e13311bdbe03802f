"""Block rules against a plain form of them on generated pages, and hostile pages."""

import random
import re
import time

import pytest

from churnlab.llm import htmltext

CONTENT = "harbour engine quarter violin granite market copper lantern meadow signal orbit timber".split()
FUNCTION = "the of and to in is that for with was".split()
CLASSES = ["", "", "", "sidebar", "post-content", "user-comments", "note"]


def words(rng):
    many, dense = rng.choice([2, 4, 30, 60]), rng.random() < 0.7
    return " ".join(rng.choice(FUNCTION if dense and rng.random() < 0.5 else CONTENT) for _ in range(many))


def tree(rng, depth=0):
    """(tag, class, children); a text is a string."""
    if depth > 4 or rng.random() < 0.35:
        text = words(rng)
        inline = [("a", "", [text])] if rng.random() < 0.2 else [text[:9], ("b", "", [text[9:]])] if rng.random() < 0.2 else [text]
        return rng.choice(["p", "li", "h2", "blockquote"]), "", inline
    tag = rng.choice(["div", "div", "section", "article", "main", "nav", "aside", "form", "header"])
    return tag, rng.choice(CLASSES) if tag in ("div", "section") else "", [tree(rng, depth + 1) for _ in range(rng.randrange(1, 5))]


def markup(node):
    if isinstance(node, str):
        return node
    tag, name, children = node
    return f"<{tag}{f' class="{name}"' if name else ''}>{''.join(map(markup, children))}</{tag}>"


def plain_blocks(node, parents=(), place="none", article=None):
    """(text, place, article, heading, linked) of a tree's leaves."""
    tag, name, children = node
    kind = "main" if tag in ("article", "main") else "bad" if tag in ("nav", "aside", "form") else {"sidebar": "named", "user-comments": "named", "post-content": "main"}.get(name, place)
    if tag == "header" and place != "main":
        kind = "bad"
    elif place == "bad":
        all_forms = all(t == "form" for t, p in parents if p == "bad")
        kind = "main" if kind == "main" and all_forms else "bad"
    elif place == "named" and kind == "main" and tag != "main":
        kind = "named"
    elif place == "named" and kind == "none":
        kind = "named"
    if kind == "main" and place != "main":
        article = object()
    if any(isinstance(c, str) or c[0] in ("a", "b") for c in children):
        parts = [(c, False) if isinstance(c, str) else (c[2][0], c[0] == "a") for c in children]
        text = "".join(t for t, _ in parts)
        return [(" ".join(text.split()), kind, article, tag == "h2", sum(len(t) for t, a in parts if a) / len(text))]
    return [b for c in children for b in plain_blocks(c, (*parents, (tag, kind)), kind, article)]


def plain_labels(blocks, bad=("bad", "named")):
    def density(text):
        return sum(w in htmltext.STOP_WORDS for w in text.split()) / len(text.split())

    long = [not heading and linked <= 0.33 and len(text) >= 70 for text, _, _, heading, linked in blocks]
    asked = [i for i, b in enumerate(blocks) if long[i] and b[1] not in bad]
    dense = [i for i in asked if density(blocks[i][0]) >= 0.3]
    good = dense if sum(len(blocks[i][0]) for i in dense) >= 0.1 * sum(len(blocks[i][0]) for i in asked) else asked
    first = []
    for i, (_, place, _, heading, linked) in enumerate(blocks):
        if place in bad or linked > 0.33 and not (heading and place == "main"):
            first.append(False)
        elif i in good:
            first.append(True)
        else:
            first.append(False if long[i] and place != "main" else None)
    out = list(first)
    for i, (_, place, article, heading, _) in enumerate(blocks):
        if first[i] is not None:
            continue
        near = [j for j, label in enumerate(first) if label is not None and (place != "main" or blocks[j][1] == "main" and blocks[j][2] is article)]
        least = min((abs(i - j) for j in near), default=0)
        found = {j: first[j] for j in near if abs(i - j) == least}
        if len(set(found.values())) == 1:
            out[i] = next(iter(found.values()))
        else:
            out[i] = place == "main" or bool(found) and heading and found[max(found)]
    if bad != ("bad",) and not any(out) and any(b[1] == "named" for b in blocks):
        return plain_labels(blocks, ("bad",))
    return out


@pytest.mark.parametrize("seed", range(300))
def test_generated_pages_agree_with_the_rules_written_plainly(seed):
    rng = random.Random(seed)
    nodes = [tree(rng) for _ in range(rng.randrange(1, 8))]
    blocks = [b for n in nodes for b in plain_blocks(n)]
    page = f"<!doctype html><html lang='en'><head><title>t</title></head><body>{''.join(map(markup, nodes))}</body></html>"
    assert [b.text for b in htmltext.blocks_of(page)] == [b[0] for b in blocks]
    want = [b[0] for b, label in zip(blocks, plain_labels(blocks), strict=True) if label]
    assert htmltext.main_text(page) == "\n\n".join(want)


N = 1_000_000
HOSTILE = {
    "short items": "<ul>" + "<li>x y</li>" * (N // 12),
    "items in an article": "<article>" + "<li>x" * (N // 5),
    "nesting": "<div>" * (N // 5) + "x",
    "nested names": "<span class=ad>" * (N // 15),
    "unclosed quotes": "<p class='x>" * (N // 12 + 1),
    "one unclosed quote": "<p class='x>hello" + '<p class="y">' * (N // 13),
    "quotes and cut-off tags": '<a "x>" ' * (N // 8),
    "less-than signs": "<" * N,
    "cut-off tags": "<a " * (N // 3),
    "cut-off ends of scripts": "<script>" + "</script" * (N // 8),
    "closing tags": "<div>" * (N // 12) + "</p></b>" * (N // 12),
    "html tags": "<html " * (N // 6),
    "attributes": "<div " + "class class= " * (N // 13) + ">x",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_megabyte_is_read_in_linear_time(name):
    start = time.process_time()
    htmltext.main_text(HOSTILE[name])
    htmltext.language(HOSTILE[name])
    assert time.process_time() - start < 5


@pytest.mark.parametrize("name", ["class='reader-comments'", "id='user-comments'", "class='comment-content'", "class='comment-list'", "id=post_comments"])
def test_reader_comments_are_no_main_text(name):
    text = " ".join(FUNCTION * 5)
    page = f"<body><div><p>{text}</p></div><div {name}><p>I say {text}</p></div></body>"
    assert htmltext.main_text(page) == text


def test_unclosed_quote_ends_with_its_tag():
    assert htmltext.main_text("<article><p class='x>one</p><p>two</p></article>") == "one\n\ntwo"
    assert htmltext.main_text("<article><p class='x>It's one</p><p>two</p></article>") == "It's one\n\ntwo"
    assert htmltext.main_text("<article><p title='a > b' id=\"c>d\">one</p></article>") == "one"


def test_language_is_found_wherever_the_html_tag_stands():
    assert htmltext.language("<!--" + "x <html lang=de> " * 1000 + "--><html class=a lang='sv-SE'>") == "sv"
    assert htmltext.language("<html data-lang=de><p lang=sv>") == ""
    assert not re.search("html", htmltext.language("text without tags"))
