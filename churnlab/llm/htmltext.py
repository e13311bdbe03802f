"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; scripts, styles, templates
and comments are passed over. A block keeps its length, the share of its
characters inside links, the share of its words that are stop words, and
where it stands: inside an article, inside boilerplate (by tag or role:
navigation, header, footer, sidebar, form, dialog; or by a whole class name
or id: those, adverts, notices, reader comments, ...), or neither. An article
or main element is one whatever its class names; class names that speak for
both say nothing.

Pass one decides, wherever a block stands, what the rules can: boilerplate
and blocks of links are bad; a block that is long enough and has the density
of stop words of running text is good; long blocks with few stop words are
bad outside an article. The others are ambiguous: short ones, and long ones
with few stop words inside an article. Where stop words say nothing (scripts
without spaces, pages whose long blocks have next to none) long blocks
without links are good. In pass two an ambiguous block takes the label of
its nearest decided neighbour, inside an article of the nearest decided
block of that article that is not in boilerplate. Equally near neighbours that differ leave it
good in an article or before a good block if it is a heading, else bad; an
article without any decided block is kept whole. Where no block is good,
boilerplate by class name or id alone is held against the rules as well.

Stop words are those of four languages, and for each language that pages
declare (none is one, too) the words that most of its pages have in their
long blocks, counted over all pages: at most ``MOST_WORDS`` of a language,
each of at most 20 letters.

A page is read in time linear in its length, however deep or broken.

Defined cases: null and empty html give an empty text; unclosed or crossed
tags and cut-off pages are read as far as they go; a quote left open ends
with its tag; repeated rows get a row
each; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.llm.common import checkpointed, ship
from churnlab.llm.tokens import text_chunks

#: A tag up to its attributes' end. A quoted value may hold ``>`` only where what follows its end can follow a value.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^">]*+"|'[^'>]*+'|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+)""")
#: Elements whose content is no text.
SILENT = frozenset("script style noscript template svg math iframe object embed canvas audio video map select textarea title button datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("nav footer aside form menu head dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Whole class names and ids of boilerplate.
HINT = re.compile(
    r"""(?<![^\s"'=])(?:(?:site|page|main|global)[_-])?(?:ads?|advert(?:s|isements?|ising)?|ad[_-](?:banner|block|box|container|slot|unit|wrapper)|banner|sponsor(?:s|ed)?|promo(?:s|tions?)?"""
    r"""|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|respond|replies|disqus(?:_thread)?"""
    r"""|(?:(?:readers?|users?|visitors?|guests?|public|post|article|story|blog|facebook|fb)[_-]?)?comments?(?:[_-]?(?:list|section|area|form|content|body|text|threads?|box|block|wrapper|wrap|container|items?|author|meta|reply|replies|feed|stream))?"""
    r"""|(?:readers?|users?)[_-](?:replies|responses|reviews|feedback)|discussion[_-](?:list|section|threads?)"""
    r"""|cookies?(?:[_-](?:notice|banner|bar|consent|popup|message))?|consent|gdpr|notices?|notifications?|alerts?|popup|modal|overlay"""
    r"""|newsletter(?:[_-](?:signup|form|box))?|subscri(?:be|ption)|share|sharing|share[_-](?:buttons|bar|links)|social(?:[_-](?:share|sharing|links|media|icons))?"""
    r"""|related(?:[_-](?:posts|articles|stories|content|links|news))?|recommend(?:ed|ations)|widgets?|toolbar|pagination|pager|copyright|disclaimer|legal|login|signup|search)(?![^\s"'>/])""",
    re.I,
)
MAIN_HINT = re.compile(r"(?:^|\s)(?:(?:post|entry|article|story|main|page)[_-]?(?:content|body|text)|main|article|post|story|entry|content|articlebody)(?:$|\s)", re.I)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

#: Frequent function words of the languages read.
STOP_WORDS = frozenset(
    (
        "the of and to a in is it that for on with as was at by an be this from or are not have has but his her they we you he she which were their its will would can "
        "le la les de des du un une et est en que qui dans pour sur pas par au aux ce se sont avec plus il elle nous vous ils ne mais ou son sa ses leur cette "
        "der die das und ist in den von zu mit sich des auf für nicht ein eine dem auch es an als nach wie im am bei aus oder wird sind war einen einer noch um "
        "el los las del y en es por con una su para como se lo al más o pero sus le ya este sí porque esta entre cuando muy sin sobre ser también me hasta hay"
    ).split()
)
SHORT, DENSE, LINKED = 70, 0.3, 0.33
#: Stop words say something on a page where dense blocks have this share of its long blocks' characters.
EVIDENCE = 0.1
#: A learned stop word stands on this share of a language's pages; a language has pages enough, and words at most.
COMMON, LEAST_PAGES, MOST_WORDS = 0.4, 20, 100
#: Words counted before a task hands its counts on.
COUNTED = 200_000
LANGUAGE = re.compile(r"""(?:^|\s)lang\s*=\s*["']?([a-zA-Z]{2,3})\b""", re.I)
HTML = re.compile(r"<html\b", re.I)
#: Letters of scripts without spaces between words; one of the first kind counts as three characters.
SYLLABLES = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003134f]")
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003134f]")
TRIM = re.compile(r"^[\W_]+|[\W_]+$")

#: NAMED is boilerplate by class name or id alone.
NONE, MAIN, BAD, NAMED = 0, 1, 2, 3


class Block:
    __slots__ = ("text", "place", "article", "heading", "linked", "label")

    def __init__(self, text, place, article, heading, linked):
        self.text, self.place, self.article, self.heading, self.linked = text, place, article, heading, linked
        self.label: bool | None = None


def _place(tag: str, attributes: str, inside: int) -> int:
    """Where an element's content stands, from its tag, names and parent."""
    names, role, kind = "", "", ""
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            names += " " + value
        elif key == "role":
            role = value.lower()
        elif key == "itemprop":
            kind = value
        elif key == "hidden" or "display:none" in value.replace(" ", "").lower():
            return BAD
    if tag in ("html", "body"):
        return inside
    if tag in ("article", "main") or role in ("main", "article"):
        return MAIN
    if tag in BOILERPLATE or role in ROLES:
        return BAD
    bad, main = bool(names and HINT.search(names)), bool(names and MAIN_HINT.search(names)) or kind.lower() == "articlebody"
    if bad != main:
        return NAMED if bad else MAIN
    return inside


def pieces(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """(None, False, text) or (tag, closing, attributes) in page order, without what is no text.

    Each character is looked at a bounded number of times: a quote that is
    never closed ends with its tag, at the next ``>``, and once a tag has run
    into the page's end quotes count no more.
    """
    at, end, quotes = 0, len(page), True
    while at < end:
        start = page.find("<", at)
        if start < 0:
            yield None, False, page[at:]
            return
        if start > at:
            yield None, False, page[at:start]
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = close + 3 if close >= 0 else end
            continue
        if page.startswith("<![CDATA[", start):
            close = page.find("]]>", start + 9)
            yield None, False, html.escape(page[start + 9 : close if close >= 0 else end])
            at = close + 3 if close >= 0 else end
            continue
        if page.startswith(("<!", "<?"), start):
            close = page.find(">", start)
            at = close + 1 if close >= 0 else end
            continue
        m = TAG.match(page, start) if quotes else None
        if m and m.end() < end and page[m.end()] == ">":
            closing, tag, attributes, at = bool(m[1]), m[2], m[3], m.end() + 1
        else:
            head = start + 2 if page.startswith("</", start) else start + 1
            if not page[head : head + 1].isascii() or not page[head : head + 1].isalpha():
                # a tag cut off by the page's end is no text
                if head < end or head == start + 1:
                    yield None, False, "<"
                at = start + 1 if head < end or head == start + 1 else end
                continue
            quotes = quotes and m.end() < end
            close = page.find(">", m.end() if quotes else head)
            if close < 0:
                # no tag ends any more; the last one is cut off
                yield None, False, page[start : page.rfind("<")]
                return
            name = re.split(r"[\s/]", page[head : min(close, head + 64)], maxsplit=1)[0]
            closing, tag, attributes, at = head == start + 2, name, page[head + len(name) : close], close + 1
        tag = tag.lower()
        if tag in SILENT:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                over = page.find(">", close.end()) if close else -1
                at = over + 1 if over >= 0 else end
            continue
        yield tag, closing, attributes


class Open:
    """The open elements; what is asked of all of them is counted."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = []  # tag, place, number of the article
        self.tags: Counter[str] = Counter()
        self.headings = self.bad_forms = self.bad_others = 0

    def _count(self, tag: str, place: int, by: int) -> None:
        self.tags[tag] += by
        self.headings += by * (tag in HEADINGS)
        self.bad_forms += by * (place == BAD and tag == "form")
        self.bad_others += by * (place == BAD and tag != "form")

    def push(self, tag: str, place: int, article: int) -> None:
        self.stack.append((tag, place, article))
        self._count(tag, place, 1)

    def pop(self) -> str:
        tag, place, _ = self.stack.pop()
        self._count(tag, place, -1)
        return tag

    def close(self, tag: str) -> None:
        """Down to the last element of this name, if one is open."""
        while self.tags[tag] and self.pop() != tag:
            pass

    def clear(self) -> None:
        self.__init__()

    @property
    def place(self) -> int:
        return self.stack[-1][1] if self.stack else NONE

    @property
    def article(self) -> int:
        return self.stack[-1][2] if self.stack else 0


def _placed(tag: str, attributes: str, above: Open) -> int:
    """The place of an element under the open ones."""
    inside, own = above.place, _place(tag, attributes, above.place)
    if tag == "header" and inside != MAIN:
        return BAD
    if inside == BAD:
        # some sites wrap the whole page in a form: an article in nothing worse than forms is one
        only_forms = above.bad_forms and not above.bad_others
        return MAIN if own == MAIN and only_forms else BAD
    if inside == NAMED and own != BAD:
        is_main = tag == "main" or re.search(r"\brole\s*=\s*[\"']?main\b", attributes, re.I)
        return MAIN if own == MAIN and is_main else NAMED
    return own


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, in time linear in its length."""
    out: list[Block] = []
    above = Open()
    held: list[tuple[str, bool]] = []
    link, breaks, articles = False, 0, 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(t for t, _ in held)).split())
        if text:
            linked = sum(len(t) for t, a in held if a) / max(1, sum(len(t) for t, _ in held))
            out.append(Block(text, above.place, above.article, above.headings > 0, linked))
        held.clear()

    for tag, closing, content in pieces(page):
        if tag is None:
            held.append((content, link))
            if breaks and content.strip():
                breaks = 0
        elif tag == "a":
            link = not closing
        elif tag == "br":
            breaks += 1
            held.append((" ", link))
            if breaks > 1:
                flush()
                breaks = 0
        elif tag in BLOCK or above.tags[tag] or (not closing and HINT.search(content) and _place(tag, content, NONE) >= BAD):
            flush()
            breaks = 0
            if tag in VOID:
                continue
            if closing:
                above.close(tag)
                link = False
                continue
            if tag == "body":
                above.clear()
            place, article = _placed(tag, content, above), above.article
            if place == MAIN and above.place != MAIN:
                articles += 1
                article = articles
            if tag == "p" and above.stack and above.stack[-1][0] == "p":
                above.pop()
            above.push(tag, place, article)
    flush()
    return out


def words_of(text: str) -> list[str]:
    return [TRIM.sub("", w) for w in text.lower().split()]


def stop_density(text: str, stop_words: frozenset[str] = STOP_WORDS) -> float:
    words = words_of(text)
    return sum(w in stop_words for w in words) / max(1, len(words))


def is_long(b: Block) -> bool:
    """Long enough for the rules, with few links and no heading."""
    return not b.heading and b.linked <= LINKED and (len(b.text) >= SHORT or len(b.text) + 2 * len(SYLLABLES.findall(b.text)) >= SHORT)


def is_unspaced(text: str) -> bool:
    return not text.isascii() and 2 * len(UNSPACED.findall(text)) > sum(map(str.isalpha, text))


def classify(blocks: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> None:
    """Both passes; every block gets a label."""
    _classify(blocks, stop_words, (BAD, NAMED))
    if not any(b.label for b in blocks) and any(b.place == NAMED for b in blocks):
        _classify(blocks, stop_words, (BAD,))


def _classify(blocks: list[Block], stop_words: frozenset[str], bad: tuple[int, ...]) -> None:
    long = [b for b in blocks if b.place not in bad and is_long(b)]
    unspaced = {b for b in long if is_unspaced(b.text)}
    spaced = [b for b in long if b not in unspaced]
    dense = {b for b in spaced if stop_density(b.text, stop_words) >= DENSE}
    tells = sum(len(b.text) for b in dense) >= EVIDENCE * sum(len(b.text) for b in long)
    good = dense | unspaced if tells else set(long)
    long = set(long)
    for b in blocks:
        if b.place in bad or b.linked > LINKED and not (b.heading and b.place == MAIN):
            b.label = False
        elif b not in long:
            b.label = None
        elif b in good:
            b.label = True
        else:
            b.label = None if b.place == MAIN else False
    lefts = _nearest(blocks, range(len(blocks)))
    rights = _nearest(blocks, range(len(blocks) - 1, -1, -1))
    for b, left, right in zip(blocks, lefts, rights, strict=True):
        if b.label is not None:
            continue
        if left is None and right is None:
            b.label = b.place == MAIN
        elif left is None or right is None:
            b.label = (left or right)[1]
        elif left[1] == right[1] or left[0] != right[0]:
            b.label = min(left, right)[1]
        else:
            b.label = b.place == MAIN or (b.heading and right[1])


def _nearest(blocks: list[Block], order: range) -> list[tuple[int, bool] | None]:
    """(distance, label) of each block's nearest decided one before it in ``order``, in its article if it has one."""
    out: list[tuple[int, bool] | None] = [None] * len(blocks)
    last: dict[int, int] = {}
    for i in order:
        b = blocks[i]
        # an article's blocks look in it, all others anywhere (-1)
        j = last.get(b.article if b.place == MAIN else -1)
        if j is not None:
            out[i] = abs(j - i), blocks[j].label
        if b.label is not None:
            last[-1] = i
            if b.place == MAIN:
                last[b.article] = i
    return out


def main_text(page: str, stop_words: frozenset[str] = STOP_WORDS) -> str:
    blocks = blocks_of(page)
    classify(blocks, stop_words)
    return "\n\n".join(b.text for b in blocks if b.label)


def language(page: str) -> str:
    """The language a page declares, without its region; empty where none."""
    if HTML.search(page):
        for tag, closing, attributes in pieces(page):
            if tag == "html" and not closing:
                found = LANGUAGE.search(attributes)
                return found[1].lower() if found else ""
    return ""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, pages: pages with the word in a long block; the empty word counts the pages."""
    counts: Counter[tuple[str, str]] = Counter()

    def counted() -> pa.RecordBatch:
        langs, words = zip(*counts, strict=True) if counts else ((), ())
        return pa.record_batch({"lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.string()), "pages": pa.array(counts.values(), pa.int64())})

    for batch in batches:
        for _, texts in text_chunks(batch.column(0)):
            for page in texts:
                long = [b.text for b in blocks_of(page) if b.place < BAD and is_long(b)]
                if long:
                    lang = language(page)
                    counts.update((lang, w) for w in {w for text in long for w in words_of(text) if w.isalpha() and len(w) <= 20} | {""})
                if len(counts) > COUNTED:
                    yield counted()
                    counts.clear()
    yield counted()


def learned_words(pages: DataFrame) -> dict[str, frozenset[str]]:
    """Stop words of each declared language: the given ones and its pages' most frequent."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("html").cast("string").alias("html"))
    counts = rows.mapInArrow(_count, "lang string, word string, pages long").groupBy("lang", "word").agg(F.sum("pages").alias("pages"))
    counts = checkpointed(counts.filter(F.col("pages") >= LEAST_PAGES * COMMON))
    totals = counts.filter(F.col("word") == "").select("lang", F.col("pages").alias("total")).filter(F.col("total") >= LEAST_PAGES)
    # one row per language
    common = counts.join(F.broadcast(totals), "lang").filter((F.col("word") != "") & (F.col("pages") >= COMMON * F.col("total")))
    found: dict[str, list[tuple[int, str]]] = {}
    # at most a page's words over COMMON for each language
    for r in common.select("lang", "word", "pages").collect():
        found.setdefault(r["lang"], []).append((-r["pages"], r["word"]))
    return {lang: STOP_WORDS.union(w for _, w in sorted(words)[:MOST_WORDS]) for lang, words in found.items()}


def _extract(batches: Iterator[pa.RecordBatch], learned: dict[str, frozenset[str]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_chunks(batch.column(2)):
            found = [main_text(t, learned.get(language(t), STOP_WORDS)) for t in texts]
            yield pa.record_batch(
                {
                    "page_id": batch.column(0).slice(first, len(texts)),
                    "url": batch.column(1).slice(first, len(texts)),
                    "text": pa.array(found, pa.string()),
                    "n_chars": pa.array(map(len, found), pa.int64()),
                }
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(partial(_extract, learned=learned_words(pages)), "page_id long, url string, text string, n_chars long")
