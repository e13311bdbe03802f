"""Language identification and main-text extraction."""

from churnlab.llm import htmltext, wordlid
from conftest import SF01
from llm_data import docs, rows_of

SAMPLES = {
    "en": ["the house of the king and the queen", "this is the way that we were going to the town", "they have been with us for a long while"],
    "de": ["das haus und der garten sind nicht weit", "wir haben eine katze und einen hund auf dem dach", "der mann ist mit dem zug gefahren"],
    "fr": ["la maison du roi est dans le village", "nous avons une belle voiture pour les vacances", "il ne faut pas que vous soyez en retard"],
}


def labelled(n=40):
    return [(len(SAMPLES) * i + j, SAMPLES[lang][i % 3], lang) for i in range(n) for j, lang in enumerate(SAMPLES)]


def test_held_out_accuracy_on_the_given_documents(spark):
    table = spark.read.parquet(f"{SF01}/documents.parquet")
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    held = [r for r in wordlid.languages(table).collect() if r.held_out]
    assert len(held) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.99
    assert all(0 <= r.score <= 1 for r in held)


def test_predictions_without_labels_and_odd_texts(spark):
    odd = [(1001, None, None), (1002, "", "en"), (1003, "123 !? ½²", None), (1004, "DER GARTEN", None), (1005, "ungesehenes maison", None), (1006, "the " * 50_000, None), (None, "the king", "en"), (1004, "DER GARTEN", None)]
    out = rows_of(wordlid.languages(docs(spark, labelled() + odd)), "doc_id", "held_out", "lang_pred", "score")
    got = {r[0]: r[2:] for r in out}
    assert got[1001] == got[1002] == got[1003] == ("und", 0.0)
    assert got[1004][0] == "de" and got[1006][0] == "en" and got[None][0] == "en"
    assert len(out) == len(labelled()) + len(odd)


def test_label_source_and_id_are_no_inputs(spark):
    rows = labelled()
    model = wordlid.fit(docs(spark, rows))
    a = rows_of(wordlid.identify(docs(spark, rows), model), "doc_id", "lang_pred", "score")
    swapped = [(r[0], r[1], "xx", "other") for r in rows]
    assert a == rows_of(wordlid.identify(docs(spark, swapped), model), "doc_id", "lang_pred", "score")


def test_backoff_uses_the_longest_known_grams():
    model = wordlid.Model(["a", "b"], [("a", 0, "known", 5), ("a", 3, "unk", 9), ("b", 3, "unk", 1), ("b", 3, "xyz", 9), ("b", 1, "z", 50), ("a", 1, "y", 50)])
    assert (model.word("known") == model.rows[model.places[0]["known"]]).all()
    assert model.word("unkz")[0] > model.word("unkz")[1]
    assert model.word("zzz")[1] > model.word("zzz")[0]
    assert model.word("qqq").tolist() == [0, 0]
    assert (model.word("unkz") == model.rows[model.places[3]["unk"]]).all()


def test_nothing_learned(spark):
    out = wordlid.languages(docs(spark, [(1, "some text", None), (2, None, None)]))
    assert rows_of(out, "lang_pred", "score") == [("und", 0.0), ("und", 0.0)]
    assert wordlid.languages(docs(spark, [])).count() == 0


def test_identified_keeps_clean_documents_and_fills_labels(spark):
    rows = labelled(10) + [(900, "das ist der garten", None), (901, "...", "en"), (902, None, "en")]
    out = {r.doc_id: r for r in wordlid.identified(docs(spark, rows)).collect()}
    assert 901 not in out and 902 not in out and len(out) == 31
    assert out[900].lang == "de" and out[900].text == "das ist der garten"


ARTICLE = "<h1>A title</h1><p>The first paragraph of the text is long enough to be read as running text by the rules, and it has the words of the language.</p><p>Short.</p><p>The last paragraph is again a long one with the words that are in all of the texts of this kind &amp; more.</p>"
WANT = "A title\n\nThe first paragraph of the text is long enough to be read as running text by the rules, and it has the words of the language.\n\nShort.\n\nThe last paragraph is again a long one with the words that are in all of the texts of this kind & more."


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p>";</script></head><body>
    <header><h1>Site name</h1><nav><ul><li><a href=/a>Home</a></li></ul></nav></header><!-- <p>no</p> -->
    <div class="cookie-notice"><p>We use cookies to make the site better for you and for all of the people that come to it, so that is it.</p></div>
    <form><p>Sign up for the letter that we write to all of you in the week, it is for free and it is the best.</p><select><option>The</option></select></form>
    <article>{ARTICLE}<div class="ad">Buy the thing that is the best of all the things in the world and it is not dear.</div>
    <div id="comments"><p>I think that this is the best of the texts that I have read in all of my life, so it was good to be here.</p></div></article>
    <aside><p>The other texts that you may like are in this list, and it is a long list of the texts that we have.</p></aside>
    <footer>&copy; The site and all of the people that have made it</footer></body></html>"""
    assert htmltext.main_text(page) == WANT


def test_page_without_an_article_element():
    links = "".join(f'<li><a href="/{i}">Some entry {i}</a></li>' for i in range(12))
    page = f"<html><body><div><ul>{links}</ul></div><div>{ARTICLE}</div><div class='footer'><p>All of the rights are with the people that made the site, and not with you or with the others.</p></div></body></html>"
    assert htmltext.main_text(page) == WANT


def test_names_about_the_page_are_no_hints():
    page = f'<html><body class="single menu-open"><div class="wrap has-sidebar"><div class="post">{ARTICLE}</div><div class="sidebar"><p>The list of all the other texts that are on the site and that you may like to read.</p></div></div></body></html>'
    assert htmltext.main_text(page) == WANT


def test_broken_markup_and_references():
    assert htmltext.main_text("<article><p>a &lt;b&gt; &eacute;&nbsp;x<p><b>c<br>d<p>e</article><p") == "a <b> é x\n\nc d\n\ne"
    assert htmltext.main_text("<article><p>cut off <scr") == "cut off"
    assert htmltext.main_text("<article><script>never closed <p>x") == ""
    assert htmltext.main_text("a < b and <article>x</article></p></div>") in ("x", "a < b and\n\nx")
    assert htmltext.main_text("<article hidden><p>x</p></article><main><p>y</p></main>") == "y"


def test_short_blocks_follow_their_neighbours():
    good = "<p>This is one of the long paragraphs that the rules can tell to be running text of the page.</p>"
    bad = "<p><a href='/x'>a long line of links that is not of the text at all, it is a list of the other pages</a></p>"
    page = f"<body><div>{bad}<p>Near the links</p>{bad}{good}<p>Near the text</p>{good}</div></body>"
    text = htmltext.main_text(page)
    assert "Near the text" in text and "Near the links" not in text


BODY = "".join(f"<p>This is paragraph {i} of the text that stands on the page, and it is long enough to be read as running text.</p>" for i in range(3))


def test_text_beside_an_article_card_is_kept():
    page = f"<body><div>{BODY}</div><article><h3>More</h3><a href='/x'>Another of the texts on the site</a></article></body>"
    assert htmltext.main_text(page).count("This is paragraph") == 3


def test_class_names_that_hold_a_hint_are_none():
    for start in ("<article class='post-12 post category-legal tag-social'>", "<div class='right-sidebar'>", "<div class='content-sidebar-wrap'>", "<div class='post widget'>", "<div class='sidebar'><main>", "<div class='legal'>"):
        assert htmltext.main_text(f"<body>{start}{BODY}").count("This is paragraph") == 3, start


SWEDISH = ["Det var en gång en liten flicka som bodde i ett hus vid skogen och som hade en katt och en hund.", "Hon gick ut i skogen och det var en dag som var så vacker att hon inte ville gå hem till sitt hus."]


def test_languages_without_given_stop_words():
    page = "<body><ul><li><a href='/a'>Hem</a></li></ul><div>" + "".join(f"<p>{x}</p>" for x in SWEDISH) + "</div></body>"
    assert htmltext.main_text(page) == "\n\n".join(SWEDISH)
    japanese = "これは空白のない言葉で書かれた長い文章であり、本文として読まれるべきものです。"
    notice = "We use the cookies that are on the site to make it better for you and for all of the others."
    assert japanese in htmltext.main_text(f"<body><div><p>{japanese}</p><p>{japanese}</p></div><div><p>{notice}</p></div></body>")


def test_stop_words_are_learned_from_the_pages(spark):
    listed = "Bokhylla Matbord Stolar Lampor Mattor Gardiner Kuddar Speglar Sängar Soffor Hyllor Skåp Byråer Garderober"
    rows = [(i, "u", f"<html lang='sv-SE'><body><div><p>{SWEDISH[0]} {i}</p><p>{SWEDISH[1]}</p></div>{f'<div><p>{listed}</p></div>' if i == 7 else ''}</body></html>") for i in range(30)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {"och", "som", "en"} <= htmltext.learned_words(table)["sv"]
    got = {r.page_id: r.text for r in htmltext.extract(table).collect()}
    assert got == {i: f"{SWEDISH[0]} {i}\n\n{SWEDISH[1]}" for i in range(30)}


def test_extract_over_a_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x", 1), (2, None, None, "x", 1), (3, "v", "", None, None), (None, "w", "<article>é</article>", "x", 1), (1, "u", f"<article>{ARTICLE}</article>", "x", 1), (4, "long", "<article>" + "<p>the word</p>" * 20_000 + "</article>", "", 0)]
    got = rows_of(htmltext.extract(spark.createDataFrame(rows, schema)), "page_id", "url", "text", "n_chars")
    assert [r[3] for r in got] == [1, len(WANT), len(WANT), 0, 0, 20_000 * 10 - 2]
    assert htmltext.extract(spark.createDataFrame([], schema)).count() == 0


def test_given_pages_equal_their_articles(spark):
    import html
    import re

    table = spark.read.parquet(f"{SF01}/pages.parquet")
    for row in htmltext.extract(table).join(table.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert row.text == "\n\n".join(b for b in blocks if b)
