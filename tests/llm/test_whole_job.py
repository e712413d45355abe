"""Cases in which an operator once did less than the whole job."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import decontamination, html_text, nearest


def test_items_that_share_a_passage(spark):
    """Each item of a document has its own stretches: a gap stays a gap, whatever an earlier item has reached."""
    passage = " ".join(f"p{i}" for i in range(10))
    docs = spark.createDataFrame([(1, " ".join([passage, *(f"f{i}" for i in range(980)), passage]))], "doc_id long, text string")
    items = [(1, passage), (2, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.search(decontamination.index(docs), bench).collect()
    assert sorted((r["item_id"], r["start"], r["end"]) for r in found) == [(i, a, a + 10) for i in (1, 2) for a in (0, 990)]
    row = decontamination.contamination(docs, bench).collect()[0]
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (1000, 20, 2)


def test_left_out_elements_end_where_they_end():
    page = "<article><p>one</p>{}<p>two</p><p>three</p></article>"
    for tag in ("<svg/>", "<svg class='i'/>", "<math />", "<iframe src='x'/>", "<video-player src='x'></video-player>", "<title-bar>", "<object-x/>", "<script src='x'/>"):
        assert html_text.extract(page.format(tag)) == "one\ntwo\nthree", tag
    for name in ("svg", "object", "video", "audio", "canvas", "iframe", "math", "template", "noscript", "title", "textarea"):
        assert html_text.extract(page.format(f"<{name} a='b'>")) == "one\ntwo\nthree", name
        assert html_text.extract(page.format(f"<{name} a='b'>left out<p>too</p></{name} >")) == "one\ntwo\nthree", name
        assert html_text.extract(page.format(f"<{name.upper()}><b>left out</{name}><{name}>")) == "one\ntwo\nthree", name
    assert html_text.extract(page.format("<iframe src=http://x/>left out</iframe>")) == "one\ntwo\nthree"
    # code without an end tag is code to the end; other cases of code are left out whole
    assert html_text.extract(page.format("<script>code('<p>no</p>')")) == "one"
    assert html_text.extract(page.format("<script a=\"b>code<p>no</p></script>")) == "one\ntwo\nthree"
    assert html_text.extract(page.format("<svg>" * 30_000)) == "one\ntwo\nthree"


def test_names_and_languages_keep_the_article():
    english = "the cat and the dog were in the house with all of the other animals that have been there. " * 4
    body = f"<p>{english}</p><p>Yes, it was so.</p>"
    want = english.strip() + "\nYes, it was so."
    for start, end in (
        ("<body class='right-sidebar'>", "</body>"), ("<body class='search' style='display:none'><div>", "</div></body>"), ("<article class='post comments-open'>", "</article>"), ("<main class='search-enabled'>", "</main>"),
        ("<div class='with-sidebar'>", "</div>"), ("<div class='layout-sidebar'>", "</div>"), ("<div class='page-share'><article>", "</article></div>"), ("<div title='a hidden gem'>", "</div>"), ("<html class='no-search'><body>", "</body></html>"),
    ):
        assert html_text.extract(start + body + end) == want, start
    for start, end in (("<div class='site-footer'>", "</div>"), ("<div class='a sidebar'>", "</div>"), ("<div id=ad>", "</div>"), ("<div hidden>", "</div>"), ("<div aria-hidden='true'>", "</div>"), ("<div style='display: none'>", "</div>"), ("<article class='comment'>", "</article>")):
        assert html_text.extract(f"<div>{body}</div>{start}<p>{english.upper()}</p>{end}") == want, start
    italian = "Il gatto dorme nella casa grande mentre gli altri animali corrono fuori tra gli alberi verdi e alti. " * 4
    russian = "Кошка спит в большом доме, пока другие животные бегают снаружи между высокими зелёными деревьями. " * 4
    for text in (italian, russian):
        page = f"<div><a href='/'>{text}</a></div><div><p>{text}</p><p>{text[:99]}</p></div><div>© 2020</div>"
        assert html_text.extract(page).startswith(text.strip() + "\n" + text[:99].strip()) and html_text.extract(page).count(text.strip()) == 1
    # refused lists on a page of a known language stay out
    assert html_text.extract(f"<div>{body}</div><div><p>{'red green blue yellow ' * 4}</p></div>") == want


def test_near_dedup_stage_goes_by_rows(spark):
    """Null ids and several texts of one id lose nothing but rows equal in id and text, and copies of a lesser id."""
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, None), (None, ""), (5, text[2]), (5, text[3]), (5, text[3]), (6, text[3]), (7, text[4]), (8, text[5]), (8, text[4]), (9, text[6] + " end"), (3, text[6])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _source string")
    got = corpus_pipeline.near_dedup_filter(spark, docs, "")
    assert got.columns == docs.columns
    want = [(None, text[0]), (None, text[1]), (None, None), (None, ""), (5, text[2]), (5, text[3]), (7, text[4]), (8, text[5]), (3, text[6])]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_repeated_vectors_count_once(spark):
    """A vec_id repeated more than k times, as it is or with other vectors, takes one place."""
    rng = np.random.default_rng(4)
    near = np.array([1.0, 0, 0, 0])
    rows = [(0, near)] + [(1, near + 0.001)] * 40 + [(2, near + 0.001 * rng.normal(size=4)) for _ in range(40)] + [(10 + i, near + 0.01 * (i + 1) * np.array([0, 1.0, 0, 0])) for i in range(8)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in nearest.search(table, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert sorted(got[:2]) == [1, 2] and got[2:] == [10, 11, 12]


def article_blocks(page):
    """A plain reading of a page: the blocks of text under article, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        depth, out, text = 0, [], ""

        def block(self):
            if self.depth and " ".join(self.text.split()):
                self.out.append(" ".join(self.text.split()))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("article", "p", "h1", "div", "footer"):
                self.block()
            self.text += " " * (tag == "br")
            self.depth += tag == "article"

        def handle_endtag(self, tag):
            if tag in ("article", "p", "h1", "div", "footer"):
                self.block()
            self.depth -= tag == "article"

        def handle_data(self, data):
            self.text += data

    reader = Reader()
    reader.out = []
    reader.feed(page)
    reader.block()
    return "\n".join(reader.out)


def test_pages_against_a_plain_reading(spark):
    """The given pages' articles; and nearly all of it with the article tags taken away, when the rules of density decide alone."""
    import re

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    want = [article_blocks(p) for p in pages]
    assert [html_text.extract(p) for p in pages] == want
    bare = [html_text.extract(re.sub(r"<(/?)article\b", r"<\1div", p)) for p in pages]
    assert sum(map(len, bare)) >= 0.98 * sum(map(len, want)) and sum(a == b for a, b in zip(bare, want, strict=True)) >= 0.85 * len(pages)
    assert all(set(b.split("\n")) <= {*w.split("\n"), ""} for b, w in zip(bare, want, strict=True)), "nothing else comes in"


def test_density_decides(monkeypatch):
    good = "the cat and the dog were in the house with all of the other animals that have been there. " * 4
    tags = "red green blue yellow purple orange silver golden crimson scarlet " * 2
    page = f"<div><p>{good}</p><p>{tags}</p><p><a href='/x'>{good}</a></p><p>Yes.</p></div>"
    assert html_text.extract(page) == good.strip()
    # short blocks go with their neighbours, before and after
    assert html_text.extract(f"<div><p>{good}</p><p>Yes.</p><p><a href='/x'>{good}</a></p></div>") == good.strip() + "\nYes."
    # a link around blocks counts in all of them; one without an end in its own block alone
    assert html_text.extract(f"<div><a href='/x'><div>{good}</div><div>{good}</div></a></div><p>{good}</p>") == good.strip()
    assert html_text.extract(f"<p><a href='/x'>one</p><p>{good}</p><p><a href='/y'>two</a></p>").endswith(good.strip())
    # between good blocks a weak one is part of the text, in the article and outside
    assert tags.strip() in html_text.extract(f"<div><p>{good}</p><p>{tags}</p><p>{good}</p></div>")
    assert tags.strip() in html_text.extract(f"<article><p>{good}</p><p>{tags}</p></article>")
    # without stop words the weak block can't be told from the text
    monkeypatch.setattr(html_text, "STOPS", frozenset())
    assert html_text.extract(page) != good.strip()


def test_pages_without_their_tags(spark, monkeypatch):
    """The block rules alone: article and main tags made divs, then the lists of names and tags taken away as well."""
    import re
    from collections import Counter

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("html IS NOT NULL").collect()]
    want = [Counter(html_text.extract(p).split("\n")) for p in pages]
    bare = [re.sub(r"<(/?)(article|main)\b", r"<\1div", p) for p in pages]
    n = lambda c: sum(len(k) * v for k, v in c.items())
    for most in (0.01, 0.05):
        got = [Counter(html_text.extract(p).split("\n")) for p in bare]
        total = sum(map(n, want))
        assert sum(n(a & b) for a, b in zip(want, got, strict=True)) >= 0.98 * total
        assert sum(n(b - a) for a, b in zip(want, got, strict=True)) <= most * total
        monkeypatch.setattr(html_text, "BAD_NAMES", frozenset())
        monkeypatch.setattr(html_text, "BAD_TAGS", frozenset())


def test_articles_outside_article_tags():
    body = [f"The story of day {i} is that it was told by all of them in the town, and they had no other way to say what it was about. Some of the people said that it was good for all of us." for i in range(5)]
    divs = "".join(f"<div>{b}</div>" for b in body)
    card = "<article class=card><p>Read our next story about the sea.</p></article>"
    menu = "<nav><a href=/>Home</a> <a href=/x>More of it</a></nav>"
    assert html_text.extract(f"<body>{menu}{divs}{card}<footer>All rights of the town</footer></body>").split("\n")[:5] == body
    assert html_text.extract(f"<body>{menu}<article>{divs}</article><p>Short one.</p></body>").split("\n") == body
    # a page of a few short paragraphs
    assert html_text.extract("<p>x") == "x" and html_text.extract(f"{menu}<p>One.</p><p>Two words.</p>") == "One.\nTwo words."
    assert html_text.extract(menu) == "" and html_text.extract("") == ""
