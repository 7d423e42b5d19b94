"""Filter audit against a count by hand, and main text of pages."""

import html
import itertools
import os
import re
from collections import Counter

import duckdb
import pytest
from outbreak_spark.llm.filter_audit import audit, default_filters
from outbreak_spark.llm.queries import QUERIES
from outbreak_spark.llm.tag_paths import extract, main_text, select_paths
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words int"
LABELS = "doc_id long, quality int, toxic int, part string"


def failed(k, text, rows):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
    out += "D" * bool(re.search(r"[#$%&*|]", text))
    return out + "E" * (k is not None and any(i is not None and i < k and (t or "") == text for i, t, *_ in rows))


def by_hand(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[n] == 1} for n in (0, 1))
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, failed(i, t or "", rows)) for i, t, s in rows if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                lost, kept = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                redundant = sum(x in f and any(y in f for y in order[: step - 1]) for _, f in own)
                out[part, order, step] = [len(kept), len(lost), redundant, sum(f == x for _, f in own), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
                left = kept
    shapley = Counter()
    for (part, order, step), r in out.items():
        shapley[part, order[step - 1]] += r[1]
    return {k: (*r, shapley[k[0], k[1][k[2] - 1]]) for k, r in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (4, "", ""), (5, None, "a"), (6, "one two two", "b"), (None, LONG, "b"), (None, LONG, "b"), (None, None, None), (7, "AB cd #" * 30, "b"),
    (8, "\x0b\x0c \t\r\n", "c"), (9, "é" * 20 + " Z ", "c"), (10, "x " * 100_000, "c"), (11, "x " * 100_000, "c"), (11, LONG + " &", "d"),
]


def test_audit_by_hand(spark):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (5, 1, None)]
    docs = spark.createDataFrame([(i, t, "en", s, 0, 7) for i, t, s in ROWS], DOCS).repartition(3)
    got = collected(audit(docs, spark.createDataFrame([(*x, "p") for x in labels], LABELS)))
    assert got == by_hand(ROWS, labels)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "en", "s", 1, 0)], DOCS)
    assert collected(audit(one, labels)) == by_hand([(1, "a", "s")], [])


def test_audit_with_other_filters(spark):
    docs = spark.createDataFrame([(i, t, "en", s, 0, 7) for i, t, s in ROWS], DOCS)
    few = {"x": F.col("words") < 2, "y": F.col("capitals") > F.lit(None).cast("int"), "z": default_filters()["E"]}
    rows = audit(docs, spark.createDataFrame([], LABELS), few).collect()
    assert len(rows) == 5 * 6 * 3 and all(r.removed == 0 for r in rows if r.filter == "y")  # a null condition passes


PAGE = """<!DOCTYPE html><html><head><title>Site &mdash; t</title><style>p{}</style></head><body class="page sidebar">
<header id="masthead"><h2>Site name</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, as all do. Accept.</div>
<div class="wrap"><div class="entry">
<h1>The&nbsp;headline &amp; more</h1><p>First paragraph of the <b>article</b>, which is long enough,
with\tmarks; and <a href='x?a=1&b=2'>a link</a>.<p>Second one &lt;tag&gt; &#233;&eacute;&copy no end, but a fair length, too.
<ul><li>An item of the list, with text.</li><li>Another</li></ul>
<blockquote>Cited words: they stay.</blockquote><form><p>Your e-mail, please.</p><input name=q></form>
<script>var s = "<p>no</p>"; if (a < b) c();</script><div class="adBox">Buy this, now!</div><p>End.</p><!-- <p>hidden</p> -->
<table><tr><td>a</td><td>b</td></tr></table></div>
<aside><p>About the author, who writes long sentences here, with commas, and stops.</p></aside>
<section id="comments"><p>I don't agree, at all, with anything written here; it is, frankly, wrong, and long.</p></section>
<div class="related-posts"><a href=1>One</a> <a href=2>Two</a></div></div>
<footer>&copy; 2024 all rights, reserved.</footer></body></html>"""


def test_page_by_hand():
    assert main_text(PAGE).split("\n\n") == [
        "The headline & more", "First paragraph of the article, which is long enough, with marks; and a link.", "Second one <tag> éé© no end, but a fair length, too.", "An item of the list, with text.", "Another", "Cited words: they stay.", "End.", "a b",
    ]


def test_other_pages():
    assert main_text("") == "" and main_text("<script>x</script>") == "" and main_text("only text, no tags") == "only text, no tags"
    assert main_text("<p>a<p>b <3 c & d</i>") == "a\n\nb <3 c & d"
    deep = "<div>" * 20_000 + "<p>in the deep" + "</div>" * 20_000
    assert main_text(deep) == "in the deep"
    cut = "<body><article><h1>A title</h1><p>Text, that is cut <b>off in a <a href='x"
    assert main_text(cut).startswith("A title\n\nText, that is cut off in a")
    comments = "<article><p>Short, but it is the article.</p></article><div class='comment-list'>" + "<p>A reader's long comment, with much to say, and more; still more.</p>" * 30 + "</div>"
    assert main_text(comments) == "Short, but it is the article."
    assert main_text("<main>" + "<p>word, </p>" * 100_000 + "</main>").count("word,") == 100_000


def test_paths_are_selected():
    import numpy as np

    path = np.array([1, 1, 1, 1, 2, 3, 3, 3, 3, 4])
    length, marks = np.array([4, 5, 6, 5, 60, 400, 300, 12, 500, 50.0]), np.array([0, 0, 0, 0, 1, 9, 7, 1, 12, 1.0])
    assert select_paths(path, length, marks).tolist() == [k == 3 for k in path]


def test_extract_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None), (2, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, element string")
    got = sorted(map(tuple, extract(pages, "element").select("page_id", "url", "element", "text", "n_chars").collect()), key=repr)
    assert got == sorted([(1, "u", "x", "a", 1), (1, "u", "x", "a", 1), (None, None, None, "", 0), (2, "v", "y", "", 0)], key=repr)
    assert extract(pages.where("page_id > 9")).count() == 0
    with pytest.raises(ValueError, match="columns"):
        extract(pages, "html")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_page_query(spark):
    """The tables' pages have one article each: its markup, cut by hand."""
    got = {r.page_id: r for r in QUERIES["op12_tag_path_ratios"](spark, DATA).collect()}
    pages = duckdb.sql(f"select page_id, url, html from '{DATA}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for k, url, source in pages:
        parts = re.split(r"</?(?:p|h1)>", source.split("<article>")[1].split("</article>")[0])
        want = "\n\n".join(s for p in parts if (s := " ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split())))
        assert (got[k].url, got[k].text, got[k].n_chars) == (url, want, len(want))
