"""The page scanner against the standard library's parser with a plain tree, and previews of odd pages."""

import random
import time
import tracemalloc
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.sources import pages as P

PICKS = (P.Pick("d", "div", "class", "x", "id"), P.Pick("s", "span"), P.Pick("m", "meta", "property", "t", "content"), P.Pick("b", "b", "id", "1"))


class Tree(HTMLParser):
    """Elements as nested lists: [tag, attributes, children]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(e)
        if tag not in P.VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, {k: v or "" for k, v in attrs}, []])

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style"):
            self.open[-1][2].append(data)


def text(e):
    return "".join(x if isinstance(x, str) else text(x) for x in e[2])


def plain(page):
    tree = Tree()
    tree.feed(page or "")
    tree.close()
    out = []

    def walk(e):
        mine = []
        for field, tag, key, value, take in PICKS:
            if e[0] == tag and (key is None or key in e[1] and (value in e[1][key].split() if key == "class" else e[1][key] == value)):
                mine.append(len(out))
                out.append([field, text(e), e[1].get(take) if take else None, 0])
        for child in e[2]:
            if not isinstance(child, str):
                walk(child)
        for i in mine:
            out[i][3] = len(out) - 1

    walk(tree.root)
    return [tuple(x) for x in out]


def scanned(spark, html):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "i int, h string").select("i", P.elements(F.col("h"), PICKS).alias("x")).orderBy("i").collect()
    return [[tuple(e) for e in r.x] for r in rows]


def test_elements_match_a_plain_tree(spark):
    bits = ['<div class="x" id=7>', "<div class='a x b' ID='q&amp;r'>", "<DIV>", "</div>", "</ div>", "<span>", "</span >", "<span/>", "<b id=1>", '<b id="1" id="2">', "</b>", "<br>", "<br/>", "</br>",
            '<meta property="t" content="a > b">', "<meta content='z' property=t/ >", "<script>var a='</div><span>';</script>", "<style>b{}</style>", "<!-- <span> -->", "<!DOCTYPE html>", " a &lt;i&gt; ", "5 < 6 ", "é\n", "</html>", "<p title=\"it's\">"]
    rng = random.Random(5)
    html = ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(400)]
    html = [h for h in html if "</ div>" not in h and "/ >" not in h] + [None, "", "no tags"]
    assert len(html) > 100
    for h, got in zip(html, scanned(spark, html), strict=True):
        assert got == plain(h), h


def test_unclosed_pieces_end_with_the_page(spark):
    cases = ['<span>a<div class="x">b', '<span>a<div class="x', "<span>a<!-- b", "<span>a<script>b</div>", '<span title="a>b<span>', "a < b <", "</span></div>", "<span><b id=1></span>c</b>"]
    got = [[(f, t, last) for f, t, _, last in x] for x in scanned(spark, cases)]
    assert got == [[("s", "ab", 1), ("d", "b", 1)], [("s", "a", 0)], [("s", "a", 0)], [("s", "a", 0)], [], [], [], [("s", "", 1), ("b", "", 1)]]


def test_long_pages_take_linear_time(spark):
    n = 100_000
    pages = ["<div>" * n + "</i>" * n, "<b>" * n + "</div>" * n, "<!--" * n, '<a "' * n, "<a <" * n, "<span>a</span>" * n, "<script>" * n, "< " * n, "<p " + "a=1 " * n + ">", "<i" + " " * n, "&" * n]
    scanned(spark, [""])
    began = time.perf_counter()
    got = scanned(spark, pages)
    assert time.perf_counter() - began < 30
    assert [len(x) for x in got] == [0, 0, 0, 0, 0, n, 0, 0, 0, 0, 0]


def test_previews_of_odd_pages(spark):
    head = '<meta property="og:title" content="T">'
    cases = [
        None, "", head, '<meta property="og:title" content="Telegram: Contact @n">', '<meta property="og:title"><meta property="og:description" content="d">',
        head + "<div class=tgme_page_extra>\n١٢ subscribers </div>", head + "<div class=tgme_page_extra>no members</div><div class=tgme_channel_info_counter><span class=counter_value>1.25m</span><span class=counter_type>Subscribers</span></div>",
        head + "<div class=tgme_channel_info><div class=tgme_channel_info_counter><span class=counter_value>7</span></div></div><span class=tgme_widget_message_views>x</span><span class=tgme_widget_message_views> 2.01K\n</span><span class=tgme_widget_message_views>0</span>",
    ]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "i int, h string").select("i", P.elements(F.col("h"), P.PREVIEW).alias("f"))
    got = [tuple(r.x) for r in rows.select("i", P.preview(F.col("f"), F.lit("n")).alias("x")).orderBy("i").collect()]
    none = (False, False, False, "", "", 0, 0)
    assert got == [none, none, (True, False, False, "T", "", 0, 0), none, none, (True, True, False, "T", "", 12, 0), (True, True, True, "T", "", 1250000, 0), (True, True, False, "T", "", 0, int(2.01 * 1000))]


def test_posts_keep_clashing_names_and_leave_out_undated(spark):
    block = lambda mark, inner: f'<div class="tgme_widget_message" {mark}>{inner}</div>'
    time_ = '<time datetime="2024-01-02T03:04:05+02:00">'
    text_ = '<div class="tgme_widget_message_text"> a<div class=in>b</div> </div>'
    page = block('data-post="c/5"', text_ + time_) + block('data-post="c/0"', time_) + block("", time_) + block('data-post="c/6"', "<time datetime=soon>") + block('data-post="x"', time_) + block('data-post="8"', time_ + "<span class=tgme_widget_message_views>1,234</span>")
    df = spark.createDataFrame([("k", page, "mine"), ("e", None, "mine")], "_k string, h string, field string").select("_k", "field", P.elements(F.col("h"), P.PREVIEW).alias("f"))
    got = sorted((r._k, r.field, r.message_id, r.text, r.at.isoformat(), r.views) for r in P.posts(df, ["_k", "field"], "f").collect())
    assert [(x[0], x[1], x[2], x[3], x[5]) for x in got] == [("k", "mine", 5, "ab", 0), ("k", "mine", 8, "", 1234)] and len({x[4] for x in got}) == 1
    assert P.posts(df.limit(0), ["_k"], "f").count() == 0


def test_profiles(spark):
    cases = [(None, "n"), ('<title> A &amp; B </title><a href="/1">x</a><a>y</a><a href="">z</a>', "n"), ('<meta property="og:title" content=" P "><meta name=description content="plain">', "n"), ('<meta property="og:description"><meta name="description" content="plain">', "n")]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, h string, n string").select("i", "n", P.elements(F.col("h"), P.PROFILE).alias("f"))
    got = [(tuple(r.a), tuple(r.b)) for r in rows.select("i", P.profile(F.col("f"), F.col("n")).alias("a"), P.profile(F.col("f"), F.col("n"), True).alias("b")).orderBy("i").collect()]
    assert got[0] == (("n", "", []), ("n", "", []))
    assert got[1] == (("n", "", ["/1", ""]), ("A & B", "", ["/1", ""]))
    assert got[2][0] == ("P", "plain", []) and got[3][0] == ("n", "", [])


def test_sites_keep_entities_that_were_cut_off(spark, tmp_path):
    import __spark_entry__

    html = ["<title>a &amp; b &amp</title><a href='/x'>", "<title>&ltx &#65; &#65 &copy; &nosuch; &ampx;</title>", "<title>&amp;lt; &amp</title>"]
    spark.createDataFrame([(i, "http://h/", x) for i, x in enumerate(html)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = __spark_entry__.queries()["src8_sites"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [r.title for r in got] == ["a & b &amp", "&ltx A &#65 © &nosuch; &ampx;", "&lt; &amp"]
    rows = spark.createDataFrame([(html[0],)], "h string").select(P.elements(F.col("h"), P.PROFILE).alias("f"))
    assert rows.select("f.text").first()[0][0] == "a & b &"


def test_a_batch_holds_few_pages_as_objects():
    pages = pa.array(["<span>a</span>" * 100] * 3000)
    run = P._scanner(PICKS, False)
    tracemalloc.start()
    got = run(pages)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3000 and len(got[2999]) == 100 and most < 20_000_000
    assert len(run(pages.slice(0, 0))) == 0
