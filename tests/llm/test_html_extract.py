import html
import random
import re

import numpy as np

from cantata.llm import html_extract

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.digest(html_extract.extract(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as text", "1 as key", "'h' as host"))).collect()}


def test_markup():
    get = lambda page: html_extract.main_text(html_extract.blocks(page))
    assert get("<nav>menu</nav><article><h1>T &amp; U</h1><p>a<b>b</b>\n c<p>d<script>x('</p>')</script><br>e</article><footer>f</footer>") == "T & U ab c d e"
    assert get("<main><div class='post'>x</div><aside>no</aside><div id=comments><p>no</div><p class=\"notice\">no<p>yes<form>no</form></main>") == "x yes"
    assert get("<article>1 &lt; 2 &copy &am <!-- <p>no --> 3<style>p{}</style> 4") == "1 < 2 © &am 3 4"
    assert get("<article><ul><li>a<li class=share>no<li>b</ul><img alt='>'>c</article>") == "a b c"
    assert get("<div role=main>m<div role='navigation'>n</div></div>") == "m"
    assert get("") == get("<p>open only</p>") == ""


def test_open_blocks_lose_what_repeats_on_the_host(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for i in range(700):
        own = " ".join(word() for _ in range(rng.randint(10, 40)))
        rows.append((i, f"http://a.com/{i}", f"<div>Welcome to our small site here, dear reader {i % 3}</div><div><p>{own}</p></div><div>All of this is ours and not yours at all</div>"))
        want[i] = own
    rows += [(1000, "http://single.com/", "<p>Only page of its host, with a text</p>"), (1001, None, None), (1002, "http://x.com", ""), (1003, "http://a.com/q", "<article>All of this is ours and not yours at all</article>")]
    want |= {1000: "Only page of its host, with a text", 1001: "", 1002: "", 1003: "All of this is ours and not yours at all"}
    got = texts(spark, rows + rows[:2])
    assert got == want


def test_repeated_runs_against_brute_force():
    rng = random.Random(2)
    pages = [[(rng.choice([0, 2]), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for _ in range(rng.randint(0, 6))] for _ in range(30)]
    hosts = np.array([i % 2 for i in range(30)], np.uint64)
    s = html_extract.Streams(pages, hosts, 5)
    tokens = [[w for _, b in p for w in (html_extract.BORDER, *b.split(" "))] for p in pages]
    stands = {}
    for i, t in enumerate(tokens):
        for k in range(len(t) - 4):
            stands.setdefault((i % 2, *t[k : k + 5]), set()).add(i)
    runs = [(i % 2, *t[k : k + 5]) for i, t in enumerate(tokens) for k in range(len(t) - 4)]
    assert len(runs) == len(s.run) and len(set(runs)) == len(set(s.run.tolist())) == len(set(zip(runs, s.run.tolist())))
    hit = np.array([len(stands[r]) >= 3 for r in runs], bool)
    cut, covered = s.verdicts(hit)
    at, want_cut, want_covered = 0, [], []
    for i, (p, t) in enumerate(zip(pages, tokens)):
        inside = [False] * len(t)
        for k in range(len(t) - 4):
            if len(stands[(i % 2, *t[k : k + 5])]) >= 3:
                inside[k : k + 5] = [True] * 5
        n, at = 0, 0
        for _, b in p:
            m = 1 + len(b.split(" "))
            want_cut.append(2 * sum(inside[at : at + m]) >= m)
            n += sum(inside[at + 1 : at + m])
            at += m
        want_covered.append(n)
    assert cut.tolist() == want_cut and covered.tolist() == want_covered


def test_a_run_on_two_pages_is_found_on_a_host_of_any_size(spark):
    notice = "this one notice of seventeen words stands on only two of all the pages of its host"
    pages = lambda n: [(i, f"http://h.com/{i}", f"<p>own words {i} {i * 7} {i * 13} a{i} b{i} c{i} d{i} e{i}</p>" + (f"<div>{notice}</div>" if i in (0, n - 1) else "")) for i in range(n)]
    for n, limit in ((2, 1 << 20), (3000, 1 << 20), (300, 0)):
        df = spark.createDataFrame(pages(n), SCHEMA).repartition(7)
        got = {r.page_id: (r.text, r.n_boilerplate) for r in html_extract.extract(df, limit=limit).collect()}
        assert len(got) == n and not any("notice" in t for t, _ in got.values()) and all(f"own words {i} " in t for i, (t, _) in got.items())
        assert sorted(i for i, (_, k) in got.items() if k) == [0, n - 1] and got[0][1] >= 17


def test_class_names_within_main_text(spark):
    """Plain names cut, mixed ones are confirmed by repetition, headings stay."""
    get = lambda page: html_extract.main_text(html_extract.blocks(page))
    assert get('<article><header class="entry-header"><h1>T</h1></header><div class="share-buttons">no</div><section id="social-science">yes</section><div class="comment-list post">no</div>a</article>') == "T yes a"
    assert get('<main class="site-main"><div class="page-header">H</div><div id=ad-slot-3>no</div><div class="sidebar left">no</div><p>p</main>') == "H p"
    page = lambda i: f"<article><p>Read this text number {i} w{i} x{i} y{i} z{i}</p><div class='related-work'>Work {i} of a{i} b{i} c{i} d{i} e{i} f{i} g{i}</div><div class='entry-footer'>Filed under the things that all of our pages are filed under</div></article>"
    got = texts(spark, [(i, f"http://h.com/{i}", page(i)) for i in range(6)] + [(100, "http://one.com/", page(100))])
    assert all(got[i] == f"Read this text number {i} w{i} x{i} y{i} z{i} Work {i} of a{i} b{i} c{i} d{i} e{i} f{i} g{i}" for i in range(6))
    assert got[100].endswith("g100 Filed under the things that all of our pages are filed under")


def test_articles_repeat_each_other(spark):
    """Declared main text stays, however many pages of the host say the same."""
    for n in (7, 8, 20):
        got = texts(spark, [(i, f"http://h.com/{i}", f"<article><p>Read this text number {i}</p><p>Follow us on every page of this site, dear reader of ours</p></article>") for i in range(n)])
        assert all(got[i] == f"Read this text number {i} Follow us on every page of this site, dear reader of ours" for i in range(n))


def test_wrappers_around_main_text():
    get = lambda page: html_extract.main_text(html_extract.blocks(page))
    assert get('<body class="has-sidebar"><div class="layout no-sidebar"><article>a</article></div>') == "a"
    assert get('<div class="site has-sidebar"><div class="widget"><main>m<div class=share>no</div></main></div></div>') == "m"
    assert get("<form><p>no</p><article>a<form>no</form><div class='my-comments'>b</div></article></form>") == "a b"
    assert get("<article>a</article><div class='related posts'><article>teaser</article></div><footer><article>no</article></footer>") == "a"
    assert get("<nav><article>no</article></nav>") == ""
    open_ = lambda page: [t for kind, t in html_extract.blocks(page) if kind == html_extract.OPEN]
    assert open_("<form><p>all of the page</p><nav>no</nav></form>") == ["all of the page"] and open_("<p>yes</p><form>no</form>") == ["yes"]


def test_tags_that_may_be_left_out():
    get = lambda page: html_extract.main_text(html_extract.blocks(page))
    assert get("<html><head><title>t</title><body><article>hello main</article>") == "hello main"
    assert get("<head><meta charset=utf-8><p>no<article>a") == "a"
    assert get("<head><title>t</title><link rel=x><style>s</style></head><article>a</article>") == "a"
    assert get("<article>a<video src=x>b<p>c</article>") == "ab c"
    assert get("<article>a<video>no</video> b<map name=m>c<area></map></article>") == "a b c"


def test_parsing_takes_time_in_proportion():
    import time

    for unit in ('<a "', "<a ", '<b ">" ', "<a '", '<a "x" ', "<!--", "<script>", "</x>", "<div><b>", "<li><div><b>", "<p <", '<a x=">', "&", "<svg ", "</ ", "<b></i>"):
        page = unit * (400_000 // len(unit))
        began = time.perf_counter()
        html_extract.blocks(page + '>"')
        html_extract.blocks(page)
        assert time.perf_counter() - began < 4, unit


def test_odd_markup():
    get = lambda page: [t for _, t in html_extract.blocks(page)]
    assert get('a <b title="x>y">c</b> d') == ["a c d"]
    assert get('a <b title="x>y c</b> d') == ["a y c d"]  # no end but one in quotes: the tag ends there
    assert get("1 < 2 and 3 <") == ["1 < 2 and 3 <"]
    assert get("a <b c") == ["a <b c"]
    assert get("a<!-- b") == get("a<style> b") == ["a"]
    assert get("a<svg/>b<?x y?>c</ >d") == ["abcd"]
    assert get("<p>a<p>b<ul><li>c<li>d<p>e<li>f</ul>") == ["a", "b", "c", "d", "e", "f"]


def test_bytes_that_are_no_utf8_and_ties(spark):
    df = spark.createDataFrame([(1, "http://h/", b"<article>a\xff b</article>"), (1, "http://h/", b"<article>a\xff b</article>"), (2, None, b"<p>\xe4</p>")], "page_id long, url string, b binary").selectExpr("page_id", "url", "cast(b as string) as html")
    assert sorted((r.page_id, r.text) for r in html_extract.extract(df).collect()) == [(1, "a\ufffd b"), (1, "a\ufffd b"), (2, "\ufffd")]


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: (r.text, r.n_chars) for r in html_extract.digest(html_extract.extract(pages)).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:b|em|i)>", "", inside).replace("<", " <").replace(">", "> ") and re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inside))).split())
        assert out[r.page_id] == (want, len(want))


def test_empty(spark):
    assert html_extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0
