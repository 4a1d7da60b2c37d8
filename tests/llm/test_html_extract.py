import html
import re

from lumenfield.llm import html_extract, queries

MARKED = """<html><head><title>No</title></head><body><header><a href="/">Site</a></header><nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav>
<article><h1>Big &amp; bold</h1><p>First <b>par</b>agraph, with   words.<br>And&nbsp;more, of it.<p>Second paragraph, longer than others. It has two sentences.
<div class="ad">Buy now</div><div class="comments"><p>Nice article, I think.</div></article><aside>Side</aside><footer>&copy; 2020</footer><script>var x = "<p>no</p>";</script></body>"""


def brute(page):
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    if not found:
        return ""
    body = re.sub(r"<(?:/?(?:p|h1)|br)[^>]*>", "\n\n", found[1])
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", b)).split()) for b in body.split("\n\n")]
    return " ".join(b for b in blocks if b)


def test_query_against_brute_force(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op9_html_extraction(spark, sf).collect()}
    for i, page in pages.items():
        assert got[i] == (brute(page), len(brute(page)))


def test_marked_page_and_pages_without_marks(spark):
    plain = MARKED.replace("article>", "div>").replace("<header>", '<div id="header">').replace("</header>", "</div>")
    rows = [(1, MARKED), (2, plain), (3, None), (4, ""), (5, "<p"), (6, "<div hidden>no</div>"), (7, "</p></div><nav>menu")] + [(10 + i, MARKED) for i in range(50)]
    df = spark.createDataFrame([(i, h, "clash") for i, h in rows], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    want = "Big & bold First paragraph, with words. And more, of it. Second paragraph, longer than others. It has two sentences."
    assert got[1] == got[2] == got[10] == want
    assert [got[i] for i in range(3, 8)] == [""] * 5
    assert html_extract.extract(df.limit(0)).collect() == []


def test_messages_give_the_marginals_of_the_whole_tree():
    import itertools
    import math

    nodes = html_extract.parse("<div><p>One, two. Three.</p><ul><li><a>x</a></li></ul></div>")
    model = html_extract.Model({"all|0": 40, "all|1": 30, "tag p|1": 20, "tag li|0": 9, "any 0|0": 30, "any 0|1": 9, "any 1|1": 20, "edge p 1|1": 7, "edge li 0|0": 5})
    total, on = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        w = math.log((0.9, 0.1)[states[0]])
        for i, x in enumerate(nodes):
            w += states[i] * sum(map(model.weight, html_extract.features(x)))
            if i:
                w += model.edge(x.tag, states[x.parent])[states[i]]
        total += math.exp(w)
        for i, s in enumerate(states):
            on[i] += s * math.exp(w)
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(nodes), on))


def test_only_attributes_hide_not_words_in_their_values(spark):
    shown = ['title="The hidden cost of rain"', 'aria-label="a hidden gem"', 'class="overflow hidden md"', "data-style='display: none'", 'title="aria-hidden=true"', 'title="hidden costs', "aria-hidden=false"]
    away = ["hidden", 'hidden=""', "HIDDEN class=x", 'aria-hidden="true"', "aria-hidden=true", 'style="color: red; display : none"', "style=display:none"]
    hides = lambda a: html_extract.parse(f"<p {a}>text</p>")[1].hidden
    assert [hides(a) for a in shown] == [False] * len(shown) and [hides(a) for a in away] == [True] * len(away)
    page = MARKED.replace("<article>", '<article title="The hidden cost of rain">').replace("<h1>", '<h1 class="overflow hidden md">')
    rows = [(1, page)] + [(10 + i, MARKED) for i in range(50)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1] == got[10] != ""


LABELLED = """<html><body><zz-top><a href=x>Home</a> <a href=y>News of today</a></zz-top><div class="k1"><h2>{0}</h2><p>{1}, as they say. It went on, and on, for a day or so.</p><p>Then {2}, which nobody saw. The end, really.</p></div>
<div class="k2"><p>Buy {0} today, it is cheap. Really, it is a bargain, and more so now.</p></div></body></html>"""


def test_labelled_pages_train_what_marks_do_not_show(spark):
    """No page marks its article; an advert has the form of prose, and only labels tell it apart."""
    words = [("Rain", "It rained", "the sun came"), ("Snow", "It snowed", "a thaw set in"), ("Wind", "It blew", "calm came")]
    text = lambda a, b, c: f"{a} {b}, as they say. It went on, and on, for a day or so. Then {c}, which nobody saw. The end, really."
    rows = [(i, LABELLED.format(*words[i % 2]), text(*words[i % 2])) for i in range(40)]
    counts = html_extract.train(spark.createDataFrame(rows, "page_id long, html string, main string"), "main")
    asked = spark.createDataFrame([(9, LABELLED.format(*words[2]))], "page_id long, html string")
    assert html_extract.extract(asked, counts).first()["text"] == text(*words[2])


def test_pages_without_marks_or_labels_give_their_long_texts(spark):
    prose = "It rained all day, and the river rose. Nobody had seen so much water, not even the old. " * 3
    page = f"<html><body><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><div><p>{prose}</p><p>{prose}</p></div><div><a href=z>More of this</a></div></body></html>"
    df = spark.createDataFrame([(1, page), (2, "<p>" + "<b x='" * 2000), (3, "<x-1><x-2>" * 3000)], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {1: " ".join([prose.strip()] * 2), 2: "", 3: ""}
    keys = html_extract.train(spark.createDataFrame([(i, f"<article><y-{i}>text, text.</y-{i}></article>") for i in range(3000)], "page_id long, html string"))
    assert sum(k.startswith("tag ") for k in keys) < 200
