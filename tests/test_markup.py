"""Elements of markup against a stack of open elements kept by the standard library's tokenizer."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from statloom.functions import html, markup
from statloom.functions.markup import STRUCTURE, VOID


class Tree(HTMLParser):
    """Bodies of all elements of the wanted tags; a closing tag closes the nearest open element of its name."""

    def __init__(self, text, tags):
        super().__init__(convert_charrefs=False)
        self.followed, self.open, self.found, self.out = set(tags) | set(STRUCTURE), [], [], []
        self.tags = tags
        self.feed(text)
        for _, slot, start in self.open:
            self.end(slot, start)

    def end(self, slot, start):
        if slot is not None:
            self.found[slot] = "".join(self.out[start:])

    def handle_starttag(self, tag, attrs):
        self.out.append(self.get_starttag_text())
        if tag in self.followed and tag not in VOID:
            slot = None
            if tag in self.tags:
                slot = len(self.found)
                self.found.append("")
            self.open.append((tag, slot, len(self.out)))

    def handle_startendtag(self, tag, attrs):
        if tag in self.tags:
            self.found.append("")
        self.out.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if tag in self.followed and any(t == tag for t, _, _ in self.open):
            while True:
                t, slot, start = self.open.pop()
                self.end(slot, start)
                if t == tag:
                    break
        self.out.append(f"</{tag}>")

    def handle_entityref(self, name):
        self.out.append(f"&{name};")

    def handle_data(self, data):
        self.out.append(data)


def random_page(seed):
    r = random.Random(seed)
    out = []
    for _ in range(r.randint(0, 60)):
        tag = r.choice(["table", "tr", "td", "th", "ul", "li", "div", "p", "b", "br", "form"])
        kind = r.random()
        if kind < 0.45:
            out.append(f"<{tag}{r.choice(['', ' class=x', ' id="a>b"', " title='q'"])}>")
        elif kind < 0.8:
            out.append(f"</{tag}>")
        elif kind < 0.85:
            out.append(f"<{tag}/>")
        out.append(r.choice(["", "word", "7,5 %", " ", "&amp;"]))
    return "".join(out)


PAGES = [random_page(i) for i in range(300)]


@pytest.mark.parametrize("tags", [("table",), ("tr",), ("td", "th"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("div",)])
def test_bodies_match_a_stack(spark, tags):
    df = spark.createDataFrame(list(enumerate(PAGES)), "i int, html string")
    got = {r.i: r.b for r in df.select("i", markup.bodies("html", tags).alias("b")).collect()}
    assert got == {i: Tree(p, tags).found for i, p in enumerate(PAGES)}


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "html string").select(column).first()[0]


def test_noise_goes_with_all_it_holds(spark):
    clean = html.without_noise("html")
    assert one(spark, "a<div class='top-menu'><div>b</div>c</div>d<p id=nav>e</p>f", clean) == "adf"
    assert one(spark, "a<table><tr><td class=sidebar>b</tr><tr><td>c</td></tr></table>", clean) == "a<table><tr></tr><tr><td>c</td></tr></table>"
    assert one(spark, "a<div class=menu>never closed", clean) == "a"
    assert one(spark, "a<script>var x='<div>'</script>b<!-- <p> -->c<style>p{}", clean) == "abc"
    assert one(spark, "", clean) == "" and one(spark, "plain", clean) == "plain"


def test_attributes(spark):
    for head, want in [('<a class="x y">', "x y"), ("<a class='x'>", "x"), ("<a class=x>", "x"), ("<a data-class=x>", None), ('<a CLASS = "X">', "X"), ('<a class="">', "")]:
        assert one(spark, head, markup.attribute("html", "class")) == want


def test_deeper_elements_stand_beside(spark):
    n = markup.DEPTH + 50
    found = one(spark, "<div>" * n + "x", F.size(markup.bodies("html", ("div",))))
    assert found == n


@pytest.mark.parametrize("unit", ["<div class='menu'>x", "<td>", "<!-- ", "<script>", '<td class="', "<div class=menu ", "<<", "</td>"])
def test_hostile_pages_take_linear_time(spark, unit):
    """Twice the page, at most 2.5 times the time."""

    def seconds(k):
        df = spark.createDataFrame([(unit * k,)], "html string").select(F.length(html.without_noise("html")), F.size(html.cells("html")))
        took = []
        for _ in range(5):
            start = time.time()
            df.collect()
            took.append(time.time() - start)
        return min(took)

    seconds(2000)
    assert seconds(16000) < 2.5 * max(seconds(8000), 0.6)


COMPLETE = [
    ('<div><FORM action=/q><div class="a>b"><ul><li>x</li></ul></div>y</form ></div>', [("<FORM action=/q>", '<div class="a>b"><ul><li>x</li></ul></div>y', "form")]),
    ("<form>a</form><b><form id='2'></form>", [("<form>", "a", "form"), ("<form id='2'>", "", "form")]),
    ("no form here", []),
]
BROKEN = [
    "<div><form>a</div>b</form>", "<form>a<form>b</form>c</form>", "<form><div>a</form>", "<form/>a", "<form>a</form><form>b", "<form title='x>a</form>", None,
    "<div><ul><form><table><tr><td><table><tr><td>deep</td></tr></table></td></tr></table></form></ul></div>", "<div>" * 260 + "<form><ul>a</ul></form>",
    "<form>" + "<form>" * 300 + "x", "<form>" + "<div>a</div>" * 300 + "</form>",
]


def test_complete_elements_are_not_folded(spark, monkeypatch):
    monkeypatch.setattr(markup, "_folded", lambda *a: F.raise_error(F.lit("folded")).cast(markup._ELEMENTS))
    pages = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(COMPLETE)], "i int, html string")
    found = pages.select("i", markup.elements("html", ("form",)).alias("e")).orderBy("i").collect()
    assert [[tuple(e) for e in r.e] for r in found] == [e for _, e in COMPLETE]


def test_search_of_elements_gives_what_the_fold_gives(spark):
    mixed = ["<ul>a</ol></ul>", "<ul class=x>a<div>b</div></ul><ol>c</ol>", "<OL>a<table></table></ol>", "<ul>a</ul title='>'>"]
    pages = spark.createDataFrame([(p,) for p in [p for p, _ in COMPLETE] + BROKEN + mixed], "html string")
    classed = lambda m: F.coalesce(markup.attribute(m["head"], "class") == "x", F.lit(False))
    for tags, keep in ((("form",), None), (("ul", "ol"), None), (("ul", "ol"), classed)):
        read = pages.select(markup.elements("html", tags, keep).alias("a"), markup._folded("html", tags, keep).alias("b")).collect()
        assert [r.a for r in read] == [r.b for r in read]
