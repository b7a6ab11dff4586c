"""Regions of marked-up pages in page order, by hand and against a plain parser."""

import re
from html.parser import HTMLParser

import pytest

from docframe.sources.readers import BLOCKS, LISTS, TAGS, WHOLE, regions_from_markup

REGION = dict(TAGS)


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.found, self.skip, self.inside = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.inside = False
        if tag in ("script", "style"):
            self.skip = 1
        if tag not in REGION and tag not in BLOCKS:
            return
        lists = [e[0] for e in self.stack if e[0] in ("li", *LISTS)]
        if tag == "li" and lists and lists[-1] == "li":
            self.close("li")
        elif self.stack and self.stack[-1][0] == "p":
            self.close("p")
        under = self.stack[-1] if self.stack else ("", None, False)
        mine = under[1]
        if tag in REGION and not under[2]:
            mine = [REGION[tag], ""]
            self.found.append(mine)
        self.stack.append((tag, mine, under[2] or tag in WHOLE))

    def close(self, tag):
        if any(e[0] == tag for e in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_comment(self, data):
        self.inside = False

    def handle_endtag(self, tag):
        self.inside = False
        if tag in ("script", "style"):
            self.skip = 0
        self.close(tag)

    def handle_data(self, data):
        if not self.skip and self.stack and self.stack[-1][1] is not None:
            self.stack[-1][1][1] += data if self.inside else " " + data
            self.inside = True  # texts around an entity come in parts

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def plain(html):
    p = Plain()
    p.feed(html)
    return [(kind, text) for kind, t in p.found if (text := re.sub(r"\s+", " ", t).strip())]


CASES = {
    "<h1>A</h1><p>one<p>two <b>bold</b> end<div>gone</div><p>three</p>tail": [("title", "A"), ("text", "one"), ("text", "two bold end"), ("text", "three")],
    "<ul><li>a<li>b<ul><li>b1<li>b2</ul>b again<li>c</ul><p>z": [("header", "a"), ("header", "b b again"), ("header", "b1"), ("header", "b2"), ("header", "c"), ("text", "z")],
    "<p>before</p><table><tr><td><p>x</p><td>y</table><p>after": [("text", "before"), ("table", "x y"), ("text", "after")],
    "<footer>f<nav><li>g</li></nav></footer></p></li><p class='<'>q</p>": [("footer", "f g"), ("text", "q")],
    "<!-- <p>no</p> --><script>var t='<p>no</p>'</script><style>p{}</style><P>Yes</P>": [("text", "Yes")],
    "<li>first</li><p></p><p> \n </p><title>late</title>": [("header", "first"), ("title", "late")],
    "no tags": [], "": [],
}


def test_by_hand(spark):
    df = spark.createDataFrame([(k, html) for k, html in enumerate(CASES)] + [(99, None)], "page_id int, html string")
    got = {}
    for r in regions_from_markup(df).orderBy("doc_id", "region_no").collect():
        assert r.region_no == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((r.region_type, r.text))
    assert [got.get(k, []) for k in range(len(CASES))] == list(CASES.values()) and 99 not in got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_against_a_plain_parser(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {}
    for r in regions_from_markup(pages).orderBy("doc_id", "region_no").collect():
        got.setdefault(r.doc_id, []).append((r.region_type, r.text))
    want = {r.page_id: plain(r.html) for r in pages.collect() if r.html}
    assert got == {k: v for k, v in want.items() if v}


def test_tables_from_boxes(spark):
    """Lines and columns from gaps; pages apart; odd boxes left out."""
    from docframe.operators.extract import extract_layout

    page = [(0, 0, 0, 30, 10, "Item name"), (1, 50, 1, 70, 9, "Qty"), (2, 90, 0, 99, 9, "qty"), (3, 0, 20, 20, 30, "bolt"), (4, 22, 21, 35, 31, "M4"), (5, 55, 22, 60, 30, " 7 "), (6, 0, 40, 10, 50, "nut"), (7, 91, 41, 95, 50, "3"), (8, 1, 52, 2, 60, "  "), (9, None, 1, 2, 3, "lost"), (10, 120, 42, 130, 50, "odd")]
    rows = [(p, *r) for p in (1, 2) for r in page] + [(3, 0, 0, 0, 9, 9, "alone")]
    df = spark.createDataFrame(rows, "page int, region_no int, x1 int, y1 int, x2 int, y2 int, text string").repartition(3)
    got = sorted((r.page, r.table_name, r.row_no, tuple(sorted(r.row.items()))) for r in extract_layout(df, "t", "page").collect())
    assert got == [x for p in (1, 2) for x in [(p, "t", 0, (("item_name", "bolt M4"), ("qty", "7"))), (p, "t", 1, (("column_3", "odd"), ("item_name", "nut"), ("qty_2", "3")))]]
    assert extract_layout(df.limit(0), "t", "page").count() == 0
