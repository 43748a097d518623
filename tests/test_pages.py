"""Page-extraction goldens (FIXTURES part C)."""

from pyspark.sql import functions as F

from concourse.operators import pages as pg
from concourse.operators.elements import Selector, element_table


def test_embedded_json_edges(spark):
    esc = '{\\"R0\\":{\\"items\\":[{\\"url\\":\\"/lounges/x/a\\",\\"name\\":\\"A\\"}]}}'
    rows = [
        (1, '<script>cfg = {regionData: {"R0": {"items": [{"url": "/lounges/uk/b", "name": "n } b"},]}}}; go();</script>'),
        (2, '<script>a</script><script>x["regionData"]: ' + esc + ";</script>"),
        (3, '<script>regionData: {"R0": {"items": [{"url": "/l/s", "name": "São Paulo"}]}}</script>'),
        (4, '<script>regionData: {"R0": {"items": [</script>'),
        (5, "<script>nothing here</script>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, html string")
    items = {r.page_id: r for r in pg.region_airports_flatten(pg.embedded_json_extract(df)).collect()}
    assert set(items) == {1, 2, 3}          # unbalanced -> no row; absent key -> no row
    assert items[1].name == "n } b"         # brace inside a string, trailing comma dropped
    assert items[2].url == "/lounges/x/a"   # backslash-escaped quotes undone
    assert items[3].name == "São Paulo"     # raw non-ASCII kept


def test_escaped_objects_equal_the_plain_one(spark):
    import json
    obj = {"R \"0\"": {"items": [{"url": "/lounges/uk/a", "name": 'Caf\u00e9 "Le } Bar" \\ 1/2'}, {"url": "/l/b", "name": "It's\nhere"}]}}
    plain = json.dumps(obj)
    slashed = plain.replace("/", "\\/")                                    # \\/ in place of /
    esc = lambda x: json.dumps(x)[1:-1]
    pretty = json.dumps(obj, indent=1)
    pages = [plain, slashed, json.dumps(obj, ensure_ascii=False), pretty]
    texts = [(f"regionData: {x}; go('y');", x) for x in pages] + [(f"regionData: {esc(x)}; go();", x) for x in pages] \
        + [(f'push(["regionData", x: "{esc(x)}"]); f("z")', x) for x in pages] + [(f"regionData: {esc(esc(x))}; go();", x) for x in pages] \
        + [(f'regionData: "{esc(esc(x))}"; a = "b";', x) for x in pages] \
        + [("regionData: '" + esc(plain).replace("'", "\\'") + "'; go(/\\d/);", plain)]
    df = spark.createDataFrame([(i, f"<script>{t}</script>") for i, (t, _) in enumerate(texts)], "page_id long, html string")
    got = {}
    for r in pg.region_airports_flatten(pg.embedded_json_extract(df)).collect():
        got.setdefault(r.page_id, []).append((r.region, r.url, r.name))
    want = [(k, x["url"], x["name"]) for k, v in obj.items() for x in v["items"]]
    assert [i for i in range(len(texts)) if got.get(i) != want] == []


def test_first_colon_then_first_brace(spark):
    df = spark.createDataFrame([(1, '<script>regionData = {"R0": {"items": []}};</script>')],
                               "page_id long, html string")
    # no colon right after the key: the first colon is inside the object, so the
    # inner object is selected (the reference's rule)
    r = pg.embedded_json_extract(df).collect()
    assert [x.region for x in r] == ["items"]


def test_country_and_detail_key(spark):
    df = spark.createDataFrame([(1, "/e1", "a"), (2, "/lounges/cote-d'ivoire/x", "b"),
                                (3, "/lounges/3rd-land/x", "c")], "page_id long, url string, name string")
    r = {x.page_id: x.country for x in pg.airport_country(df).collect()}
    assert r == {1: "Unknown", 2: "Cote D'Ivoire", 3: "3Rd Land"}
    u = spark.createDataFrame([("https://h/lounges/ab?q=a/b",), ("https://h/lounges/ab/",), ("https://h/l/ab#frag",)],
                              "url string")
    keys = [x[0] for x in u.select(pg.detail_key(F.col("url"))).collect()]
    assert keys == ["b", "", "ab#frag"]


def test_section_items(spark):
    prim = '<button><h2>Location</h2></button><div><ul><li> a </li><li>  </li></ul></div>'
    fb = '<h2>Location</h2><div><ul><li> a </li><li> </li></ul></div>'
    df = spark.createDataFrame([(1, prim), (2, fb), (3, "<p>no heading</p>")], "id int, html string")
    r = {x.id: x.items for x in pg.section_items(df, "Location", "items").collect()}
    assert r == {1: ["a"], 2: ["a", ""], 3: []}


def test_section_items_in_nested_markup(spark):
    html = ('<button class="x"><span>+</span><h2 class="t">Location</h2></button><div><div><ul><li class="i"> a <b>bold</b></li></ul>'
            '</div><div><ul><li>second</li></ul></div></div><button><h2>Conditions</h2></button><div><ul><li>c</li></ul></div>')
    df = spark.createDataFrame([(1, html)], "id int, html string")
    d = pg.section_items(pg.section_items(df, "Location", "loc"), "Conditions", "cond").collect()[0]
    assert d.loc == ["a bold", "second"] and d.cond == ["c"]


def test_cards_are_lounge_links(spark):
    html = ('<ul><li><a href="/about">About</a></li><li class="c"><a class="k" href="/lounges/a1"><h4> One <i>!</i></h4><p>x</p></a></li>'
            '<li><a href="https://h/lounges/b2?r=1">Two</a></li></ul>')
    df = spark.createDataFrame([(1, html), (2, "<li><a href='/x'>no</a></li>")], "page_id long, html string")
    r = pg.card_explode(df).orderBy("page_id", "pos").collect()
    assert [(x.page_id, x.pos, x.href, x.name) for x in r] == [
        (1, 0, "/lounges/a1", "One !"), (1, 1, "https://h/lounges/b2?r=1", "Two"), (2, None, None, None)]
    good = spark.createDataFrame([(1, html)], "k long, card string")
    assert [x.lounge_id for x in pg.parse_cards(pg.card_explode(df).filter("card IS NOT NULL").drop("name", "href")).collect()] == ["a1", "b2"]
    assert pg.parse_cards(good).collect()[0].reject_reason == "missing name"    # of markup with several cards the first counts


def test_cards_in_nested_markup(spark):
    rows = [
        (1, '<li><div><a data-q="1" class="k" href="/lounges/a?x=1&amp;y=2"><div><h4 class="t">Bar &amp; <b>Grill</b></h4></div>'
            '<p data-testid=\'outlet-card-terminal\' class="p"><span> 2C </span></p><div><p>Hours: <b>06:00</b> - 20:00 Hours:</p></div>'
            '<img alt="x > y" src="/i.png?a=1&amp;b=2"></a></div></li>'),
        (2, "<ul><li><a href='/lounges/b'><h4>B<li><a href=/lounges/c><h4>C</h4><p>no <i>Hours: 1</i></p></ul><a href='/lounges/d'><h4>no item</h4></a>"),
        (3, '<li><a href="/lounges/e"><script>if (a < b) "</a><h4>no</h4>"</script><!-- <h4>no</h4> --><h4>E</h4></a></li>'),
        (4, None), (5, ""), (6, "<li><a href="), (7, "</a></li></li> text <b>"),
    ]
    e = pg.card_explode(spark.createDataFrame(rows, "page_id long, html string"))
    r = pg.parse_cards(e.filter("card IS NOT NULL").drop("name", "href")).orderBy("page_id", "pos").collect()
    assert [(x.page_id, x.pos, x.detail_url, x.name, x.terminal, x.opening_hours, x.image_url) for x in r] == [
        (1, 0, "/lounges/a?x=1&y=2", "Bar & Grill", "2C", "06:00 - 20:00", "/i.png?a=1&b=2"),
        (2, 0, "/lounges/b", "B", "N/A", "N/A", ""), (2, 1, "/lounges/c", "C", "N/A", "N/A", ""),
        (3, 0, "/lounges/e", "E", "N/A", "N/A", "")]
    assert e.filter("card IS NULL").count() == 4


def test_amenities_in_nested_blocks(spark):
    html = ('<div class="row wide"><div><span class="n">Wi-Fi</span></div><div><span class="t"> Free </span><span class="t">Fast</span></div></div>'
            '<div class="wide row other"><span class="t">no name</span></div><div class="rows"><span class="n">no block</span></div>'
            '<div class="row wide"><div class="row wide"><span class="n">Inner</span></div><span class="n">Outer</span></div>')
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string")
    own = {"block": Selector("div", classes=("row", "wide")), "name": Selector("span", classes=("n",), within="block"),
           "tag": Selector("span", classes=("t",), within="block")}
    r = {x.id: x.amenities for x in pg.amenity_format(df, selectors=own).collect()}
    assert r == {1: "Wi-Fi (Free, Fast); Inner; Inner", 2: "N/A", 3: "N/A"}


def test_element_table(spark):
    html = '<div id="a"><p>one <b>two</b></p><div id=\'b\'><p>three<p>four</div></div><p>&lt;five&gt;'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    own = {"div": Selector("div"), "par": Selector("p"), "deep": Selector("p", within="inner"), "inner": Selector("div", attributes={"id": "b"}, shown=False)}
    r = element_table(df, own, ["page_id"]).orderBy("begin").collect()
    assert [(x.tag, x.begin, x.inner, x.text, x.names) for x in r] == [
        ("div", 0, 4, "one twothreefour", ["div"]), ("p", 1, 0, "one two", ["par"]), ("div", 2, 2, "threefour", ["div"]),
        ("p", 3, 0, "three", ["par", "deep"]), ("p", 4, 0, "four", ["par", "deep"]), ("p", 5, 0, "<five>", ["par"])]
    assert r[2].parent == r[0].node and r[3].parent == r[2].node and r[5].parent is None
    assert r[0].attributes == {"id": "a"}


def test_elements_equal_a_plain_parser(spark):
    """The texts and attributes of well-formed nested markup, against the standard library's parser."""
    import random
    from html.parser import HTMLParser
    from concourse.operators.elements import read_elements

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found, self.open = [], []

        def handle_starttag(self, tag, attrs):
            self.found.append([tag, dict(attrs), ""])
            self.open.append(self.found[-1])

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            for e in self.open:
                e[2] += data

    rng = random.Random(3)

    def make(depth):
        out = ""
        for _ in range(rng.randint(0, 4)):
            out += rng.choice(["x ", "&amp;", "1 &lt; 2 ", "é", "\n"])
            if depth:
                tag = rng.choice(["div", "section", "span", "h4", "em"])
                q = rng.choice(["\"", "'"])
                own = rng.choice(["", f" class={q}a b > c{q}", f" id={q}i{q} data-x={q}&quot;{q}"])
                out += f"<{tag}{own}>{make(depth - 1)}</{tag}>"
        return out

    for _ in range(200):
        page = make(4)
        plain = Plain()
        plain.feed(page)
        plain.close()
        got = [(e["tag"], dict(e["attributes"]), e["text"]) for e in read_elements(page, {"any": Selector()})]
        assert got == [tuple(e) for e in plain.found]


def test_header_selectors_are_parameters(spark):
    html = ('<html lang="en"><h1>N <i>&amp;</i> M</h1><span data-testid="airport-code"> <b>LHR</b> </span>'
            '<p class="q" data-testid="airport-location">London</p><div class="filter"><span class="big count">12</span></div></html>')
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    r = pg.page_header_fields(df, fields={"airport_code": pg.marked("airport-code"), "airport_location": pg.marked("airport-location")}).collect()[0]
    assert (r.airport_name, r.airport_code, r.airport_location, r.total_experiences) == ("N & M", "LHR", "London", "12")
    r = pg.page_header_fields(spark.createDataFrame([(1, "u", "")], df.schema)).collect()[0]
    assert tuple(r) == (1, "u", "N/A", "N/A", "N/A")


def test_oracle_does_not_import_the_rules():
    from pathlib import Path
    import concourse.oracle as oracle
    for f in Path(oracle.__path__[0]).glob("*.py"):
        assert "concourse.operators" not in f.read_text(), f
