"""Web-page extraction: pages -> airport and lounge columns.

Links, scripts and sections are read with Catalyst string, regex, JSON and array expressions. Where
nesting matters (headers, cards, amenities) a page's elements are read first (``elements``) and the
rules are expressions on that array. Every rule is row-local (one page or card per row) except the
detail join (equi-join on the detail URL) and the nesting back into airport records (bounded parts,
see ``nesting``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concourse.operators.elements import Selector, first, inside, matching, with_elements
from concourse.operators.ocr import ws_trim
from concourse.plans.joins import sized_broadcast

# Fixed patterns and values.
HREF_RE = r'href="([^"]*)"'
SCRIPT_RE = r"(?s)<script[^>]*>(.*?)</script>"
TAG_RE = r"<[^>]+>"
LIST_ITEM_RE = r"(?s)<li[^>]*>(.*?)</li>"
TRAILING_COMMA_RE = r",\s*([}\]])"
SITE_ORIGIN = "https://x.example"
DEFAULT_COUNTRIES = ["United Kingdom", "United States Of America"]
NA = "N/A"


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def filter_detail_links(pages: DataFrame, needle: str = "/lounges/") -> DataFrame:
    """Anchors whose href contains ``needle``, in document order."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF_RE), 1))
                         .alias("pos", "href"))
    return links.filter(F.col("href").contains(needle))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (a one-element
    ``transform``): stops the optimizer from inlining an expensive expression into
    every consumer when projections are collapsed."""
    return F.get(F.transform(F.array(value), body), 0)


def embedded_object_text(pages: DataFrame, key: str = "regionData") -> DataFrame:
    """First script containing ``key``; quoted key before bare key; first ``:`` after
    it, then the first ``{``; the text from there to the end of the script.
    Pages where any step fails yield no row."""
    scripts = F.regexp_extract_all("html", F.lit(SCRIPT_RE), 1)
    target = F.get(F.filter(scripts, lambda s: s.contains(key)), 0)

    def after(s: Column, mark: str) -> Column:
        """The text behind the first ``mark``, or null."""
        return F.when(s.contains(mark), F.substring(s, F.instr(s, mark) + F.lit(len(mark)), F.length(s)))

    behind = let(target, lambda s: F.coalesce(after(s, f'"{key}"'), after(s, key)))
    obj = let(let(behind, lambda s: after(s, ":")), lambda s: F.concat(F.lit("{"), after(s, "{")))
    return (pages.select("page_id", obj.alias("object_text"))
            .filter(F.col("object_text").isNotNull()))


def embedded_json_repair(df: DataFrame, col: str = "object_text") -> DataFrame:
    """Undo the escapes of a text that stands in a string literal, or in one inside another (only when the object starts
    with an escaped key), and drop commas before ``}`` or ``]``. Also inside strings, as the reference does."""
    return df.withColumn("repaired", repaired_text(F.col(col)))


def parse_region_map(df: DataFrame, col: str = "repaired") -> DataFrame:
    """``map<region, raw json>``. The JSON reader is string-aware, stops after the
    first value (so trailing script text is ignored) and gives null when the object
    is unbalanced or invalid — an empty result, never a failure."""
    return df.withColumn("regions", F.from_json(F.col(col), "map<string,string>"))


def embedded_json_extract(pages: DataFrame, key: str = "regionData") -> DataFrame:
    m = parse_region_map(embedded_json_repair(embedded_object_text(pages, key)))
    return m.select("page_id", F.explode("regions").alias("region", "value"))


#: An object whose first key is behind a backslash; white space may itself be escaped.
ESCAPED_RE = r'^\{(?:\s|\\+[nrt])*\\+"'
ESCAPE_LEVELS = 3
#: Marks that stand for an escaped backslash and an escaped quote while a literal's end is looked for.
_BACKSLASH, _QUOTE = "\x01", "\x02"


def unescaped(s: Column) -> Column:
    """One level of string escapes undone, token by token: the text is read as the literal that it is, up to the first
    quote without a backslash. Escapes that only JavaScript has (``\\'``, ``\\x27``) count as well."""
    plain = F.regexp_replace(F.replace(F.replace(s, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE)),
                             r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    literal = F.replace(F.replace(F.substring_index(plain, '"', 1), F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    rules = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.get(F.from_json(F.concat(F.lit('["'), literal, F.lit('"]')), "array<string>", rules), 0)


def repaired_text(object_text: Column) -> Column:
    """``embedded_json_repair`` as a single expression (each level bound once)."""
    text = object_text
    for _ in range(ESCAPE_LEVELS):
        text = let(text, lambda s: F.when(s.rlike(ESCAPED_RE), unescaped(s)).otherwise(s))
    return F.regexp_replace(text, TRAILING_COMMA_RE, "$1")


def region_airports_flatten(regions: DataFrame) -> DataFrame:
    """One row per item of each region object; scalar regions and items lacking
    ``url`` or ``name`` are skipped."""
    items = F.from_json(F.col("value"), "struct<items:array<struct<url:string,name:string>>>")["items"]
    r = regions.select("page_id", "region", F.explode(items).alias("item"))
    return (r.select("page_id", "region", F.col("item.url").alias("url"), F.col("item.name").alias("name"))
            .filter(F.col("url").isNotNull() & F.col("name").isNotNull()))


def title_case(c: Column) -> Column:
    """Python ``str.title``: capitalise the first letter of every letter run."""
    runs = F.regexp_extract_all(c, F.lit(r"[^\p{L}]+|\p{L}+"), 0)
    return F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")


def airport_country(items: DataFrame, origin: str = SITE_ORIGIN) -> DataFrame:
    """Country = third ``/``-segment of the path, ``-`` -> space, title-cased;
    fewer than three segments -> ``Unknown``; url = origin + path."""
    parts = F.split(F.col("url"), "/")
    country = F.when(F.size(parts) >= 3, title_case(F.replace(F.get(parts, 2), F.lit("-"), F.lit(" ")))) \
               .otherwise(F.lit("Unknown"))
    return items.select("page_id", country.alias("country"), F.col("name").alias("airport_name"),
                        F.concat(F.lit(origin), F.col("url")).alias("url"), F.col("url").alias("relative_path"))


def filter_countries(airports: DataFrame, countries: list[str] | DataFrame = DEFAULT_COUNTRIES) -> DataFrame:
    """Case-insensitive equality against a list, or a ``left_semi`` against a table
    of countries (broadcast behind its size check)."""
    if isinstance(countries, DataFrame):
        t = countries.select(F.lower(F.col(countries.columns[0])).alias("_c")).distinct()
        return (airports.withColumn("_c", F.lower("country")).join(sized_broadcast(t), "_c", "left_semi")
                .drop("_c"))
    return airports.filter(F.lower("country").isin([c.lower() for c in countries]))


#: Field of the page header: its element, and the attribute that holds it (None: the element's text).
HEADER = {"airport_name": (Selector("h1"), None), "airport_code": (Selector("html"), "lang"),
          "airport_location": (Selector("title"), None), "total_experiences": (Selector("span", classes=("count",)), None)}


def marked(test_id: str) -> tuple[Selector, None]:
    """The element with this ``data-testid``."""
    return Selector(attributes={"data-testid": test_id}), None


def page_header_fields(pages: DataFrame, link_name: str = "url",
                       fields: dict[str, tuple[Selector, str | None]] | None = None) -> DataFrame:
    """First text of each marked element, whatever is nested in it, all whitespace at its rim trimmed;
    ``fields`` replaces those of the default page layout, as by ``marked("airport-code")``. Missing code,
    location or count -> ``N/A``; a missing name keeps the link's name."""
    own = HEADER | (fields or {})
    e = with_elements(pages, {n: selector for n, (selector, _) in own.items()}, keep=["page_id", link_name])

    def value(name: str) -> Column:
        attribute = own[name][1]
        return let(first(F.col("elements"), name),
                   lambda x: ws_trim(x["text"] if attribute is None else F.try_element_at(x["attributes"], F.lit(attribute))))
    return e.select(
        "page_id",
        F.coalesce(value("airport_name"), F.col(link_name)).alias("airport_name"),
        *[F.coalesce(value(n), F.lit(NA)).alias(n) for n in ("airport_code", "airport_location", "total_experiences")])


def plain_text(html: Column) -> Column:
    """Text of a piece of markup: tags dropped, white space at its rim trimmed."""
    return ws_trim(F.regexp_replace(html, TAG_RE, ""))


def card_selectors(needle: str | None) -> dict[str, Selector]:
    """A list item's link whose href contains ``needle`` (None: any, with or without href), and what
    a card shows. The label of the hours stands in the first text of its paragraph."""
    return {
        "item": Selector("li", shown=False),
        "card": Selector("a", contains={} if needle is None else {"href": needle}, within="item"),
        "name": Selector("h4", within="card"),
        "terminal": Selector("p", attributes={"data-testid": "outlet-card-terminal"}, within="card"),
        "hours": Selector("p", own_text="Hours:", within="card"),
        "image": Selector("img", within="card")}


def cards_of(df: DataFrame, needle: str | None, markup: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``cards``: each card's own element (``self``) and the elements inside it (``inner``), in
    document order."""
    e = with_elements(df, card_selectors(needle), markup, keep)
    found = F.transform(matching(F.col("elements"), "card"), lambda c: F.struct(
        c.alias("self"), inside(F.col("elements"), c).alias("inner")))
    return e.select(*keep, found.alias("cards"))


def card_explode(pages: DataFrame, needle: str = "/lounges/") -> DataFrame:
    """One row per link in a list item whose href contains ``needle``, at any depth and in document order: its
    href, its name (the heading's text, else all text) and ``card``, its elements. A page without cards
    keeps one row with null card fields (an airport with zero lounges)."""
    e = cards_of(pages, needle, "html", ["page_id"]).select("page_id", F.posexplode_outer("cards").alias("pos", "card"))
    name = F.coalesce(first(F.col("card.inner"), "name")["text"], F.col("card.self.text"))
    return e.select("page_id", "pos", _attribute(F.col("card.self"), "href").alias("href"), ws_trim(name).alias("name"), "card")


def _attribute(e: Column, name: str) -> Column:
    return F.try_element_at(e["attributes"], F.lit(name))


def detail_key(url: Column) -> Column:
    """Last ``/``-segment, then the text before ``?`` (fragment kept; trailing ``/`` -> '')."""
    return F.element_at(F.split(F.element_at(F.split(url, "/"), -1), "[?]"), 1)


def parse_cards(cards: DataFrame, card: str = "card") -> DataFrame:
    """Card -> card fields with defaults, plus ``reject_reason`` (missing href or heading) so bad cards are
    quarantined instead of failing the run. ``card`` holds a card's elements, as of ``card_explode``, or the
    markup of one card."""
    if isinstance(cards.schema[card].dataType, T.StringType):
        keep = [c for c in cards.columns if c != card]
        cards = cards_of(cards, None, card, keep).select(*keep, F.get("cards", 0).alias(card))
    inner = F.col(f"{card}.inner")
    d = cards.withColumn("_f", F.struct(
        _nz(_attribute(F.col(f"{card}.self"), "href")).alias("href"),
        *[ws_trim(first(inner, n)["text"]).alias(n) for n in ("name", "terminal", "hours")],
        _attribute(first(inner, "image"), "src").alias("image")))
    f = F.col("_f")
    return d.select(
        *cards.columns,
        f["href"].alias("detail_url"),
        detail_key(f["href"]).alias("lounge_id"),
        f["name"].alias("name"),
        F.coalesce(f["terminal"], F.lit(NA)).alias("terminal"),
        F.coalesce(ws_trim(F.replace(f["hours"], F.lit("Hours:"), F.lit(""))), F.lit(NA)).alias("opening_hours"),
        F.coalesce(f["image"], F.lit("")).alias("image_url"),
        F.when(f["href"].isNull(), F.lit("missing href")).when(f["name"].isNull(), F.lit("missing name")).alias("reject_reason"))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("reject_reason").isNull()
    return df.filter(ok).drop("reject_reason"), df.filter(~ok)


AMENITY = {"block": Selector("p", classes=("am",)), "name": Selector("span", within="block"), "tag": Selector("i", within="block")}


def amenity_format(details: DataFrame, html: str = "html", selectors: dict[str, Selector] | None = None) -> DataFrame:
    """Each block ``name`` or ``name (tag, tag)``, whatever its elements are nested in; blocks without a name
    element are skipped; joined with ``; ``; none -> ``N/A``. ``selectors`` replaces ``block``, ``name`` and
    ``tag`` of the default layout."""
    d = with_elements(details, AMENITY | (selectors or {}), html, out="_elements")

    def block(e: Column) -> Column:
        tags = F.transform(matching(e, "tag"), lambda t: ws_trim(t["text"]))
        name = ws_trim(first(e, "name")["text"])
        return F.when(F.size(tags) > 0, F.concat(name, F.lit(" ("), F.array_join(tags, ", "), F.lit(")"))).otherwise(name)

    texts = F.transform(matching(F.col("_elements"), "block"), lambda b: block(inside(F.col("_elements"), b)))
    named = F.filter(texts, lambda t: t.isNotNull())
    d = d.withColumn("_named", named)
    return d.withColumn("amenities", F.when(F.size("_named") > 0, F.array_join("_named", "; ")).otherwise(F.lit(NA))) \
        .drop("_elements", "_named")


def section_items(details: DataFrame, heading: str, out: str, html: str = "html") -> DataFrame:
    """Texts of the list items under ``<h2>heading</h2>``. Primary: all items between the heading's
    button and the next heading, blanks dropped, whatever blocks they are nested in. If that
    yields nothing: the first list after the heading, blanks kept. Heading absent -> []."""
    title = rf"<h2[^>]*>\s*{heading}\s*</h2>"
    primary_block = rf"(?s)<button[^>]*>(?:(?!</button>).)*?{title}(?:(?!</button>).)*?</button>(.*?)(?=<button|<h2|$)"
    fallback_list = rf"(?s){title}.*?<ul[^>]*>(.*?)</ul>"

    def items(block: Column) -> Column:
        return F.transform(F.regexp_extract_all(block, F.lit(LIST_ITEM_RE), 1), plain_text)

    prim = F.filter(items(F.regexp_extract(F.col(html), primary_block, 1)), lambda x: x != "")
    fb = items(F.regexp_extract(F.col(html), fallback_list, 1))
    return details.withColumn(out, F.when(F.size(prim) > 0, prim).otherwise(fb))


def access_notes(details: DataFrame, items: str = "location_items") -> DataFrame:
    """``Location:`` then one ``- item`` per line; none -> ``N/A``."""
    return details.withColumn("access_notes", F.when(
        F.size(items) > 0, F.concat(F.lit("Location:\n- "), F.array_join(items, "\n- "))).otherwise(F.lit(NA)))


def parse_details(details: DataFrame) -> DataFrame:
    d = amenity_format(details)
    d = section_items(d, "Location", "location_items")
    d = section_items(d, "Conditions", "conditions")
    return access_notes(d).select("url", "amenities", "access_notes", "conditions")


def detail_join(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Card left-join detail on the detail URL; detail fields win; a card without a
    detail page gets ``N/A``, ``N/A``, ``[]``."""
    d = details.withColumnRenamed("url", "detail_url").withColumn("_matched", F.lit(True))
    j = cards.join(d, "detail_url", "left")
    matched = F.coalesce(F.col("_matched"), F.lit(False))
    return (j.withColumn("amenities", F.when(matched, F.col("amenities")).otherwise(F.lit(NA)))
            .withColumn("access_notes", F.when(matched, F.col("access_notes")).otherwise(F.lit(NA)))
            .withColumn("conditions", F.when(matched, F.col("conditions"))
                        .otherwise(F.array().cast("array<string>")))
            .drop("_matched"))
