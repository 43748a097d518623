"""Elements of web pages as rows.

``with_elements`` gives each page an array of those of its elements that match named selectors, in
document order; ``element_table`` is the same as rows. The markup is read once, tag by tag with a
stack of the open elements, so attributes may stand in any order, nesting and unclosed tags are
followed, and entities are decoded. ``begin`` is an element's place in the array, ``inner`` the number
of elements of the array inside it: what an element contains is a slice of the array, and a containment
test on the table is ``begin < x.begin <= begin + inner``. Rules on elements are Catalyst expressions on
the array (``matching``, ``inside``, ``text_of``): no shuffle, no join.

Null markup has no elements. Markup is never an error: an end tag without its start is left out, an
element that is not closed ends with the one around it, ``li``, ``p``, ``dt``, ``dd``, ``option``,
table cells and ``a`` end where the next one begins, and scripts, styles and comments have no text. A
blank that may not break counts as a blank.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Selector:
    """An element with this tag, these attribute values, values that contain a text, classes, and
    ``own_text`` in its first piece of text; inside an element that matches the selector named
    ``within``. ``shown`` selectors give rows, others only serve as ``within``."""
    tag: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)
    classes: tuple[str, ...] = ()
    own_text: str | None = None
    within: str | None = None
    shown: bool = True

    def fits(self, tag: str, attributes: dict[str, str], open_: dict[str, int]) -> bool:
        """Whether a start tag matches; ``own_text`` is left to the element's end."""
        return ((self.tag is None or self.tag == tag)
                and (self.within is None or open_[self.within] > 0)
                and all(attributes.get(k) == v for k, v in self.attributes.items())
                and all(v in attributes.get(k, "") and k in attributes for k, v in self.contains.items())
                and set(self.classes) <= set(attributes.get("class", "").split()))


# Fixed lists of the markup language.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_END = {"script": re.compile(r"</script\b", re.I), "style": re.compile(r"</style\b", re.I)}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                   "pre section table ul".split())
#: The open elements that a start tag ends, and the elements that it looks for them no further than.
ENDS = ({tag: ({"p"}, {"button", "td", "th"}) for tag in BLOCKS}
        | {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "a": ({"a"}, {"td", "th", "button"})})
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")

ELEMENT = T.StructType([
    T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("begin", T.IntegerType()), T.StructField("inner", T.IntegerType()),
    T.StructField("tag", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()), T.StructField("names", T.ArrayType(T.StringType())),
])
_ARROW = pa.list_(pa.struct([
    ("node", pa.int32()), ("parent", pa.int32()), ("begin", pa.int32()), ("inner", pa.int32()), ("tag", pa.string()),
    ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("names", pa.list_(pa.string()))]))


class _Open:
    """An element whose end was not met yet."""
    __slots__ = ("tag", "node", "names", "row", "pieces", "own")

    def __init__(self, tag, node, names, row, pieces):
        self.tag, self.node, self.names, self.row, self.pieces, self.own = tag, node, names, row, pieces, None


def read_elements(markup: str | None, selectors: dict[str, Selector]) -> list[dict]:
    """The elements of one page that match a shown selector, in document order."""
    rows: list[dict] = []
    stack: list[_Open] = []
    pieces: list[str] = []                  # the page's text
    tags: dict[str, int] = {}               # open elements of each tag
    open_ = dict.fromkeys(selectors, 0)     # and of each selector
    late = {n for n, s in selectors.items() if s.own_text is not None}

    def end(e: _Open) -> None:
        tags[e.tag] -= 1
        for n in e.names:
            open_[n] -= 1
        if e.row is not None:
            row = rows[e.row]
            row["last"] = len(rows)
            row["text"] = "".join(pieces[e.pieces:])
            row["names"] = [n for n in row["names"] if n not in late or selectors[n].own_text in (e.own or "")]

    def text(piece: str) -> None:
        if piece and stack:
            piece = entities.unescape(piece).replace("\xa0", " ")
            pieces.append(piece)
            if stack[-1].own is None:
                stack[-1].own = piece

    at, node, markup = 0, 0, markup or ""
    while (token := TOKEN.search(markup, at)) is not None:
        text(markup[at:token.start()])
        at = token.end()
        slash, tag, rest = token.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if tags.get(tag):
                while True:
                    e = stack.pop()
                    end(e)
                    if e.tag == tag:
                        break
            continue
        ended, limits = ENDS.get(tag, ((), ()))
        if any(tags.get(t) for t in ended):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ended:
                    while len(stack) > i:
                        end(stack.pop())
                    break
                if stack[i].tag in limits:
                    break
        attributes: dict[str, str] = {}
        for name, double, single, bare in ATTRIBUTE.findall(rest):
            attributes.setdefault(name.lower(), entities.unescape(double or single or bare))
        names = [n for n, s in selectors.items() if s.fits(tag, attributes, open_)]
        row = None
        if any(selectors[n].shown for n in names):
            row = len(rows)
            rows.append({"node": node, "parent": stack[-1].node if stack else None, "begin": row, "last": row + 1, "tag": tag,
                         "attributes": attributes, "text": "", "names": [n for n in names if selectors[n].shown]})
        e = _Open(tag, node, names, row, len(pieces))
        node += 1
        for n in names:
            open_[n] += 1
        tags[tag] = tags.get(tag, 0) + 1
        if tag in VOID:
            end(e)
            continue
        stack.append(e)
        if tag in RAW_END:
            close = RAW_END[tag].search(markup, at)
            at = close.start() if close else len(markup)
    text(markup[at:])
    while stack:
        end(stack.pop())
    return _kept(rows)


def _kept(rows: list[dict]) -> list[dict]:
    """Without the elements whose only selectors asked for an own text that they lack."""
    before = [0]
    for r in rows:
        before.append(before[-1] + bool(r["names"]))
    out = []
    for i, r in enumerate(rows):
        if r["names"]:
            out.append(r | {"begin": before[i], "inner": before[r["last"]] - before[i] - 1, "attributes": list(r["attributes"].items())})
            del out[-1]["last"]
    return out


def with_elements(df: DataFrame, selectors: dict[str, Selector], markup: str = "html", keep: list[str] | None = None,
                  out: str = "elements") -> DataFrame:
    """The columns ``keep`` (all, if not given) and ``out``: the elements of ``markup`` that match a selector."""
    keep = list(df.columns) if keep is None else keep
    own = df.select(*keep, F.col(markup).cast("string").alias("_markup"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([read_elements(m, selectors) for m in b.column(len(keep)).to_pylist()], _ARROW)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=[*keep, out])

    schema = T.StructType([*own.schema.fields[:-1], T.StructField(out, T.ArrayType(ELEMENT))])
    return own.mapInArrow(rows, schema)


def element_table(pages: DataFrame, selectors: dict[str, Selector], keys: list[str], markup: str = "html") -> DataFrame:
    """One row per matching element: ``keys``, node, parent, begin, inner, tag, attributes, text, names."""
    return with_elements(pages, selectors, markup, keys).select(*keys, F.explode("elements").alias("e")).select(*keys, "e.*")


def matching(elements: Column, name: str) -> Column:
    """The elements that match the selector ``name``."""
    return F.filter(elements, lambda e: F.array_contains(e["names"], name))


def first(elements: Column, name: str) -> Column:
    """The first element that matches ``name``, or null."""
    return F.get(matching(elements, name), 0)


def inside(elements: Column, e: Column) -> Column:
    """The elements inside ``e``, itself left out; ``elements`` is the page's whole array."""
    return F.slice(elements, e["begin"] + 2, e["inner"])
