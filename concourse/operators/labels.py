"""Labels and values on printed passes.

A text is cut into tokens: labels (longest first, so ``GATE CLOSES`` is not ``GATE``), clock times, words, line
ends. One fold over the tokens binds each value to a label: to the nearest label before it that takes
values of its type, and where a line holds several labels and the next line their values, to the
first of them that is still open. A label is given up after ``GAP`` other words in its line. Everything is an
expression on the text's own row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = 2      # words that may stand between a label and its value

# What labels are printed as, by the field that they name.
LABELS = {
    "boarding": ["boarding time", "boarding starts at", "boarding starts", "boarding at", "boarding", "boards at", "boards", "board at"],
    "departure": ["scheduled departure", "departure time", "departure", "departs at", "departs", "departing at", "dep time", "dep", "etd", "std"],
    "arrival": ["scheduled arrival", "arrival time", "arrival", "arrives at", "arrives", "arr time", "arr", "eta", "sta"],
    "other time": ["gate closes at", "gate closes", "gate closing", "gate opens", "gates close", "check-in closes", "printed at", "issued at",
                   "printed", "issued"],
    "time": ["time"],
    "gate": ["gate number", "gate no.", "gate no", "gate"],
    "flight": ["flight number", "flight no.", "flight no", "flight", "flt"],
    "terminal": ["terminal building", "terminal no.", "terminal no", "terminal"],
    "seat": ["seat number", "seat no.", "seat no", "seat"],
    "other": ["boarding group", "boarding zone", "boarding pass", "group", "zone", "class", "sequence", "seq", "row", "date", "name", "passenger"],
}
NAMED_TERMINALS = ["NORTH", "SOUTH", "EAST", "WEST", "CENTRAL", "MAIN", "INTERNATIONAL", "DOMESTIC"]

#: Labels that take each type of value.
TAKEN_BY = {"clock": ["boarding", "departure", "arrival", "other time", "time", "flight"], "flight": ["flight"], "gate": ["gate"],
            "terminal": ["terminal"], "seat": ["seat"]}
_DATE = r"\d{4}-\d{2}-\d{2}[T ]\s*"
_CLOCK = rf"(?:{_DATE})?\d{{1,2}}[:.h]\d{{2}}(?![\d:.])(?:\s*[ap]\.?m\b\.?)?"
TYPES = {
    "clock": rf"(?i)^{_CLOCK}$",
    "flight": r"^(?:[A-Z]{2,3}|[A-Z]\d|\d[A-Z])\s?\d{1,5}$",
    "gate": r"^(?:[A-Z]{0,2}\d{1,3}[A-Z]?|[A-Z])$",
    "terminal": rf"^(?:T?\d{{1,2}}[A-Z]?|[A-Z]|{'|'.join(NAMED_TERMINALS)})$",
    "seat": r"^\d{1,2}[A-K]$",
}
#: What a token of any type has: a digit, or it is a letter alone or a named terminal. Other words are not tested further.
VALUE_RE = rf"\d|^(?:[A-Z]|{'|'.join(NAMED_TERMINALS)})$"
_KIND = {label: kind for kind, labels in LABELS.items() for label in labels}
_PRINTED = "|".join(w.replace(".", r"\.").replace(" ", r"\s+") for w in sorted(_KIND, key=lambda w: (-len(w), w)))
TOKEN_RE = (rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{_PRINTED})(?![\p{{L}}\p{{N}}])|\n|{_CLOCK}|[A-Z]{{2}}\s\d{{3,4}}(?![\p{{L}}\p{{N}}:.])"
            r"|[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*")
#: Words that may stand between a label and its value without being counted.
LINKS = ["AT", "IS", "NO", "NR", "NUMBER", "FROM", "BY", "STARTS", "YOUR", "THE"]

FIELDS = ["boarding", "departure", "arrival", "time", "gate", "flight", "terminal"]
STATE = "struct<open:array<string>,columns:boolean,words:int,after:string," + ",".join(f"`{f}`:string" for f in FIELDS) + ">"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _token(t: Column) -> Column:
    """struct<text, kind, types>: a label's kind, or the types that a value fits."""
    kinds = F.create_map(*[F.lit(x) for pair in _KIND.items() for x in pair])
    plain = F.lower(F.regexp_replace(t, r"\s+", " "))

    def typed(x: Column) -> Column:
        fits = [F.when(x["up"].rlike(pattern), F.lit(name)) for name, pattern in TYPES.items()]
        types = F.when(x["up"].rlike(VALUE_RE), F.filter(F.array(*fits), lambda f: f.isNotNull())).otherwise(F.array().cast("array<string>"))
        return F.struct(x["up"].alias("up"), x["text"].alias("text"), x["kind"].alias("kind"), F.when(x["kind"].isNull(), types).alias("types"))

    def named(p: Column) -> Column:      # the map is searched key by key, the list is hashed
        return F.struct(F.upper(t).alias("up"), t.alias("text"), F.when(p.isin(list(_KIND)), F.try_element_at(kinds, p)).alias("kind"))

    return _let(_let(plain, named), typed)


def _bound(open_: Column, types: Column, columns: Column) -> Column:
    """The open label that a value of these types belongs to."""
    taken = F.create_map(*[x for name, labels in TAKEN_BY.items() for x in (F.lit(name), F.array(*map(F.lit, labels)))])
    fit = F.filter(open_, lambda k: F.exists(types, lambda t: F.array_contains(F.try_element_at(taken, t), k)))
    return _let(fit, lambda f: F.get(f, F.when(columns, F.lit(0)).otherwise(F.size(f) - 1)))


def _step(st: Column, x: Column) -> Column:
    line, label = x["up"] == "\n", x["kind"].isNotNull()
    none = F.array().cast("array<string>")
    to = F.when(~label & ~line, _bound(st["open"], x["types"], st["columns"]))
    to = _let(to, lambda b: F.struct(b.alias("label"), F.when(F.array_contains(x["types"], "clock") & (b == "flight"), F.lit("time")).otherwise(b).alias("field")))

    def word() -> Column:
        """The state after a word that is neither label nor value, the short way."""
        link = x["up"].isin(LINKS)
        words = F.when(link, st["words"]).otherwise(st["words"] + 1)
        return F.struct(F.when(~st["columns"] & (words > GAP), none).otherwise(st["open"]).alias("open"), st["columns"].alias("columns"),
                        words.alias("words"), F.when(link, st["after"]).otherwise(F.lit("word")).alias("after"),
                        *[st[f].alias(f) for f in FIELDS]).cast(STATE)

    def new(bound: Column) -> Column:
        b = bound["label"]
        hit = b.isNotNull()
        plain = ~label & ~line & ~hit
        words = F.when(label | hit | line, F.lit(0)).when(plain & ~x["up"].isin(LINKS), st["words"] + 1).otherwise(st["words"])
        # labels side by side wait together; one behind anything else begins anew
        begun = F.when(st["after"] == "label", F.filter(st["open"], lambda k: k != x["kind"])).otherwise(none)
        open_ = (F.when(label, F.concat(begun, F.array(x["kind"])))
                 .when(line, F.when(st["columns"] | (st["after"] != "label"), none).otherwise(st["open"]))
                 .when(hit, F.when(st["columns"], F.filter(st["open"], lambda k: k != b)).when(b == "flight", F.array(b)).otherwise(none))
                 .when(plain & ~st["columns"] & (words > GAP), none).otherwise(st["open"]))
        columns = F.when(label, F.lit(False)).when(line, (F.size(st["open"]) > 1) & (st["after"] == "label") & ~st["columns"]).otherwise(st["columns"])
        after = F.when(label, F.lit("label")).when(hit, F.lit("value")).when(line, F.lit("line")).when(plain & ~x["up"].isin(LINKS), F.lit("word")) \
            .otherwise(st["after"])

        def field(name: str) -> Column:
            return F.coalesce(st[name], F.when(bound["field"] == name, x["text"]))

        return F.struct(open_.alias("open"), columns.alias("columns"), words.alias("words"), after.alias("after"),
                        *[field(f).alias(f) for f in FIELDS]).cast(STATE)

    return F.when(~label & ~line & (F.size(x["types"]) == 0), word()).otherwise(_let(to, new))


def as_printed(clock: Column) -> Column:
    """A clock time as ``HH:MM``: ``.`` and ``h`` become ``:``, 12-hour times 24-hour ones; others stay as printed."""
    plain = F.regexp_replace(clock, r"(\d)[.hH](\d{2})", "$1:$2")
    part = rf"(?i)^((?:{_DATE})?)(\d{{1,2}}):(\d{{2}})\s*([ap])\.?m"
    hour = F.regexp_extract(plain, part, 2).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(plain, part, 4)) == "p", 12).otherwise(0)
    return F.when(plain.rlike(part), F.concat(F.regexp_extract(plain, part, 1), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"),
                                              F.regexp_extract(plain, part, 3))).otherwise(plain)


def bound_values(text: Column) -> Column:
    """struct of FIELDS: the first value printed for each, as it stands there, or null."""
    start = F.struct(F.array().alias("open"), F.lit(False).alias("columns"), F.lit(0).alias("words"), F.lit("line").alias("after"),
                     *[F.lit(None).alias(f) for f in FIELDS]).cast(STATE)
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_RE), F.lit(0)), _token)
    return F.aggregate(tokens, start, _step)
