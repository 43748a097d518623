"""I-Match document fingerprints, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band: not so common that
they say nothing, not so rare that one edit changes them. A text's fingerprint is, for each
of ``SUBSETS`` random parts of the lexicon, the hash of its distinct terms in that part, in
sorted order. Parts come in levels that hold from 1/4 to 1/256 of the lexicon, so that texts
of any length have a level whose parts hold few of their terms; an edit leaves the hashes of
the parts that it does not touch. Likeness of two fingerprints: on the level where it is
largest, equal hashes over parts that are not empty in both; a level counts with
``LEAST_PARTS`` such parts, and all parts together count as a level.

The lexicon is bounded by its band: the terms in at least a share ``LEAST_SHARE`` of the
documents number at most the mean count of distinct terms per text over that share. It is
broadcast after its rows are counted, beyond ``BROADCAST_TERMS`` it is joined by shuffle.

Defined results: null texts count as empty. A text without lexicon terms is fingerprinted
by its bytes, so it is like equal texts only. Repeated rows keep a row each; of rows with
one doc_id the one of smaller text hash comes first. Null ids come before all others. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concourse.llm.common import staged, whole_text
from concourse.llm.ordering import order_key, range_of, range_starts

LEAST_SHARE = 0.001   # of the documents, that hold a lexicon term
MOST_SHARE = 0.1
LEVELS = (2, 4, 6, 8)  # a subset of the level holds each term with chance 1 / 2^level
PER_LEVEL = 8
SUBSETS = len(LEVELS) * PER_LEVEL
LEAST_PARTS = 3
BROADCAST_TERMS = 500_000
RANGE_ROWS = 2_000
MOST_RANGES = 100_000


def terms(text: Column) -> Column:
    """Distinct lower-case terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame) -> DataFrame:
    """(term, parts) of the terms in the band; bit s of ``parts``: the term is in subset s."""
    n = docs.count()
    own = docs.select(F.explode(terms(whole_text())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = own.filter((F.col("df") >= max(2, LEAST_SHARE * n)) & (F.col("df") <= MOST_SHARE * n))
    drawn = F.sha2("term", 256)
    parts = F.lit(0).cast("long")
    for s in range(SUBSETS):
        byte = F.conv(F.substring(drawn, 2 * s + 1, 2), 16, 10).cast("int")
        parts = parts.bitwiseOR(F.when(byte < (256 >> LEVELS[s // PER_LEVEL]), F.lit(1 << s).cast("long")).otherwise(0))
    return band.select("term", parts.alias("parts"))


NO_TERMS = "d41d8cd9"  # start of the MD5 of nothing


def _bits(levels: range) -> Column:
    """The subsets of some levels as bits."""
    return F.lit(sum(1 << s for lv in levels for s in range(lv * PER_LEVEL, (lv + 1) * PER_LEVEL))).cast("long")


def with_subset_hashes(df: DataFrame, found: str, text_md5: str, name: str) -> DataFrame:
    """``df`` with the hash per subset of ``found``, structs (term, parts), in its place. The terms of the sparse levels are picked out first, so that each of their subsets
    looks through few."""
    cut = [1, 2]  # levels from which on the terms are picked out again
    lists = {0: found} | {c: f"_{found}_{c}" for c in cut}
    for c in cut:
        below = lists[max(k for k in lists if k < c)]
        df = df.withColumn(lists[c], _having(below, _bits(range(c, len(LEVELS)))))

    def own(s: int) -> Column:
        source = lists[max(k for k in lists if k <= s // PER_LEVEL)]
        terms_ = F.sort_array(F.transform(_having(source, F.lit(1 << s).cast("long")), lambda x: x["term"]))
        return F.replace(F.substring(F.md5(F.concat_ws(" ", terms_)), 1, 8), F.lit(NO_TERMS), F.lit(""))

    bare = F.array(*([F.substring(F.col(text_md5), 1, 8)] * SUBSETS))
    hashes = F.when(F.size(found) > 0, F.array(*map(own, range(SUBSETS)))).otherwise(bare)
    return df.withColumn(name, hashes).drop(*lists.values(), text_md5)


def _having(found: str, bits: Column) -> Column:
    return F.filter(found, lambda x: x["parts"].bitwiseAND(bits) != 0)


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with the largest share of equal hashes among the parts of a level that are not
    empty in both of ``a`` and ``b``."""
    # 2: equal hashes, 1: not both empty, 0: both empty
    both = F.zip_with(a, b, lambda x, y: F.when((x == "") & (y == ""), 0).when(x == y, 2).otherwise(1))

    def share(part: Column, least: int) -> Column:
        some = F.size(F.filter(part, lambda x: x > 0))
        return F.when(some >= least, F.size(F.filter(part, lambda x: x == 2)) / some)

    pairs = F.col("_pairs")
    levels = [share(F.slice(pairs, 1 + PER_LEVEL * i, PER_LEVEL), LEAST_PARTS) for i in range(len(LEVELS))]
    near = F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(share(pairs, 1), *levels))
    return df.withColumn("_pairs", both).withColumn(name, near).drop("_pairs")


def with_hashes(rows: DataFrame, lex: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """``rows`` with the hashes of each text column of ``texts`` (column: name of its hashes) in
    place of the text. ``keys`` tell the rows apart; rows partitioned by one of them are
    not shuffled. The other columns go with a row's first term only."""
    names = list(texts)
    rest = [c for c in rows.columns if c not in keys and c not in names]
    # whatever needs a text is made before its terms are spread, not again for every term
    made = rows.withColumns({f"md5_{i}": F.md5(c) for i, c in enumerate(names)}
                            | {f"terms_{i}": terms(F.col(c)) for i, c in enumerate(names)})
    once = [*rest, *[f"md5_{i}" for i in range(len(names))]]
    upto = [F.size(f"terms_{i}") for i in range(len(names))]
    made = made.select(*keys, *once, *[sum(upto[:i + 1], F.lit(0)).alias(f"upto_{i}") for i in range(len(names))],
                       F.concat(*[F.col(f"terms_{i}") for i in range(len(names))]).alias("terms"))
    own = made.select(*keys, *once, *[f"upto_{i}" for i in range(len(names))],
                      F.posexplode_outer("terms").alias("at", "term"))
    own = own.withColumn("at", F.coalesce("at", F.lit(0)))
    first = F.col("at") == 0
    # joined by a number, which hashes faster than a string; the term itself decides
    known = lex.select(F.xxhash64("term").alias("_h"), F.col("term").alias("_term"), "parts")
    if known.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    own = own.withColumn("h_", F.xxhash64("term"))
    hits = own.join(known, (F.col("h_") == F.col("_h")) & (F.col("term") == F.col("_term")), "left").filter(
        F.col("parts").isNotNull() | first)  # no row is lost
    of = [F.col("parts").isNotNull() & (F.col("at") < F.col(f"upto_{i}"))
          & ((F.col("at") >= F.col(f"upto_{i - 1}")) if i else F.lit(True)) for i in range(len(names))]
    found = hits.groupBy(*keys).agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in once],
        *[F.collect_list(F.when(of[i], F.struct("term", "parts"))).alias(f"found_{i}")
          for i in range(len(names))])
    for i, c in enumerate(names):
        found = with_subset_hashes(found, f"found_{i}", f"md5_{i}", texts[c])
    return found


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, fingerprint."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), whole_text().alias("text"))
    lex = staged(lexicon(docs), "lexicon")
    return with_hashes(rows, lex, ["row"], {"text": "hashes"}).select(
        "doc_id", F.concat_ws("-", "hashes").alias("fingerprint"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The edited text has its last quarter replaced by the start of the next document's text.

    Documents are dealt once, into ranges of doc_id; the first document of a range is also
    dealt to the range before it, as its tail, so each text meets its successor there."""
    lex = staged(lexicon(docs), "lexicon")
    starts = range_starts(docs, RANGE_ROWS, MOST_RANGES)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order_key().alias("k"),
                      F.monotonically_increasing_id().alias("row"), whole_text().alias("text"))
    own = own.withColumn("h", F.xxhash64("text")).withColumn("range", range_of(F.col("k"), starts or [0]))
    here = F.struct(F.col("range"), F.lit(0).alias("tail"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(max(1, len(starts)))).alias("range"), F.lit(1).alias("tail"))
    first = F.get(F.split(F.lit(",".join(map(str, starts or [0]))), ",").cast("array<bigint>"), F.col("range")) == F.col("k")
    dealt = own.withColumn("to", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here))))
    dealt = dealt.select("to.range", "to.tail", "k", F.col("doc_id").isNotNull().alias("known"), "h", "row", "doc_id", "text")
    by = Window.partitionBy("range").orderBy("tail", "k", "known", "h", "row")
    rows = (
        dealt.withColumn("next", F.coalesce(F.lead("text").over(by), F.lit("")))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.expr("left(text, int(length(text) - floor(length(text) / 4)))"),
                                       F.expr("left(next, int(floor(length(text) / 4)))")))
        .withColumn("edited_sha256", F.sha2("edited", 256))
    )
    rows = rows.select("range", "tail", "k", "known", "h", "row", "doc_id", "n_chars", "edited_sha256", "text", "edited")
    done = with_hashes(rows, lex, ["range", "tail", "row"], {"text": "own", "edited": "new"})
    done = done.withColumn("after", F.lead("own").over(by)).filter("tail = 0")
    done = with_likeness(with_likeness(done, "own", "new", "near_edited"), "own", "after", "near_next")
    return done.select("doc_id", "n_chars", "edited_sha256", F.concat_ws("-", "own").alias("fingerprint"),
                       F.concat_ws("-", "new").alias("edited_fingerprint"), "near_edited", "near_next")


def edited_sql() -> str:
    """``edited_fingerprints`` of ``documents`` as DuckDB SQL."""
    terms_ = lambda t: f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"
    limits = ", ".join(str(256 >> LEVELS[s // PER_LEVEL]) for s in range(SUBSETS))

    def like(a: str, b: str) -> str:
        def share(low: int, high: int, least: int) -> str:
            same = f"len(list_filter(range({low}, {high}), lambda i: {a}[i] = {b}[i] AND {a}[i] <> ''))"
            some = f"len(list_filter(range({low}, {high}), lambda i: {a}[i] <> '' OR {b}[i] <> ''))"
            return f"CASE WHEN {some} >= {least} THEN {same}::DOUBLE / {some} END"
        levels = [share(1 + PER_LEVEL * i, 1 + PER_LEVEL * (i + 1), LEAST_PARTS) for i in range(len(LEVELS))]
        return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE greatest({', '.join([share(1, SUBSETS + 1, 1), *levels])}) END"

    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text,
                     row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS row FROM documents),
n AS (SELECT count(*) AS n FROM docs),
pairs AS (SELECT d.doc_id, d.row, d.text, length(d.text) AS n_chars, e.text AS next, e.row AS next_row
          FROM docs d CROSS JOIN n JOIN docs e ON e.row = d.row % n.n + 1),
texts AS (SELECT row, 0 AS of, text FROM pairs
          UNION ALL
          SELECT row, 1, left(text, n_chars - n_chars // 4) || left(next, n_chars // 4) FROM pairs),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest({terms_('text')}) AS term FROM docs) GROUP BY term),
lex AS (SELECT term, sha256(term) AS drawn FROM df CROSS JOIN n
        WHERE df >= greatest(2, {LEAST_SHARE} * n) AND df <= {MOST_SHARE} * n),
subsets AS (SELECT unnest(range(0, {SUBSETS})) AS s, unnest([{limits}]) AS most),
parts AS (SELECT term, s FROM lex, subsets
          WHERE CAST('0x' || substr(drawn, CAST(2 * s + 1 AS BIGINT), 2) AS INTEGER) < most),
hits AS (SELECT DISTINCT t.row, t.of, l.term
         FROM (SELECT row, of, unnest({terms_('text')}) AS term FROM texts) t JOIN lex l USING (term)),
present AS (SELECT DISTINCT row, of FROM hits),
own AS (SELECT h.row, h.of, p.s, left(md5(string_agg(h.term, ' ' ORDER BY h.term)), 8) AS hash
        FROM hits h JOIN parts p USING (term) GROUP BY h.row, h.of, p.s),
hashes AS (SELECT t.row, t.of, list(CASE WHEN s.row IS NULL THEN left(md5(t.text), 8) ELSE coalesce(o.hash, '') END
                                    ORDER BY u.s) AS list
           FROM texts t CROSS JOIN subsets u LEFT JOIN present s ON s.row = t.row AND s.of = t.of
           LEFT JOIN own o ON o.row = t.row AND o.of = t.of AND o.s = u.s GROUP BY t.row, t.of)
SELECT p.doc_id, p.n_chars, sha256(t.text) AS edited_sha256,
       array_to_string(a.list, '-') AS fingerprint, array_to_string(b.list, '-') AS edited_fingerprint,
       {like('a.list', 'b.list')} AS near_edited, {like('a.list', 'c.list')} AS near_next
FROM pairs p JOIN texts t ON t.row = p.row AND t.of = 1
JOIN hashes a ON a.row = p.row AND a.of = 0 JOIN hashes b ON b.row = p.row AND b.of = 1
JOIN hashes c ON c.row = p.next_row AND c.of = 0
"""
