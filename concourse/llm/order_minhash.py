"""Near-duplicates by Order MinHash.

A document is its sequence of lower-case words. Its k-mers of five words are labelled
with their occurrence number, so repeats count. For each of ``SKETCHES`` random orders
the ``PICKS`` smallest labelled k-mers are taken and put back in text order; their hash
is one key. Two texts share a key only if the same k-mers stand in the same order, which
edit similarity makes likely and a shuffled text does not. Picks are few and sketches many, so that
texts at the law's own threshold meet: where a fifth of the words is replaced, a fifth of the k-mers is
shared, and nine pairs in ten have a key in common (``tests/llm`` measure it). Texts that share a key are
aligned word by word inside a band; they are linked if the alignment keeps at least
``SIMILARITY`` of the longer text's words. Linked texts form classes (connected
components); a class is named by its smallest doc_id.

Pairs that meet by a common passage are dropped before they become rows: every text has counts of its words in
``BINS`` bins, and the smaller counts of two texts add up to no less than any alignment keeps. The counts are written as
bits, one for each count up to ``LEVELS``, so the sum is a popcount; what exceeds ``LEVELS`` is added whole.

Hot groups: equal word sequences are collapsed first by a partial aggregation. Then a bucket's
smallest node is compared with all others, and classes are formed: near copies fall together, so
rows grow linearly with such a group. What is left of the buckets is worked off in cells. A bucket of
few free nodes is a cell. In a larger one many texts share a common passage and little else: its
texts are dealt into cells by their rarest words. A text's words are sorted by how few texts hold them.
Two texts that align over the share have a word in common among so many of their rarest as each may lose,
and one more. A pair is made in its first common cell, if the words from there on can still make up the
share, and is kept if the two share a bucket.
Cells are compared by pivots from the smallest classes, first ``MORE`` of a cell, then all. So each
pair of a bucket is in one class or was compared, or its words show that it can't align; nothing is capped.
Length classes keep texts that cannot be similar out of one bucket.

Defined results: texts without words (null, empty, punctuation only) are equal to nothing
but the same text; a null text is alone. Texts under five words have one k-mer, the whole
text. Repeated rows and repeated ids fall into the class of their text; if two texts share
a doc_id, the classes stay those of the texts. Rows with null doc_id take their text's
class; a class of null ids only has the id null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concourse.llm.common import WORD, fresh, staged
from concourse.plans.joins import sized_broadcast

KMER = 5
SKETCHES = 80
PICKS = 2
BINS, LEVELS = 256, 8     # of word hashes and of counts, for a bound of what two texts can share
SIMILARITY = 0.8
SMALL = 32     # a bucket of more free nodes is dealt into cells by rare words
MORE = 32      # pivots of a cell, in the first of its two rounds
SEEN = 128     # cells before a cell that are looked at for a pair that was made there; another is made twice

SLICE = 2_000_000  # letters of text that are sketched at once

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def kmers(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mer hashes of texts that lie one after another, and their number per
    text. A text shorter than a k-mer gives one of all its words."""
    counts = np.where(lengths > 0, np.maximum(lengths - KMER + 1, 1), 0)
    text = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(lengths) - lengths
    start = first[text] + np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
    end = (first + lengths)[text]
    mers = np.zeros(len(text), np.uint64)
    for j in range(KMER):
        at = start + j
        inside = at < end
        mers = mers * _ODD + np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(j + 1))
    mers = _mix(mers)
    order = np.lexsort((mers, text))  # stable: equal k-mers stay in text order
    run = np.ones(len(text), bool)
    run[1:] = (mers[order][1:] != mers[order][:-1]) | (text[order][1:] != text[order][:-1])
    at = np.arange(len(text))
    label = np.empty(len(text), np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(run, at, 0))).astype(np.uint64)
    return _mix(mers + label * _ODD), counts


def sketch_keys(mers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of SKETCHES keys per text that has k-mers; ``counts`` all above zero."""
    start = np.cumsum(counts) - counts
    keys = np.empty((len(counts), SKETCHES), np.uint64)
    far = np.iinfo(np.int64).max
    for s in range(SKETCHES):
        drawn = _mix(mers ^ _mix(np.array([s + 1], np.uint64) * _ODD))
        at = np.full((len(counts), PICKS), far, np.int64)
        for p in range(PICKS):
            least = np.minimum.reduceat(drawn, start)
            hit = np.flatnonzero(drawn == np.repeat(least, counts))
            text = np.searchsorted(start, hit, side="right") - 1
            own, one = np.unique(text, return_index=True)
            hit = hit[one]
            open_ = counts[own] > p
            at[own[open_], p] = hit[open_]
            drawn[hit] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at.sort(axis=1)
        key = np.full(len(counts), s + 1, np.uint64)
        for p in range(PICKS):
            there = at[:, p] < far
            key = np.where(there, _mix(key * _ODD + mers[np.where(there, at[:, p], 0)]), key)
        keys[:, s] = key
    return keys


def aligned_share(a: list[int], b: list[int]) -> float:
    """Matched words of the best alignment, over the longer length; 0 if it is under
    SIMILARITY. An alignment that keeps the share shifts no word by more than the band, so
    matches outside of it are left out. Bits stand for positions in ``a``, whose row of the
    alignment is one integer."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m < SIMILARITY * n:
        return 0.0
    band = n - int(np.ceil(SIMILARITY * n - 1e-9))
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full, open_ = (1 << n) - 1, (1 << (2 * band + 1)) - 1
    row, spare = full, m - (n - band)
    for j, w in enumerate(b):
        if j % 128 == 127 and j - (n - row.bit_count()) > spare:
            return 0.0      # too many words of b were left out already
        hit = where.get(w)
        if hit:
            inside = open_ << (j - band) if j >= band else open_ >> (band - j)
            u = row & hit & inside
            row = ((row + u) | (row - u)) & full
    share = (n - row.bit_count()) / n
    return share if share >= SIMILARITY - 1e-12 else 0.0


def _buckets(hashes: np.ndarray, lengths: np.ndarray) -> list:
    """Sketch keys of each text by length class; none for a text without words. The word hashes of the texts stand
    one text after another."""
    out: list = [[]] * len(lengths)
    keep = np.flatnonzero(lengths)
    if len(keep):
        mers, counts = kmers(hashes, lengths)
        keys = sketch_keys(mers, counts[keep])
        low = np.floor(np.log2(lengths[keep])).astype(np.uint64)
        high = np.floor(np.log2(lengths[keep] / SIMILARITY + 1e-9)).astype(np.uint64)
        near, far = (_mix(keys + c[:, None] * _ODD).view(np.int64) for c in (low, high))
        for at, i in enumerate(keep):
            out[i] = near[at] if low[at] == high[at] else np.append(near[at], far[at])
    return out


def document_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, node, words, buckets) of every document with a text, in one pass over
    the texts. ``node`` is the key of the word sequence, ``hash`` that of the text as it is;
    ``buckets`` are the sketch keys by length class: the class of the text's length and,
    where it differs, that of the longest text it can be similar to. Classes are powers of
    two, so similar texts meet in one."""
    def rows(batches):
        for batch in batches:
            size = batch["text"].str.len().cumsum().to_numpy() // SLICE
            for _, b in batch.groupby(size):
                lists = [WORD.findall(t.lower()) for t in b["text"]]
                nodes = [hashlib.md5((" ".join(x) if x else "\n" + t).encode()).digest()
                         for x, t in zip(lists, b["text"])]
                lengths = np.array([len(x) for x in lists], np.int64)
                hashes = word_hashes([w for x in lists for w in x])
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "hash": b["hash"].to_numpy(), "node": nodes,
                                    "words": lengths.astype(np.int32), "buckets": _buckets(hashes, lengths),
                                    "bins": word_bins(hashes, lengths)})

    own = docs.filter(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return own.mapInPandas(rows, "doc_id long, hash long, node binary, words int, buckets array<long>, bins array<long>")


def word_bins(hashes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """How many words of each text fall into each bin: for each level the bins that reach it, in 64-bit words, and at the end
    the words beyond the last level."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(text * BINS + (hashes % np.uint64(BINS)).astype(np.int64), minlength=len(lengths) * BINS).reshape(-1, BINS)
    bits = np.packbits(counts[:, None, :] > np.arange(LEVELS)[None, :, None], axis=2).reshape(len(counts), -1)
    beyond = np.maximum(counts - LEVELS, 0).sum(axis=1, keepdims=True)
    return list(np.concatenate([np.ascontiguousarray(bits).view(np.int64), beyond], axis=1))


def _may_align(x: Column, y: Column, words_x: Column, words_y: Column) -> Column:
    """False where word counts show that no alignment keeps the share."""
    n = LEVELS * BINS // 64
    shared = F.least(F.get(x, F.lit(n)), F.get(y, F.lit(n)))
    for i in range(n):
        shared = shared + F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.get(y, F.lit(i))))
    return shared >= SIMILARITY * F.greatest(words_x, words_y) - 1e-9


def bucket_members(keys: DataFrame) -> DataFrame:
    """(bucket, node, words, least) of the buckets that hold several nodes; ``least`` is the
    bucket's smallest node, with its words. Most buckets hold one node: only numbers are counted per bucket, and what is left
    of the rows is found by joining the buckets that count."""
    nodes = staged(keys.groupBy("node").agg(F.first("words").alias("words"), F.first("buckets").alias("buckets")), "nodes")
    several = staged(nodes.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().filter("count > 1")
                     .select("bucket"), "buckets")
    rows = staged(nodes.select(F.explode("buckets").alias("bucket"), "node", "words").join(sized_broadcast(several), "bucket"), "rows")
    least = rows.groupBy("bucket").agg(F.min(F.struct("node", "words")).alias("least"))
    return rows.join(least, "bucket")


def facts(keys: DataFrame) -> DataFrame:
    """(node, n, bins): number of words and their counts by bin."""
    return keys.groupBy("node").agg(F.first("words").alias("n"), F.first("bins").alias("bins"))


def first_pairs(members: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's smallest node with its others that may align."""
    pairs = members.filter((F.col("node") != F.col("least.node")) & _lengths_fit(F.col("words"), F.col("least.words"))) \
        .select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()
    x = known.select(F.col("node").alias("a"), F.col("n").alias("_n"), F.col("bins").alias("_bins"))
    y = known.select(F.col("node").alias("b"), F.col("n").alias("_m"), F.col("bins").alias("_more"))
    return pairs.join(x, "a").join(y, "b").filter(_may_align(F.col("_bins"), F.col("_more"), F.col("_n"), F.col("_m"))).select("a", "b")


def _lengths_fit(x, y):
    return F.least(x, y) >= SIMILARITY * F.greatest(x, y) - 1e-9


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def open_nodes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, words, size) of the buckets whose free nodes, all but the smallest, are of several classes."""
    free = with_roots(members.filter(F.col("node") != F.col("least.node")).select("bucket", "node", "words"), roots)
    every = Window.partitionBy("bucket")
    return (free.withColumn("several", F.min("root").over(every) != F.max("root").over(every))
            .withColumn("size", F.count("*").over(every))
            .filter("several").select("bucket", "node", "words", "size"))


def rare_words(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(cell, node, words, rest, at, seen): a row for each of a text's rarest words that another text holds too. ``rest`` is the
    number of its words from there on, ``seen`` the first SEEN of these rows' words, of which ``at`` come before."""
    def rows(batches):
        for b in batches:
            lists = [word_hashes(WORD.findall(t.lower())).view(np.int64) for t in b["text"]]
            found = [np.unique(x, return_counts=True) for x in lists]
            sizes = [len(w) for w, _ in found]
            yield pd.DataFrame({"node": b["node"].to_numpy().repeat(sizes), "words": np.repeat([len(x) for x in lists], sizes),
                                "word": np.concatenate([np.empty(0, np.int64), *(w for w, _ in found)]),
                                "times": np.concatenate([np.empty(0, np.int64), *(n for _, n in found)])})

    own = staged(texts.join(nodes.select("node"), "node", "left_semi").mapInPandas(
        rows, "node binary, words int, word long, times int"), "words")
    held = own.groupBy("word").agg(F.count("*").alias("held"))
    order = Window.partitionBy("node").orderBy("held", "word")
    gone = F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("times")
    may_lose = F.col("words") - F.ceil(SIMILARITY * F.col("words") - 1e-9)
    rare = (own.join(held, "word").withColumn("rest", F.col("words") - gone)
            .filter((F.col("words") - F.col("rest") <= may_lose) & (F.col("held") > 1))
            .withColumn("at", F.row_number().over(order) - 1)
            .withColumn("seen", F.collect_list(F.when(F.col("at") < SEEN, F.col("word"))).over(
                order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return rare.select(F.col("word").alias("cell"), "node", "words", "rest", "at", "seen")


def cells(free: DataFrame, texts: DataFrame) -> DataFrame:
    """(cell, node, words, rest, at, seen) of the open nodes: their buckets of at most SMALL nodes, and the rare words of those
    that are in larger ones."""
    small = (free.filter(F.col("size") <= SMALL).groupBy("node")
             .agg(F.first("words").alias("words"), F.sort_array(F.collect_set("bucket")).alias("seen"))
             .select("node", "words", "seen", F.posexplode("seen").alias("at", "cell"))
             .select("cell", "node", "words", F.col("words").alias("rest"), "at", "seen"))
    large = staged(free.filter(F.col("size") > SMALL).select("node").distinct(), "large")
    return small if large.isEmpty() else small.union(rare_words(large, texts))


def ranked_nodes(left: DataFrame, roots: DataFrame) -> DataFrame:
    """``left`` in the cells of several classes, with ``root`` and ``rank``: nodes of a cell's smallest classes come first."""
    every, own = Window.partitionBy("cell"), Window.partitionBy("cell", "root")
    return (with_roots(left, roots)
            .withColumn("several", F.min("root").over(every) != F.max("root").over(every)).filter("several").drop("several")
            .withColumn("members", F.count("*").over(own))
            .withColumn("rank", F.row_number().over(every.orderBy("members", "root", "node"))).drop("members"))


def pivot_pairs(ranked: DataFrame, n: int | None) -> DataFrame:
    """Pairs (node, pivot) of the first ``n`` nodes of each cell, or all, with those after them outside their class: each pair in
    its first common cell, and if their words from there on can make up the share."""
    chosen = (ranked if n is None else ranked.filter(F.col("rank") <= n)).select(
        "cell", *(F.col(c).alias(f"pivot_{c}") for c in ("root", "rank", "words", "rest", "at", "seen")), F.col("node").alias("pivot"))
    longer = F.greatest("words", "pivot_words")
    return (
        ranked.join(chosen, "cell")
        .filter((F.col("rank") > F.col("pivot_rank")) & (F.col("root") != F.col("pivot_root"))
                & (F.least("rest", "pivot_rest") >= SIMILARITY * longer - 1e-9)
                & ~F.arrays_overlap(F.slice("seen", 1, F.col("at")), F.slice("pivot_seen", 1, F.col("pivot_at"))))
        .select("node", "pivot").distinct()
    )


def kept_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (node, pivot) that share a bucket and may align, as (a, b)."""
    x = known.select("node", "n", "bins", "buckets")
    y = known.select(F.col("node").alias("pivot"), F.col("n").alias("_n"), F.col("bins").alias("_bins"), F.col("buckets").alias("_buckets"))
    return (pairs.join(x, "node").join(y, "pivot")
            .filter(_may_align(F.col("bins"), F.col("_bins"), F.col("n"), F.col("_n")) & F.arrays_overlap("buckets", "_buckets"))
            .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())


def candidate_texts(docs: DataFrame, keys: DataFrame, members: DataFrame) -> DataFrame:
    """(node, text) of the nodes that share a bucket: one text of each."""
    one = (keys.join(members.select("node").distinct(), "node", "left_semi")
           .groupBy("node").agg(F.min(F.struct("doc_id", "hash")).alias("one"))
           .select("node", F.col("one.doc_id").alias("_id"), F.col("one.hash").alias("_hash")))
    own = docs.filter(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return (own.join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
            .groupBy("node").agg(F.min("text").alias("text")))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts align."""
    def rows(batches):
        known: dict[str, list[int]] = {}

        def words(t: str) -> list[int]:
            if t not in known:
                if len(known) > 500:
                    known.clear()
                known[t] = word_hashes(WORD.findall(t.lower())).tolist()
            return known[t]

        for p in batches:
            ok = [aligned_share(words(x), words(y)) > 0 for x, y in zip(p["text_a"], p["text_b"])]
            yield p.loc[np.array(ok, bool), ["a", "b"]]

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(rows, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: root is the smallest node that links reach. Each node is
    labelled with the least of its neighbours and itself, the links are drawn between labels, and
    what links are left is solved the same way. Labels are at most half of the nodes, so the
    levels are few; every step is an equi-join or an aggregation with partial sums."""
    both = links.union(links.select("b", "a")).toDF("node", "near")
    labels = staged(both.groupBy("node").agg(F.min("near").alias("near"))
                    .select("node", F.least("node", "near").alias("root")), "labels")
    rest = staged(contracted(links, labels), "links")
    return labels if rest.isEmpty() else composed(labels, components(rest))


def contracted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The links between different roots; a node without a root is its own."""
    def root_of(side: str) -> DataFrame:
        return roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))

    return links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b").distinct()


def composed(roots: DataFrame, up: DataFrame) -> DataFrame:
    """``roots`` with the roots' own roots in place of them."""
    above = up.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return staged(roots.join(above, F.col("root") == F.col("_node"), "left")
                  .select("node", F.coalesce("_root", "root").alias("root")), "roots")


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after more links: the links between different roots join classes."""
    ends = staged(contracted(links, roots), "links")
    if ends.isEmpty():
        return roots
    more = components(ends)
    new = more.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return composed(roots, more).union(new)


def similar_classes(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, root) of the texts that verified links join. A pair of a cell needs no comparing once
    it is in one class or one of the two was a pivot, so a cell is done when its free nodes,
    those that were no pivots, are of one class."""
    members = staged(bucket_members(keys), "members")
    texts = staged(candidate_texts(docs, keys, members), "candidates")
    known = staged(facts(keys).join(members.select("node").distinct(), "node", "left_semi"), "facts")
    compared = staged(first_pairs(members, known), "pairs")
    roots = components(staged(verified(compared, texts), "verified"))
    free = staged(open_nodes(members, roots), "open")
    if free.isEmpty():
        return roots
    known = staged(known.join(free.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "node"), "facts")
    left = cells(free, texts)
    for n in (MORE, None):
        ranked = staged(ranked_nodes(left, roots), "ranked")
        if ranked.isEmpty():
            break
        pairs = staged(kept_pairs(pivot_pairs(ranked, n), known).join(compared, ["a", "b"], "left_anti"), "pairs")
        roots = joined_roots(roots, staged(verified(pairs, texts), "verified"))
        compared = compared.union(pairs)
        left = ranked.filter(F.col("rank") > n).drop("root", "rank") if n else None
    return roots


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, class_id, kept) of every document: ``class_id`` is the smallest doc_id
    of its class, ``kept`` marks one document of each class; ``hash`` is that of the text,
    null for null."""
    keys = staged(document_keys(docs), "keys")
    roots = similar_classes(docs, keys)
    ids = keys.groupBy("node").agg(F.min("doc_id").alias("least"))  # copies fall together before the shuffle
    named = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    names = named.join(least, "root").select("node", "class_id")
    texts = keys.select("doc_id", "hash", "node").join(names, "node").select("doc_id", "hash", "class_id")
    bare = docs.filter(F.col("text").isNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("hash"),
        F.col("doc_id").cast("long").alias("class_id"))
    return texts.union(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; columns unchanged. Of rows that repeat the
    kept document's id and text only one stays; documents without a text all stay."""
    name = fresh(docs, "hash_")
    classes = staged(near_duplicate_classes(docs).filter(F.col("hash").isNotNull()), "classes")
    keys = [F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")]
    own = docs.withColumn(name, F.xxhash64("text"))

    def same(others: DataFrame):
        return own["doc_id"].eqNullSafe(others["_id"]) & (own[name] == others["_hash"])

    gone = classes.filter(~F.col("kept")).select(*keys).distinct()
    repeated = (classes.filter("kept OR doc_id IS NULL").groupBy("doc_id", "hash").count().filter("count > 1")
                .select(*keys))
    rest = own.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return rest.select(*docs.columns)
    once = (own.join(repeated, same(repeated), "left_semi").join(gone, same(gone), "left_anti")
            .dropDuplicates(["doc_id", name]))
    return rest.join(repeated, same(repeated), "left_anti").union(once).select(*docs.columns)
