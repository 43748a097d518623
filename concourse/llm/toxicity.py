"""Toxicity by nearest labelled examples.

Documents and labelled examples are TF-IDF vectors over all terms of the examples; terms
whose presence marks the label weigh more. An example's nearness is the exact cosine. A block-max
inverted index over the examples finds the nearest: examples of like length and most frequent word stand
in one block. Terms that few examples hold are added up from their postings. Terms that many hold are kept
as rows of numbers over the examples, with their largest weight in each block: a block whose largest score so
far, with all that the query's frequent terms can add in it, stays under the k-th score is not opened; in the
others a product of matrices completes the scores of a batch of texts. So no nearer example is missed.
Distance-weighted
votes of the nearest give a raw score; a part of the labelled rows that is not in the index turns raw
scores into rates of label 1, and chooses how much more marking terms weigh (one of ``MARKS``).

The labelled sample is bounded by ``MAX_LABELLED`` rows (those of smallest id hash) and ``MAX_BYTES`` of
different texts (those of smallest text hash), so the fitted model has a fixed size and is broadcast.
Document frequencies cover all documents. A term that no example holds adds to no cosine's product and is
left out of the text's norm, which leaves the order of the examples as it is. Terms are known by 64-bit
hashes. Scoring is row-local: no shuffle of texts.

Defined results: null and empty texts, and texts that share no term with any example, have
no neighbour and get the rate of label 1 among such labelled texts. Repeated labelled texts
count once, with their mean label. Labels that are null, or of unknown documents, are
left out; of several for one document the largest holds. Without labelled rows every
score is 0. Ties between examples go to the smaller example id.
"""

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concourse.llm.common import WORD, fresh, staged, whole_text

MAX_LABELLED = 20_000   # labelled rows the model is fitted on, at most
MIN_PRECISION = 0.5     # lower confidence bound of P(label 1 | term) for a term to mark the label
MAX_BYTES = 64 << 20    # of their texts, at most
MARKS = (1.0, 3.0, 10.0, 30.0)  # how much more such a term may weigh
NEIGHBOURS = 16
BLOCK = 64
FREQUENT = 1 / 8        # a term of more examples than this share is kept as a row over all of them
FIRST = 4               # one block in so many is opened before the k-th score is looked at
BATCH = 16              # texts that are searched at once
SLICE = 1024            # texts whose vectors are held at once
KNOWN = 20_000          # scores of texts that a task keeps for their copies
REJECT_AT = 0.7
BINS = 5
RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(T.LongType())),
])


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


class BlockMaxIndex:
    """Inverted index over example vectors: per term its postings in row order; for frequent terms their weight in
    every row and their largest weight in every block of rows; all in flat arrays."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, postings: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        terms = sorted(postings)
        sizes = [len(postings[t][0]) for t in terms]
        self._fill(ids, labels, np.repeat(np.array(terms, np.int64), sizes),
                   np.concatenate([postings[t][0] for t in terms] or [np.empty(0, np.int64)]),
                   np.concatenate([postings[t][1] for t in terms] or [np.empty(0)]))

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, term: np.ndarray, row: np.ndarray, weight: np.ndarray) -> "BlockMaxIndex":
        """From one entry per (term, row) in any order."""
        order = np.lexsort((row, term)).astype(np.int32)
        index = cls.__new__(cls)
        index._fill(ids, labels, term[order], row[order], weight[order])
        return index

    def _fill(self, ids, labels, term, row, weight) -> None:
        self.ids, self.labels = ids, labels
        n, terms = len(ids), int(term[-1]) + 1 if len(term) else 0
        self.postings = np.searchsorted(term, np.arange(terms + 1, dtype=term.dtype)).astype(np.int32)
        self.frequent = np.diff(self.postings) > max(BLOCK, FREQUENT * n)
        self.place = np.cumsum(self.frequent) - 1       # of a frequent term among them
        many = self.frequent[term]
        self.edges = np.arange(0, n, BLOCK)
        self.dense = np.zeros((len(self.edges), int(self.frequent.sum()), BLOCK))    # of each block, frequent terms x rows
        self.dense[row[many] // BLOCK, self.place[term[many]], row[many] % BLOCK] = weight[many]
        self.most = self.dense.max(axis=2).T
        self.row, self.weight = row[~many].astype(np.int32), weight[~many]
        self.start = np.append(0, np.cumsum(np.where(self.frequent, 0, np.diff(self.postings)))).astype(np.int32)
        self.opened = self.blocks = 0                   # blocks opened, and blocks there were, over all queries

    def nearest(self, query: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``search`` for a vector given as term: weight."""
        return self.search(np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), float, len(query)), k)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.search_all([(terms, weights)], k)[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, rows and exact cosines of the k nearest, nearest first, ties to the smaller id."""
        n, q = len(self.ids), len(queries)
        if not n:
            return [(np.empty(0, np.int64), np.empty(0))] * q
        scores, vectors = np.empty((q, n)), np.zeros((q, len(self.most)))
        for i, (terms, weights) in enumerate(queries):
            known = terms < len(self.frequent)
            terms, weights = terms[known], weights[known]
            many = self.frequent[terms]
            vectors[i, self.place[terms[many]]] = weights[many]
            few = terms[~many]
            at, size = _spread(self.start[few], self.start[few + 1])
            scores[i] = np.bincount(self.row[at], np.repeat(weights[~many], size) * self.weight[at], minlength=n)
        peak = np.maximum.reduceat(scores, self.edges, axis=1)
        low = np.partition(peak, -k, axis=1)[:, -k] if len(self.edges) >= k else np.zeros(q)  # k rows score that or more
        bound = peak + vectors @ self.most
        order = np.argsort(-bound.max(axis=0), kind="stable")       # the most promising blocks give a better k-th score
        first = np.sort(order[:-(-len(order) // FIRST)])
        rows, whole = self._opened(first, scores, vectors)
        if whole.shape[1] >= k:
            low = np.maximum(low, np.partition(whole, -k, axis=1)[:, -k])
        open_ = (bound > 0) & (bound >= low[:, None] - 1e-11)
        open_[:, first] = False
        blocks = np.flatnonzero(open_.any(axis=0))
        more, rest = self._opened(blocks, scores, vectors)
        rows, whole = np.concatenate([rows, more]), np.concatenate([whole, rest], axis=1)
        self.opened, self.blocks = self.opened + q * (len(first) + len(blocks)), self.blocks + q * len(self.edges)
        out = []
        for score, least in zip(whole, low):
            near = np.flatnonzero((score > 0) & (score >= least - 1e-11))
            score = score[near]
            if len(near) > k:
                cut = score >= np.partition(score, -k)[-k] - 1e-11
                near, score = near[cut], score[cut]
            best = np.lexsort((self.ids[rows[near]], -np.round(score, 12)))[:k]
            out.append((rows[near[best]], score[best]))
        return out

    def _opened(self, blocks: np.ndarray, scores: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of these blocks and their whole scores."""
        rows = (self.edges[blocks][:, None] + np.arange(BLOCK)).ravel()
        whole = np.empty((len(vectors), len(rows)))
        for i, b in enumerate(blocks):
            whole[:, i * BLOCK:(i + 1) * BLOCK] = vectors @ self.dense[b]
        there = rows < len(self.ids)
        return rows[there], whole[:, there] + scores[:, rows[there]]


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one range after another, and the size of each."""
    start, size = start.astype(np.int64), (end - start).astype(np.int64)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


@dataclass
class ToxicityModel:
    terms: np.ndarray  # hashes, sorted
    idf: np.ndarray
    marks: np.ndarray  # terms that mark the label
    ids: np.ndarray  # of the examples, with the terms and counts of each, one example after another
    labels: np.ndarray
    sizes: np.ndarray
    example_terms: np.ndarray
    example_counts: np.ndarray
    no_neighbour: float
    mark: float = 1.0  # how much more those weigh
    steps: np.ndarray | None = None  # the rate of label 1 in each bin of raw votes

    @cached_property
    def scale(self) -> np.ndarray:
        return self.idf * np.where(self.marks, self.mark, 1.0)

    @cached_property
    def index(self) -> BlockMaxIndex:
        """Made where it is searched, so that the driver holds and sends the examples only."""
        if not len(self.ids):
            return BlockMaxIndex.of(self.ids, self.labels, self.example_terms, self.example_terms, np.empty(0))
        start = np.cumsum(self.sizes) - self.sizes
        weight = np.log(self.example_counts)
        weight += 1
        weight *= self.scale[self.example_terms]
        weight /= np.repeat(np.sqrt(np.add.reduceat(weight * weight, start)), self.sizes)
        commonest = np.maximum.reduceat((self.example_counts.astype(np.int64) << 32) | self.example_terms, start) & 0xFFFFFFFF
        order = np.lexsort((self.ids, self.sizes, commonest))  # like vectors share a block
        place = np.empty(len(self.ids), np.int32)
        place[order] = np.arange(len(self.ids))
        return BlockMaxIndex.of(self.ids[order], self.labels[order], self.example_terms, np.repeat(place, self.sizes), weight)

    def votes(self, found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """Distance-weighted share of label 1 among the nearest, and their ids; of texts given by terms and counts. Texts of
        the same most frequent term are searched together, as they open the same blocks."""
        out: list[tuple[float, list[int]]] = [(-1.0, [])] * len(found)
        there = [i for i, (t, _) in enumerate(found) if len(t)]
        there.sort(key=lambda i: (int(found[i][0][np.argmax(found[i][1])]), len(found[i][0])))
        for a in range(0, len(there), BATCH):
            some, queries = there[a:a + BATCH], []
            for i in some:
                terms, counts = found[i]
                weights = (1 + np.log(counts)) * self.scale[terms]
                queries.append((terms, weights / np.sqrt(weights @ weights)))
            for i, (rows, cosines) in zip(some, self.index.search_all(queries, NEIGHBOURS)):
                if len(rows):
                    weight = 1 / (1.05 - np.minimum(cosines, 1))
                    out[i] = float(weight @ self.index.labels[rows] / weight.sum()), self.index.ids[rows].tolist()
        return out

    def scores(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        """Score and evidence of each text."""
        def rate(raw: float) -> float:
            return float(np.interp(raw * BINS, np.arange(BINS) + 0.5, self.steps)) if raw >= 0 else self.no_neighbour

        return [(rate(raw), evidence) for raw, evidence in self.votes([term_counts(self.terms, t) for t in texts])]


def hashes(words) -> np.ndarray:
    words = list(words)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False).view(np.int64) if words else np.empty(0, np.int64)


def term_counts(terms: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The known terms in the whole text, by their place in ``terms``, and how often each is there."""
    found = Counter(WORD.findall(text.lower()))
    own, n = hashes(found), np.fromiter(found.values(), np.int64, len(found))
    at = np.searchsorted(terms, own)
    known = at < len(terms)
    known[known] = terms[at[known]] == own[known]
    at, n = at[known], n[known]
    order = np.argsort(at, kind="stable")
    return at[order], n[order]


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(key, id, text, label, part) of the labelled rows outside the held-out part, at most MAX_LABELLED and
    MAX_BYTES of them; part 0 calibrates, the others are examples."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
    )
    own = docs.select(F.col("doc_id").alias("_id"), whole_text().alias("_text"))
    texts = staged(
        own.join(F.broadcast(chosen), "_id")  # MAX_LABELLED rows of 16 bytes
        .groupBy(F.md5("_text").alias("key"))
        .agg(F.min("_id").alias("id"), F.min("_text").alias("text"), F.avg("_y").alias("label")), "labelled")
    sizes = texts.select("key", F.octet_length("text").alias("size"))  # MAX_LABELLED rows
    before = F.sum("size").over(Window.orderBy(F.xxhash64("key"), "key"))
    fit = sizes.withColumn("before", before).filter(F.col("before") <= MAX_BYTES).select("key")
    return texts.join(F.broadcast(fit), "key").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(4)))


def example_terms(examples: DataFrame) -> pd.DataFrame:
    """(term, marks) of all terms of the examples, as hashes; ``marks``: the Wilson lower bound of
    P(label 1 | term), over texts, reaches MIN_PRECISION."""
    def pairs(batches):
        for b in batches:
            found = [hashes(set(WORD.findall(t.lower()))) for t in b["text"]]
            yield pd.DataFrame({"term": np.concatenate([np.empty(0, np.int64), *found]),
                                "label": np.repeat(b["label"].to_numpy(), [len(f) for f in found])})

    n, p, z2 = F.col("n"), F.col("pos") / F.col("n"), 1.96 ** 2
    low = (p + z2 / (2 * n) - 1.96 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return (
        examples.select("text", "label").mapInPandas(pairs, "term long, label double")
        .groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
        .select("term", (low >= MIN_PRECISION).alias("marks")).toArrow().to_pandas()  # terms of MAX_LABELLED texts at most
        .sort_values("term", ignore_index=True)
    )


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents with each term; each task sends its sums."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def sums(batches):
        known = shared.value
        n, df = 0, np.zeros(len(known), np.int64)
        for b in batches:
            n += len(b)
            for t in b["_text"]:
                df[term_counts(known, t)[0]] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(at, -1), "df": np.append(df[at], n)})

    rows = (
        docs.select(whole_text().alias("_text")).mapInPandas(sums, "term long, df long")
        .groupBy("term").agg(F.sum("df").alias("df")).toArrow().to_pandas()  # a row per term and one more at most
    )
    shared.unpersist()
    own = rows[rows["term"] >= 0]
    df = np.zeros(len(terms))
    df[own["term"].to_numpy(np.int64)] = own["df"]
    return int(rows["df"][rows["term"] < 0].sum()), df


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    """Fit on the labelled rows of ``docs`` that are not held out."""
    share = docs.sparkSession.sparkContext.broadcast
    examples = staged(labelled_texts(docs, labels, label), "examples")
    found = example_terms(examples.filter("part > 0"))
    terms, marks = found["term"].to_numpy(np.int64), found["marks"].to_numpy(bool)
    shared = share(terms)

    def vectors(batches):
        for b in batches:
            own = [term_counts(shared.value, t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "part": b["part"], "size": [len(t) for t, _ in own],
                                "terms": [t.astype(np.int32).tobytes() if p else b"" for (t, _), p in zip(own, b["part"])],
                                "counts": [n.astype(np.int32).tobytes() if p else b"" for (_, n), p in zip(own, b["part"])]})

    rows = (examples.select("id", "label", "part", "text")  # MAX_LABELLED rows and MAX_BYTES of texts at most
            .mapInPandas(vectors, "id long, label double, part long, size long, terms binary, counts binary")
            .toArrow().to_pandas())
    shared.unpersist()
    n_docs, df = document_frequencies(docs, terms)
    bare = rows["size"] == 0
    own = rows[(rows["part"] > 0) & ~bare]
    model = ToxicityModel(
        terms, np.log((1 + n_docs) / (1 + df)) + 1, marks, own["id"].to_numpy(np.int64), own["label"].to_numpy(float),
        own["size"].to_numpy(np.int64), np.frombuffer(b"".join(own["terms"]), np.int32),
        np.frombuffer(b"".join(own["counts"]), np.int32), float(rows["label"][bare].mean()) if bare.any() else 0.0)
    return calibrated(model, examples.filter("part = 0").select("text", "label"))


def calibrated(model: ToxicityModel, rows: DataFrame) -> ToxicityModel:
    """``model`` with the weight of marking terms that tells the labels of ``rows`` apart best (of equals the
    largest), and with the rate of label 1 per bin of raw votes."""
    best, chosen = -1.0, None
    for mark in MARKS if model.marks.any() else MARKS[:1]:
        own = replace(model, mark=mark)
        found = _votes(rows, own)
        if (area := _area(found)) >= best - 1e-9:
            best, chosen = max(area, best), (own, found)
    model, found = chosen
    model.steps = _rates(found)
    return model


def _votes(rows: DataFrame, model: ToxicityModel) -> pd.DataFrame:
    """(raw, label) of the rows that have neighbours."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def votes(batches):
        for b in batches:
            found = [term_counts(shared.value.terms, t) for t in b["text"]]
            yield pd.DataFrame({"raw": [raw for raw, _ in shared.value.votes(found)], "label": b["label"]})

    found = rows.mapInPandas(votes, "raw double, label double").filter("raw >= 0").toArrow().to_pandas()  # MAX_LABELLED rows
    shared.unpersist()
    return found


def _area(found: pd.DataFrame) -> float:
    """Chance that a vote for label 1 is above one for label 0; 0.5 if there is one label only."""
    up, rank = found["label"] >= 0.5, found["raw"].rank()
    a, b = int(up.sum()), int((~up).sum())
    return float((rank[up].sum() - a * (a + 1) / 2) / (a * b)) if a and b else 0.5


def _rates(found: pd.DataFrame) -> np.ndarray:
    """Rate of label 1 per bin of raw votes, drawn towards the vote where rows are few, never falling."""
    at = np.minimum((found["raw"].to_numpy(float) * BINS).astype(int), BINS - 1)
    n = np.bincount(at, minlength=BINS)
    pos = np.bincount(at, found["label"].to_numpy(float), minlength=BINS)
    middle = (np.arange(BINS) + 0.5) / BINS
    return np.maximum.accumulate((pos + 2 * middle) / (n + 2))


def with_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name``: struct of score and evidence (nearest example ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple[float, list[int]]] = {}     # copies
        for batch in batches:
            for a in range(0, len(batch), SLICE):
                texts = batch.iloc[a:a + SLICE].tolist()
                keys = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
                if len(known) >= KNOWN:
                    known.clear()
                new = {k: t for k, t in zip(keys, texts) if k not in known}
                known.update(zip(new, shared.value.scores(list(new.values()))))
                yield pd.DataFrame({"score": [known[k][0] for k in keys], "evidence": [known[k][1] for k in keys]})

    return docs.withColumn(name, scored(whole_text()))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score reaches REJECT_AT; columns unchanged."""
    name = fresh(docs, "toxicity")
    scored = with_toxicity(docs, fit_toxicity(docs, labels), name)
    return scored.filter(F.col(f"{name}.score") < REJECT_AT).select(*docs.columns)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every document."""
    own = docs.select("doc_id", "text")
    return with_toxicity(own, fit_toxicity(own, labels)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= REJECT_AT).cast("int").alias("predicted"),
        F.col("toxicity.evidence").alias("evidence"),
    )
