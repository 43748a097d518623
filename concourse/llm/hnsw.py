"""Nearest neighbours by one hierarchical navigable small-world graph per shard.

Equal vectors are collapsed first, each with its smallest ids, so a vector that a third of
the rows share is one node. Distinct vectors are dealt by hash into shards of about
``SHARD_ROWS``. A shard's graph is built in its task: a node's level is drawn from its hash;
on every level it is linked to near nodes of that level that are not nearer to a link
already chosen (so links point in many directions), links go both ways, and the nearest
``links`` stay. The vectors of a shard are compared in blocks to find the near nodes.
Levels are stored as flat arrays of neighbour numbers, ``links`` per node, -1 for none.

A query goes down the levels greedily and searches the lowest one with a candidate list of
``breadth``; the shards' results are merged by exact cosine in double precision. Queries are
packed in blocks, and each block visits each shard once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, as query or candidate; rows without vec_id neither. Vectors of another length
are no candidates. Rows that repeat a vec_id are one candidate, with the best score, and one
query; a query's own id is no candidate. Ties go to the smaller vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concourse.llm.common import staged

SHARD_ROWS = 4_096
LINKS = 16           # links of a node on the upper levels; twice as many on the lowest
NEAR = 64            # near nodes that links are chosen from
BREADTH = 64         # candidates that a search keeps
QUERY_BLOCK = 1_024
MAX_SHARDS = 1 << 20


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the rows that take part; v as doubles."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
        .filter(F.exists(v, lambda x: x != 0)).withColumn("dim", F.size(v))
    )


def distinct_vectors(rows: DataFrame, members: int) -> DataFrame:
    """(v, dim, ids): each vector with its ``members`` smallest ids. More ids of one vector
    cannot be among the nearest, as ties go to smaller ids."""
    by = Window.partitionBy("v").orderBy("vec_id")
    return (rows.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= members)
            .groupBy("v", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)   # no overflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Graph:
    """Levels of flat neighbour arrays over the rows of ``units`` (unit vectors, float32)."""

    def __init__(self, units: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.units, self.nodes, self.links = units, nodes, links

    @classmethod
    def build(cls, units: np.ndarray, draws: np.ndarray) -> Graph:
        """``draws``: a number from 0 to 1 per row, that gives its level."""
        units = units.astype(np.float32)
        level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(LINKS)).astype(int), 8)
        nodes, links = [], []
        for lv in range(level.max() + 1):
            own = np.flatnonzero(level >= lv)
            nodes.append(own)
            links.append(_linked(units[own], LINKS if lv else 2 * LINKS))
        return cls(units, nodes, links)

    def search(self, q: np.ndarray, breadth: int = BREADTH) -> np.ndarray:
        """Rows near the unit vector ``q``, nearest first."""
        q = q.astype(np.float32)
        at = 0
        for lv in range(len(self.nodes) - 1, 0, -1):
            own, links = self.nodes[lv], self.links[lv]
            if lv < len(self.nodes) - 1:
                at = int(np.searchsorted(own, at_row))
            best = float(self.units[own[at]] @ q)
            while True:
                near = links[at][links[at] >= 0]
                if not len(near):
                    break
                s = self.units[own[near]] @ q
                i = int(s.argmax())
                if s[i] <= best:
                    break
                best, at = float(s[i]), int(near[i])
            at_row = own[at]
        start = int(at_row) if len(self.nodes) > 1 else 0
        links, units = self.links[0], self.units
        seen = np.zeros(len(units), bool)
        seen[start] = True
        s0 = float(units[start] @ q)
        todo, kept = [(-s0, start)], [(s0, start)]
        while todo:
            s, i = heapq.heappop(todo)
            if len(kept) >= breadth and -s < kept[0][0]:
                break
            near = links[i]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            scores = units[near] @ q
            floor = kept[0][0] if len(kept) >= breadth else -2.0
            for s, j in zip(scores.tolist(), near.tolist()):
                if s > floor or len(kept) < breadth:
                    heapq.heappush(todo, (-s, j))
                    heapq.heappush(kept, (s, j))
                    if len(kept) > breadth:
                        heapq.heappop(kept)
                    floor = kept[0][0]
        return np.array([j for _, j in sorted(kept, reverse=True)], np.int64)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, units=self.units, **{f"nodes{i}": n for i, n in enumerate(self.nodes)},
                 **{f"links{i}": n for i, n in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as z:
            n = sum(k.startswith("nodes") for k in z.files)
            return cls(z["units"], [z[f"nodes{i}"] for i in range(n)], [z[f"links{i}"] for i in range(n)])


def _linked(units: np.ndarray, most: int) -> np.ndarray:
    """Neighbour numbers of each node, ``most`` at most, -1 for none."""
    n, wanted = len(units), min(NEAR, len(units) - 1)
    out: list[dict[int, float]] = [{} for _ in range(n)]
    for a in range(0, n, 512):
        scores = units[a:a + 512] @ units.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -2
        near = np.argpartition(-scores, wanted - 1, axis=1)[:, :wanted] if wanted else np.empty((len(scores), 0), int)
        for i, row in enumerate(near):
            row = row[np.lexsort((row, -scores[i, row]))]
            among = units[row] @ units[row].T
            chosen: list[int] = []
            for k in range(len(row)):
                if len(chosen) >= most // 2:
                    break
                if not chosen or among[k, chosen].max() < scores[i, row[k]]:
                    chosen.append(k)
            chosen += [k for k in range(len(row)) if k not in chosen][:max(0, most // 2 - len(chosen))]
            for k in chosen:
                s = float(scores[i, row[k]])
                out[a + i][int(row[k])] = s
                out[int(row[k])][a + i] = s
    links = np.full((n, most), -1, np.int32)
    for i, near in enumerate(out):
        best = sorted(near, key=lambda j: (-near[j], j))[:most]
        links[i, :len(best)] = best
    return links


def build_shards(distinct: DataFrame, shards: int) -> DataFrame:
    """(dim, shard, vectors, ids, graph) with one row per shard: its vectors as doubles, the
    ids of each, and its graph."""
    def build(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("mark", kind="stable")
        v = np.array(b["v"].tolist(), np.float64)
        draws = (b["mark"].to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) / float(1 << 53)
        return pd.DataFrame({"dim": [int(key[0])], "shard": [int(key[1])], "vectors": [v.tobytes()],
                             "ids": [b["ids"].tolist()], "graph": [Graph.build(unit(v), draws).dump()]})

    rows = distinct.withColumn("mark", F.xxhash64("v")).withColumn(
        "shard", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(shards)).cast("int"))
    return rows.groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard int, vectors binary, ids array<array<long>>, graph binary")


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """(dim, block, query_ids, queries): queries packed in blocks of about QUERY_BLOCK."""
    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [int(key[0])], "block": [int(key[1])], "query_ids": [b["vec_id"].tolist()],
                             "queries": [np.array(b["v"].tolist(), np.float64).tobytes()]})

    at = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    return queries.withColumn("block", at).groupBy("dim", "block").applyInPandas(
        pack, "dim int, block int, query_ids array<long>, queries binary")


def nearest(vectors: DataFrame, is_query, k: int, breadth: int = BREADTH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of each row that meets ``is_query``,
    a condition on vec_id, among all other rows."""
    rows = staged(usable(vectors).dropDuplicates(["vec_id", "v"]), "vectors")
    n = rows.count()
    shards = max(1, min(MAX_SHARDS, -(-n // SHARD_ROWS)))
    queries = rows.filter(is_query)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    graphs = staged(build_shards(distinct_vectors(rows, k + 1), shards), "graphs")
    packed = staged(query_blocks(queries, blocks), "queries")
    pairs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, ["dim", "block"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                graph = Graph.load(r.graph)
                v = np.frombuffer(r.vectors, np.float64).reshape(-1, r.dim)
                qs = np.frombuffer(r.queries, np.float64).reshape(-1, r.dim)
                own = unit(v)
                out = []
                for qid, q in zip(r.query_ids, unit(qs)):
                    at = graph.search(q, max(breadth, 2 * k + 2))
                    exact = own[at] @ q
                    best = np.lexsort(([r.ids[j][0] for j in at], -exact))[:k + 1]
                    for j, s in zip(at[best].tolist(), exact[best].tolist()):
                        out += [(qid, int(i), s) for i in r.ids[j]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = pairs.repartition(F.col("shard"), F.col("block")).mapInPandas(search, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
