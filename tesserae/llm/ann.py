"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is filed in a leaf.  A query visits leaves in the order in which a
priority queue over the tree's nodes yields them, and the number of visits is widened, on a bounded set of calibration
queries, until their recall against brute force over the whole table reaches the target.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.storage import hash_sample, materialise

#: Vectors that the tree is fitted on, queries that the visits are calibrated on, children of a node, levels.
SAMPLE_ROWS, CALIBRATION_ROWS, BRANCH, LEVELS = 20_000, 256, 8, 2
#: Recall to reach on the calibration queries, and vectors or queries that are compared as one block.
RECALL, BLOCK_ROWS = 0.97, 2048


@dataclass
class Tree:
    """Centres of all nodes; the children of node i are ``children[i]``, and leaves are numbered by ``leaf``."""

    centre: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray  # -1 for inner nodes

    def leaves_in_order(self, q: np.ndarray, visits: int) -> list[int]:
        """Best-bin-first: pop the node whose centre has the largest inner product with the query, push its children."""
        near = self.centre @ q
        queue, out = [(-np.inf, 0)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
            for child in self.children[node]:
                heapq.heappush(queue, (-near[child], child))
        return out

    def file(self, X: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every level the nearest centre."""
        at = np.zeros(len(X), dtype=np.int64)
        for node in range(len(self.children)):
            if kids := self.children[node]:
                rows = np.flatnonzero(at == node)
                if len(rows):
                    at[rows] = np.array(kids)[nearest(X[rows], self.centre[kids])]
        return self.leaf[at]


def nearest(X: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre in Euclidean distance."""
    return np.argmin((centres**2).sum(axis=1) - 2 * (X @ centres.T), axis=1)


def k_means(X: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's iterations from evenly spaced rows; returns at most ``k`` distinct centres."""
    rows = np.unique(X, axis=0)
    if len(rows) <= k:
        return rows
    centres = rows[np.random.default_rng(7).choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        of = nearest(X, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, X)
        n = np.bincount(of, minlength=len(centres))[:, None]
        moved = np.where(n > 0, sums / np.maximum(n, 1), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return np.unique(centres, axis=0)


def grow(X: np.ndarray, branch: int = BRANCH, levels: int = LEVELS) -> Tree:
    """The tree over a sample; a node with few or equal vectors is a leaf."""
    centre, children, leaf = [X.mean(axis=0) if len(X) else np.zeros(X.shape[1])], [[]], [-1]
    todo, leaves = [(0, X, levels)], 0
    while todo:
        node, rows, left = todo.pop(0)
        centres = k_means(rows, branch) if left and len(rows) > branch else np.zeros((0, X.shape[1]))
        if len(centres) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        of = nearest(rows, centres)
        for k in range(len(centres)):
            children[node].append(len(centre))
            centre.append(centres[k])
            children.append([])
            leaf.append(-1)
            todo.append((children[node][-1], rows[of == k], left - 1))
    return Tree(np.array(centre), children, np.array(leaf))


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors as doubles, without those that are null, empty, zero or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    return table.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def best_of_block(q: np.ndarray, q_ids: np.ndarray, V: np.ndarray, ids: np.ndarray, k: int):
    """Per query the k best candidates of a block without its own row: query ids, vector ids, scores.

    A matrix product preselects; all that may tie with the k-th are scored anew component by component, so that equal
    vectors score equally wherever they lie.
    """
    rough = q @ V.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    out = []
    for i in range(len(q)):
        row = rough[i]
        pick = np.flatnonzero(row > -np.inf)
        if len(pick) > k:
            kth = np.partition(row[pick], len(pick) - k)[len(pick) - k]
            pick = pick[row[pick] >= kth - 1e-9 * max(1.0, abs(kth))]
        score = (V[pick] * q[i]).sum(axis=1)
        order = np.lexsort((ids[pick], -score))[:k]
        out.append((np.full(len(order), q_ids[i]), ids[pick][order], score[order]))
    return [np.concatenate(x) if out else np.zeros(0) for x in zip(*out)] if out else [np.zeros(0)] * 3


def search(table: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for every row whose id is divisible by ``every``.

    Nearness is the inner product in double precision, ties go to the smaller id.  Invalid vectors and null ids take no part;
    vectors of another length than the most common one of the sample neither; a query never finds rows of its own id; rows
    of one id and vector that are repeated are separate candidates; fewer candidates than ``k`` are all returned; an empty
    table gives no rows.  A leaf is split into blocks of at most about ``BLOCK_ROWS`` vectors by hash, so a vector that a
    third of the rows share costs no task more than others.
    """
    spark = table.sparkSession
    vectors = valid_vectors(table, id_col, vector_col)
    sample = hash_sample(vectors.withColumn("h", F.xxhash64("vec_id", "v")), "h", SAMPLE_ROWS).orderBy("h", "vec_id").select("v").toPandas()["v"]
    if not len(sample):
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    width = int(pd.Series([len(x) for x in sample]).mode()[0])
    tree = spark.sparkContext.broadcast(grow(matrix([x for x in sample if len(x) == width])))

    @F.pandas_udf("int")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(tree.value.file(matrix(v)), dtype="int32")

    filed = materialise(vectors.where(F.size("v") == width).withColumn("leaf", leaf_of("v")))
    queries = filed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    visits = calibrate(filed, queries, tree, k, recall)

    @F.pandas_udf("array<int>")
    def visited(q: pd.Series) -> pd.Series:
        return pd.Series([tree.value.leaves_in_order(np.asarray(x), visits) for x in q])

    found = compare(filed, queries.withColumn("leaf", F.explode(visited("q"))), k)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def compare(filed: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """The k best of each (query, leaf block) for visits (query_id, q, leaf)."""
    sizes = filed.groupBy("leaf").agg(F.count("*").alias("n"))
    blocks = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).select("leaf", "blocks")
    blocks = F.broadcast(materialise(blocks))  # a row per leaf, at most BRANCH ** LEVELS
    right = filed.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    left = visits.join(blocks, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def best(left, right):
        # queries come in slices, so no product is larger than a block by a block
        ids, V = right["vec_id"].to_numpy(), matrix(right["v"])
        parts = [best_of_block(matrix(x["q"]), x["query_id"].to_numpy(), V, ids, k) for x in (left.iloc[i : i + BLOCK_ROWS] for i in range(0, len(left) if len(ids) else 0, BLOCK_ROWS))]
        q, v, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0),) * 3
        return pd.DataFrame({"query_id": q.astype("int64"), "vec_id": v.astype("int64"), "score": s.astype("float64")})

    # queries of one block are dealt to several tasks as well, so that many queries that want one leaf do not meet in one
    deal = F.pmod(F.xxhash64("query_id"), F.lit(4)).cast("int")
    left = left.withColumn("deal", deal).select("leaf", "block", "deal", "query_id", "q")
    right = right.withColumn("deal", F.explode(F.array(*map(F.lit, range(4))))).select("leaf", "block", "deal", "vec_id", "v")
    keys = ["leaf", "block", "deal"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")


def calibrate(filed: DataFrame, queries: DataFrame, tree, k: int, recall: float) -> int:
    """The fewest visits with which the calibration queries find the share ``recall`` of their true neighbours.

    The true neighbours come from a pass over the whole table, whose rows meet the bounded query set as a broadcast.
    """
    some = hash_sample(queries.withColumn("h", F.xxhash64("query_id")), "h", CALIBRATION_ROWS).orderBy("h").toPandas()
    if not len(some):
        return 1
    held = filed.sparkSession.sparkContext.broadcast((matrix(some["q"]), some["query_id"].to_numpy()))

    def best(batches):
        q, q_ids = held.value
        for batch in batches:
            for i in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[i : i + BLOCK_ROWS]
                ids = part["vec_id"].to_numpy()
                a, b, s = best_of_block(q, q_ids, matrix(part["v"]), ids, k)
                leaf = pd.Series(part["leaf"].to_numpy(), index=ids)
                leaf = leaf[~leaf.index.duplicated()]
                yield pd.DataFrame({"query_id": a.astype("int64"), "vec_id": b.astype("int64"), "score": s, "leaf": leaf.reindex(b).to_numpy(dtype="int32")})

    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    truth = filed.mapInPandas(best, "query_id long, vec_id long, score double, leaf int").withColumn("rank", F.row_number().over(order))
    truth = truth.where(F.col("rank") <= k).select("query_id", "leaf").toPandas()
    wanted = truth.groupby("query_id")["leaf"].apply(list).to_dict()
    leaves = int((tree.value.leaf >= 0).sum())
    needed = np.zeros(leaves + 1, dtype=np.int64)
    for q, query in zip(some["q"], some["query_id"]):
        place = {leaf: i for i, leaf in enumerate(tree.value.leaves_in_order(np.asarray(q), leaves), 1)}
        for leaf in wanted.get(query, []):
            needed[place[leaf]] += 1
    reached = np.cumsum(needed)
    return max(1, int(np.searchsorted(reached, recall * reached[-1])))
