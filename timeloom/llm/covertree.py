"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and data are each indexed by a cover tree.  Pairs of nodes are visited
best bound first; a pair is pruned when no product of a vector below one with a
vector below the other can reach the worst k-th score of the query node's group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

DATA_BLOCK = 8192
QUERY_BLOCK = 4096
LEAF = 128
#: Query groups are smaller, for their worst k-th scores to be close to each one's.
QUERY_LEAF = 8
#: A node whose net has more centres keeps what these don't cover as one leaf;
#: its radius is measured, so bounds and results stay exact.
FAN_OUT = 48
#: Vectors of a leaf that are compared at once.
TOGETHER = 512


@dataclass
class Node:
    centre: np.ndarray
    length: float
    radius: float
    rows: np.ndarray
    children: list


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree with base 2: children lie within 2**(level - 1) of their
    centres, the centres are further apart than that, and a node's own centre is
    the first of its children's."""

    squares = np.einsum("ij,ij->i", x, x)

    def distances(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        # of whole numbers, so exact before the root
        return np.sqrt(np.maximum(squares[rows] + c @ c - 2 * (x[rows] @ c), 0))

    def make(rows: np.ndarray, centre: np.ndarray, far: np.ndarray, level: int) -> Node:
        radius = float(far.max())
        node = Node(centre, float(np.sqrt(centre @ centre)), radius, rows, [])
        if len(rows) <= leaf or radius == 0:
            return node
        while 2.0 ** (level - 1) >= radius:
            level -= 1
        scale = 2.0 ** (level - 1)
        left, c, d = rows, centre, far
        while len(left):
            if len(node.children) == FAN_OUT:
                node.children.append(Node(centre, node.length, float(distances(left, centre).max()), left, []))
                break
            near = d <= scale
            if near.any():
                node.children.append(make(left[near], c, d[near], level - 1))
            left = left[~near]
            if len(left):
                c = x[left[0]]
                d = distances(left, c)
        return node

    rows = np.arange(len(x))
    far = distances(rows, x[0])
    top = float(far.max())
    return make(rows, x[0], far, int(np.ceil(np.log2(top))) + 1 if top > 0 else 0)


@dataclass
class Work:
    """Products that a search computed, of how many."""

    computed: int = 0
    every: int = 0


def exact_search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`dual_search`, in whole numbers of any size: for components whose
    sums of products aren't exact in doubles."""
    rows, ids, scores = [], [], []
    whole = np.array([[int(c) for c in v] for v in x], object).reshape(x.shape)
    for i, v in enumerate(q):
        s = whole @ np.array([int(c) for c in v], object)
        best = heapq.nsmallest(k, ((-int(s[j]), int(x_ids[j])) for j in range(len(x)) if x_ids[j] != q_ids[i]))
        if any(abs(b) >= 1 << 63 for b, _ in best):
            raise OverflowError("a score doesn't fit into 64 bits")
        rows += [i] * len(best)
        ids += [b for _, b in best]
        scores += [-b for b, _ in best]
    return np.array(rows, np.int64), np.array(ids, np.int64), np.array(scores, np.int64)


def dual_search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, work: Work | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, vector ids, scores): the ``k`` best vectors of another id for
    each query, equal scores by the smaller id."""
    # squared distances are sums of up to four such products
    if len(q) and len(x) and 4 * max(float(np.abs(q).max()), float(np.abs(x).max())) ** 2 * x.shape[1] >= 2.0**53:
        return exact_search(q, q_ids, x, x_ids, k)
    work = work or Work()
    work.every += len(q) * len(x)
    qt, xt = cover_tree(q, QUERY_LEAF), cover_tree(x)
    top = np.full((len(q), k), -np.inf)
    top_id = np.full((len(q), k), np.iinfo(np.int64).max)
    worst = top[:, -1]

    def bound(a: Node, b: Node) -> float:
        s = float(a.centre @ b.centre) + a.radius * b.length + b.radius * a.length + a.radius * b.radius
        return s + abs(s) * 1e-9 + 1e-6

    def compare(a: Node, b: Node) -> None:
        for i in range(0, len(b.rows), TOGETHER):
            some(a.rows, b.rows[i : i + TOGETHER])

    def some(asked: np.ndarray, met: np.ndarray) -> None:
        s = q[asked] @ x[met].T
        work.computed += s.size
        s[q_ids[asked][:, None] == x_ids[met][None, :]] = -np.inf
        least = worst[asked]
        # a query that has fewer than k takes this many best of here, and their equals
        new = np.flatnonzero(np.isinf(least))
        if len(new) and s.shape[1] > k:
            least[new] = np.partition(s[new], -k, 1)[:, -k]
        i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        again = (s[i, j] > worst[asked[i]]) | (x_ids[met[j]] < top_id[asked[i], -1])
        i, j = i[again], j[again]
        if not len(i):
            return
        touched = np.unique(i)
        rows = np.concatenate([i, np.repeat(touched, k)])
        scores = np.concatenate([s[i, j], top[asked[touched]].ravel()])
        ids = np.concatenate([x_ids[met[j]], top_id[asked[touched]].ravel()])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        take = starts[:, None] + np.arange(k)
        at = asked[rows[starts]]
        top[at], top_id[at] = scores[take], ids[take]

    heap: list = [(-bound(qt, xt), 0, qt, xt)]
    n = 0
    while heap:
        b, _, a, d = heapq.heappop(heap)
        if -b < worst[a.rows].min():
            continue
        if not a.children and not d.children:
            compare(a, d)
            continue
        split_query = a.children and (not d.children or a.radius > d.radius)
        for u, v in [(c, d) for c in a.children] if split_query else [(a, c) for c in d.children]:
            if (s := bound(u, v)) >= worst[u.rows].min():
                heapq.heappush(heap, (-s, n := n + 1, u, v))
    rows, place = np.nonzero(np.isfinite(top))
    return rows, top_id[rows, place], top[rows, place]


def _scaled(scale: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and floor(scale * component) as bytes of doubles; null where the
    vector takes no part."""
    for batch in batches:
        lists = batch.column("embedding")
        # nulls in the flat values become NaN
        v = np.floor(scale * pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
        ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)]).astype(np.int64))
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(v))])[ends]
        takes = (np.diff(bad) == 0) & pc.is_valid(lists).to_numpy(zero_copy_only=False)
        raw, ends = v.tobytes(), (8 * ends).tolist()
        out = [raw[a:b] if t else None for t, a, b in zip(takes.tolist(), ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])


def _search(k: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows.v), np.float64).reshape(len(rows), -1)
        is_query, ids = rows.is_query.to_numpy(), rows.vec_id.to_numpy()
        if not is_query.any() or is_query.all() or not x.shape[1]:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q_ids = ids[is_query]
        at, found, score = dual_search(x[is_query], q_ids, x[~is_query], ids[~is_query], k)
        return pd.DataFrame({"query_id": q_ids[at], "vec_id": found, "score": score.astype(np.int64)})

    return work


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which the column
    ``is_query`` holds, the ``k`` largest inner products of floor(scale * x) with
    the rows of other ids, equal ones by the smaller id; all, if there are fewer.

    Null vectors, and such with null or non-finite components, take no part;
    vectors of different lengths don't meet; an empty vector meets nothing;
    repeated rows are one.  Scores are exact: where sums of products might not be
    so in doubles, whole numbers are compared, and a score beyond 64 bits fails.

    Queries are dealt into blocks of about ``QUERY_BLOCK`` and data into blocks of
    about ``DATA_BLOCK`` rows by the hash of the id; each pair of blocks is a task
    with two trees, which hands on at most ``k`` rows a query.
    """
    clean = materialise(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .filter("vec_id is not null")
        .mapInArrow(lambda it, s=scale: _scaled(s, it), "vec_id long, v binary")
        .filter("v is not null")
        .distinct()
        .withColumn("n", F.length("v"))
        .withColumn("asks", is_query),
        "vectors",
    )
    counts = clean.agg(F.count("*").alias("all"), F.count_if("asks").alias("asks")).first()
    nx, nq = (max(1, -(-a // b)) for a, b in ((counts["all"], DATA_BLOCK), (counts["asks"], QUERY_BLOCK)))
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    data = clean.select("n", "vec_id", "v", F.lit(False).alias("is_query"), deal(nx).alias("xb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    asked = clean.filter("asks").select("n", "vec_id", "v", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("xb"), deal(nq).alias("qb"))
    found = data.union(asked).groupBy("n", "xb", "qb").applyInPandas(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
