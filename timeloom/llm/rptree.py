"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Every tree splits by random directions; a vector close to a split goes to both
sides, so a close pair is parted only if it straddles the whole spill band.
Pairs within a leaf are compared exactly, and a pair that shares several leaves
counts in the first of them alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialise

TREES = 6
#: Trees are fitted on the vectors with the smallest hashes, so many at most.
SAMPLE = 20_000
LEAF = 800
BLOCK = 1024
#: Vectors of one leaf and block are compared in tiles of so many rows.
TILE = 512


@dataclass
class Tree:
    """Nodes in arrays: direction and border of inner ones, -1 - leaf as child."""

    directions: list = field(default_factory=list)
    borders: list = field(default_factory=list)
    children: list = field(default_factory=list)
    leaves: int = 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tame(x: np.ndarray) -> np.ndarray:
    """Divided by the largest component, so that no square over- or underflows."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def grow(sample: np.ndarray, least: int, spill: float, rng: np.random.Generator) -> Tree:
    """A tree over unit vectors: of a few random directions and quantiles the one
    that puts the fewest vectors into the spill band; a node is a leaf when it is
    small or when no split makes both sides clearly smaller."""
    tree = Tree()

    def build(rows: np.ndarray) -> int:
        if len(rows) > least:
            best = None
            for _ in range(6):
                d = rng.standard_normal(sample.shape[1])
                d /= np.linalg.norm(d)
                p = sample[rows] @ d
                for q in (0.35, 0.5, 0.65):
                    border = float(np.quantile(p, q))
                    larger = max((p <= border + spill).sum(), (p >= border - spill).sum())
                    if best is None or larger < best[0]:
                        best = (larger, d, border, p)
            larger, d, border, p = best
            if larger <= 0.85 * len(rows):
                node = len(tree.children)
                tree.directions.append(d)
                tree.borders.append(border)
                tree.children.append(None)
                tree.children[node] = (build(rows[p <= border + spill]), build(rows[p >= border - spill]))
                return node
        tree.leaves += 1
        return -tree.leaves

    tree.root = build(np.arange(len(sample)))
    return tree


def leaves_of(tree: Tree, x: np.ndarray, spill: float) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows of ``x`` in it) for unit vectors ``x``."""
    out, stack = [], [(tree.root, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if node < 0:
            out.append((-node - 1, rows))
            continue
        p = x[rows] @ tree.directions[node]
        left, right = tree.children[node]
        stack.append((left, rows[p <= tree.borders[node] + spill]))
        stack.append((right, rows[p >= tree.borders[node] - spill]))
    return out


def spill_of(cosine: float, dimensions: int) -> float:
    """Half the typical distance along a random direction of two unit vectors at
    the threshold: one standard deviation either way."""
    return math.sqrt(2 - 2 * cosine) / math.sqrt(dimensions) / 2


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and the vector as bytes of doubles; null where it links with nothing."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            ok = v and None not in v
            x = np.asarray(v, np.float64) if ok else None
            ok = ok and np.isfinite(x).all() and x.any()
            out.append((x + 0.0).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])


def _place(forest, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and leaf, with all leaves of the vector."""
    trees, spill, first, lone = forest.value
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            raw = part.column("v").to_pylist()
            lists: list[list[int]] = [[] for _ in raw]
            by: dict[int, list[int]] = {}
            for k, r in enumerate(raw):
                by.setdefault(len(r) // 8, []).append(k)
            for d, ks in by.items():
                if d not in trees:
                    for k in ks:
                        lists[k].append(lone + d)
                    continue
                x = _unit(_tame(np.frombuffer(b"".join(raw[k] for k in ks), np.float64).reshape(len(ks), d)))
                for tree, base in zip(trees[d], first[d]):
                    for leaf, rows in leaves_of(tree, x, spill[d]):
                        for r in rows:
                            lists[ks[r]].append(base + leaf)
            ids = part.column("id").to_pylist()
            n = [len(x) for x in lists]
            every = [sorted(x) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x for e in every for x in e], pa.int32()),
                    pa.array(np.repeat(ids, n), pa.int64()),
                    pa.array(np.repeat(part.column("copies").to_numpy(), n), pa.int64()),
                    pa.array([r for r, k in zip(raw, n) for _ in range(k)], pa.binary()),
                    pa.array([e for e, k in zip(every, n) for _ in range(k)], pa.list_(pa.int32())),
                ],
                ["leaf", "id", "copies", "v", "leaves"],
            )


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low


def _compare(cosine: float):
    """Links within one leaf and block pair that no earlier leaf has: for each
    vector, how many rows it links with here, and the smallest of its component here."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        leaf, p, q = int(rows.leaf.iloc[0]), int(rows.p.iloc[0]), int(rows.q.iloc[0])
        rows = rows.sort_values("id")
        x = np.frombuffer(b"".join(rows.v), np.float64).reshape(len(rows), -1)
        x = _unit(_tame(x))
        ids, copies, block = rows.id.to_numpy(), rows.copies.to_numpy(), rows.block.to_numpy()
        width = max(map(len, rows.leaves))
        every = np.full((len(rows), width), -1, np.int32)
        for k, e in enumerate(rows.leaves):
            every[k, : len(e)] = e
        links, pairs = np.zeros(len(rows), np.int64), []
        for i in range(0, len(rows), TILE):
            for j in range(i, len(rows), TILE):
                a, b = np.nonzero(x[i : i + TILE] @ x[j : j + TILE].T >= cosine)
                a, b = a + i, b + j
                keep = (a < b) & ((block[a] != block[b]) if p != q else True)
                a, b = a[keep], b[keep]
                pairs.append((a, b))
                if width > 1 and len(a):
                    here = np.ones(len(a), bool)
                    for k in range(width):  # an earlier leaf that both have
                        e = every[a, k]
                        look = np.flatnonzero(here & (e >= 0) & (e < leaf))
                        if len(look):
                            here[look] = ~(every[b[look]] == e[look, None]).any(1)
                    a, b = a[here], b[here]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
        low = _smallest(len(rows), np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))
        out = pd.DataFrame({"id": ids, "links": links, "to": ids[low]})
        return out[(out.links > 0) | (out.to != out.id)]

    return work


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, trees: int = TREES, seed: int = 23) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of ``vectors``.

    Two vectors are linked when a tree puts them into one leaf and their cosine,
    in double precision, is ``cosine`` or more.  Null or zero vectors and such
    with null or non-finite components link with nothing; vectors of different
    lengths don't link.  Equal vectors are one node from the start, whose copies
    count as links of each other, so a vector with very many copies costs no
    more than one.  Repeated rows of one id are one vector and stay as rows;
    should an id come with several vectors, it has the links of all and joins
    their components.  A null id links with nothing; its component and kept are
    null.

    Trees are fitted on at most ``SAMPLE`` vectors (smallest hashes); every vector
    is placed.  A leaf of any size is compared whole: more than ``BLOCK`` rows are
    dealt into blocks, and each pair of blocks is a task.
    """
    spark = vectors.sparkSession
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    clean = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .filter("vec_id is not null")
        .mapInArrow(_clean, "vec_id long, v binary")
        .distinct()
    )
    clean = materialise(clean, "vectors")
    nodes = clean.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    # a node is its smallest id, or a hash of the vector where an id has several
    several = clean.filter("v is not null").groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id")
    nodes = nodes.join(several.withColumnRenamed("vec_id", "id").withColumn("many", F.lit(True)), "id", "left")
    nodes = materialise(nodes.select("v", F.when(F.col("many"), F.xxhash64("v")).otherwise(F.col("id")).alias("id"), "copies"), "nodes")
    # bounded by SAMPLE, whatever the size of the table
    picked = [r["v"] for r in nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    total = nodes.count()
    forests, first, spills, at = {}, {}, {}, 0
    by: dict[int, list[bytes]] = {}
    for r in picked:
        by.setdefault(len(r) // 8, []).append(r)
    for d in sorted(by):
        x = _unit(_tame(np.frombuffer(b"".join(by[d]), np.float64).reshape(-1, d)))
        spills[d] = spill_of(cosine, d)
        least = max(24, int(LEAF * len(picked) / max(1, total)))
        forests[d], first[d] = [], []
        for t in range(trees):
            tree = grow(x, least, spills[d], np.random.default_rng((seed, d, t)))
            forests[d].append(tree)
            first[d].append(at)
            at += tree.leaves
    # vectors of a length that the sample hasn't are a leaf of their own, dealt into blocks like any
    sent = spark.sparkContext.broadcast((forests, spills, first, at))
    placed = materialise(
        nodes.mapInArrow(lambda it, f=sent: _place(f, it), "leaf int, id long, copies long, v binary, leaves array<int>"), "leaves"
    )
    # one row per leaf of the bounded forest
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("nb"))
    dealt = (
        placed.join(sizes, "leaf")
        .withColumn("block", F.expr("cast(pmod(xxhash64(id), nb) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        .select("leaf", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "copies", "v", "leaves")
    )
    found = materialise(dealt.groupBy("leaf", "p", "q").applyInPandas(_compare(cosine), "id long, links long, to long"), "found")
    # an id with several vectors is a link between them
    placed_ids = clean.join(several, "vec_id", "left_semi").join(nodes.select("v", "id"), "v").select("vec_id", "id")
    hubs = placed_ids.join(placed_ids.groupBy("vec_id").agg(F.min("id").alias("low")), "vec_id").select(F.col("id").alias("a"), F.col("low").alias("b"))
    comps = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")).union(hubs))
    discard(placed)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_node = (
        nodes.join(links, "id", "left")
        .join(comps, F.col("id") == F.col("node"), "left")
        .select("v", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    )
    per_id = clean.join(per_node, "v", "left").groupBy("vec_id").agg(
        F.sum(F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), F.min("component").alias("component")
    )
    # a component is its smallest id, where a hash came before that
    hashed = placed_ids.join(comps, F.col("id") == F.col("node"), "left").select(F.coalesce("component", "id").alias("component")).distinct()
    low = per_id.join(hashed, "component", "left_semi").groupBy("component").agg(F.min("vec_id").alias("low"))
    rows = ids.join(per_id.join(low, "component", "left"), "vec_id", "left")
    component = F.coalesce("low", "component", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
