"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Documents with one shingle set are one node from the start.  The signatures of
the sets are banded; what shares a band is a candidate.  A candidate pair's
signatures are compared batch by batch: after each batch it is dropped if the
posterior probability that its similarity reaches the threshold has fallen
below a chosen miss probability.  What survives is verified exactly, on the full
sets.

No bucket is expanded into all its pairs.  First each member meets the smallest
member of its bucket; the links found so far make components.  Only buckets
that still hold several components are looked at again, in blocks of members:
signature matrices are compared, and what survives is verified there and then,
the most alike first, until two components are linked or no pair is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialise, slices, text_or_empty

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
BATCH = 25
#: A pair is dropped when its similarity reaches the threshold with no more than
#: this probability, given the hashes seen.
MISS = 1e-6
BLOCK = 512
#: An open bucket of so few members is expanded at once.
SMALL = 16
#: Bits of the filter that keeps the texts of other ids than the candidates' from
#: being shuffled: 8 MB, whatever the number of ids.  Where the filter is full,
#: more texts are shuffled; the join after it is exact.
FILTER_BITS = 1 << 26
_PAGE = 1 << 15
#: So many pairs of one member are checked exactly at a time.
CHECKED = 64
PIECE = 1 << 22

_RNG = np.random.default_rng(1905)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xD1342543DE82EF95)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xDABA0B6EB09322E3)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _STEP, np.uint64), dtype=np.uint64)


_POWERS = _powers(1 << 12)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words, runs of bytes other than white space, with A-Z
    in lower case.  Worked on in pieces cut at white space."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        while end < n and not _GAP[data[end]]:
            end += 1
        b = _LOWER[np.frombuffer(data, np.uint8, end - at, at)]
        gap = _GAP[b]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            first = starts[0]
            inside = np.arange(first, len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
            longest = int((ends - starts).max())
            power = _POWERS if longest <= len(_POWERS) else _powers(longest)
            inside = np.minimum(inside, len(power) - 1)
            h = np.where(gap[first:], np.uint64(0), _BYTE[b[first:]] * power[inside])
            out.append(_mix(np.add.reduceat(h, starts - first) + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words; of the
    whole sequence where a text has fewer; none without words."""
    w = word_hashes(text.encode("utf-8", "replace"))
    if not len(w):
        return w
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, np.uint64(size if size < words else 0))
    for k in range(size):
        h = _mix(h * _STEP + w[k : k + len(h)])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of ``HASHES`` hash functions, 32 bits of each."""
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096]
        h = x[:, None] * _A + _B
        np.minimum(out, (h ^ (h >> np.uint64(31))).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def posterior_bounds(threshold: float, miss: float = MISS) -> list[int]:
    """For each batch, the fewest agreeing hashes a pair may have to stay: with
    fewer, P(similarity >= threshold) <= ``miss`` under a uniform prior."""
    grid = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() > miss:
                out.append(m)
                break
    return out


def survivors(a: np.ndarray, b: np.ndarray, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of signature rows that stay, and how many hashes agree."""
    live = np.arange(len(a))
    agree = np.zeros(len(a), np.int16)
    for k, least in enumerate(bounds):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        agree[live] += (a[live, cut] == b[live, cut]).sum(1).astype(np.int16)
        live = live[agree[live] >= least]
    return live, agree[live]


SKETCH = "doc_id long, n_shingles long, digest binary, signature binary"


def _sketch(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, digests, signatures = [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py(), words)
            n.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            signatures.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
            ["doc_id", "n_shingles", "digest", "signature"],
        )


def _sets(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: the sets are as large as the texts."""
    for batch in slices(batches):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in part.column("text")]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "shingles"])


def _prune(bounds: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequential verification of the pairs' signatures."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
            keep, _ = survivors(a, b, bounds)
            yield part.select(["a", "b"]).take(pa.array(keep))


def _block_links(bounds: list[int], percent: int):
    """Links between different components among the members of one block pair of a
    bucket.  Signatures are compared first; of what stays, the most alike go first
    into the exact check, and a component that is linked is one with the other
    from then on, so that a link is passed on for each merger alone."""
    none = pd.DataFrame({"a": [], "b": []}).astype("int64")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (rows[rows.side == k] for k in (0, 1))
        same = bool(rows.same.iloc[0])
        if same:
            y = x
        if not len(x) or not len(y):
            return none
        ix, iy, rx = x.id.to_numpy(), y.id.to_numpy(), x.comp.to_numpy().copy()
        ry = rx if same else y.comp.to_numpy().copy()
        sx, sy = (np.frombuffer(b"".join(r.signature), np.uint32).reshape(-1, HASHES) for r in (x, y))
        tx = [np.sort(v) for v in x.shingles]
        ty = tx if same else [np.sort(v) for v in y.shingles]
        out = []
        for k in range(len(ix)):
            other = np.flatnonzero((ry != rx[k]) & ((iy > ix[k]) if same else True))
            if not len(other):
                continue
            keep, agree = survivors(np.broadcast_to(sx[k], (len(other), HASHES)), sy[other], bounds)
            left = other[keep[np.argsort(-agree, kind="stable")]]
            while len(left):
                now = left[:CHECKED]
                sizes = np.array([len(ty[j]) for j in now])
                joined = np.concatenate([ty[j] for j in now])
                at = np.minimum(np.searchsorted(tx[k], joined), len(tx[k]) - 1)
                common = np.add.reduceat((tx[k][at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                for j in now[100 * common >= percent * (len(tx[k]) + sizes - common)]:
                    if ry[j] != rx[k]:
                        out.append((min(ix[k], iy[j]), max(ix[k], iy[j])))
                        old, new = ry[j], rx[k]
                        rx[rx == old] = new
                        ry[ry == old] = new
                left = left[CHECKED:]
                left = left[ry[left] != rx[k]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64") if out else none

    return work


def _bit(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def filter_of(ids: DataFrame) -> DataFrame:
    """The pages of a bit map of the hashes of ``id``, 4 KB each and
    ``FILTER_BITS / 8`` bytes altogether at most."""
    return ids.select((_bit("id") / _PAGE).cast("int").alias("__page"), (_bit("id") % _PAGE).alias("at")).groupBy("__page").agg(F.expr("bitmap_construct_agg(at)").alias("__bits"))


def perhaps_in(rows: DataFrame, key: str, pages: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among the ids of the bit map, no other missing."""
    at = _bit(key) % _PAGE
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(b, p) & 1 = 1")
    kept = rows.join(F.broadcast(pages), (_bit(key) / _PAGE).cast("int") == F.col("__page"))
    return kept.withColumns({"b": byte, "p": (at % 8).cast("int")}).filter(hit).select(*rows.columns)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked when 100 * |intersection| >= percent * |union| of their
    sets of shingles of ``shingle_words`` words; the component is the smallest
    id that links reach.  A null, empty or blank text has an empty set and links
    with nothing; a null id is never linked and is its own (null) component with
    kept null; repeated rows with one id and text are one document and stay as
    rows.  A pair at the threshold shares no band with probability
    (1 - 0.8**5)**25 = 5e-5, and is dropped unverified with ``MISS`` per batch.
    Shingles are compared as 64-bit hashes.
    """
    bounds = posterior_bounds(percent / 100)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    sketch = materialise(rows.mapInArrow(lambda it, w=shingle_words: _sketch(w, it), SKETCH), "sketch")
    classes = materialise(
        sketch.filter("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "signature")).alias("m"))
        .select("digest", F.col("m.doc_id").alias("id"), F.col("m.signature").alias("signature")),
        "classes",
    )
    bands = classes.select(
        "id",
        F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(signature, b * {4 * ROWS} + 1, {4 * ROWS})))")).alias("band"),
    )
    full = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("pivot"), F.max("id").alias("last"), F.sum(F.expr("cast(xxhash64(id) as decimal(38,0))")).alias("mark")).filter("n > 1")
    # buckets with the same members are one
    full = full.groupBy("n", "pivot", "last", "mark").agg(F.min("band").alias("band"))
    members = materialise(bands.join(full.select("band", "n", "pivot"), "band"), "members")
    wanted = materialise(members.select("id").distinct(), "wanted")
    # the texts of candidates are needed again; the exact join moves what the filter lets by
    among = wanted.hint("merge")
    sets = materialise(
        perhaps_in(rows, "doc_id", filter_of(wanted)).join(among, F.col("doc_id") == F.col("id"), "left_semi")
        .select(F.col("doc_id").alias("id"), "text")
        .mapInArrow(lambda it, w=shingle_words: _sets(w, it), "id long, shingles array<long>"),
        "sets",
    )
    marks = materialise(classes.select("id", "signature").join(among, "id", "left_semi"), "marks")

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are linked."""
        both = pairs.join(marks.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(
            marks.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b"
        )
        left = both.select("a", "b", "sa", "sb").mapInArrow(lambda it, k=bounds: _prune(k, it), "a long, b long")
        sized = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
        )
        sized = sized.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("ni"))
        return sized.filter(F.col("ni") * 100 >= percent * (F.col("nx") + F.col("ny") - F.col("ni"))).select("a", "b").distinct()

    tested = materialise(members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = materialise(verify(tested), "links")
    comps = components(links)
    open_members = members.filter("n > 2").join(comps, members.id == comps.node, "left").select("band", "id", F.coalesce("component", "id").alias("comp"))
    # the largest component of a bucket meets the other members alone, not itself
    open_bands = (
        open_members.groupBy("band", "comp")
        .agg(F.count("*").alias("c"))
        .groupBy("band")
        .agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"))
        .filter("n > top.c")
    )
    still = materialise(open_members.join(open_bands, "band"), "open")
    few = (
        still.filter(F.col("n") <= SMALL)
        .groupBy("band")
        .agg(F.collect_list(F.struct("id", "comp")).alias("m"))
        .select(F.explode(F.expr("flatten(transform(m, x -> transform(filter(m, y -> y.id > x.id and y.comp <> x.comp), y -> struct(x.id as a, y.id as b))))")).alias("p"))
        .select("p.a", "p.b")
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    dealt = (
        still.filter(F.col("n") > SMALL)
        .select("band", "id", "comp", F.col("top.comp").alias("main"), F.expr(f"cast(ceil(top.c / {BLOCK}) as int)").alias("nm"), F.expr(f"cast(ceil((n - top.c) / {BLOCK}) as int)").alias("ns"))
        .join(marks, "id")
        .join(sets.dropDuplicates(["id"]), "id")
        .withColumn("j", F.expr("cast(pmod(xxhash64(id), if(comp = main, nm, ns)) as int)"))
        .withColumn(
            "to",
            F.explode(
                F.expr(
                    """if(comp = main,
                    transform(sequence(0, ns - 1), k -> struct(0 as kind, j as p, k as q, 0 as side)),
                    concat(transform(sequence(0, nm - 1), k -> struct(0 as kind, k as p, j as q, 1 as side)),
                           transform(sequence(0, ns - 1), k -> struct(1 as kind, least(j, k) as p, greatest(j, k) as q, if(j > k, 1, 0) as side))))"""
                )
            ),
        )
        .select("band", "id", "comp", "signature", "shingles", "to.kind", "to.p", "to.q", "to.side", F.expr("to.kind = 1 and to.p = to.q").alias("same"))
    )
    found = dealt.groupBy("band", "kind", "p", "q").applyInPandas(_block_links(bounds, percent), "a long, b long")
    # each pair of members of different components has been looked at now
    comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(verify(few)).union(found))
    for df in (members, wanted, sets, marks, tested, links, still):
        discard(df)
    ids = classes.select("digest", "id").join(comps, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(ids, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
