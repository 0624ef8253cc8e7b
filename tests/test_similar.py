"""Similar frames in blocks, against each pair by itself."""

import numpy as np
import pytest

from timeloom import plans
from timeloom.functions import pixels as px
from timeloom.operators import similarity as si

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def grids(spark):
    """900 grids of many colours, whose bands are often equal."""
    rng = np.random.default_rng(3)
    out = []
    for f in range(900):
        bucket = [int(x) for x in (rng.integers(0, 32, 3) if f % 3 else rng.integers(13, 19, 3))]
        hashes = [int(sum(int(x) << 16 * k for k, x in enumerate(rng.integers(0, 60, 4)))) for _ in range(2)]
        out.append((f, *hashes, bucket[0] | bucket[1] << 5 | bucket[2] << 10, bytes(rng.integers(100, 130, 64).astype(np.uint8))))
    return spark.createDataFrame(out, "frame_id long, average_hash long, difference_hash long, bucket int, luma binary").cache()


@pytest.fixture(scope="module")
def scored(grids):
    """Of pairs joined one by one, from the keys."""
    luma = {r.frame_id: np.frombuffer(r.luma, np.uint8).astype(int) for r in grids.collect()}
    pairs = rows(si.candidates(grids, grids.filter("frame_id % 10 = 0")).select("target", "frame_id"))
    return {(t, f): int(px.basis_points(np.abs(luma[t] - luma[f]).sum(), 64)) for f, t in pairs}


def scored_in_blocks(grids, targets):
    return si.luma_near(grids, targets).union(si.luma_pairs(si.by_band(grids, targets), grids))


def test_large_cells_are_cut_into_rows(grids):
    got = si.blocks(grids, "luma", 0, 7).collect()
    ids = [np.frombuffer(r.ids, np.int64) for r in got]
    assert max(map(len, ids)) == 7 and sorted(np.concatenate(ids)) == list(range(900))
    assert all(len(r.data) == 64 * len(x) and len(r.buckets) == 4 * len(x) for r, x in zip(got, ids))


def test_pairs_in_blocks(grids, scored):
    got = rows(scored_in_blocks(grids, grids.filter("frame_id % 10 = 0")))
    assert got == sorted((f, s, t) for (t, f), s in scored.items())


def test_best_in_blocks(grids, scored, spark):
    t = grids.filter("frame_id % 10 = 0")
    far = si.luma_pairs(si.by_band(grids, t), grids)
    pairs = spark.createDataFrame([(t, f, s) for (t, f), s in scored.items()], "target long, frame_id long, similarity long")
    for least, cap in ((9600, 3), (0, 200)):
        got = si.top_of_parts(si.best_near(grids, t, "luma", si.scan_luma, least, cap), far, least, cap)
        assert rows(got) == rows(si.top(pairs, least, cap))


def test_counts_in_blocks(grids, scored):
    t = grids.filter("frame_id % 10 = 0")
    got = {r.similarity: r.n for r in si.luma_counts(grids, t).groupBy("similarity").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    for r in si.luma_pairs(si.by_band(grids, t), grids).collect():
        got[r.similarity] = got.get(r.similarity, 0) + 1
    want = list(scored.values())
    assert got == {s: want.count(s) for s in set(want)}


def pictures(n, colours, seed=5):
    rng = np.random.default_rng(seed)
    v = rng.normal(127, 16, (n, 8, 8, colours)).clip(0, 255).astype(np.uint8)
    v = np.repeat(v, 3, 3) if colours == 1 else v
    v[1::7] = np.roll(v[::7][: len(v[1::7])], 1, 1)
    v[2::9] = v[::9][: len(v[2::9])] + np.uint8(20)
    return v


@pytest.mark.parametrize("colours", [1, 3])
def test_described_and_likeness_above(colours):
    v = pictures(140, colours)
    average, difference, d = px.described(v)
    assert [(a, b, x.tobytes()) for a, b, x in zip(average, difference, d)] == [(px.average_hash(x), px.difference_hash(x), px.descriptor(x)) for x in v]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(140), indexing="ij"))
    want = px.confirm(d[i], d[j]).reshape(60, 140)
    x = d[..., :colours]
    floor, every = np.sort(want, 1)[:, -9], np.ones((60, 140), bool)
    got = px.likeness_above(px.Views(x), slice(0, 60), px.Views(x), [(every, floor)])
    hit = want >= floor[:, None]
    assert (got[hit] == want[hit]).all() and (got < floor[:, None])[~hit].all()


def test_pictures_in_blocks(spark):
    v = np.concatenate([pictures(400, 1), pictures(300, 3, 6)])
    v[::11] = v[::11] // 2 + 60  # other colours
    flat = [(k, 8, 8, 32, np.concatenate([x, np.full((8, 8, 1), 255, np.uint8)], 2).tobytes()) for k, x in enumerate(v)]
    d = si.with_bucket(si.describe(spark.createDataFrame(flat, "frame_id long, width int, height int, stride int, pixels binary"))).cache()
    t = d.filter("frame_id % 25 = 0")
    likeness = si.confirm(si.candidates(d, t), d).cache()
    for least, cap in ((9300, 64), (9550, 5), (9700, 64)):
        assert rows(si.similar_frames(d, t, least, cap)) == rows(si.top(likeness, least, cap))


@pytest.mark.parametrize("name", ["g10_luma_similarity", "t1_top_similar", "a6_candidate_counts", "a5_score_histogram", "j15_similar_frames"])
def test_no_row_for_a_colour_key_of_a_pair(spark, name):
    """Pairs near in colour are scored in blocks, not joined and made distinct one by one."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "kind" not in plan and "cell" in plan
