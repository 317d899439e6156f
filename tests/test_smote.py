"""SMP6: exact neighbours against brute force; pruning is counted; synthetic points on their segments."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import neighbours as NB
from riskframe.operators import smote as SM
from riskframe.plans.tables import Tables
from riskframe.plans.train import embedding_matrix
from tests.conftest import SF_CHECK


def brute(ids, x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, d[n]))[:k]] for n, i in enumerate(ids)}


def found(result):
    out = {}
    for r in result.rows.collect():
        out.setdefault(r["id"], {})[r["position"]] = r["neighbour"]
    return {i: [v[p] for p in sorted(v)] for i, v in out.items()}


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id long, x array<double>")


@pytest.mark.parametrize("cell", [2_048, 40])
def test_nearest_on_embeddings(spark, cell):
    data, feats = embedding_matrix(Tables(spark, SF_CHECK))
    pts = SM.points_of(data, "vec_id", feats)
    rows = pts.collect()
    want = brute(np.array([r.id for r in rows]), np.array([r.x for r in rows]), 5)
    assert found(NB.nearest(pts, "id", "x", 5, cell)) == want


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 20
    x = np.concatenate([c + rng.normal(size=(60, 16)) for c in centres])
    ids = rng.permutation(len(x)) * 7 + 1
    got = NB.nearest(frame(spark, ids, x), "id", "x", 4, 60)
    assert found(got) == brute(ids, x, 4)
    assert got.pairs < 0.15 * got.points ** 2


def test_ties_and_equal_points(spark):
    """A third of all points are one point: its distances cannot be cut into shells, parts by hash keep cells small."""
    x = np.concatenate([np.zeros((120, 3)), np.arange(240 * 3).reshape(240, 3) % 11.0])
    ids = np.arange(360) * 3 + 5
    assert found(NB.nearest(frame(spark, ids, x), "id", "x", 3, 25)) == brute(ids, x, 3)


def test_small_inputs(spark):
    one = frame(spark, [4], np.zeros((1, 2)))
    assert NB.nearest(one, "id", "x", 3).rows.count() == 0
    two = frame(spark, [4, 9], np.array([[0.0, 1.0], [2.0, 3.0]]))
    assert found(NB.nearest(two, "id", "x", 3)) == {4: [9], 9: [4]}


def test_numbers_follow_the_order(spark):
    data, feats = embedding_matrix(Tables(spark, SF_CHECK))
    rows = SM.numbered(SM.points_of(data, "vec_id", feats).select("id"), "id").collect()
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] == sorted(r.id for r in rows)
    assert sorted(r["rank"] for r in rows) == list(range(len(rows)))


def test_smote_rows_are_where_they_should_be(spark):
    data, feats = embedding_matrix(Tables(spark, SF_CHECK))
    feats = feats[:8]
    out = SM.smote(data, "y", "vec_id", feats, ratio=0.5, k=5, cell=10).collect()
    base = {r.vec_id: r for r in data.collect()}
    assert {r.vec_id for r in out if not r.synthetic} == set(base)
    assert all(r[f] == base[r.vec_id][f] for r in out if not r.synthetic for f in feats)
    small = sorted(i for i, r in base.items() if r.y == 1)
    x = {i: np.array([base[i][f] for f in feats]) for i in small}
    near = brute(np.array(small), np.array([x[i] for i in small]), 5)
    made = [r for r in out if r.synthetic]
    assert sorted(r.synthetic_no for r in made) == list(range(int((len(base) - len(small)) * 0.5 - len(small))))
    for r in made:
        h = hashlib.md5(f"{r.synthetic_no}|smote|42".encode()).hexdigest()
        pair, gap = int(h[:15], 16) % (len(small) * 5), int(h[15:23], 16) / 16 ** 8
        a = small[pair // 5]
        b = near[a][pair % 5]
        assert np.allclose([r[f] for f in feats], x[a] + gap * (x[b] - x[a]), rtol=0, atol=1e-12) and r.y == 1 and r.vec_id is None


def test_nothing_to_make(spark):
    data, feats = embedding_matrix(Tables(spark, SF_CHECK))
    for rows in (data.limit(0), data.where("y = 0"), data.where("y = 0").unionAll(data.where("y = 1").limit(1))):
        assert SM.smote(rows, "y", "vec_id", feats[:3]).where(F.col("synthetic")).count() == 0


def test_points_that_do_not_prune_are_sent_to_blocks(spark, tmp_path):
    """Even points in 64 dimensions want nearly all cells: what is written stays a few times the points, not points times cells."""
    folder = spark.sparkContext.getCheckpointDir()
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names)
    x = np.random.default_rng(5).normal(size=(1_500, 64))
    ids = np.arange(1_500)
    before = size()
    assert found(NB.nearest(frame(spark, ids, x), "id", "x", 5, 8)) == brute(ids, x, 5)
    assert size() - before < 30 * x.nbytes


def test_product_form_leaves_no_neighbour_out(spark):
    """Points far from the origin, where the product form of the distance has no digits left, and sizes that overflow it."""
    rng = np.random.default_rng(6)
    x = np.concatenate([1e8 + rng.normal(size=(150, 8)) * 1e-3, np.full((3, 8), 1e200), rng.normal(size=(100, 8))])
    ids = rng.permutation(len(x)) + 1
    with np.errstate(all="ignore"):
        d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    got = found(NB.nearest(frame(spark, ids, x), "id", "x", 2, 20))
    place = {int(i): n for n, i in enumerate(ids)}
    for i, near in got.items():
        row = np.delete(d[place[i]], place[i])
        assert [float(f"{d[place[i], place[j]]:.6g}") for j in near] == [float(f"{v:.6g}") for v in np.sort(row)[:2]]
    assert len(got) == len(ids)
