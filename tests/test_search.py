"""Search in cells, scores in blocks, and clustering, against plain versions."""

import collections
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors as V


def frame(spark, v, key):
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], f"{key} long, v array<double>")


@pytest.mark.parametrize("kind", ["clustered", "spread", "tied"])
@pytest.mark.parametrize("k", [1, 5])
def test_search_in_cells_equals_the_search_in_all(spark, monkeypatch, kind, k):
    monkeypatch.setattr(V, "BLOCK", 16)
    r = np.random.default_rng(k)
    if kind == "clustered":
        c = r.normal(size=(8, 16))
        v = c[r.integers(0, 8, 300)] + r.normal(size=(300, 16)) * 0.1
    elif kind == "spread":
        v = r.normal(size=(200, 6))
    else:
        v = r.integers(-1, 2, (200, 3)).astype(float)  # equal vectors, zero vectors, and one large cell
        v[:80] = [1.0, 0, 0]
    prints = frame(spark, v, "name").unionByName(spark.createDataFrame([(10_000, None)], "name long, v array<double>"))
    probes = frame(spark, np.concatenate([v[::7] * 2, r.normal(size=(20, v.shape[1]))]), "cluster_id").unionByName(spark.createDataFrame([(900, None), (901, [0.0] * v.shape[1])], "cluster_id long, v array<double>"))
    rows = lambda d: sorted((x.cluster_id, x.rank, x.name, round(x.dist, 12)) for x in d.collect())
    assert rows(V.nearest_pruned(probes, prints, k)) == rows(V.nearest(probes, prints, k))
    assert V.nearest_pruned(probes.limit(0), prints, k).count() == 0 and V.nearest_pruned(probes, prints.limit(0), k).count() == 0


def test_cells_of_odd_vectors(spark):
    r = np.random.default_rng(5)
    v = [x.tolist() for x in r.normal(size=(60, 4))] + [[float("nan"), 1.0, 0.0, 0.0], [1e200, 1.0, 0.0, 0.0], [1e-200, 0.0, 0.0, 0.0], [1.0, 2.0], [2.0, 1.0], [1.0, None, 0.0, 0.0], [0.0] * 4, [], None]
    prints = spark.createDataFrame(list(enumerate(v)), "name long, v array<double>")
    probes = prints.withColumnRenamed("name", "cluster_id")
    rows = lambda d: sorted((x.cluster_id, x.rank, x.name, str(x.dist)) for x in d.collect())
    assert rows(V.nearest_pruned(probes, prints, 63)) == rows(V.nearest(probes, prints, 63))


def test_search_where_no_cell_is_left_out_takes_less_than_the_search_in_all(spark):
    v = np.random.default_rng(6).normal(size=(2000, 128))
    prints = frame(spark, v, "name").cache()
    probes = frame(spark, v[:1000], "cluster_id").cache()
    assert prints.count() + probes.count() == 3000
    took = []
    for search in (V.nearest_pruned, V.nearest):
        began = time.time()
        assert search(probes, prints, 2).count() == 2000
        took.append(time.time() - began)
    assert took[0] < took[1]


def test_most_cells_are_left_out(spark):
    r = np.random.default_rng(3)
    c = r.normal(size=(20, 32))
    v = c[r.integers(0, 20, 600)] + r.normal(size=(600, 32)) * 0.05
    probes = frame(spark, v[::6] + r.normal(size=(100, 32)) * 0.01, "cluster_id")
    dealt, cell = V.cells(frame(spark, v, "name"))
    best = V.nearest(probes, frame(spark, v, "name"), 3).where("rank = 3").select("cluster_id", F.acos(1 - F.col("dist")).alias("most"))
    asked = V.searched(probes, cell, best)
    share = asked.join(cell, "cell").agg(F.sum("n")).first()[0] / (100 * 600)
    assert dealt.count() == 600 and cell.agg(F.sum("n")).first()[0] == 600 and share < 0.25


def profiles(spark, n, key, seed, more=""):
    r = np.random.default_rng(seed)
    rows = [(k, r.normal(size=4).tolist(), float(r.integers(0, 3) * 60), 0.05, float(r.uniform(0, 900)), 30.0) for k in range(n)]
    return spark.createDataFrame(rows, f"{key} long, v array<double>, pitch_hz double, energy_rms double, spectral_centroid double, total_speech_sec double")


def test_scores_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 3)
    clusters = profiles(spark, 9, "cluster_id", 1).withColumn("file_id", F.concat(F.lit("f"), F.col("cluster_id") % 2)).unionByName(profiles(spark, 1, "cluster_id", 1).selectExpr("*", "'f0' AS file_id").withColumn("cluster_id", F.lit(77).cast("long")))
    prints = profiles(spark, 40, "name", 2)
    every = V.candidates(clusters, prints)
    assert every.count() == 400
    few = V.candidates(clusters, prints, best=4)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(few) == rows(V.ranked(every).where("rank <= 4").drop("rank"))
    assert rows(V.match_clusters(few)) == rows(V.match_clusters(every)) and rows(V.alternatives(few)) == rows(V.alternatives(every))
    blocks = V.scored_blocks(clusters, prints, best=4)
    assert blocks.agg(F.max(F.size("top"))).first()[0] <= 4
    assert rows(V.similar_blocks(blocks, tolerance=0.3)) == rows(V.similar_profiles(every.withColumn("dist", F.col("combined")), tolerance=0.3))
    assert V.similar_blocks(blocks).count() >= 1


def plain_labels(v, most, far):
    """The whole matrix is searched for every merge."""
    n, size = len(v), np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    d = 1 - (v / size) @ (v / size).T
    np.fill_diagonal(d, np.inf)
    label, weight, left = np.arange(n), np.ones(n), n
    while left > 1 and (most is None or left > most):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        if far is not None and d[i, j] >= far:
            break
        row = (d[i] * weight[i] + d[j] * weight[j]) / (weight[i] + weight[j])
        d[i], d[:, i] = row, row
        d[i, i] = d[j] = d[:, j] = np.inf
        weight[i] += weight[j]
        label[label == j] = i
        left -= 1
    return pd.factorize(label)[0]


@pytest.mark.parametrize("most,far", [(None, 0.3), (3, None), (None, 0.9), (1, None)])
def test_clusters_with_ties(monkeypatch, most, far):
    r = np.random.default_rng(1)
    for t in range(150):
        n = int(r.integers(1, 50))
        v = r.integers(-1, 2, (n, int(r.integers(1, 5)))).astype(float) if t % 2 else r.normal(size=(n, 5))
        monkeypatch.setattr(V, "MATRIX", 5000)
        got = V._linkage(v, most, far)
        assert (got == plain_labels(v, most, far)).all()
        if t % 2 == 0:
            monkeypatch.setattr(V, "MATRIX", 0)
            assert (V._linkage(v, most, far) == got).all()


@pytest.mark.parametrize("matrix", [5000, 0])
def test_equally_near_windows_look_again_but_seldom(monkeypatch, matrix):
    monkeypatch.setattr(V, "MATRIX", matrix)
    looked, rows = [], V._Distances.rows
    monkeypatch.setattr(V._Distances, "rows", lambda self, k: looked.append(len(k)) or rows(self, k))
    who = np.random.default_rng(4).integers(0, 3, 600)
    label = V._linkage(np.eye(64)[who], None, 0.35)
    assert len({*zip(who.tolist(), label.tolist())}) == 3 and sum(looked) < 3 * 600


def test_thousands_of_windows_of_one_file(spark):
    r = np.random.default_rng(2)
    c = r.normal(size=(9, 64))
    who = r.integers(0, 9, 5000)
    v = c[who] + r.normal(size=(5000, 64)) * 0.4
    began = time.time()
    label = V._linkage(v, None, 0.5)
    assert time.time() - began < 60 and len({*zip(who.tolist(), label.tolist())}) == 9
    odd = spark.createDataFrame([("f", 1, [1.0]), ("f", 2, [1.0, 2.0])], "file_id string, vec_id int, v array<double>")
    with pytest.raises(Exception, match="vectors of 1 and of 2 numbers in f"):
        V.clustered(odd).collect()
    named = V.clustered(odd.where("vec_id = 1"))
    assert dict(named.dtypes)["vec_id"] == "int" and collections.Counter(x.cluster for x in named.collect()) == {0: 1}
