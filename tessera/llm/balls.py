"""Operator 11: k-means over integer vectors by ball-tree filtering.

The vectors are dealt into blocks of a bounded number, and each block becomes one row: a metric tree of balls with centre, radius, count and integer sum,
and the vectors in the order of its leaves. The trees are written once to the shared folder and read in every round. A round sends
the few centroids to all tasks. From a tree's root on, centroids that the triangle inequality rules out for a ball are dropped; a ball with
one centroid left adds its count and sum as a whole, others descend, and in leaves the squared distances are exact integers, of which the smallest
with the smallest number wins. Bounds are rounded outwards, so ties and near ties reach the leaves. Sums meet as decimals, by cluster and
component, after partial sums in the tasks; the driver gets the k centroids alone.

Kept are vectors with exactly DIM components, none null or non-finite, and none of which reaches 2^17: a squared distance then fits a long. Null
vectors and tables without any give no rows. An inertia beyond a long is null. Rows that repeat count as often as they occur; a null vec_id comes last in the choice of the first
centroids. Of rows with the same hash the smaller vector comes first; with fewer than k vectors there are as many clusters as vectors. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fixed, saved, shared_dir, table

DIM, K, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, 3
#: Vectors of one tree, and of a leaf at most.
BLOCK, LEAF = 4096, 24
_TOP = float(1 << 27)
_TREE = "ids binary, vectors binary, first array<int>, last array<int>, child array<int>, radius array<double>, sums binary"


def scaled(v: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as a long; null for vectors that aren't kept."""
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    ok = (F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * float(scale)) < _TOP))
    return F.when(ok, x)


def tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[int], list[int], list[int], list[float], np.ndarray]:
    """Order of the rows, and for each ball first and last + 1 of its rows in that order, number of its left child (its right one follows; 0 in a leaf), radius about its mean, sum.

    A ball is halved at the median along the line between two far points: from the row farthest of the mean to the row farthest of that.
    """
    order, f = np.arange(len(x)), x.astype(float)
    first, last, child, radius, sums = [0], [len(x)], [0], [0.0], [x.sum(axis=0)]
    at = 0
    while at < len(first):
        rows = order[first[at] : last[at]].copy()
        part = f[rows]
        away = ((part - sums[at] / len(rows)) ** 2).sum(axis=1)
        radius[at] = float(np.sqrt(away.max()))
        if len(rows) > leaf and radius[at] > 0:
            a = part[int(away.argmax())]
            b = part[int(((part - a) ** 2).sum(axis=1).argmax())]
            by = np.argsort(part @ (b - a), kind="stable")
            order[first[at] : last[at]] = rows[by]
            half = len(rows) // 2
            child[at] = len(first)
            left = x[rows[by[:half]]].sum(axis=0)
            for i, j, s in ((first[at], first[at] + half, left), (first[at] + half, last[at], sums[at] - left)):
                first.append(i)
                last.append(j)
                child.append(0)
                radius.append(0.0)
                sums.append(s)
        at += 1
    return order, first, last, child, radius, np.stack(sums)


def planted(df: DataFrame, key: str = "vec_id", v: str = "v", block: int = BLOCK) -> DataFrame:
    """Rows (key, v: array<long>) as trees, a row each. A partition's vectors fill its trees as they come, so no shuffle is needed and nothing is as large as a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for k in range(0, b.num_rows, block):
                held.append(b.slice(k, block))
                n += held[-1].num_rows
                while n >= block:
                    all_ = pa.Table.from_batches(held).combine_chunks()
                    yield _tree_row(all_.slice(0, block))
                    held, n = all_.slice(block).to_batches(), n - block
        if n:
            yield _tree_row(pa.Table.from_batches(held))

    return df.select(F.col(f"`{key}`").cast("long"), v).mapInArrow(run, _TREE)


def _tree_row(rows: pa.Table) -> pa.RecordBatch:
    ids, vectors = rows.column(0).combine_chunks(), rows.column(1).combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), -1)
    order, first, last, child, radius, sums = tree(x)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids.take(pa.array(order))], ["id"]))
    row = [sink.getvalue().to_pybytes(), x[order].astype("<i4").tobytes(), first, last, child, radius, sums.astype("<i8").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW)], [c.split()[0] for c in _TREE.split(", ")])


_ARROW = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.binary()]


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    if 4 * x.shape[1] * top * top < 1 << 53:  # every partial sum is an integer that a double holds
        f, g = x.astype(float), c.astype(float)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - y) ** 2).sum(axis=1) for y in c], axis=1)


def assigned(x: np.ndarray, first: np.ndarray, last: np.ndarray, child: np.ndarray, radius: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Whole balls (ball, centroid), and the rows of leaves that had to be looked at with their centroids."""
    g, whole, leaves = centroids.astype(float), [], []
    balls, open_ = np.array([0]), np.ones((1, len(g)), bool)
    while len(balls):
        centre = sums[balls] / (last[balls] - first[balls])[:, None]
        d = np.sqrt(np.maximum(((centre[:, None] - g[None]) ** 2).sum(axis=2), 0))
        r, slack = radius[balls][:, None], 1e-9 * (1 + d + radius[balls][:, None])
        most = np.where(open_, d + r + slack, np.inf).min(axis=1, keepdims=True)
        open_ = open_ & (d - r - slack <= most)
        one = open_.sum(axis=1) == 1
        whole += zip(balls[one].tolist(), open_[one].argmax(axis=1).tolist())
        leaf = ~one & (child[balls] == 0)
        leaves += balls[leaf].tolist()
        down = ~one & ~leaf
        balls, open_ = np.concatenate([child[balls[down]], child[balls[down]] + 1]), np.concatenate([open_[down]] * 2)
    rows = np.concatenate([np.arange(first[b], last[b]) for b in leaves]) if leaves else np.zeros(0, int)
    return whole, rows, _exact(x[rows], centroids).argmin(axis=1) if len(rows) else rows


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[bytes, np.ndarray, list[np.ndarray]]]:
    for b in batches:
        for k in range(b.num_rows):
            ids, x, *rest, sums = (b.column(c)[k].as_py() for c in range(7))
            yield ids, np.frombuffer(x, "<i4").reshape(-1, dim).astype(np.int64), [*map(np.asarray, rest), np.frombuffer(sums, "<i8").reshape(-1, dim)]


def moved(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: of every cluster with vectors floor(sum / count) by component; others stay."""
    c = np.array(centroids, np.int64)
    k, dim = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, balls in _trees(batches, dim):
            total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
            whole, rows, of = assigned(x, *balls, c)
            for ball, j in whole:
                total[j] += balls[4][ball]
                count[j] += balls[1][ball] - balls[0][ball]
            np.add.at(total, of, x[rows])
            count += np.bincount(of, minlength=k).astype(np.int64)
            j = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(j, dim)), pa.array(np.tile(np.arange(dim), len(j))), pa.array(total[j].ravel()), pa.array(np.repeat(count[j], dim))], ["cluster", "at", "total", "n"])

    parts = trees.mapInArrow(run, "cluster long, at long, total long, n long")
    sums = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = [list(x) for x in centroids]
    for r in sums.collect():  # k * dim rows
        out[r["cluster"]][r["at"]] = int(r["s"]) // int(r["n"])
    return out


def placed(trees: DataFrame, centroids: list[list[int]], key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance) of every vector."""
    c = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, balls in _trees(batches, c.shape[1]):
            whole, rows, of = assigned(x, *balls, c)
            cluster, far = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
            cluster[rows] = of
            for ball, j in whole:
                cluster[balls[0][ball] : balls[1][ball]] = j
            for j in range(len(c)):
                at = np.flatnonzero(cluster == j)
                far[at] = _exact(x[at], c[j : j + 1])[:, 0]
            with pa.ipc.open_stream(ids) as stream:
                names = stream.read_all().column(0).combine_chunks()
            yield pa.RecordBatch.from_arrays([names, pa.array(cluster), pa.array(far)], [key, "cluster", "distance"])

    return trees.mapInArrow(run, f"`{key}` long, cluster int, distance long")


def clustered(df: DataFrame, k: int = K, rounds: int = ROUNDS, key: str = "vec_id", v: str = "embedding", dim: int = DIM, scale: int = SCALE, salt: int = SALT) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark, where = df.sparkSession, shared_dir(df.sparkSession)
    kept = fixed(df, [key], scaled(F.col(f"`{v}`"), dim, scale).alias("v")).where("v IS NOT NULL")
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(f"`{key}`").cast("string")), 256)
    centroids = [list(r["v"]) for r in kept.orderBy(hashed.asc_nulls_last(), "v").select("v").limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = saved(planted(kept, key), f"{where}/trees")
    for _ in range(rounds):
        after = moved(trees, centroids)
        if after == centroids:
            break  # further rounds give the same
        centroids = after
    rows = saved(placed(trees, centroids, key), f"{where}/placed")
    total = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    long_ = lambda n: n if n < 1 << 63 else None
    figures = [(j, long_(total.get(j, 0)), long_(sum(total.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    of = spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def oracle_sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: int = SALT) -> str:
    """The same with plain assignment, one step for each round."""
    steps = [
        f"""x AS (SELECT vec_id, row_number() OVER () AS id, list_transform(embedding, lambda c: floor(c::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dim})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS j, v FROM x QUALIFY j < {k})",
        "d AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM x)",
    ]
    near = "SELECT x.id, arg_min(c.j, struct_pack(d := list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, j := c.j)) AS j FROM x, c{0} c GROUP BY x.id"
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        mean = "CASE WHEN sum(d.x) >= 0 THEN sum(d.x) // count(*) ELSE -((-sum(d.x) + count(*) - 1) // count(*)) END"
        steps.append(f"m{r} AS (SELECT j, list(m::BIGINT ORDER BY p) AS v FROM (SELECT a.j, d.p, {mean} AS m FROM a{r} a JOIN d USING (id) GROUP BY ALL) GROUP BY j)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (j))")
    steps.append(f"a{rounds} AS ({near.format(rounds)})")
    steps.append(f"r AS (SELECT x.vec_id, a.j::INT AS cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN x USING (id) JOIN c{rounds} c USING (j))")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM r"
