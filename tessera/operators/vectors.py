"""Embedding vectors, clusters, and speaker matching. Vectors are array<double>; voiceprints are a small table of checked size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.storage import saved

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """OP-60c: v / |v|; a zero vector stays as it is."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))[0]


def cosine_distance(a: Column, b: Column) -> Column:
    """OP-60d: 1 - a.b / (|a| |b|); null for a zero vector."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def mean_vector(df: DataFrame, keys: list[str], v: str = "v", weight: str | None = None) -> DataFrame:
    """OP-101, 103: element-wise (weighted) mean, by position: partial sums before the shuffle, no vectors gathered."""
    w = F.col(weight) if weight else F.lit(1.0)
    at = df.select(*keys, w.alias("_w"), F.posexplode(v).alias("_p", "_x"))
    sums = at.groupBy(*keys, "_p").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    return sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(v))


def centroids(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """OP-62d: normalised mean."""
    return mean_vector(df, keys, v).withColumn(v, normalised(F.col(v)))


def embed_files(windows: DataFrame, raw_mean: bool = False) -> DataFrame:
    """OP-60, 60b: windows (file_id, v) to a file's embedding: mean of the normalised (raw_mean: raw) windows, normalised. A file whose windows have none gets null."""
    some = windows.where(F.col("v").isNotNull())
    mean = centroids(some if raw_mean else some.withColumn("v", normalised(F.col("v"))), ["file_id"])
    return windows.select("file_id").distinct().join(mean, "file_id", "left")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[int, int]:
    """Rows of df, or rows + 1 if there are more, and their bytes: about eight for each number and its own length for each string."""
    width = sum((F.coalesce(F.size(c) * 8, F.lit(0)) if k.startswith("array") else F.coalesce(F.length(c), F.lit(0)) if k == "string" else F.lit(8) for c, k in df.dtypes), F.lit(0))
    got = df.select(width.cast("long").alias("w")).limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    return got["n"], got["w"]


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most rows rows and size bytes."""
    n, w = sized(df, rows)
    return n <= rows and w <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small enough; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, rows, size) else df


#: Prints of a block at most, on average.
BLOCK = 512


def paired(probes: DataFrame, prints: DataFrame) -> DataFrame:
    """probes, each row once for every block of prints, with _block, its number, and _prints, its prints as structs in order (their first column tells them apart). The prints are a query set against all probes: written once, as they are looked at twice, and broadcast if they are small
    enough, else each block meets its copy of the probes by a shuffle. There are as many blocks as the prints need."""
    prints = saved(prints)
    n, size = sized(prints)
    few = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    count = max(1, -(-(n if few else prints.count()) // BLOCK))
    blocks = prints.groupBy(F.pmod(F.xxhash64("name"), F.lit(count)).alias("_block")).agg(F.sort_array(F.collect_list(F.struct(*prints.columns))).alias("_prints"))
    every = probes.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    return every.join(F.broadcast(blocks) if few else blocks, "_block")


def nearest(probes: DataFrame, prints: DataFrame, k: int = 1) -> DataFrame:
    """OP-66: (cluster_id, name, dist, rank) of the k nearest voiceprints of each probe. Probes (cluster_id, v), prints (name, v): each block's best k are kept before blocks meet.
    Prints without a vector are left out (OP-27); a probe without one, or a zero vector, has no neighbours."""
    pairs = paired(probes.select("cluster_id", "v"), prints.where(F.col("v").isNotNull()).select("name", "v"))
    near = F.filter(F.transform("_prints", lambda p: F.struct(cosine_distance(F.col("v"), p["v"]).alias("dist"), p["name"].alias("name"))), lambda m: m["dist"].isNotNull())
    found = pairs.select("cluster_id", F.explode(F.slice(F.sort_array(near), 1, k)).alias("_m")).select("cluster_id", "_m.*")
    w = Window.partitionBy("cluster_id").orderBy("dist", "name")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Angles are widened by this much, more than rounding can move them.
ANGLE = 1e-6


def _angle(dist: Column) -> Column:
    return F.when(dist.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - dist))))


def _ordinary(size: int) -> Column:
    """Whether v has size numbers and a length that neither products nor quotients move out of range."""
    return F.coalesce((F.size("v") == size) & norm(F.col("v")).between(1e-100, 1e100), F.lit(False))


def _usual_size(df: DataFrame) -> int:
    """The size that most vectors have."""
    sizes = df.where(F.size("v") > 0).groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    return sizes["s"] if sizes else 1


#: Cosines of the matrix product are trusted to this much, more than rounding can move them.
COSINE = 1e-9


def _near_pairs(a: np.ndarray, most: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Probes a (row after row) and prints b, in order of name: the pairs, as i * len(b) + j, that may be among a probe's k nearest of b and within its angle most. Of equal prints the first k will do."""
    a = a.reshape(len(most), -1)
    b = b.reshape(-1, a.shape[1])
    a, unit = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    same = pd.factorize(np.ascontiguousarray(b).view(np.dtype((np.void, b.itemsize * b.shape[1]))).ravel().astype(object))[0]
    some = np.flatnonzero(pd.Series(same).groupby(same).cumcount().to_numpy() < k)
    c = a @ unit[some].T
    least = np.cos(np.minimum(most + ANGLE, np.pi)) - COSINE
    hit = c >= least[:, None]
    many = np.flatnonzero(hit.sum(axis=1) > k)
    if len(many):
        hit[many] &= c[many] >= np.partition(c[many], c.shape[1] - k, axis=1)[:, c.shape[1] - k, None] - COSINE
    i, j = np.nonzero(hit)
    return i * len(b) + some[j]


def _packed(probes: DataFrame, count: Column | int, *keys: str) -> DataFrame:
    """probes (cluster_id, v, most, keys) in rows of keys and _probes, count of them for each value of the keys."""
    part = F.pmod(F.xxhash64("cluster_id"), F.lit(count) if isinstance(count, int) else count).alias("_part")
    return probes.groupBy(*keys, part).agg(F.collect_list(F.struct("cluster_id", "v", "most")).alias("_probes")).drop("_part")


def _flat(c: str) -> Column:
    return F.flatten(F.transform(c, lambda p: p["v"]))


def _of_pairs(rows: DataFrame, row) -> DataFrame:
    """What row makes of a probe and a print for each of the pairs _at, i * size(_prints) + j."""
    n = F.size("_prints")
    return rows.select(F.inline(F.transform("_at", lambda at: row(F.get("_probes", F.floor(at / n).cast("int")), F.get("_prints", (at % n).cast("int"))))))


def _met(rows: DataFrame, k: int) -> DataFrame:
    """(cluster_id, dist, name) of what may be the k nearest of _prints (name, v), in order of name, for each of _probes (cluster_id, v, most): a matrix product finds them, and their distances are those of cosine_distance."""

    @F.pandas_udf("array<long>")
    def pairs(a: pd.Series, most: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_near_pairs(x, m, y, k) for x, m, y in zip(a, most, b)], dtype=object)

    found = rows.select("_probes", "_prints", pairs(_flat("_probes"), F.transform("_probes", lambda p: p["most"]), _flat("_prints")).alias("_at"))
    return _of_pairs(found, lambda a, b: F.struct(a["cluster_id"].alias("cluster_id"), cosine_distance(a["v"], b["v"]).alias("dist"), b["name"].alias("name")))


def cells(prints: DataFrame, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Prints (name, v) dealt to the nearest of some of them, the pivots (about the root of their number if not given): (cell, name, v), and for each cell (cell, pv, radius, n), its pivot, the angle to its farthest print and its size.
    Prints of another size than most, or beyond the range of _ordinary, are in no cell."""
    some = saved(prints.where(_ordinary(_usual_size(prints))).select("name", "v"))
    n = some.count()
    count = pivots or max(1, int(n**0.5))
    # The pivots are those of the smallest hashes; equal vectors would give empty cells, which do no harm.
    chosen = saved(some.orderBy(F.xxhash64("name"), "name").limit(count))
    asking = some.select(F.col("name").alias("cluster_id"), "v", F.lit(4.0).alias("most"))
    met = _met(paired(_packed(asking, max(1, -(-n // BLOCK))), chosen), 1)
    home = met.groupBy(F.col("cluster_id").alias("name")).agg(F.min(F.struct("dist", F.col("name").alias("cell"))).alias("_m")).select("name", "_m.*")
    dealt = saved(some.join(home, "name").select("cell", "name", "v", _angle(F.col("dist")).alias("angle")))
    size = dealt.groupBy("cell").agg((F.max("angle") + ANGLE).alias("radius"), F.count(F.lit(1)).alias("n"))
    return dealt.select("cell", "name", "v"), saved(size.join(chosen.withColumnsRenamed({"name": "cell", "v": "pv"}), "cell").select("cell", "pv", "radius", "n"))


def _left_cells(a: np.ndarray, most: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Probes a and pivots, row after row: the pairs, as i * len(radius) + j, that the triangle inequality leaves."""
    a, b = a.reshape(len(most), -1), pivots.reshape(len(radius), -1)
    c = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    i, j = np.nonzero(np.arccos(np.clip(c, -1, 1)) - radius[None] <= most[:, None] + ANGLE)
    return i * len(radius) + j


def searched(probes: DataFrame, cell: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """(cluster_id, cell, most) of the cells that may hold a neighbour: with bound (cluster_id, most), an angle, those whose prints can be as near as that by the triangle inequality; without, each probe's nearest cell that isn't empty. Probes (cluster_id, v) have vectors of the pivots' size, or none."""
    some = probes.where(F.col("v").isNotNull() & (norm(F.col("v")) > 0)).select("cluster_id", "v")
    some = some.withColumn("most", F.lit(4.0)) if bound is None else some.join(bound, "cluster_id")
    packed = _packed(some, max(1, -(-probes.count() // BLOCK)))
    met = paired(packed, cell.select(F.col("cell").alias("name"), F.col("pv").alias("v"), "radius"))
    if bound is None:
        return _met(met, 1).groupBy("cluster_id").agg(F.min(F.struct("dist", "name")).alias("_m")).select("cluster_id", F.col("_m.name").alias("cell"), F.lit(4.0).alias("most"))

    @F.pandas_udf("array<long>")
    def left(a: pd.Series, most: pd.Series, b: pd.Series, radius: pd.Series) -> pd.Series:
        return pd.Series([_left_cells(*x) for x in zip(a, most, b, radius)], dtype=object)

    at = left(_flat("_probes"), F.transform("_probes", lambda p: p["most"]), _flat("_prints"), F.transform("_prints", lambda p: p["radius"]))
    return _of_pairs(met.select("_probes", "_prints", at.alias("_at")), lambda a, b: F.struct(a["cluster_id"].alias("cluster_id"), b["name"].alias("cell"), a["most"].alias("most")))


def _best_in(probes: DataFrame, asked: DataFrame, dealt: DataFrame, k: int) -> DataFrame:
    """(cluster_id, dist, name) of what may be the k best prints of each block of the cells asked (cluster_id, cell, most: no farther than this angle) by probes (cluster_id, v). A large cell is some blocks, and many probes of a block are too."""
    at = F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / BLOCK)).alias("_block")
    size = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = dealt.join(size, "cell").select("cell", at, "name", "v").groupBy("cell", "_block").agg(F.sort_array(F.collect_list(F.struct("name", "v"))).alias("_prints"))
    often = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).join(size, "cell")
    every = asked.join(often, "cell").join(small(probes), "cluster_id").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1)))
    return _met(_packed(every, F.ceil(F.col("_n") / BLOCK), "cell", "_block").join(blocks, ["cell", "_block"]), k)


def nearest_pruned(probes: DataFrame, prints: DataFrame, k: int = 1, pivots: int | None = None) -> DataFrame:
    """OP-66 without meeting every print: the same rows as nearest, for many prints. A probe looks into its nearest cell first; the k-th angle found there bounds what other cells may hold, and
    only those that the triangle inequality leaves are looked into, a block of probes against a block of prints at once. Prints that are in no cell, and probes that no cell can be told for, meet all. Probes' cluster_id are distinct."""
    probes, prints = probes.where(F.col("v").isNotNull()).select("cluster_id", "v"), prints.where(F.col("v").isNotNull()).select("name", "v")
    usual = _ordinary(_usual_size(prints))
    dealt, cell = cells(prints, pivots)
    asking = saved(probes.where(usual))
    asked = lambda *bound: saved(searched(asking, cell, *bound))
    first = saved(_best_in(asking, asked(), dealt, k))
    kth = first.groupBy("cluster_id").agg(F.get(F.sort_array(F.collect_list("dist")), F.lit(k - 1)).alias("d"))
    bound = kth.select("cluster_id", F.coalesce(_angle(F.col("d")), F.lit(4.0)).alias("most"))
    found = _best_in(asking, asked(bound), dealt, k)
    size = norm(F.col("v"))
    odd = ~usual & (size > 0)
    # What cells can't tell: prints in no cell, probes of their kind, and zero vectors, whose distance to boundless ones isn't null.
    for a, b in ((asking, prints.where(odd)), (probes.where(odd), prints), (probes.where(size == 0), prints.where(~size.between(0.0, 1e300)))):
        if not b.isEmpty() and not a.isEmpty():
            found = found.unionByName(nearest(a, b, k).drop("rank"))
    w = Window.partitionBy("cluster_id").orderBy("dist", "name")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_CONFIG = Config()
WEIGHTS, SCALES, MATCHING = _CONFIG.get("weights"), _CONFIG.get("normalization"), _CONFIG.get("matching")
SPEECH_FACTOR = 2.0  # fixed value
LOOSE, TIGHT = MATCHING["accept_threshold"], MATCHING["embed_only_accept_threshold"]
#: Further features of a speaker, by name.
SPECTRAL = ("spectral_centroid", "spectral_rolloff")
MFCC = tuple(f"mfcc{k}_{s}" for k in range(13) for s in ("mean", "std"))


def capped_difference(a: Column, b: Column, scale: float) -> Column:
    """|a - b| / scale, at most 1; 0.5 where either is missing or 0, that is, unknown."""
    known = (F.coalesce(a, F.lit(0.0)) != 0) & (F.coalesce(b, F.lit(0.0)) != 0)
    return F.when(known, F.least(F.lit(1.0), F.abs(a - b) / scale)).otherwise(0.5)


def spectral_distance(a: Column, b: Column, scales: dict[str, float] = SCALES) -> Column:
    """OP-65: mean of the scaled differences of those features of SPECTRAL that both structs have above 0; 0.5 with none."""
    both = {n: (F.coalesce(a[n], F.lit(0.0)) > 0) & (F.coalesce(b[n], F.lit(0.0)) > 0) for n in SPECTRAL}
    total = sum(F.when(ok, F.abs(a[n] - b[n]) / scales[f"{n}_per_unit"]).otherwise(0.0) for n, ok in both.items())
    count = sum(ok.cast("int") for ok in both.values())
    return F.when(count > 0, total / count).otherwise(0.5)


def mfcc_distance(a: Column, b: Column, scales: dict[str, float] = SCALES) -> Column:
    """OP-65: mean, over the coefficients whose mean isn't 0 on both sides, of the mean of the scaled differences of mean and deviation; 0.5 with none. A missing value is 0."""
    get = lambda s, n: F.coalesce(s[n], F.lit(0.0))
    total, count = F.lit(0.0), F.lit(0)
    for k in range(13):
        m, d = f"mfcc{k}_mean", f"mfcc{k}_std"
        used = (get(a, m) != 0) | (get(b, m) != 0)
        part = (F.abs(get(a, m) - get(b, m)) / scales[f"{m}_per_unit"] + F.abs(get(a, d) - get(b, d)) / scales[f"{d}_per_unit"]) / 2
        total, count = total + F.when(used, part).otherwise(0.0), count + used.cast("int")
    return F.when(count > 0, total / count).otherwise(0.5)


def _scores(a, b, config: Config, known: bool = True) -> dict[str, Column]:
    """OP-65 for two sides, each a function of a name to a column: emb_dist, spectral_dist, mfcc_dist, combined and confidence."""
    weights, scales = config.get("weights"), config.get("normalization")
    emb = F.coalesce(cosine_distance(a("v"), b("v")), F.lit(1.0))
    spectral = spectral_distance(a("features"), b("features"), scales) if known else F.lit(0.5)
    mfcc = mfcc_distance(a("features"), b("features"), scales) if known else F.lit(0.5)
    part = {
        "embedding": emb,
        "pitch": capped_difference(a("pitch_hz"), b("pitch_hz"), scales["pitch_hz_per_unit"]),
        "energy": capped_difference(a("energy_rms"), b("energy_rms"), scales["energy_rms_per_unit"]),
        "spectral": F.least(F.lit(1.0), spectral),
        "mfcc": F.least(F.lit(1.0), mfcc),
    }
    combined = sum(weights[k] * v for k, v in part.items()) / sum(weights[k] for k in part)
    confidence = F.round(F.greatest(F.lit(0.0), 1 - combined / scales["confidence_max_distance"]), 3)
    return {"emb_dist": F.round(emb, 3), "spectral_dist": F.round(spectral, 3), "mfcc_dist": F.round(mfcc, 3), "combined": F.round(combined, 3), "confidence": confidence}


def composite(pairs: DataFrame, config: Config = _CONFIG) -> DataFrame:
    """OP-65: pairs with v/pitch_hz/energy_rms of both sides (suffixes _a, _b), and features_a, features_b (structs of SPECTRAL and MFCC) or not, get emb_dist, spectral_dist, mfcc_dist, combined and confidence."""
    return pairs.withColumns(_scores(lambda n: F.col(f"{n}_a"), lambda n: F.col(f"{n}_b"), config, "features_a" in pairs.columns))


def scored_blocks(clusters: DataFrame, prints: DataFrame, config: Config = _CONFIG, best: int | None = None) -> DataFrame:
    """OP-65, 66: clusters (file_id, cluster_id, v, pitch_hz, energy_rms and features) against blocks of voiceprints (name, the same, total_speech_sec), scored inside the row: (file_id, cluster_id, block,
    top: the best prints of the block with their scores, or all, and dists: the combined distances of all, in the block's order). Vectors don't leave the row, and of what follows only the best are shuffled. Features that a table lacks are unknown."""

    def side(df: DataFrame) -> Column:
        have = [n for n in (*SPECTRAL, *MFCC) if n in df.columns]
        return F.struct(*[(F.col(n) if n in have else F.lit(None).cast("double")).alias(n) for n in (*SPECTRAL, *MFCC)]).alias("features")

    names = ["v", "pitch_hz", "energy_rms"]
    a = clusters.select("file_id", "cluster_id", F.struct(*names, side(clusters)).alias("_a"))
    b = prints.where(F.col("v").isNotNull()).select("name", *names, side(prints), "total_speech_sec")

    def score(p: Column) -> Column:
        s = _scores(lambda n: F.col("_a").getField(n), lambda n: p[n], config)
        return F.struct(s.pop("combined").alias("combined"), p["name"].alias("name"), *[c.alias(n) for n, c in s.items()], p["total_speech_sec"].alias("total_speech_sec"))

    rows = paired(a, b).select("file_id", "cluster_id", F.col("_block").alias("block"), F.transform("_prints", score).alias("_s"))
    top = F.slice(F.sort_array("_s"), 1, best) if best else F.col("_s")
    return rows.select("file_id", "cluster_id", "block", top.alias("top"), F.transform("_s", lambda x: x["combined"]).alias("dists"))


_CANDIDATE = ["file_id", "cluster_id", "name", "emb_dist", "spectral_dist", "mfcc_dist", "combined", "confidence", "total_speech_sec"]


def candidates(clusters: DataFrame, prints: DataFrame, config: Config = _CONFIG, best: int | None = None) -> DataFrame:
    """OP-65, 66: (file_id, cluster_id, name, emb_dist, spectral_dist, mfcc_dist, combined, confidence, total_speech_sec) of all voiceprints, or of the best of each cluster, by combined distance and name."""
    return best_of(scored_blocks(clusters, prints, config, best), best)


def best_of(blocks: DataFrame, best: int | None = None) -> DataFrame:
    rows = blocks.select("file_id", "cluster_id", F.inline("top")).select(*_CANDIDATE)
    return ranked(rows).where(F.col("rank") <= best).drop("rank") if best else rows


def _of(df: DataFrame) -> list[str]:
    """What tells clusters apart: cluster_id, within file_id where there is one."""
    return ["file_id", "cluster_id"] if "file_id" in df.columns else ["cluster_id"]


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates ((file_id,) cluster_id, name, combined, ...) with rank, least first."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*_of(candidates)).orderBy("combined", "name")))


def clear_winner(candidates: DataFrame) -> DataFrame:
    """OP-67: the best candidate of each cluster and clear: no second one, a gap of clear_winner_gap, or over twice the second's speech and a strong embedding."""
    w = Window.partitionBy(*_of(candidates)).orderBy("combined", "name")
    gap = F.lead("combined").over(w) - F.col("combined")
    d = candidates.withColumn("_gap", gap).withColumn("_speech", F.lead("total_speech_sec").over(w)).withColumn("rank", F.row_number().over(w)).where("rank = 1")
    much = (F.col("total_speech_sec") > SPEECH_FACTOR * F.col("_speech")) & (F.col("combined") < MATCHING["embed_only_threshold"])
    return d.withColumn("clear", F.col("_gap").isNull() | (F.col("_gap") >= MATCHING["clear_winner_gap"]) | F.coalesce(much, F.lit(False))).drop("_gap", "_speech", "rank")


def match_clusters(candidates: DataFrame, loose: float = LOOSE, tight: float = TIGHT, strong: float = MATCHING["embed_only_threshold"]) -> DataFrame:
    """OP-68: the clear winner with matched: near enough, by a tighter threshold where the embeddings alone are near."""
    limit = F.when(F.col("emb_dist") < strong, tight).otherwise(loose)
    return clear_winner(candidates).withColumn("matched", F.col("clear") & (F.col("combined") <= limit))


def early_match(windows: DataFrame, labels: DataFrame, prints: DataFrame, close: float = 0.1, mutual: float = 0.2, accept: float = 0.03) -> DataFrame:
    """OP-64: windows (file_id, ord, v), labels (file_id, ord, cluster) and prints (name, v) to (file_id, cluster, head, final).

    Clusters with the same nearest voiceprint, each within close of it, join the first of them, the head, that is less than mutual away. A head takes
    the name of the voiceprint within accept of its new centroid; the others are SPEAKERn in order of head. Few clusters of a file share a voiceprint, so they meet in one row.
    """
    v = windows.where(F.col("v").isNotNull()).select("file_id", "ord", "v").join(labels.select("file_id", "ord", "cluster"), ["file_id", "ord"])
    centre = centroids(v, ["file_id", "cluster"])
    best = nearest(centre.select(F.struct("file_id", "cluster").alias("cluster_id"), "v"), prints.select("name", "v")).where(F.col("dist") <= close).select("cluster_id.*", "name")
    groups = centre.join(best, ["file_id", "cluster"]).groupBy("file_id", "name").agg(F.sort_array(F.collect_list(F.struct("cluster", "v"))).alias("_c"))
    row = lambda c, head: F.struct(c["cluster"].alias("cluster"), c["v"].alias("v"), head.alias("head"))
    near = lambda s, c: F.filter(s, lambda h: (h["head"] == h["cluster"]) & (cosine_distance(h["v"], c["v"]) < mutual))
    joined = F.aggregate("_c", F.slice(F.transform("_c", lambda c: row(c, c["cluster"])), 1, 0), lambda s, c: F.concat(s, F.array(row(c, F.coalesce(F.get(near(s, c), F.lit(0))["head"], c["cluster"])))))
    heads = groups.select("file_id", F.explode(joined).alias("_h")).select("file_id", F.col("_h.cluster").alias("cluster"), F.col("_h.head").alias("head"))
    every = centre.select("file_id", "cluster").join(heads, ["file_id", "cluster"], "left").withColumn("head", F.coalesce("head", "cluster"))
    again = centroids(v.join(every, ["file_id", "cluster"]), ["file_id", "head"])
    named = nearest(again.select(F.struct("file_id", "head").alias("cluster_id"), "v"), prints.select("name", "v")).where(F.col("dist") <= accept).select("cluster_id.*", "name")
    n = F.sum(F.col("name").isNull().cast("int")).over(Window.partitionBy("file_id").orderBy("head"))
    final = again.select("file_id", "head").join(named, ["file_id", "head"], "left").select("file_id", "head", F.coalesce("name", F.concat(F.lit("SPEAKER"), n)).alias("final"))
    return every.join(final, ["file_id", "head"]).select("file_id", "cluster", "head", "final")


def final_names(matches: DataFrame) -> DataFrame:
    """OP-69: matched clusters take the name; the others SPEAKERn in order of cluster_id."""
    n = F.sum((~F.col("matched")).cast("int")).over(Window.partitionBy("file_id").orderBy("cluster_id"))
    return matches.withColumn("final", F.when(F.col("matched"), F.col("name")).otherwise(F.concat(F.lit("SPEAKER"), n)))


def alternatives(candidates: DataFrame, least: float = 0.3) -> DataFrame:
    """OP-29, 70: ranks 2 to 4 of each cluster with a confidence of least or more, rounded to 2 places."""
    top = ranked(candidates).where("rank <= 4").groupBy(*_of(candidates)).agg(F.sort_array(F.collect_list(F.struct("rank", "name", "confidence"))).alias("_t"))
    kept = F.filter(F.filter("_t", lambda c: c["rank"] > 1), lambda c: c["confidence"] >= least)
    return top.select(*_of(candidates), F.transform(kept, lambda c: F.struct(c["name"].alias("speaker"), F.round(c["confidence"], 2).alias("confidence"))).alias("alternatives"))


def merge_named(clusters: DataFrame) -> DataFrame:
    """OP-71: clusters of one name become one: pitch and energy weighted by speech, durations added."""
    w = F.col("total_speech_sec")
    return clusters.groupBy("name").agg((F.sum(F.col("pitch_hz") * w) / F.sum(w)).alias("pitch_hz"), (F.sum(F.col("energy_rms") * w) / F.sum(w)).alias("energy_rms"), F.sum(w).alias("total_speech_sec"), F.count(F.lit(1)).alias("n"))


def similar_profiles(distances: DataFrame, common: int = 3, tolerance: float = 0.05) -> DataFrame:
    """OP-72: pairs of a file's clusters whose distances (file_id, cluster_id, name, dist) to at least common voiceprints all differ by less than tolerance. A file has max_clusters (15) at most."""
    a = distances.select("file_id", "name", F.col("cluster_id").alias("a"), F.col("dist").alias("_da"))
    b = distances.select("file_id", "name", F.col("cluster_id").alias("b"), F.col("dist").alias("_db"))
    both = a.join(b, ["file_id", "name"]).where("a < b").groupBy("file_id", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("_da") - F.col("_db"))).alias("worst"))
    return both.where((F.col("n") >= common) & (F.col("worst") < tolerance))


def similar_blocks(blocks: DataFrame, common: int = 3, tolerance: float = 0.05) -> DataFrame:
    """OP-72 from scored blocks: a file's clusters meet with their distances as one array for each block, not as a row for each voiceprint."""
    side = lambda n: blocks.select("file_id", "block", F.col("cluster_id").alias(n), F.col("dists").alias(f"_d{n}"))
    far = F.array_max(F.zip_with("_da", "_db", lambda x, y: F.abs(x - y)))
    both = side("a").join(side("b"), ["file_id", "block"]).where("a < b").groupBy("file_id", "a", "b").agg(F.sum(F.size("_da")).alias("n"), F.max(far).alias("worst"))
    return both.where((F.col("n") >= common) & (F.col("worst") < tolerance))


def clarity(distances: DataFrame) -> DataFrame:
    """OP-73: of windows' distances to all centroids (window_id, cluster_id, dist), the least over the second least, at most 1; 0 with one cluster."""
    two = distances.groupBy("window_id").agg(F.slice(F.sort_array(F.collect_list("dist")), 1, 2).alias("_d"))
    ratio = F.least(F.lit(1.0), F.col("_d")[0] / F.nullif(F.get("_d", F.lit(1)), F.lit(0.0)))
    return two.select("window_id", F.when(F.size("_d") < 2, 0.0).otherwise(F.coalesce(ratio, F.lit(1.0))).alias("clarity"))


def segment_confidence(windows: DataFrame) -> DataFrame:
    """OP-74: windows (seg_id, speaker, clarity, dist, duration, known) to a segment's confidence."""
    per = windows.groupBy("seg_id", "speaker").agg(F.sum("clarity").alias("c"), F.sum("dist").alias("d"), F.count(F.lit(1)).alias("n"), F.max("duration").alias("t"), F.max("known").alias("k"))
    s = per.groupBy("seg_id").agg((F.sum("c") / F.sum("n")).alias("c"), (F.sum("d") / F.sum("n")).alias("d"), (F.max("n") / F.sum("n")).alias("m"), F.max("t").alias("t"), F.max("k").alias("k"))
    zero = F.lit(0.0)
    base = 0.3 * F.greatest(zero, 1 - F.col("c")) + 0.3 * F.greatest(zero, 1 - F.col("d") / 0.5) + 0.25 * F.col("m") + 0.15 * F.least(F.lit(1.0), F.col("t") / 5)
    return s.select("seg_id", F.least(F.lit(1.0), base + F.when(F.col("k"), 0.15).otherwise(0.0)).alias("confidence"))


def vote(windows: DataFrame, most: float = 0.3, share: float = 0.8) -> DataFrame:
    """OP-75: windows (seg_id, ord, name, dist) of the nearest voiceprint: the name of most windows within most, if it has share of all; else UNKNOWN."""
    near = windows.withColumn("_n", F.when(F.col("dist") <= most, F.col("name")))
    per = near.groupBy("seg_id", "_n").agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("d"), F.min("ord").alias("o"))
    w = Window.partitionBy("seg_id")
    best = per.withColumn("_all", F.sum("n").over(w)).where(F.col("_n").isNotNull()).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "o"))).where("r = 1")
    ok = F.col("n") / F.col("_all") >= share
    named = best.select("seg_id", F.when(ok, F.col("_n")).otherwise("UNKNOWN").alias("name"), F.round(F.when(ok, 1 - F.col("d")).otherwise(0.0), 3).alias("confidence"), F.round(F.when(ok, F.col("d")).otherwise(1.0), 4).alias("dist"))
    return windows.select("seg_id").distinct().join(named, "seg_id", "left").na.fill({"name": "UNKNOWN", "confidence": 0.0, "dist": 1.0})


#: Up to so many vectors of a file their distances are kept (200 MB); beyond, they are computed from the clusters' sums when they are needed.
MATRIX = 5000


class _Distances:
    """Mean cosine distances between clusters; rows(k) has those of the clusters k to all others, infinite to themselves and to those that are gone."""

    def __init__(self, v: np.ndarray):
        self.unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        self.weight, self.gone, self.kept = np.ones(len(v)), np.zeros(len(v), bool), None
        if len(v) <= MATRIX:
            self.kept = 1 - self.unit @ self.unit.T
            np.fill_diagonal(self.kept, np.inf)
        else:
            self._shrunk(np.arange(len(v)), self.unit.copy())

    def _shrunk(self, live: np.ndarray, sums: np.ndarray) -> None:
        self.live, self.sum = live, sums
        self.at = np.zeros(len(self.gone), np.int64)
        self.at[live] = np.arange(len(live))

    def rows(self, k: np.ndarray) -> np.ndarray:
        if self.kept is not None:
            return self.kept[k]
        # The mean of 1 - a.b over the pairs of two clusters of unit vectors is 1 less the product of the clusters' means.
        d = np.full((len(k), len(self.gone)), np.inf)
        d[:, self.live] = 1 - (self.sum[self.at[k]] @ self.sum.T) / (self.weight[k][:, None] * self.weight[self.live][None])
        d[:, self.gone] = np.inf
        d[np.arange(len(k)), k] = np.inf
        return d

    def merge(self, i: int, j: int) -> None:
        if self.kept is not None:
            d, w = self.kept, self.weight
            row = (d[i] * w[i] + d[j] * w[j]) / (w[i] + w[j])
            d[i], d[:, i] = row, row
            d[i, i] = np.inf
            d[j], d[:, j] = np.inf, np.inf
        else:
            self.sum[self.at[i]] += self.sum[self.at[j]]
        self.weight[i] += self.weight[j]
        self.gone[j] = True
        if self.kept is None and 2 * (~self.gone[self.live]).sum() < len(self.live):
            stay = ~self.gone[self.live]
            self._shrunk(self.live[stay], self.sum[stay])


def _linkage(v: np.ndarray, most: int | None, far: float | None) -> np.ndarray:
    """Average-linkage labels by cosine distance, down to most clusters or up to a distance of far, numbered by first appearance. Of equally near pairs the first is merged.

    Every cluster knows its nearest other. A merge takes those clusters that had one of the two as theirs, and are now farther from both, for stale: what they know is a lower bound, and they look at all
    again only when they come first by it. Steps are quadratic, also where many are equally near, but for odd cases.
    """
    n = len(v)
    d = _Distances(v)
    near, dist, stale = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, bool)

    def look(k: np.ndarray) -> None:
        for at in range(0, len(k), 256):
            some = k[at : at + 256]
            rows = d.rows(some)
            near[some] = rows.argmin(axis=1)
            dist[some] = rows[np.arange(len(some)), near[some]]
            stale[some] = False

    if n > 1:
        look(np.arange(n))
    label, left = np.arange(n), n
    while left > 1 and (most is None or left > most):
        i = int(dist.argmin())
        if stale[i]:
            look(np.array([i]))
            continue
        i, j = sorted((i, int(near[i])))
        if far is not None and dist[i] >= far:
            break
        d.merge(i, j)
        dist[j], stale[j] = np.inf, False
        label[label == j] = i
        left -= 1
        if left > 1:
            theirs = ((near == i) | (near == j)) & ~stale & ~d.gone
            row = d.rows(np.array([i]))[0]
            closer = ((row < dist) | ((row == dist) & ~stale & (theirs | (i < near)))) & ~d.gone
            near[closer], dist[closer] = i, row[closer]
            stale[theirs] = True
            stale[closer] = False
            near[i] = row.argmin()
            dist[i], stale[i] = row[near[i]], False
    return pd.factorize(label)[0]


def _merge_centroids(v: np.ndarray, label: np.ndarray, near: float) -> np.ndarray:
    """OP-62c: the first two clusters nearer than near become one, again and again."""
    while True:
        ids = np.unique(label)
        c = np.stack([v[label == i].mean(axis=0) for i in ids])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        d = np.triu(1 - c @ c.T < near, 1)
        hit = np.argwhere(d)
        if not len(hit):
            return pd.factorize(label)[0]
        label = np.where(label == ids[hit[0][1]], ids[hit[0][0]], label)


def clustered(df: DataFrame, clusters: int | None = None, far: float = 0.35, most: int | None = None, near: float | None = 0.25, keys: str = "file_id") -> DataFrame:
    """OP-62, 62b, 62c, 76: (file_id, vec_id, cluster) by average linkage within each file; an exact number of clusters or a distance, then a cap, then the merge of near centroids. Rows without a vector are left out; vectors of unequal length in a file are an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        sizes = pdf["v"].map(len)
        if sizes.nunique() > 1:
            raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} numbers in {pdf[keys].iloc[0]}")
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        label = _linkage(v, clusters, None if clusters else far)
        if clusters is None:
            if most and label.max() + 1 > most:
                label = _linkage(v, most, None)
            if near:
                label = _merge_centroids(v, label, near)
        return pd.DataFrame({keys: pdf[keys], "vec_id": pdf["vec_id"], "cluster": label.astype("int64")})

    kinds = dict(df.dtypes)
    # Files are dealt to a fixed number of tasks, as their work goes by the square of their windows and not by bytes.
    dealt = df.where(F.col("v").isNotNull()).select(keys, "vec_id", "v").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys)
    return dealt.groupBy(keys).applyInPandas(run, f"{keys} {kinds[keys]}, vec_id {kinds['vec_id']}, cluster long")


def unknown_clusters(windows: DataFrame, far: float = 0.35, most: int = 10, near: float = 0.25) -> DataFrame:
    """OP-76: windows (file_id, ord, v) that no voiceprint was found for, to (file_id, ord, name, confidence, dist): UNKNOWN_n by clusters, numbered from 1 without gaps by first appearance."""
    c = clustered(windows.withColumn("vec_id", F.col("ord")), far=far, most=most, near=near)
    return c.select("file_id", F.col("vec_id").alias("ord"), F.concat(F.lit("UNKNOWN_"), F.col("cluster") + 1).alias("name"), F.lit(0.0).alias("confidence"), F.lit(1.0).alias("dist"))


def refined(samples: DataFrame, stored: DataFrame, skip_existing: bool = False) -> DataFrame:
    """OP-61, 61d: samples (name, v, pitch_hz, energy_rms, duration) blended into stored voiceprints (name, v, pitch_hz, energy_rms, total_speech_sec) by seconds of speech, all speakers at once. skip_existing: samples of stored names are left out."""
    if skip_existing:
        samples = samples.join(stored.select("name"), "name", "left_anti")
    new_v = mean_vector(samples.where(F.col("v").isNotNull()), ["name"], "v", "duration").withColumn("v", normalised(F.col("v")))
    d, p = F.col("duration"), F.col("pitch_hz")
    pitched = F.when(p > 0, d)
    new = samples.groupBy("name").agg((F.sum(F.when(p > 0, p * d)) / F.sum(pitched)).alias("_p"), (F.sum(F.col("energy_rms") * d) / F.sum(d)).alias("_e"), F.sum(d).alias("_t")).join(new_v.withColumnRenamed("v", "_v"), "name", "left")
    both = stored.join(new, "name", "full_outer")
    old, more = F.coalesce("total_speech_sec", F.lit(0.0)), F.coalesce("_t", F.lit(0.0))
    share = F.when(old + more > 0, old / (old + more)).otherwise(0.0)
    blend = lambda a, b: F.when(F.col(a).isNull() | (F.col(a) == 0), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) * share + F.col(b) * (1 - share))
    v = F.when(F.col("v").isNull(), F.col("_v")).when(F.col("_v").isNull(), F.col("v")).otherwise(normalised(F.zip_with("v", "_v", lambda a, b: a * share + b * (1 - share))))
    return both.select("name", v.alias("v"), F.round(blend("pitch_hz", "_p"), 1).alias("pitch_hz"), F.round(blend("energy_rms", "_e"), 4).alias("energy_rms"), F.round(old + more, 1).alias("total_speech_sec"))


def add_samples(samples: DataFrame, stored: DataFrame) -> DataFrame:
    """OP-61b: embedding and pitch are replaced by plain means of the new samples, energy is the mean of old and new, durations add."""
    v = mean_vector(samples, ["name"], "v").withColumn("_v", normalised(F.col("v"))).drop("v")
    new = samples.groupBy("name").agg(F.avg("pitch_hz").alias("_p"), F.avg("energy_rms").alias("_e"), F.sum("duration").alias("_t")).join(v, "name")
    both = stored.join(new, "name", "left")
    return both.select("name", F.coalesce("_v", "v").alias("v"), F.coalesce("_p", "pitch_hz").alias("pitch_hz"), F.when(F.col("_e").isNull(), F.col("energy_rms")).otherwise((F.col("energy_rms") + F.col("_e")) / 2).alias("energy_rms"), (F.col("total_speech_sec") + F.coalesce("_t", F.lit(0.0))).alias("total_speech_sec"))


def add_new(stored: DataFrame, found: DataFrame, overwrite: bool = False) -> DataFrame:
    """OP-61c, 61e: stored voiceprints and those found ones that have an embedding and a new name (overwrite: whatever the name)."""
    good = found.where(F.col("v").isNotNull())
    if overwrite:
        return stored.join(good, "name", "left_anti").unionByName(good, allowMissingColumns=True)
    return stored.unionByName(good.join(stored, "name", "left_anti"), allowMissingColumns=True)


def renamed_unknown(df: DataFrame) -> DataFrame:
    """OP-77: UNKNOWN_n speakers of a file, by name, become SPEAKER1, SPEAKER2, ..."""
    names = df.where(F.col("speaker").startswith("UNKNOWN")).select("file_id", "speaker").distinct()
    names = names.withColumn("_new", F.concat(F.lit("SPEAKER"), F.row_number().over(Window.partitionBy("file_id").orderBy("speaker"))))
    return df.join(names, ["file_id", "speaker"], "left").withColumn("speaker", F.coalesce("_new", "speaker")).drop("_new")


def reassigned(files: DataFrame, moves: DataFrame) -> DataFrame:
    """OP-78: files (speaker, file_name) of moves (speaker, target) go to the target and are numbered anew there; start and end come from names like hash_MM-SS_conf_dur."""
    to = files.join(small(moves), "speaker", "left").withColumn("speaker", F.coalesce("target", "speaker")).drop("target")
    m = lambda k: F.try_element_at(F.regexp_extract_all("file_name", F.lit(r"_(\d+)-(\d+)_"), F.lit(k)), F.lit(1)).cast("int")
    return to.withColumn("start", (m(1) * 60 + m(2)).cast("double")).withColumn("number", F.row_number().over(Window.partitionBy("speaker").orderBy("file_name")))


def relabelled_by_pitch(profiles: DataFrame) -> DataFrame:
    """OP-59c: SPEAKER1 has the lowest pitch in its file; unknown pitch comes last."""
    w = Window.partitionBy("file_id").orderBy(F.when(F.col("pitch_hz") > 0, F.col("pitch_hz")).otherwise(9999.0), "speaker")
    return profiles.withColumn("label", F.concat(F.lit("SPEAKER"), F.row_number().over(w)))
