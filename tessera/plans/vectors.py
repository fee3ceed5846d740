"""Queries of the vector operators over the embeddings table; labels stand for clusters and speakers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import vectors as V
from tessera.plans.adapters import VEC, rounded, vec

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
NORM = "sqrt(list_sum(list_transform({a}, lambda x: x * x)))"
COS = "(1 - " + DOT.format(a="{a}", b="{b}") + " / (" + NORM.format(a="{a}") + " * " + NORM.format(a="{b}") + "))"


def cos(a: str, b: str) -> str:
    return COS.replace("{a}", a).replace("{b}", b)


def _profiles(spark, d):
    """Voiceprints: centroids of the labels of even vectors; clusters: those of odd ones, with pitch, energy, features and speech made of the label. Label 3 has no centroid of its spectrum, odd voiceprints no roll-off."""
    v, label = vec(spark, d), F.col("label").cast("double")
    extra = lambda df, k: df.select("*", (F.lit(120.0) + 5 * label + k).alias("pitch_hz"), (F.lit(0.05) + 0.01 * label).alias("energy_rms"), (F.lit(10.0) + F.pmod(label * 7, F.lit(5.0)) * 30).alias("total_speech_sec"))
    prints = extra(V.mean_vector(v.where("vec_id % 2 = 0"), ["label"]), 0).withColumns(
        {"spectral_centroid": 1050 + 130 * label, "spectral_rolloff": F.when(F.col("label") % 2 == 0, 2100 + 60 * label), "mfcc0_mean": 2 * label - 5, "mfcc0_std": F.lit(1.0)}
    )
    clusters = extra(V.mean_vector(v.where("vec_id % 2 = 1"), ["label"]), 3).withColumns(
        {"spectral_centroid": F.when(F.col("label") != 3, 1000 + 100 * label).otherwise(0.0), "spectral_rolloff": 2000 + 80 * label, "mfcc0_mean": 2 * label - 6, "mfcc0_std": 1 + label, "mfcc5_mean": label}
    )
    return clusters, prints


_MEAN = """mean_even AS (SELECT label, list(m ORDER BY p) AS v FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM vec WHERE vec_id % 2 = 0) GROUP BY ALL) GROUP BY label),
mean_odd AS (SELECT label, list(m ORDER BY p) AS v FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM vec WHERE vec_id % 2 = 1) GROUP BY ALL) GROUP BY label)"""


def _candidates(spark, d):
    c, p = _profiles(spark, d)
    got = V.candidates(c.withColumn("file_id", F.lit(0)).withColumnRenamed("label", "cluster_id"), p.withColumnRenamed("label", "name"))
    return got.drop("file_id").withColumn("name", F.col("name").cast("string"))


_CAND = f"""{VEC}, {_MEAN}, cand00 AS (SELECT o.label AS o, e.label AS e, o.label AS cluster_id, CAST(e.label AS VARCHAR) AS name, {cos('o.v', 'e.v')} AS emb,
least(1.0, abs((123.0 + 5 * o.label) - (120.0 + 5 * e.label)) / 50.0) AS dp, least(1.0, abs((0.05 + 0.01 * o.label) - (0.05 + 0.01 * e.label))::DOUBLE / 0.05) AS de,
CASE WHEN o.label <> 3 THEN abs(1000.0 + 100 * o.label - 1050 - 130 * e.label) / 500 ELSE 0 END + CASE WHEN e.label % 2 = 0 THEN abs(2000.0 + 80 * o.label - 2100 - 60 * e.label) / 1000 ELSE 0 END AS sp_sum,
CASE WHEN o.label <> 3 THEN 1 ELSE 0 END + CASE WHEN e.label % 2 = 0 THEN 1 ELSE 0 END AS sp_n,
((abs(2.0 * o.label - 6 - 2 * e.label + 5) / 10 + o.label / 5.0) / 2 + CASE WHEN o.label <> 0 THEN o.label / 5.0 / 2 ELSE 0 END) / CASE WHEN o.label <> 0 THEN 2 ELSE 1 END AS mf, 10.0 + (e.label * 7 % 5) * 30 AS total_speech_sec FROM mean_odd o, mean_even e),
cand0 AS (SELECT *, CASE WHEN sp_n = 0 THEN 0.5 ELSE sp_sum / sp_n END AS sp FROM cand00),
cand AS (SELECT cluster_id, name, round(emb, 3) AS emb_dist, round(sp::DOUBLE, 3) AS spectral_dist, round(mf::DOUBLE, 3) AS mfcc_dist, round(0.6 * emb + 0.15 * dp + 0.05 * de + 0.1 * least(1.0, sp) + 0.1 * least(1.0, mf), 3) AS combined,
round(greatest(0.0, 1 - (0.6 * emb + 0.15 * dp + 0.05 * de + 0.1 * least(1.0, sp) + 0.1 * least(1.0, mf)) / 0.5), 3) AS confidence, total_speech_sec FROM cand0)"""
_BEST = """best AS (SELECT *, row_number() OVER w AS rank, lead(combined) OVER w - combined AS gap, lead(total_speech_sec) OVER w AS speech2 FROM cand WINDOW w AS (PARTITION BY cluster_id ORDER BY combined, name)),
win AS (SELECT *, gap IS NULL OR gap >= 0.02 OR coalesce(total_speech_sec > 2 * speech2 AND combined < 0.16, false) AS clear FROM best WHERE rank = 1)"""


@query("l2_norm", f"WITH {VEC} SELECT vec_id, round({NORM.format(a='v')}, 6) AS norm, list_transform(v, lambda x: round(x / {NORM.format(a='v')}, 5)) AS unit FROM vec")
def l2_norm(spark, d):
    return vec(spark, d).select("vec_id", rounded(V.norm(F.col("v")), 6).alias("norm"), F.transform(V.normalised(F.col("v")), lambda x: rounded(x, 5)).alias("unit"))


@query("cosine_pairs", f"WITH {VEC} SELECT a.vec_id AS a, b.vec_id AS b, round({cos('a.v', 'b.v')}, 5) AS dist FROM vec a JOIN vec b ON a.vec_id // 40 = b.vec_id // 40 AND a.vec_id < b.vec_id")
def cosine_pairs(spark, d):
    """Forty vectors are a file; pairs are of one file."""
    v = vec(spark, d).withColumn("file_id", F.floor(F.col("vec_id") / 40))
    a, b = v.select("file_id", F.col("vec_id").alias("a"), F.col("v").alias("va")), v.select("file_id", F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    return a.join(b, "file_id").where("a < b").select("a", "b", F.round(V.cosine_distance(F.col("va"), F.col("vb")), 5).alias("dist"))


@query("centroids", f"WITH {VEC}, m AS (SELECT label, list(m ORDER BY p) AS v FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM vec) GROUP BY ALL) GROUP BY label) SELECT label, list_transform(v, lambda x: round(x / {NORM.format(a='v')}, 5)) AS v FROM m")
def centroids(spark, d):
    return V.centroids(vec(spark, d), ["label"]).select("label", F.transform("v", lambda x: F.round(x, 5)).alias("v"))


@query("weighted_mean", f"WITH {VEC} SELECT label, list(m ORDER BY p) AS v FROM (SELECT label, p, round(sum(x * w) / sum(w), 5) AS m FROM (SELECT label, vec_id % 7 + 1 AS w, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM vec) GROUP BY ALL) GROUP BY label")
def weighted_mean(spark, d):
    v = vec(spark, d).withColumn("w", (F.col("vec_id") % 7 + 1).cast("double"))
    return V.mean_vector(v, ["label"], "v", "w").select("label", F.transform("v", lambda x: F.round(x, 5)).alias("v"))


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / {NORM.format(a=v)})"


def _by_label(name: str, where: str, weight: str = "1") -> str:
    """A table of the weighted mean vector of each label."""
    return f"{name} AS (SELECT label, list(m ORDER BY p) AS v FROM (SELECT label, p, sum(x * w) / sum(w) AS m FROM (SELECT label, {weight} AS w, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM vec WHERE {where}) GROUP BY ALL) GROUP BY label)"


@query(
    "weighted_blend",
    f"""WITH {VEC}, s AS (SELECT label, 120.0 + vec_id % 5 AS p, 0.05 + 0.001 * (vec_id % 3) AS e, vec_id % 9 + 1.0 AS dur FROM vec WHERE vec_id % 2 = 1), n AS (SELECT label, sum(p * dur) / sum(dur) AS p, sum(e * dur) / sum(dur) AS e, sum(dur) AS t FROM s GROUP BY label),
    {_by_label("o0", "vec_id % 2 = 0 AND label < 8")}, {_by_label("n0", "vec_id % 2 = 1", "vec_id % 9 + 1.0::DOUBLE")}, o AS (SELECT label, {_unit('v')} AS v FROM o0), nv AS (SELECT label, {_unit('v')} AS v FROM n0),
    b AS (SELECT coalesce(n.label, o.label) AS label, n.p, n.e, n.t, o.v AS old, nv.v AS new, (60 / (60 + n.t))::DOUBLE AS share FROM n JOIN nv USING (label) FULL JOIN o ON n.label = o.label),
    c AS (SELECT *, CASE WHEN old IS NULL THEN new WHEN new IS NULL THEN old ELSE list_transform(range(1, len(old) + 1), lambda i: old[i] * share + new[i] * (1 - share)) END AS mixed FROM b)
    SELECT label, round((CASE WHEN old IS NULL THEN p WHEN new IS NULL THEN 100.0 ELSE 100.0 * share + p * (1 - share) END)::DOUBLE, 1) AS pitch_hz, round((CASE WHEN old IS NULL THEN e WHEN new IS NULL THEN 0.04 ELSE 0.04 * share + e * (1 - share) END)::DOUBLE, 4) AS energy_rms,
    (CASE WHEN old IS NULL THEN 0 ELSE 60 END + coalesce(t, 0))::DOUBLE AS total_speech_sec, list_transform({_unit('mixed')}, lambda x: round(x, 5)) AS v FROM c""",
)
def weighted_blend(spark, d):
    v = vec(spark, d)
    samples = v.where("vec_id % 2 = 1").select(F.col("label").alias("name"), "v", (F.lit(120.0) + F.col("vec_id") % 5).alias("pitch_hz"), (F.lit(0.05) + 0.001 * (F.col("vec_id") % 3)).alias("energy_rms"), (F.col("vec_id") % 9 + 1).cast("double").alias("duration"))
    stored = V.centroids(v.where("vec_id % 2 = 0 AND label < 8"), ["label"]).select(F.col("label").alias("name"), "v", F.lit(100.0).alias("pitch_hz"), F.lit(0.04).alias("energy_rms"), F.lit(60.0).alias("total_speech_sec"))
    return V.refined(samples, stored).select(F.col("name").alias("label"), "pitch_hz", "energy_rms", "total_speech_sec", F.transform("v", lambda x: F.round(x, 5)).alias("v"))


@query("nearest_prints", f"WITH {VEC}, {_MEAN}, p AS (SELECT a.vec_id AS cluster_id, e.label AS name, {cos('a.v', 'e.v')} AS dist FROM vec a, mean_even e WHERE a.vec_id % 2 = 1) SELECT cluster_id, name, round(dist, 5) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, name) AS rank FROM p) WHERE rank <= 3")
def nearest_prints(spark, d):
    v = vec(spark, d)
    prints = V.mean_vector(v.where("vec_id % 2 = 0"), ["label"]).withColumnRenamed("label", "name")
    return V.nearest(v.where("vec_id % 2 = 1").select(F.col("vec_id").alias("cluster_id"), "v"), prints, 3).select("cluster_id", "name", F.round("dist", 5).alias("dist"), "rank")


@query("nearest_prints_pruned", f"WITH {VEC}, p AS (SELECT a.vec_id AS cluster_id, b.vec_id AS name, {cos('a.v', 'b.v')} AS dist FROM vec a, vec b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT cluster_id, name, round(dist, 5) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, name) AS rank FROM p) WHERE rank <= 3")
def nearest_prints_pruned(spark, d):
    """A search: every vector whose id is divisible by 20 against all, by cells and the triangle inequality; its nearest is itself."""
    v = vec(spark, d)
    probes, prints = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("cluster_id"), "v"), v.select(F.col("vec_id").alias("name"), "v")
    near = V.nearest_pruned(probes, prints, 4).where("cluster_id <> name")
    w = Window.partitionBy("cluster_id").orderBy("dist", "name")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("cluster_id", "name", F.round("dist", 5).alias("dist"), "rank")


@query("composite_distance", f"WITH {_CAND} SELECT cluster_id, name, emb_dist, spectral_dist, mfcc_dist, combined, confidence FROM cand")
def composite_distance(spark, d):
    return _candidates(spark, d).select("cluster_id", "name", "emb_dist", "spectral_dist", "mfcc_dist", "combined", "confidence")


@query("best_match", f"WITH {_CAND}, {_BEST} SELECT cluster_id, name, combined FROM best WHERE rank = 1")
def best_match(spark, d):
    return V.ranked(_candidates(spark, d)).where("rank = 1").select("cluster_id", "name", "combined")


@query("clear_winner", f"WITH {_CAND}, {_BEST} SELECT cluster_id, name, clear FROM win")
def clear_winner(spark, d):
    return V.clear_winner(_candidates(spark, d)).select("cluster_id", "name", "clear")


@query("match_clusters", f"WITH {_CAND}, {_BEST} SELECT cluster_id, name, clear AND combined <= CASE WHEN emb_dist < 0.7 THEN 0.6 ELSE 0.8 END AS matched FROM win")
def match_clusters(spark, d):
    return V.match_clusters(_candidates(spark, d), 0.8, 0.6, 0.7).select("cluster_id", "name", "matched")


@query("final_names", f"WITH {_CAND}, {_BEST}, m AS (SELECT cluster_id, name, clear AND combined <= CASE WHEN emb_dist < 0.7 THEN 0.6 ELSE 0.62 END AS matched FROM win) SELECT cluster_id, CASE WHEN matched THEN name ELSE 'SPEAKER' || CAST(sum(CASE WHEN matched THEN 0 ELSE 1 END) OVER (ORDER BY cluster_id) AS BIGINT) END AS final FROM m")
def final_names(spark, d):
    m = V.match_clusters(_candidates(spark, d), 0.62, 0.6, 0.7).withColumn("file_id", F.lit(0))
    return V.final_names(m).select("cluster_id", "final")


@query("topk_alternatives", f"""WITH {_CAND}, {_BEST}, k AS (SELECT cluster_id, list(name ORDER BY rank) FILTER (WHERE rank > 1 AND confidence >= 0.05) AS names, list(round(CAST(confidence AS DECIMAL(6, 3)), 2)::DOUBLE ORDER BY rank) FILTER (WHERE rank > 1 AND confidence >= 0.05) AS confidences FROM best WHERE rank <= 4 GROUP BY cluster_id)
SELECT cluster_id, coalesce(names, []) AS names, coalesce(confidences, []) AS confidences FROM k""")
def topk_alternatives(spark, d):
    return V.alternatives(_candidates(spark, d), 0.05).select("cluster_id", F.col("alternatives.speaker").alias("names"), F.col("alternatives.confidence").alias("confidences"))


@query("merge_named", "WITH l AS (SELECT label, vec_id % 3 AS g, 100.0 + vec_id % 11 AS p, 0.05 + 0.01 * (vec_id % 4) AS e, vec_id % 9 + 1.0 AS t FROM embeddings) SELECT label * 10 + g AS name, round((sum(p * t) / sum(t))::DOUBLE, 4) AS pitch_hz, round((sum(e * t) / sum(t))::DOUBLE, 6) AS energy_rms, sum(t)::DOUBLE AS total_speech_sec, count(*) AS n FROM l GROUP BY ALL")
def merge_named(spark, d):
    c = vec(spark, d).select((F.col("label") * 10 + F.col("vec_id") % 3).alias("name"), (F.lit(100.0) + F.col("vec_id") % 11).alias("pitch_hz"), (F.lit(0.05) + 0.01 * (F.col("vec_id") % 4)).alias("energy_rms"), (F.col("vec_id") % 9 + 1).cast("double").alias("total_speech_sec"))
    return V.merge_named(c).select("name", F.round("pitch_hz", 4).alias("pitch_hz"), F.round("energy_rms", 6).alias("energy_rms"), "total_speech_sec", "n")


@query("similar_profiles", f"WITH {_CAND} SELECT a.cluster_id AS a, b.cluster_id AS b, count(*) AS n FROM cand0 a JOIN cand0 b ON a.name = b.name AND a.cluster_id < b.cluster_id GROUP BY ALL HAVING count(*) >= 3 AND max(abs(a.emb - b.emb)) < 0.35")
def similar_profiles(spark, d):
    c, p = _profiles(spark, d)
    near = V.nearest(c.select(F.col("label").alias("cluster_id"), "v"), p.select(F.col("label").alias("name"), "v"), 1000)
    return V.similar_profiles(near.select(F.lit(0).alias("file_id"), "cluster_id", "name", "dist"), 3, 0.35).select("a", "b", "n")


def _window_distances(spark, d):
    v = vec(spark, d)
    prints = V.mean_vector(v.where("vec_id % 2 = 0"), ["label"]).withColumnRenamed("label", "name")
    return V.nearest(v.select(F.col("vec_id").alias("cluster_id"), "v"), prints, 10).select(F.col("cluster_id").alias("window_id"), F.col("name").alias("cluster_id"), "dist")


_WD = f"{VEC}, {_MEAN}, wd AS (SELECT a.vec_id AS window_id, e.label AS cluster_id, {cos('a.v', 'e.v')} AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY {cos('a.v', 'e.v')}, e.label) AS r FROM vec a, mean_even e)"


@query("clarity", f"WITH {_WD} SELECT a.window_id, round(least(1.0, a.dist / b.dist), 5) AS clarity FROM wd a JOIN wd b ON a.window_id = b.window_id AND a.r = 1 AND b.r = 2")
def clarity(spark, d):
    return V.clarity(_window_distances(spark, d)).select("window_id", F.round("clarity", 5).alias("clarity"))


@query(
    "segment_confidence",
    f"""WITH {_WD}, x AS (SELECT a.window_id // 5 AS seg_id, a.cluster_id AS speaker, least(1.0, a.dist / b.dist) AS clarity, a.dist / 2 AS dist FROM wd a JOIN wd b ON a.window_id = b.window_id AND a.r = 1 AND b.r = 2),
    p AS (SELECT seg_id, speaker, sum(clarity) AS c, sum(dist) AS d, count(*) AS n FROM x GROUP BY ALL), s AS (SELECT seg_id, sum(c) / sum(n) AS c, sum(d) / sum(n) AS d, max(n) / sum(n) AS m FROM p GROUP BY ALL)
    SELECT seg_id, round(least(1.0, 0.3 * greatest(0.0, 1 - c) + 0.3 * greatest(0.0, 1 - d / 0.5) + 0.25 * m + 0.15 * 0.6 + CASE WHEN seg_id % 2 = 0 THEN 0.15 ELSE 0 END), 5) AS confidence FROM s""",
)
def segment_confidence(spark, d):
    w = _window_distances(spark, d)
    best = w.groupBy("window_id").agg(F.min_by("cluster_id", F.struct("dist", "cluster_id")).alias("speaker"), F.min("dist").alias("dist")).join(V.clarity(w), "window_id")
    seg = F.floor(F.col("window_id") / 5)
    x = best.select(seg.alias("seg_id"), "speaker", "clarity", (F.col("dist") / 2).alias("dist"), F.lit(3.0).alias("duration"), (seg % 2 == 0).alias("known"))
    return V.segment_confidence(x).select("seg_id", F.round("confidence", 5).alias("confidence"))


@query(
    "vote_identify",
    f"""WITH {_WD}, x AS (SELECT window_id // 5 AS seg_id, window_id AS ord, CASE WHEN dist <= 0.8 THEN CAST(cluster_id AS VARCHAR) END AS name, dist FROM wd WHERE r = 1), p AS (SELECT seg_id, name, count(*) AS n, min(ord) AS o, avg(dist) AS d FROM x GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY seg_id) AS total FROM p), b AS (SELECT *, n / total >= 0.4 AS ok, row_number() OVER (PARTITION BY seg_id ORDER BY n DESC, o) AS r FROM t WHERE name IS NOT NULL)
    SELECT s.seg_id, CASE WHEN b.ok THEN b.name ELSE 'UNKNOWN' END AS name, CASE WHEN b.ok THEN round(1 - b.d, 3) ELSE 0.0::DOUBLE END AS confidence, CASE WHEN b.ok THEN round(b.d, 4) ELSE 1.0::DOUBLE END AS dist FROM (SELECT DISTINCT seg_id FROM x) s LEFT JOIN b ON s.seg_id = b.seg_id AND b.r = 1""",
)
def vote_identify(spark, d):
    w = _window_distances(spark, d)
    best = w.groupBy("window_id").agg(F.min_by("cluster_id", F.struct("dist", "cluster_id")).cast("string").alias("name"), F.min("dist").alias("dist"))
    return V.vote(best.select(F.floor(F.col("window_id") / 5).alias("seg_id"), F.col("window_id").alias("ord"), "name", "dist"), 0.8, 0.4).select("seg_id", "name", "confidence", "dist")


@query("agglomerative")
def agglomerative(spark, d):
    return V.clustered(vec(spark, d).select(F.col("label").alias("file_id"), "vec_id", "v"), far=0.9, near=0.6)


# Of all pairs of clusters that with the least mean distance becomes one, in the place of the first, until three are left.
_LINKED = f"""WITH RECURSIVE {VEC}, f AS (SELECT label, list(v ORDER BY vec_id) AS vs, list(vec_id ORDER BY vec_id) AS ids FROM vec GROUP BY label),
    d AS MATERIALIZED (SELECT label, ids, list_transform(vs, lambda a: list_transform(vs, lambda b: {cos('a', 'b')})) AS d FROM f),
    r AS (SELECT label, list_transform(range(1, len(ids) + 1), lambda i: [i]) AS c FROM d
      UNION ALL SELECT label, list_transform(list_filter(range(1, len(c) + 1), lambda k: k <> p.j), lambda k: CASE WHEN k = p.i THEN list_concat(c[k], c[p.j]) ELSE c[k] END)
      FROM (SELECT r.label, c, list_min(flatten(list_transform(range(1, len(c)), lambda i: list_transform(range(i + 1, len(c) + 1), lambda j: struct_pack(m := list_avg(flatten(list_transform(c[i], lambda a: list_transform(c[j], lambda b: d.d[a][b])))), i := i, j := j))))) AS p
        FROM r JOIN d ON r.label = d.label WHERE len(c) > 3)),
    o AS (SELECT label, unnest(c) AS m, generate_subscripts(c, 1) - 1 AS cluster FROM r WHERE len(c) <= 3), e AS (SELECT label, cluster, unnest(m) AS i FROM o)
    SELECT e.label AS file_id, d.ids[e.i] AS vec_id, e.cluster FROM e JOIN d ON e.label = d.label"""


@query("agglomerative_exact", _LINKED)
def agglomerative_exact(spark, d):
    return V.clustered(vec(spark, d).select(F.col("label").alias("file_id"), "vec_id", "v"), clusters=3)


@query("embed_files_raw", f"WITH {VEC}, {_by_label('m', 'vec_id % 7 <> 0')} SELECT l.label AS file_id, list_transform(m.v, lambda x: round(x / {NORM.format(a='m.v')}, 5)) AS v FROM (SELECT DISTINCT label FROM vec) l LEFT JOIN m USING (label)")
def embed_files_raw(spark, d):
    """The mean of the raw windows; every seventh window has no vector."""
    w = vec(spark, d).select(F.col("label").alias("file_id"), F.when(F.col("vec_id") % 7 != 0, F.col("v")).alias("v"))
    return V.embed_files(w, raw_mean=True).select("file_id", F.transform("v", lambda x: F.round(x, 5)).alias("v"))


@query("nearest_prints_null", f"WITH {VEC}, {_MEAN}, p AS (SELECT a.vec_id AS cluster_id, e.label AS name, {cos('a.v', 'e.v')} AS dist FROM vec a, mean_even e WHERE a.vec_id % 5 <> 0 AND e.label % 3 <> 0) SELECT cluster_id, name, round(dist, 5) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, name) AS rank FROM p) WHERE rank <= 2")
def nearest_prints_null(spark, d):
    """A third of the voiceprints have no vector, and every fifth probe has none."""
    v = vec(spark, d)
    prints = V.mean_vector(v.where("vec_id % 2 = 0"), ["label"]).select(F.col("label").alias("name"), F.when(F.col("label") % 3 != 0, F.col("v")).alias("v"))
    probes = v.select(F.col("vec_id").alias("cluster_id"), F.when(F.col("vec_id") % 5 != 0, F.col("v")).alias("v"))
    return V.nearest(probes, prints, 2).select("cluster_id", "name", F.round("dist", 5).alias("dist"), "rank")


@query("refined_new_only", f"WITH {VEC}, n AS (SELECT label, sum((120.0 + vec_id % 5) * (vec_id % 9 + 1)) / sum(vec_id % 9 + 1) AS p, sum(vec_id % 9 + 1) AS t FROM vec WHERE vec_id % 2 = 1 GROUP BY label), l AS (SELECT DISTINCT label FROM vec) SELECT label AS name, round((CASE WHEN label < 8 THEN 100.0 ELSE p END)::DOUBLE, 1) AS pitch_hz, (CASE WHEN label < 8 THEN 60 ELSE t END)::DOUBLE AS total_speech_sec FROM l LEFT JOIN n USING (label) WHERE label < 8 OR t IS NOT NULL")
def refined_new_only(spark, d):
    """Samples of voiceprints that are stored already are left out."""
    v = vec(spark, d)
    samples = v.where("vec_id % 2 = 1").select(F.col("label").alias("name"), "v", (F.lit(120.0) + F.col("vec_id") % 5).alias("pitch_hz"), F.lit(0.05).alias("energy_rms"), (F.col("vec_id") % 9 + 1).cast("double").alias("duration"))
    stored = V.centroids(v.where("label < 8"), ["label"]).select(F.col("label").alias("name"), "v", F.lit(100.0).alias("pitch_hz"), F.lit(0.04).alias("energy_rms"), F.lit(60.0).alias("total_speech_sec"))
    return V.refined(samples, stored, skip_existing=True).select("name", F.round("pitch_hz", 1).alias("pitch_hz"), "total_speech_sec")


@query("embed_files", f"WITH {VEC}, u AS (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(list_transform(v, lambda x: x / {NORM.format(a='v')})) AS x, generate_subscripts(v, 1) AS p FROM vec) GROUP BY ALL), m AS (SELECT label, list(m ORDER BY p) AS v FROM u GROUP BY label) SELECT label AS file_id, list_transform(v, lambda x: round(x / {NORM.format(a='v')}, 5)) AS v FROM m")
def embed_files(spark, d):
    return V.embed_files(vec(spark, d).select(F.col("label").alias("file_id"), "v")).select("file_id", F.transform("v", lambda x: F.round(x, 5)).alias("v"))


@query(
    "add_new_prints",
    f"WITH {VEC}, {_by_label('m', 'true')}, r AS (SELECT label AS name, list_transform(v, lambda x: round(x, 5)) AS v FROM m) SELECT false AS overwritten, name, name >= 5 AS fresh, v FROM r WHERE name <> 7 UNION ALL SELECT true, name, true, v FROM r WHERE name <> 7",
)
def add_new_prints(spark, d):
    """Labels under 5 are stored, all are found anew, label 7 without a vector; kept and overwritten."""
    v = vec(spark, d)
    old = V.mean_vector(v.where("label < 5"), ["label"]).select(F.col("label").alias("name"), "v", F.lit(False).alias("fresh"))
    new = V.mean_vector(v, ["label"]).select(F.col("label").alias("name"), F.when(F.col("label") != 7, F.col("v")).alias("v"), F.lit(True).alias("fresh"))
    both = V.add_new(old, new).withColumn("overwritten", F.lit(False)).unionByName(V.add_new(old, new, True).withColumn("overwritten", F.lit(True)))
    return both.select("overwritten", "name", "fresh", F.transform("v", lambda x: rounded(x, 5)).alias("v"))


@query("add_samples", f"WITH {VEC}, {_by_label('m', 'true')}, a AS (SELECT label, round(avg(100.0 + vec_id % 5)::DOUBLE, 4) AS pitch_hz, 0.05::DOUBLE AS energy_rms, (60 + count(*))::DOUBLE AS total_speech_sec FROM vec GROUP BY label) SELECT label AS name, pitch_hz, energy_rms, total_speech_sec, list_transform({_unit('v')}, lambda x: round(x, 5)) AS v FROM a JOIN m USING (label)")
def add_samples(spark, d):
    v = vec(spark, d)
    samples = v.select(F.col("label").alias("name"), "v", (F.lit(100.0) + F.col("vec_id") % 5).alias("pitch_hz"), F.lit(0.06).alias("energy_rms"), F.lit(1.0).alias("duration"))
    stored = v.select(F.col("label").alias("name")).distinct().select("name", F.array_repeat(F.lit(1.0), 64).alias("v"), F.lit(90.0).alias("pitch_hz"), F.lit(0.04).alias("energy_rms"), F.lit(60.0).alias("total_speech_sec"))
    return V.add_samples(samples, stored).select("name", F.round("pitch_hz", 4).alias("pitch_hz"), F.round("energy_rms", 6).alias("energy_rms"), "total_speech_sec", F.transform("v", lambda x: F.round(x, 5)).alias("v"))


@query("rename_unknown", "WITH x AS (SELECT DISTINCT label % 2 AS file_id, CASE WHEN label > 3 THEN 'UNKNOWN_' || label ELSE 'name' || label END AS old FROM embeddings) SELECT file_id, old, CASE WHEN old LIKE 'UNKNOWN%' THEN 'SPEAKER' || row_number() OVER (PARTITION BY file_id, old LIKE 'UNKNOWN%' ORDER BY old) ELSE old END AS speaker FROM x")
def rename_unknown(spark, d):
    x = vec(spark, d).select((F.col("label") % 2).alias("file_id"), F.when(F.col("label") > 3, F.concat(F.lit("UNKNOWN_"), F.col("label"))).otherwise(F.concat(F.lit("name"), F.col("label"))).alias("old")).distinct()
    return V.renamed_unknown(x.withColumn("speaker", F.col("old"))).select("file_id", "old", "speaker")


@query("relabel_pitch", "SELECT vec_id % 10 AS file_id, vec_id AS speaker, 'SPEAKER' || row_number() OVER (PARTITION BY vec_id % 10 ORDER BY CASE WHEN label > 0 THEN label ELSE 9999 END, vec_id) AS label FROM embeddings")
def relabel_pitch(spark, d):
    return V.relabelled_by_pitch(vec(spark, d).select((F.col("vec_id") % 10).alias("file_id"), F.col("vec_id").alias("speaker"), F.col("label").cast("double").alias("pitch_hz"))).select("file_id", "speaker", "label")


@query("reassign_files", "WITH f AS (SELECT label AS s0, CASE WHEN label = 3 THEN 4 ELSE label END AS speaker, 'abc_' || lpad(CAST(vec_id // 60 % 60 AS VARCHAR), 2, '0') || '-' || lpad(CAST(vec_id % 60 AS VARCHAR), 2, '0') || '_90_' || vec_id AS file_name, vec_id FROM embeddings) SELECT CAST(speaker AS VARCHAR) AS speaker, file_name, CAST(vec_id // 60 % 60 * 60 + vec_id % 60 AS DOUBLE) AS start, row_number() OVER (PARTITION BY speaker ORDER BY file_name) AS number FROM f")
def reassign_files(spark, d):
    f = vec(spark, d).select(F.col("label").cast("string").alias("speaker"), F.format_string("abc_%02d-%02d_90_%d", (F.floor(F.col("vec_id") / 60) % 60), F.col("vec_id") % 60, F.col("vec_id")).alias("file_name"))
    moves = spark.range(1).select(F.lit("3").alias("speaker"), F.lit("4").alias("target"))
    return V.reassigned(f, moves).select("speaker", "file_name", "start", "number")
