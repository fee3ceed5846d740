"""Queries of the frame operators; the numbers of an embedding are a short signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import frames as R
from tessera.operators import segments as S
from tessera.operators import signals as G
from tessera.plans.adapters import VEC, rounded, vec
from tessera.sources import audio as A

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _signal(spark, d):
    return vec(spark, d).select(F.col("vec_id").alias("file_id"), F.col("v").alias("samples"), F.col("label").cast("string").alias("speaker"))


def _rms(x: str) -> str:
    return f"sqrt(list_sum(list_transform({x}, lambda x: x * x)) / len({x}))"


@query("energy", f"WITH {VEC} SELECT vec_id AS file_id, round({_rms('v')}, 6) AS energy FROM vec")
def energy(spark, d):
    return _signal(spark, d).select("file_id", F.round(R.rms(F.col("samples")), 6).alias("energy"))


@query("rms_filter", f"WITH {VEC} SELECT vec_id AS file_id FROM vec WHERE {_rms('v')} * (1 + vec_id % 5) >= 0.3")
def rms_filter(spark, d):
    """The signals are louder by the file's number, so that some are silent."""
    s = _signal(spark, d).withColumn("samples", F.transform("samples", lambda x: x * (1 + F.col("file_id") % 5)))
    return R.not_silent(s, least=0.3).select("file_id")


@query(
    "sliding_windows",
    f"""WITH {VEC}, n AS (SELECT vec_id AS file_id, CAST(64 - vec_id % 60 AS INTEGER) AS n FROM vec), f AS (SELECT file_id, n, (n - 16) // 6 + 1 AS k FROM n WHERE n >= 16),
    w AS (SELECT file_id, unnest(range(k)) * 6 AS start, unnest(range(k)) * 6 + 16 AS "end" FROM f UNION ALL SELECT file_id, k * 6, n FROM f WHERE n - k * 6 > 2 UNION ALL SELECT file_id, 0, n FROM n WHERE n < 16) SELECT file_id, start, "end" FROM w""",
)
def sliding_windows(spark, d):
    n = (F.lit(64) - F.col("file_id") % 60).cast("int")
    return _signal(spark, d).select("file_id", F.inline(R.windows(n, 16, 6, 2)))


@query("frame_energy", f"WITH {VEC}, k AS (SELECT vec_id AS file_id, v, unnest(range(7)) AS frame FROM vec) SELECT file_id, frame, round({_rms('v[frame * 8 + 1:frame * 8 + 16]')}, 6) AS energy FROM k")
def frame_energy(spark, d):
    return R.frame_rms(_signal(spark, d), 16, 8).select("file_id", "frame", F.round("energy", 6).alias("energy"))


@query(
    "vad_probabilities",
    f"""WITH {VEC}, p AS (SELECT vec_id AS file_id, unnest(v) AS prob, generate_subscripts(v, 1) - 1 AS frame FROM vec), r AS (SELECT *, sum(CASE WHEN prob > 0.0 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY frame) AS r FROM p),
    s AS (SELECT file_id, min(frame) / 100 AS start, (min(frame) + count(*)) / 100 AS "end" FROM r WHERE prob > 0.0 GROUP BY file_id, r HAVING count(*) >= 3),
    b AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY file_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.015 THEN 0 ELSE 1 END AS br FROM s),
    i AS (SELECT *, sum(br) OVER (PARTITION BY file_id ORDER BY start) AS i FROM b) SELECT file_id, round(min(start), 4) AS start, round(max("end"), 4) AS "end", count(*) AS n FROM i GROUP BY file_id, i""",
)
def vad_probabilities(spark, d):
    p = _signal(spark, d).select("file_id", F.posexplode("samples").alias("frame", "prob"))
    return R.probability_segments(p, 0.0, 30, 100, 0.015).select("file_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "n")


@query("vad_chunks", f"WITH {VEC}, n AS (SELECT vec_id AS file_id, CAST(vec_id AS DOUBLE) AS d FROM vec), k AS (SELECT file_id, d, unnest(range(greatest(CAST(ceil(d / 25) AS BIGINT), 1))) AS k FROM n) SELECT file_id, CAST(k * 25 AS DOUBLE) AS start, least(k * 25 + 30, d) AS \"end\" FROM k")
def vad_chunks(spark, d):
    return _signal(spark, d).select("file_id", F.inline(R.chunk_offsets(F.col("file_id").cast("double")))).select("file_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))


@query("audio_cut", f"WITH {VEC} SELECT vec_id AS file_id, list_transform(v[vec_id % 10 + 1:least(vec_id % 10 + 20, 64)], lambda x: round(x, 5)) AS part, 64 / 16.0::DOUBLE AS seconds FROM vec")
def audio_cut(spark, d):
    s = _signal(spark, d)
    a = (F.col("file_id") % 10).cast("double")
    return s.select("file_id", F.transform(A.cut(F.col("samples"), a, a + 20, 1), lambda x: rounded(x, 5)).alias("part"), A.duration(F.col("samples"), 16).alias("seconds"))


@query("chunk_padded", f"WITH {VEC}, k AS (SELECT vec_id AS file_id, unnest(range(3)) AS chunk, v FROM vec) SELECT file_id, chunk, list_transform(range(24), lambda i: round(coalesce(v[chunk * 24 + i + 1], 0.0), 5)) AS samples FROM k")
def chunk_padded(spark, d):
    c = S.chunk_padded(_signal(spark, d), size=24)
    return c.select("file_id", "chunk", F.transform("samples", lambda x: rounded(x.cast("double"), 5)).alias("samples"))


def _chunks(spark, d, size: int, times: int = 1):
    """The signals as chunks, so that frames, dips and speech lie across cuts."""
    s = _signal(spark, d)
    return G.chunked(s.withColumn("samples", F.flatten(F.array_repeat("samples", times))) if times > 1 else s, size)


@query("mean_removed", f"WITH {VEC}, f AS (SELECT vec_id, list_transform(range(8), lambda k: v[8 * k + 1:8 * k + 8]) AS f FROM vec) SELECT vec_id AS file_id, list_transform(f, lambda r: list_transform(r, lambda x, i: round(x - list_sum(list_transform(f, lambda g: g[i])) / 8, 5))) AS frames FROM f")
def mean_removed(spark, d):
    f = F.array(*[F.slice("samples", 8 * k + 1, 8) for k in range(8)])
    return _signal(spark, d).withColumn("f", f).select("file_id", F.transform(R.mean_removed(F.col("f")), lambda r: F.transform(r, lambda x: rounded(x, 5))).alias("frames"))


@query("concatenated", f"WITH {VEC} SELECT vec_id // 5 AS grp, flatten(list(list_transform(v, lambda x: round(x, 5)) ORDER BY vec_id)) AS samples FROM vec GROUP BY ALL")
def concatenated(spark, d):
    s = _signal(spark, d).select(F.floor(F.col("file_id") / 5).alias("grp"), F.col("file_id").alias("ord"), F.transform("samples", lambda x: x.cast("float")).alias("samples"))
    return A.concatenated(s, ["grp"]).select("grp", F.transform("samples", lambda x: rounded(x.cast("double"), 5)).alias("samples"))


@query("down_mix", f"WITH {VEC} SELECT vec_id AS file_id, list_transform(range(1, 33), lambda i: round((v[i] + v[i + 32]) / 2, 5)) AS mono FROM vec")
def down_mix(spark, d):
    c = F.array(F.slice("samples", 1, 32), F.slice("samples", 33, 32))
    return _signal(spark, d).withColumn("c", c).select("file_id", F.transform(R.down_mixed(F.col("c")), lambda x: rounded(x, 5)).alias("mono"))


@query(
    "energy_speech",
    f"""WITH {VEC}, k AS (SELECT vec_id AS file_id, v, unnest(range(62)) AS frame FROM vec), e AS (SELECT file_id, frame, frame / 100 AS start, (frame + 3) / 100 AS "end" FROM k WHERE {_rms('v[frame + 1:frame + 3]')} > 0.2),
    b AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY file_id ORDER BY frame) < 0.05 THEN 0 ELSE 1 END AS br FROM e), i AS (SELECT *, sum(br) OVER (PARTITION BY file_id ORDER BY frame) AS i FROM b)
    SELECT file_id, round(min(start), 4) AS start, round(max("end"), 4) AS "end" FROM i GROUP BY file_id, i UNION ALL SELECT vec_id, 0.0, 0.64 FROM vec WHERE vec_id NOT IN (SELECT file_id FROM e)""",
)
def energy_speech(spark, d):
    return R.energy_speech(_signal(spark, d), 100, 0.2, 0.05).select("file_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query(
    "dip_split",
    f"""WITH {VEC}, k AS (SELECT vec_id AS file_id, flatten(list_transform(range(10), lambda i: v)) AS v FROM vec), f AS (SELECT file_id, v, unnest(range(319)) AS frame FROM k), e AS (SELECT file_id, frame, {_rms('v[frame * 2 + 1:frame * 2 + 2]')} AS energy FROM f),
    m AS (SELECT *, energy < 0.7 * median(energy) OVER (PARTITION BY file_id) AS low FROM e), r AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY frame) AS r FROM m),
    d AS (SELECT file_id, (min(frame) + count(*) // 2) * 2 / 100 AS cut FROM r WHERE low GROUP BY file_id, r HAVING count(*) >= 2), c AS (SELECT file_id, [0.0::DOUBLE] || list(cut ORDER BY cut) || [6.4::DOUBLE] AS c FROM d GROUP BY file_id),
    p AS (SELECT file_id, unnest(range(1, len(c))) AS i, c FROM c), q AS (SELECT file_id, round(c[i], 4) AS start, round(c[i + 1], 4) AS "end" FROM p WHERE round(c[i + 1], 4) - round(c[i], 4) >= 0.2), s AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM q)
    SELECT file_id, 0 AS ord, CAST(row_number() OVER (PARTITION BY file_id ORDER BY start) - 1 AS INTEGER) AS piece, start, "end" FROM s WHERE n > 1 UNION ALL SELECT vec_id, 0, 0, 0.0, 6.4 FROM vec WHERE vec_id NOT IN (SELECT file_id FROM s WHERE n > 1)""",
)
def dip_split(spark, d):
    s = _signal(spark, d).select("file_id", F.lit(0).alias("ord"), F.lit(0.0).alias("start"), F.lit(6.4).alias("end"), F.flatten(F.array_repeat("samples", 10)).alias("samples"))
    return R.dip_split(s, 100, ratio=0.7, least_dip=0.04, least_piece=0.2)


def _lag(x: str, k: str, n: int) -> str:
    return f"list_dot_product({x}[1:{n} - {k}], {x}[1 + {k}:{n}])"


@query(
    "pitch",
    f"""WITH {VEC}, s AS (SELECT vec_id AS file_id, flatten(list_transform(range(40), lambda i: v)) AS v FROM vec), f AS (SELECT file_id, unnest([v[1:2048], v[513:2560]]) AS x FROM s), z AS (SELECT file_id, list_transform(x, lambda a: a - list_avg(x)) AS x FROM f),
    l AS (SELECT file_id, list_transform(range(53, 200), lambda k: {_lag('x', 'k', 2048)} / list_dot_product(x, x)) AS l FROM z), p AS (SELECT file_id, CASE WHEN list_max(l) >= 0.2 THEN 16000 / (52 + list_position(l, list_max(l))) ELSE 0 END AS p FROM l)
    SELECT file_id, round(coalesce(median(p) FILTER (WHERE p > 60 AND p < 400), 0.0), 4) AS pitch_hz, round(coalesce(stddev_pop(p) FILTER (WHERE p > 60 AND p < 400), 0.0), 4) AS pitch_std FROM p GROUP BY file_id""",
)
def pitch(spark, d):
    s = _signal(spark, d).withColumn("samples", F.flatten(F.array_repeat("samples", 40)))
    return R.pitch(s).select("file_id", F.round("pitch_hz", 4).alias("pitch_hz"), F.round("pitch_std", 4).alias("pitch_std"))


@query(
    "speaker_profiles",
    f"""WITH {VEC}, s AS (SELECT vec_id, label, flatten(list_transform(range(10), lambda i: v)) AS v FROM vec), f AS (SELECT vec_id, label, v[1:480] AS x FROM s), z AS (SELECT label, list_transform(x, lambda a: a - list_avg(x)) AS x FROM f),
    e AS (SELECT label, sqrt(list_dot_product(x, x) / 480) AS e, list_dot_product(x, x) AS n, list_transform(range(40, 266), lambda k: {_lag('x', 'k', 480)}) AS l FROM z),
    p AS (SELECT label, e, CASE WHEN list_max(l) > 0 AND list_max(l) / (n + 1e-9) >= 0.25 THEN 16000 / (39 + list_position(l, list_max(l))) END AS p FROM e WHERE e >= 1e-4)
    SELECT CAST(label AS VARCHAR) AS speaker, round(median(p), 1) AS pitch_hz, round(stddev_pop(p), 1) AS pitch_std, round(avg(e), 4) AS energy_rms, round(count(*) * 0.04, 1)::DOUBLE AS total_speech_sec FROM p GROUP BY label""",
)
def speaker_profiles(spark, d):
    """The figures that SQL can tell; the others are held against plain versions by test."""
    return _profiled(spark, d).select("speaker", "pitch_hz", "pitch_std", "energy_rms", "total_speech_sec")


def _profiled(spark, d):
    s = _signal(spark, d).withColumn("samples", F.flatten(F.array_repeat("samples", 10)))
    return R.profiles(s.select(F.lit(0).cast("long").alias("file_id"), "speaker", F.col("file_id").cast("double").alias("start"), (F.col("file_id") + 0.04).alias("end"), "samples"))


@query("speaker_spectra")
def speaker_spectra(spark, d):
    return _profiled(spark, d).drop("pitch_hz", "pitch_std", "energy_rms", "total_speech_sec")


# The same on chunks, held against the SQL of the whole signals.


@query("frame_energy_chunked", ORACLE_SQL["frame_energy"])
def frame_energy_chunked(spark, d):
    return G.frame_rms(_chunks(spark, d, 21), 16, 8).select("file_id", F.col("frame").cast("int").alias("frame"), F.round("energy", 6).alias("energy"))


@query("energy_speech_chunked", ORACLE_SQL["energy_speech"])
def energy_speech_chunked(spark, d):
    return G.energy_speech(_chunks(spark, d, 13), 100, 0.2, 0.05).select("file_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query("dip_split_chunked", ORACLE_SQL["dip_split"])
def dip_split_chunked(spark, d):
    c = _chunks(spark, d, 97, 10)
    whole = G.lengths(c).select("file_id", F.lit(0).alias("ord"), F.lit(0.0).alias("start"), F.lit(6.4).alias("end"))
    return G.dip_split(c, whole, 100, ratio=0.7, least_dip=0.04, least_piece=0.2)


@query("pitch_chunked", ORACLE_SQL["pitch"])
def pitch_chunked(spark, d):
    return G.pitch(_chunks(spark, d, 2050, 40)).select("file_id", F.round("pitch_hz", 4).alias("pitch_hz"), F.round("pitch_std", 4).alias("pitch_std"))


@query("audio_cut_chunked", f"WITH {VEC}, p AS (SELECT vec_id AS file_id, k, v, vec_id % 7 + k * 9 AS a, vec_id % 7 + k * 19 + 3 AS b FROM vec, range(3) r(k)) SELECT file_id, k AS ord, list_transform(v[a + 1:least(b, 64)], lambda x: round(x, 5)) AS samples FROM p")
def audio_cut_chunked(spark, d):
    """Pieces of every signal, of one sample to several chunks."""
    c = _chunks(spark, d, 10)
    a = (F.col("file_id") % 7).cast("double")
    p = G.lengths(c).select("file_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord")).select("file_id", F.col("ord").cast("long").alias("ord"), (a + F.col("ord") * 9).alias("start"), (a + F.col("ord") * 19 + 3).alias("end"))
    return G.sliced(c, p, 1, 8).select("file_id", "ord", F.transform("samples", lambda x: rounded(x, 5)).alias("samples"))


@query("speaker_profiles_chunked", ORACLE_SQL["speaker_profiles"])
def speaker_profiles_chunked(spark, d):
    s = _signal(spark, d).select("file_id", "speaker")
    seg = s.select("file_id", "speaker", F.lit(0.0).alias("start"), F.lit(0.04).alias("end"))
    # A file is a signal here; the speakers of all files are one, as in the query on whole signals.
    c = _chunks(spark, d, 500, 10)
    per = G.sliced(c, seg, halo=500)
    return R.profiles(per.select(F.lit(0).cast("long").alias("file_id"), "speaker", F.col("file_id").cast("double").alias("start"), (F.col("file_id") + 0.04).alias("end"), "samples")).select("speaker", "pitch_hz", "pitch_std", "energy_rms", "total_speech_sec")


@query("filterbank")
def filterbank(spark, d):
    """Each signal nine times over, as an embedding model's input: Kaldi's filterbank less its mean over time."""
    s = _signal(spark, d).select("file_id", F.flatten(F.array_repeat("samples", 9)).alias("samples"))
    return R.filterbanks(s).select("file_id", F.transform(R.mean_removed(F.col("frames")), lambda r: F.transform(r, lambda x: F.round(x, 2))).alias("frames"))


@query("resampled", f"WITH {VEC} SELECT vec_id AS file_id, CAST(ceil(640 * 160 / 441.0) AS BIGINT) AS n, true AS level FROM vec")
def resampled(spark, d):
    """A signal of its own mean throughout, at 44,100 hertz in chunks, keeps its level at 16,000: its middle is that mean."""
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / 64
    s = _signal(spark, d).select("file_id", F.transform(F.sequence(F.lit(1), F.lit(640)), lambda _: mean).alias("samples"))
    c = G.resampled(G.chunked(s, 200), 44_100)
    back = c.groupBy("file_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "samples"))), lambda x: x["samples"])).alias("x"))
    flat = F.forall(F.slice("x", 60, 110), lambda x: F.abs(x - F.col("m")) < 1e-3)
    return back.join(s.select("file_id", F.get("samples", F.lit(0)).alias("m")), "file_id").select("file_id", F.size("x").cast("long").alias("n"), flat.alias("level"))
