"""Chunked signals against the same signals as one array, resampling, and the filterbank."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import frames as R
from tessera.operators import signals as G
from tessera.sources.audio import cut
from tessera.sources.resample import Resampler, resampled

RATE = 16_000
CUTS = [700, 1000, 50_000]


def noisy(seed, n):
    """Noise with stretches of silence, of dips and of tones, also across cuts."""
    r = np.random.default_rng(seed)
    x = r.normal(size=n) * 0.1
    for _ in range(n // 400):
        a, m = int(r.integers(0, n)), int(r.integers(20, 300))
        x[a : a + m] *= r.choice([0.0, 0.05, 3.0])
    return x


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"f{k}", noisy(k, n).tolist()) for k, n in enumerate([5000, 3999, 1000, 700, 701, 1, 20])] + [("none", None), ("empty", [])]
    return spark.createDataFrame(rows, "file_id string, samples array<double>").cache()


def rounded(df):
    return sorted(tuple(round(x, 5) if isinstance(x, float) else tuple(round(y, 6) for y in x) if isinstance(x, list) else x for x in r) for r in df.collect())


def test_chunks_are_the_file(spark, files):
    for size in CUTS:
        c = G.chunked(files, size)
        assert G.is_chunked(c) and not G.is_chunked(files)
        back = c.groupBy("file_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "samples"))), lambda s: s["samples"])).alias("samples"))
        assert rounded(back) == rounded(files.withColumn("samples", F.coalesce("samples", F.array().cast("array<double>"))))
        assert c.where("size(samples) <> n OR n > " + str(size)).count() == 0
    assert rounded(G.lengths(G.chunked(files, 700))) == rounded(files.select("file_id", F.greatest(F.coalesce(F.size("samples"), F.lit(0)), F.lit(0)).cast("long")))


@pytest.mark.parametrize("size", CUTS)
@pytest.mark.parametrize("frame,hop", [(30, 10), (16, 16), (10, 30), (699, 7)])
def test_frames_equal_those_of_the_whole(spark, files, size, frame, hop):
    assert rounded(G.frame_rms(G.chunked(files, size), frame, hop)) == rounded(R.frame_rms(files, frame, hop))


@pytest.mark.parametrize("size", CUTS)
def test_speech_equals_that_of_the_whole(spark, files, size):
    c = G.chunked(files, size)
    has = files.where("samples IS NOT NULL")
    assert rounded(G.energy_speech(c, 1000, 0.08, 0.02).where("file_id <> 'none'")) == rounded(R.energy_speech(has, 1000, 0.08, 0.02))
    whole = R.speech_segments(has, lambda d: R.energy_speech(d, 1000, 0.08, 0.02), 0.03, 0.1)
    assert rounded(G.speech_segments(c, lambda d: G.energy_speech(d, 1000, 0.08, 0.02), 0.03, 0.1).where("file_id <> 'none'")) == rounded(whole)


def pieces(spark, rate):
    r = np.random.default_rng(9)
    rows = []
    for k, n in enumerate([5000, 3999, 1000, 700, 701, 1, 20]):
        for j in range(12):
            a = float(r.uniform(0, 1.1 * n / rate))
            rows.append((f"f{k}", j, a, a + float(r.choice([0.0, 0.01, 0.3, 1.0, 2.5])), "ab"[j % 2]))
    rows += [("f0", 50, 0.5, None, "a"), ("f0", 51, 0.0, 4.0, "b"), ("f0", 51, 0.0, 4.0, "b"), ("f0", 52, 0.1, 0.2, "b"), ("f0", 52, 0.1, 0.2, "b"), ("empty", 0, 0.0, 1.0, "a"), ("unknown", 0, 0.0, 1.0, "a")]
    return spark.createDataFrame(rows, "file_id string, ord long, start double, end double, speaker string")


@pytest.mark.parametrize("size,halo", [(700, 100), (1000, 999), (50_000, 1), (700, 1)])
def test_pieces_are_cut_across_chunks(spark, files, size, halo):
    p = pieces(spark, 1000)
    want = p.join(files.where("samples IS NOT NULL").withColumnRenamed("samples", "x"), "file_id").select(*p.columns, cut(F.col("x"), F.col("start"), F.col("end"), 1000).alias("samples"))
    assert sorted(map(str, G.sliced(G.chunked(files, size), p, 1000, halo).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("size", CUTS)
def test_dips_across_cuts(spark, files, size):
    p = pieces(spark, 1000).where("end IS NOT NULL").dropDuplicates(["file_id", "ord"])
    x = files.where("samples IS NOT NULL").withColumnRenamed("samples", "x")
    whole = p.join(x, "file_id").withColumn("samples", cut(F.col("x"), F.col("start"), F.col("end"), 1000)).select("file_id", "ord", "start", "end", "samples")
    want = R.dip_split(whole, 1000, longest=0.25, ratio=0.8, least_dip=0.03, least_piece=0.05)
    got = G.dip_split(G.chunked(files, size), p.join(x.select("file_id"), "file_id"), 1000, longest=0.25, ratio=0.8, least_dip=0.03, least_piece=0.05)
    assert rounded(got) == rounded(want) and got.groupBy("file_id", "ord").count().where("count > 1").count() > 3


def tones(spark):
    t = np.arange(5 * RATE) / RATE
    r = np.random.default_rng(2)
    rows = [(k, (np.sin(2 * np.pi * f * t) * 0.3 + np.sin(2 * np.pi * 2 * f * t) * 0.1 + r.normal(size=len(t)) * 0.01).astype(np.float32).tolist()) for k, f in enumerate((110, 180, 240))]
    return spark.createDataFrame(rows, "file_id long, samples array<float>")


@pytest.mark.parametrize("size", [9001, 30_000])
def test_pitch_and_profiles_equal_those_of_the_whole(spark, size):
    files = tones(spark)
    chunks = G.chunked(files, size)
    assert rounded(G.pitch(chunks)) == rounded(R.pitch(files))
    seg = spark.createDataFrame([(k, "ab"[j % 2], j * 0.9 + 0.0313, j * 0.9 + 0.9) for k in range(3) for j in range(5)] + [(0, "c", 0.0, 5.0)], "file_id long, speaker string, start double, end double")
    whole = seg.join(files.withColumnRenamed("samples", "x"), "file_id").withColumn("samples", cut(F.col("x"), F.col("start"), F.col("end"))).drop("x")
    assert [[pytest.approx(v, abs=1e-6) for v in r] for r in rounded(R.profiles(whole))] == [list(r) for r in rounded(G.profiles(chunks, seg, part=0.25, halo=size))]


def test_windows_of_chunks(spark, files):
    want = files.where("size(samples) > 0").select("file_id", F.inline(R.windows(F.size("samples"), 400, 170, 50)))
    assert rounded(G.sliding_windows(G.chunked(files, 700).where("n > 0"), 400, 170, 50)) == rounded(want)


@pytest.mark.parametrize("rate,to", [(44_100, 16_000), (48_000, 16_000), (8000, 16_000), (16_000, 16_000), (22_050, 16_000), (16_000, 11_025)])
def test_resampling_keeps_what_is_below_and_stops_what_is_above(rate, to):
    n, low = rate, min(rate, to) / 2
    level = lambda x: 20 * math.log10(max(1e-9, np.sqrt(2 * np.mean(x[len(x) // 8 : -len(x) // 8] ** 2))))
    tone = lambda f, r: np.sin(2 * np.pi * f * np.arange(r) / r)
    for f in (50, 0.25 * low, 0.8 * low):
        got = resampled(tone(f, n), rate, to)
        assert len(got) == to and abs(level(got)) < 0.1
        assert np.abs(got - tone(f, to))[to // 8 : -to // 8].max() < 0.01
    if rate > to:
        for f in (1.02 * low, 1.2 * low):
            assert level(resampled(tone(f, n), rate, to)) < -60
    assert np.allclose(resampled(np.ones(n), rate, to)[to // 8 : -to // 8], 1, atol=1e-6)


def test_any_part_of_a_resampled_signal_is_that_of_the_whole(spark):
    x = noisy(1, 44_100)
    r = Resampler(44_100, 16_000)
    whole = resampled(x, 44_100, 16_000)
    for a, b in [(0, 1), (5000, 5001), (4321, 9876), (15_990, 16_000), (7, 7)]:
        base = max(0, a * 441 // 160 - r.reach - 3)
        assert np.allclose(r.part(x[base : b * 441 // 160 + r.reach + 5], base, a, b), whole[a:b], atol=1e-7)
    df = spark.createDataFrame([(1, x.tolist()), (2, x[:100].tolist()), (3, [])], "file_id long, samples array<double>")
    for size in (5000, 44_100):
        chunks = G.resampled(G.chunked(df, size), 44_100)
        back = {k: [] for k in (1, 2, 3)}
        for c in chunks.orderBy("file_id", "chunk").collect():
            assert c.first == len(back[c.file_id]) and c.n == len(c.samples)
            back[c.file_id] += c.samples
        assert np.allclose(back[1], whole, atol=1e-7) and np.allclose(back[2], resampled(x[:100], 44_100, 16_000), atol=1e-7) and back[3] == []


def plain_fbank(x, bands=80):
    """Kaldi's definition step by step: per frame the mean, pre-emphasis, Hamming window, 512 points, triangles in mel."""
    mel = lambda h: 1127 * math.log(1 + h / 700)
    step = (mel(8000) - mel(20)) / (bands + 1)
    out = []
    for i in range(0, len(x) - 399, 160):
        f = [v * 32768 for v in x[i : i + 400]]
        f = [v - sum(f) / 400 for v in f]
        f = [f[k] - 0.97 * f[max(0, k - 1)] for k in range(400)]
        f = [f[k] * (0.54 - 0.46 * math.cos(2 * math.pi * k / 399)) for k in range(400)]
        power = np.abs(np.fft.fft(f, 512)[:256]) ** 2
        row = []
        for b in range(bands):
            left, mid, right = (mel(20) + (b + k) * step for k in range(3))
            weights = [(m - left) / step if left < m <= mid else (right - m) / step if mid < m < right else 0.0 for m in (mel(k * 31.25) for k in range(256))]
            row.append(math.log(max(float(np.dot(weights, power)), float(np.finfo(np.float32).eps))))
        out.append(row)
    return np.array(out)


def test_filterbank_is_kaldis(spark):
    r = np.random.default_rng(3)
    x = np.sin(np.arange(1200) / 7) * 0.2 + r.normal(size=1200) * 0.01
    assert np.allclose(R.fbank(x), plain_fbank(x), atol=1e-4) and R.fbank(x).shape == (6, 80)
    assert R.fbank(np.zeros(399)).shape == (0, 80) and np.allclose(R.fbank(np.zeros(400)), math.log(np.finfo(np.float32).eps))
    df = spark.createDataFrame([("a", 1, x.tolist()), ("b", 2, None), ("c", 3, [0.0] * 10), ("d", 4, x[:400].tolist())], "file_id string, ord int, samples array<double>")
    got = {k.file_id: k.frames for k in R.filterbanks(df).collect()}
    assert np.allclose(got["a"], plain_fbank(x), atol=1e-4) and got["b"] == got["c"] == [] and len(got["d"]) == 1
    mean = R.filterbanks(df.where("ord = 1")).select(R.mean_removed(F.col("frames")).alias("m")).first().m
    assert np.allclose(np.mean(mean, axis=0), 0, atol=1e-4)
