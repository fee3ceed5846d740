"""Operators against plain versions, nulls and empty tables, and the whole flow on sound that is made up."""

import collections
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import frames as R
from tessera.operators import segments as S
from tessera.operators import signals as G
from tessera.operators import vectors as V
from tessera.plans import pipelines as P
from tessera.sources import audio as A

RATE = 16_000


def test_config():
    c = Config({"matching": {"accept_threshold": 0.5}, "own": {"x": 1}})
    assert c.get("matching", "accept_threshold") == 0.5 and c.get("matching", "clear_winner_gap") == 0.02 and Config().get("matching", "accept_threshold") == 0.35
    assert c.get("own", "x") == 1 and c.get("own", "y", 7) == 7 and c.get("none", default=3) == 3 and c.get("none", "x", 4) == 4
    assert c.get("normalization")["mfcc12_std_per_unit"] == 3 and c.get("normalization")["mfcc1_mean_per_unit"] == 8


def test_retries_give_error_rows(spark):
    def model(pdf):
        if (pdf["id"] % 2 == 0).any():
            raise ValueError("even")
        return pdf.assign(text="t" + pdf["id"].astype(str))

    d = spark.range(4).repartition(4, "id").withColumn("other", F.lit(1))
    got = {r.id: (r.text, r.error) for r in S.mapped_batches(d, model, "id long, text string, error string", wait=0.01).collect()}
    assert set(got) == {0, 1, 2, 3} and all((e is None) == (t is not None) for t, e in got.values()) and got[0] == (None, "ValueError: even")
    assert S.mapped_batches(d.limit(0), model, "id long, text string, error string").count() == 0


def test_broadcasts_are_sized(spark):
    few = spark.range(50).select(F.col("id").cast("string").alias("name"), F.array_repeat(F.lit(1.0), 100).alias("v"))
    assert V.fits(few) and not V.fits(few, rows=49) and not V.fits(few, size=30_000) and V.fits(few.limit(0))
    near = V.nearest(spark.createDataFrame([(1, [1.0] * 100), (2, None), (3, [0.0] * 100)], "cluster_id long, v array<double>"), few.unionByName(few.limit(1).select(F.lit("none").alias("name"), F.lit(None).cast("array<double>").alias("v"))), 2)
    assert [(r.cluster_id, r.name, r.rank) for r in near.orderBy("rank").collect()] == [(1, "0", 1), (1, "1", 2)]


def plain_linkage(v, most, far):
    """Average linkage by all pairs again and again."""
    groups = [[k] for k in range(len(v))]
    dist = lambda a, b: 1 - float(v[a] @ v[b] / (np.linalg.norm(v[a]) * np.linalg.norm(v[b])))
    while len(groups) > 1 and (most is None or len(groups) > most):
        pairs = [(sum(dist(x, y) for x in g for y in h) / (len(g) * len(h)), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        d, i, j = min(pairs)
        if far is not None and d >= far:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("most,far", [(None, 0.5), (None, 0.9), (3, None), (1, None)])
def test_clusters_equal_plain_average_linkage(spark, most, far):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for f in range(6):
        v = r.normal(size=(int(r.integers(1, 18)), 6))
        want[f] = plain_linkage(v, most, far)
        rows += [(f, k, x.tolist()) for k, x in enumerate(v)] + [(f, 100, None)]
    got = collections.defaultdict(lambda: collections.defaultdict(set))
    df = spark.createDataFrame(rows, "file_id long, vec_id long, v array<double>")
    for x in V.clustered(df, clusters=most, far=far or 0.35, near=None).collect():
        got[x.file_id][x.cluster].add(x.vec_id)
    assert {f: {frozenset(g) for g in c.values()} for f, c in got.items()} == want
    assert V.clustered(df.limit(0)).count() == 0
    capped = V.clustered(df, far=0.01, most=4, near=None).groupBy("file_id").agg(F.countDistinct("cluster").alias("n")).collect()
    assert max(x.n for x in capped) == 4
    unknown = V.unknown_clusters(df.withColumnRenamed("vec_id", "ord"), far=0.01, most=4).where("file_id = 1").orderBy("ord").collect()
    assert unknown[0].name == "UNKNOWN_1" and {x.name for x in unknown} == {f"UNKNOWN_{k + 1}" for k in range(len({x.name for x in unknown}))} and unknown[0].dist == 1.0


def plain_mfcc(x):
    out = []
    for i in range(0, len(x) - 399, 160):
        f = x[i : i + 400] - np.mean(x[i : i + 400])
        f = np.array([f[k] - 0.97 * f[max(0, k - 1)] for k in range(400)])
        f = f * np.array([(0.5 - 0.5 * math.cos(2 * math.pi * k / 399)) ** 0.85 for k in range(400)])
        power = np.abs(np.fft.fft(f, 512)[:256]) ** 2
        mel = lambda h: 1127 * math.log(1 + h / 700)
        step = (mel(8000) - mel(20)) / 24
        bank = []
        for b in range(23):
            left = mel(20) + b * step
            weight = [max(0.0, min((mel(k * 31.25) - left) / step, (left + 2 * step - mel(k * 31.25)) / step)) for k in range(256)]
            bank.append(math.log(max(float(np.dot(weight, power)), np.finfo(np.float32).eps)))
        out.append([(1 + 11 * math.sin(math.pi * n / 22)) * math.sqrt((1 if n == 0 else 2) / 23) * sum(e * math.cos(math.pi * n * (b + 0.5) / 23) for b, e in enumerate(bank)) for n in range(13)])
    return np.array(out)


def test_mfcc_and_spectrum():
    r = np.random.default_rng(3)
    x = np.sin(np.arange(1400) / 9) * 0.2 + r.normal(size=1400) * 0.01
    assert np.allclose(R.mfcc(x), plain_mfcc(x))
    tone = np.sin(2 * np.pi * 1000 * np.arange(8000) / RATE)
    centroid, rolloff = R.spectral(tone)
    assert 900 < centroid < 1200 and 950 < rolloff < 1100
    assert R.spectral(np.zeros(8000)) == (0.0, 0.0) and R.spectral(np.ones(10)) == (0.0, 0.0) and len(R.mfcc(np.ones(10))) == 0


def test_profiles_take_the_first_seconds_of_a_speaker_not_of_a_segment(spark, monkeypatch):
    monkeypatch.setattr(R, "PROFILE_SECONDS", 1)
    r = np.random.default_rng(8)
    t = np.arange(int(0.8 * RATE)) / RATE
    parts = [np.sin(2 * np.pi * f * t) * 0.3 + r.normal(size=len(t)) * 0.01 for f in (150, 220, 300)]
    rows = [(1, "a", 5.0, 5.8, parts[1].tolist()), (1, "a", 1.0, 1.8, parts[0].tolist()), (1, "a", 9.0, 9.8, parts[2].tolist()), (1, "b", 2.0, 3.0, None), (1, "c", 4.0, 4.5, [0.0] * 8000)]
    d = spark.createDataFrame(rows, "file_id long, speaker string, start double, end double, samples array<double>")
    got = {x.speaker: x for x in R.profiles(d).collect()}
    first = np.concatenate(parts)[:RATE]
    c = R.mfcc(first)
    assert got["a"].mfcc3_mean == pytest.approx(c[:, 3].mean()) and got["a"].mfcc12_std == pytest.approx(c[:, 12].std()) and got["a"].spectral_centroid == pytest.approx(R.spectral(first)[0])
    assert got["a"].total_speech_sec == 2.4 and got["a"].pitch_hz == pytest.approx(220, abs=3) and round(got["a"].energy_rms, 4) == got["a"].energy_rms
    assert (got["b"].pitch_hz, got["b"].energy_rms, got["b"].mfcc0_mean, got["b"].total_speech_sec) == (0.0, 0.0, None, 1.0) and got["c"].spectral_centroid is None
    assert R.profiles(d.limit(0)).count() == 0


def test_dips_in_silence_and_short_signals_are_left(spark):
    d = spark.createDataFrame([(1, 0, 0.0, 6.0, [0.0] * 600), (2, 0, 0.0, 6.0, [0.5] * 3), (3, 0, 0.0, 6.0, None)], "file_id long, ord long, start double, end double, samples array<double>")
    assert {(r.file_id, r.start, r.end) for r in R.dip_split(d, 100).collect()} == {(k, 0.0, 6.0) for k in (1, 2, 3)}
    assert R.pitch(d).where("pitch_hz <> 0").count() == 0


def test_segments_of_no_rows(spark):
    none = spark.createDataFrame([], "file_id long, ord long, speaker string, start double, end double, confidence double")
    for f in (S.collapse, S.merge_trim, S.merge_any, S.refine, S.overlaps, S.identified, S.split_even, S.split_fixed, S.pack_greedy, S.group_capped, S.absorb_islands, S.drop_ghosts, S.speaker_totals, S.talkative, S.mode_ratio, S.first_appearance, S.review, S.boundary_windows):
        assert f(none).count() == 0, f.__name__


def test_file_ids_of_any_type_and_rows_without_times(spark):
    rows = [("a/b.wav", k, k * 2.0, k * 2.0 + 1.9, "xyx"[k % 3]) for k in range(9)]
    d = spark.createDataFrame([*rows, ("a/b.wav", 20, None, 3.0, "x"), ("c", 21, 3.0, None, "x")], "file_id string, ord int, start double, end double, speaker string")
    for f in (S.pack_greedy, S.group_capped, S.absorb_islands, S.drop_ghosts, lambda d: S.clamp_boundaries(d, d.select("file_id", "ord", F.lit(1.0).alias("boundary")))):
        got = f(d)
        assert dict(got.dtypes)["file_id"] == "string" and dict(got.dtypes)["ord"] == "int" and got.select("file_id").distinct().collect() == [("a/b.wav",)]
    said = S.transcribe_carried(spark.createDataFrame([("f", 1, "x"), ("f", 0, "y")], "file_id string, ord long, text string"), lambda t, p: p + t, lambda t: t[-1:])
    assert [tuple(r) for r in said.collect()] == [("f", "y yx")]


def plain_islands(rows, short):
    rows = [list(r) for r in rows]
    while True:
        changed = False
        for k in range(1, len(rows) - 1):
            if rows[k][1] - rows[k][0] < short and rows[k - 1][2] == rows[k + 1][2] != rows[k][2]:
                rows[k][2], changed = rows[k - 1][2], True
        if not changed:
            return [tuple(r) for r in rows]
        out = []
        for r in sorted(rows, key=lambda r: r[0]):
            if out and out[-1][2] == r[2] and r[0] - out[-1][1] <= 0:
                out[-1][1] = max(out[-1][1], r[1])
            else:
                out.append(r)
        rows = out


def test_absorbing_equals_a_plain_loop(spark):
    r = random.Random(4)
    rows, want = [], {}
    for f in range(40):
        at, mine = 0.0, []
        for _ in range(r.randint(1, 25)):
            size = r.choice([0.25, 0.5, 1.5, 3.0])
            mine.append((at, at + size, r.choice("abc")))
            at += size + r.choice([0.0, 0.0, 0.5])
        want[f] = plain_islands(mine, 1.0)
        rows += [(f, k, s, e, w) for k, (s, e, w) in enumerate(mine)]
    got = collections.defaultdict(list)
    for x in S.absorb_islands(spark.createDataFrame(rows, "file_id long, ord long, start double, end double, speaker string")).orderBy("file_id", "start").collect():
        got[x.file_id].append((x.start, x.end, x.speaker))
    assert got == want


def test_sources_and_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("a b 3",), ("",), (None,), ("no number",), ("x 99999999999",)], "value string")
    assert [tuple(r) for r in A.parse_vocabulary(lines).collect()] == [("a b", 3)]
    d = spark.createDataFrame([(f"/x/{n}.wav", "ann", 65.0, 66.5, 0.875, [0.5, -0.5]) for n in ("one", "two")] + [("noext", "bob", 0.0, 1.0, None, None)], "path string, speaker string, start double, end double, confidence double, samples array<float>")
    A.write_segments(d, f"{tmp_path}/seg", 8000)
    back = spark.read.parquet(f"{tmp_path}/seg").collect()
    assert {r.speaker for r in back} == {"ann", "bob"} and all(r.file_name.endswith("s.wav") for r in back) and any("_01-05_88_1.5s" in r.file_name for r in back)
    x, rate = A.decode_wav(bytes(next(r.content for r in back if r.speaker == "ann")))
    assert rate == 8000 and np.allclose(x, [0.5, -0.5], atol=1e-4)
    s = spark.createDataFrame([(1, 0, "a", 0.0, 2.0, 0.5), (1, 1, "a", 3.0, 4.0, 0.7), (1, 2, "b", 4.0, 5.0, None)], "file_id long, ord long, speaker string, start double, end double, confidence double")
    A.write_review(s, f"{tmp_path}/review")
    j = spark.read.json(f"{tmp_path}/review").first()
    assert [(q.speaker, q.segments, q.seconds) for q in j.speakers] == [("a", 2, 3.0), ("b", 1, 1.0)] and len(j.segments) == 3
    had = spark.createDataFrame([([0.0], "broken"), ([0.0] * 40, None)], "samples array<double>, error string")
    assert [r.error for r in A.guarded(had, 2 / RATE).collect()] == ["broken", "audio too long"]
    done = spark.createDataFrame([("/out/a.wav",)], "path string")
    files = spark.createDataFrame([("/in/a.mp3",), ("/in/b.mp3",)], "path string")
    assert [r.path for r in A.not_converted(files, done).collect()] == ["/in/b.mp3"]
    prints = spark.createDataFrame([("ann", [0.5, 1.0], 120.0, 0.1, 9.0)], "name string, v array<double>, pitch_hz double, energy_rms double, total_speech_sec double")
    A.write_voiceprints(prints, f"{tmp_path}/prints")
    assert [tuple(r) for r in A.read_voiceprints(spark, f"{tmp_path}/prints").collect()] == [tuple(r) for r in prints.collect()]
    assert V.refined(prints.select("name", "v", "pitch_hz", "energy_rms", F.lit(5.0).alias("duration")), prints, skip_existing=True).first().total_speech_sec == 9.0


def test_whole_flow_on_made_up_sound(spark, tmp_path):
    """Two speakers, tones with overtones, in turns with pauses; one of them is known. From a file read in chunks to named segments, and the same from the file as one row."""
    def spectrum(samples: pd.Series) -> pd.Series:
        """A stand-in for an embedding model: the size of 40 bands up to 800 Hz."""
        out = []
        for x in samples:
            s = np.abs(np.fft.rfft(np.asarray(x, float), RATE))[: 40 * 20].reshape(40, 20).sum(axis=1) if x is not None and len(x) else np.zeros(40)
            out.append((s / max(1e-9, np.linalg.norm(s))).tolist())
        return pd.Series(out)

    r = np.random.default_rng(1)

    def voice(pitch, seconds):
        t = np.arange(int(seconds * RATE)) / RATE
        return sum(np.sin(2 * np.pi * pitch * k * t) / k for k in (1, 2, 3)) * 0.2 + r.normal(size=len(t)) * 0.002

    embed = F.pandas_udf(spectrum, "array<double>")
    turns = [(120, 7.0), (210, 6.5), (120, 6.0), (210, 7.5)]
    sound, at, want = [], 0.0, []
    for pitch, seconds in turns:
        sound += [voice(pitch, seconds), np.zeros(int(0.8 * RATE))]
        want.append((at, at + seconds, pitch))
        at += seconds + 0.8
    (tmp_path / "calls").mkdir()
    (tmp_path / "calls" / "f.wav").write_bytes(A.encode_wav(np.concatenate(sound)))
    chunks = A.read_sound(spark, str(tmp_path), seconds=5.0077)
    audio = A.decoded(A.media_files(spark, str(tmp_path))).select(F.col("path").alias("file_id"), "samples")
    windows = P.embedded(audio, P.speech_windows(audio), embed).select("file_id", "ord", "start", "end", "v")
    ann = spectrum(pd.Series([voice(120, 3.0)]))[0]
    prints = spark.createDataFrame([("Ann", ann, 120.0, 0.15, 60.0)], "name string, v array<double>, pitch_hz double, energy_rms double, total_speech_sec double")
    got = P.diarised(windows, prints, audio=audio, embed=embed).orderBy("start").collect()
    again = P.diarised_files(chunks, embed, prints).orderBy("start").collect()
    assert [tuple(g)[1:] for g in again] == [tuple(g)[1:] for g in got] and {g.file_id.split("/")[-1] for g in (*got, *again)} == {"f.wav"} and len(chunks.collect()) > 5
    assert [g.speaker for g in got] == ["Ann", "SPEAKER2", "Ann", "SPEAKER2"]  # by pitch, Ann being the first
    for g, (a, b, _) in zip(got, want):
        assert abs(g.start - a) < 1.0 and abs(g.end - b) < 1.0 and 0.5 < g.confidence <= 1.0
