"""The sound source: WAV and FLAC, ranges, damaged files, and what a writer leaves behind."""

import io
import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import signals as G
from tessera.sources import audio as A
from tessera.sources import flac, sound
from tessera.sources.resample import resampled


def wav_file(x, rate, kind, bits, extensible=False):
    """x (n, channels) as a WAV file of any of the kinds that are read."""
    data = x.astype(f"<f{bits // 8}").tobytes() if kind == sound.FLOAT else (x.astype(np.uint8).tobytes() if bits == 8 else (x.astype("<i4") << 32 - bits).view(np.uint8).reshape(-1, 4)[:, 4 - bits // 8 :].tobytes())
    c = x.shape[1]
    form = struct.pack("<HHIIHH", sound.EXTENSIBLE if extensible else kind, c, rate, rate * c * bits // 8, c * bits // 8, bits)
    if extensible:
        form += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", kind) + bytes(14)
    parts = [(b"fmt ", form), (b"LIST", b"odd"), (b"data", data)]
    body = b"".join(n + struct.pack("<I", len(d)) + d + bytes(len(d) % 2) for n, d in parts)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
@pytest.mark.parametrize("extensible", [False, True])
def test_wav_of_all_widths(bits, extensible):
    r = np.random.default_rng(bits)
    x = r.integers(-(1 << bits - 1), 1 << bits - 1, (101, 2))
    got, rate = sound.decoded_bytes(wav_file(x + 128 if bits == 8 else x, 8000, sound.PCM, bits, extensible))
    assert rate == 8000 and np.allclose(got, x.mean(axis=1) / (1 << bits - 1), atol=1e-6)
    f = r.normal(size=(50, 1))
    assert np.allclose(sound.decoded_bytes(wav_file(f, 8000, sound.FLOAT, 64 if bits == 8 else 32, extensible))[0], f[:, 0], atol=1e-6)


@pytest.mark.parametrize("content", [b"", b"RIFF", b"RIFF0000WAVE", b"x" * 100, b"fLaC", b"fLaC\x80\x00\x00\x22" + bytes(10), sound.wav(np.zeros(100), 8000)[:30], wav_file(np.zeros((9, 1)), 8000, 7, 16)])
def test_broken_files_are_errors(content):
    with pytest.raises(Exception):  # noqa: B017
        sound.decoded_bytes(content)


def flac_whole(data, a=0, b=None):
    f = flac.Flac.opened(io.BytesIO(data), len(data))
    return f.whole(a, f.frames if b is None else b)


def shapes(seed, n, channels, width):
    """Tones with noise, noise alone, ramps and silence, after one another."""
    r, t = np.random.default_rng(seed), np.arange(n)[:, None]
    top = (1 << width - 1) - 1
    kinds = [np.sin(t / 9 + np.arange(channels)) * top / 2 + r.normal(size=(n, channels)) * top / 300, r.integers(-top - 1, top + 1, (n, channels)), t * 3 % top + np.zeros((1, channels)), np.zeros((n, channels)) + r.integers(-9, 9)]
    x = np.concatenate([k[: n // 4 + 1] for k in kinds])[:n]
    return np.clip(x, -top - 1, top).astype(np.int64) // (1 << seed % 2)


@pytest.mark.parametrize("width", [8, 12, 16, 20, 24])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_flac_is_lossless(width, channels):
    for seed, n, block in [(0, 9000, 4096), (1, 4097, 4096), (2, 1000, 192), (3, 1, 4096), (4, 0, 4096), (5, 17, 16)]:
        x = shapes(seed, n, channels, width)
        data = flac.encoded(x, 44_100, width, block)
        assert (flac_whole(data) == x).all() and len(data) < n * channels * width / 8 * 1.02 + 120 + n
        for a, b in [(0, 1), (n // 2, n // 2 + 9), (n - 1, n)]:
            if 0 <= a < b <= n:
                assert (flac_whole(data, a, b) == x[a:b]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-8388608, 8388607), st.integers(-8388608, 8388607)), min_size=1, max_size=300), st.sampled_from([16, 64, 4096]))
def test_any_samples_come_back(rows, block):
    x = np.array(rows)
    assert (flac_whole(flac.encoded(x, 96_000, 24, block)) == x).all()


def test_stereo_that_is_alike_is_told_by_its_difference():
    x = shapes(0, 8192, 1, 16)
    both = flac.encoded(np.concatenate([x, x], axis=1), 44_100)
    assert len(both) < 1.1 * len(flac.encoded(x, 44_100))


def test_tone_is_smaller_than_samples():
    x = shapes(0, 4000, 1, 16)[:1000]
    assert len(flac.encoded(np.tile(x, (16, 1)), 16_000)) < 0.7 * 2 * 16_000


def test_damage_in_a_frame_is_found_and_others_are_read():
    x = shapes(0, 30_000, 1, 16)
    data = bytearray(flac.encoded(x, 16_000, block=1000))
    data[len(data) // 8] ^= 1
    good = 0
    for k in range(30):
        try:
            assert (flac_whole(bytes(data), 1000 * k, 1000 * k + 1000) == x[1000 * k : 1000 * k + 1000]).all()
            good += 1
        except ValueError:
            pass
    assert good == 29
    with pytest.raises(ValueError):
        flac_whole(bytes(data))


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        got = super().read(n)
        self.read_bytes += len(got)
        return got


@pytest.mark.parametrize("kind", ["wav", "flac"])
def test_a_range_of_a_long_file_reads_its_bytes_only(kind):
    x = np.random.default_rng(1).normal(size=2_000_000) * 0.1
    data = sound.wav(x, 16_000) if kind == "wav" else flac.encoded(sound.whole(x)[:1_000_000, None], 16_000)
    f = Counted(data)
    times = sound.Times([("start", sound.GreaterThanOrEqual, 10.0), ("end", sound.LessThanOrEqual, 14.0)])
    got = list(sound.chunks(sound.opened(f, len(data)), 16_000, 2.0, times=times))
    assert [(k, a, len(y)) for k, a, y in got] == [(5, 160_000, 32_000), (6, 192_000, 32_000)]
    assert np.allclose(np.concatenate([y for *_, y in got]), x[160_000:224_000], atol=1e-4)
    assert f.read_bytes <= 4 * 32_000 + 200 if kind == "wav" else f.read_bytes < 0.4 * len(data)


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(7)
    for who, name, n, rate, kind in [("ann", "long", 100_000, 16_000, "wav"), ("ann", "slow", 30_000, 8000, "wav"), ("bob", "cd", 70_001, 44_100, "flac"), ("bob", "none", 0, 16_000, "wav")]:
        os.makedirs(tmp_path / who, exist_ok=True)
        x = (r.normal(size=n) * 0.1).astype(np.float32)
        (tmp_path / who / f"{name}.{kind}").write_bytes(sound.wav(x, rate) if kind == "wav" else flac.encoded(sound.whole(x)[:, None], rate))
    (tmp_path / "bob" / "broken.WAV").write_bytes(b"RIFF")
    (tmp_path / "bob" / "notes.txt").write_text("no")
    return str(tmp_path)


def test_files_are_read_in_parts_as_a_whole(spark, folder):
    whole = {r.path.removeprefix("file:"): r.samples for r in A.decoded(A.media_files(spark, folder)).collect() if r.samples is not None}
    for options in ({"seconds": 30.0}, {"seconds": 0.7, "split": 20_000}):
        got = A.read_sound(spark, folder, **options)
        assert G.is_chunked(got)
        rows = got.orderBy("file_id", "chunk").collect()
        back = {}
        for r in rows:
            if r.error is None:
                x = back.setdefault(r.file_id, [])
                assert r.first == len(x) and r.n == len(r.samples) and r.rate == 16_000 and abs(r.end - (r.first + r.n) / 16_000) < 1e-9 and r.speaker == r.file_id.split("/")[-2]
                x += r.samples
        assert back.keys() == whole.keys() and all(np.allclose(back[f], whole[f], atol=1e-6) for f in whole)
        assert [r.file_id.split("/")[-1] for r in rows if r.error] == ["broken.WAV"]
    assert got.rdd.getNumPartitions() > 10


def test_comparisons_are_pushed_to_the_source(spark, folder):
    d = A.read_sound(spark, folder, seconds=0.5, pushdown=True)
    some = d.where((F.col("speaker") == "ann") & (F.col("start") >= 1.0) & (F.col("end") <= 2.0))
    assert {(r.file_id.split("/")[-1], r.chunk) for r in some.collect()} == {("long.wav", 2), ("long.wav", 3), ("slow.wav", 2), ("slow.wav", 3)}
    assert some.rdd.getNumPartitions() == 2
    again = lambda: A.read_sound(spark, folder, seconds=0.5, pushdown=True)
    assert again().where("file_id = 'x'").count() == 0 and again().where("chunk = 3 AND error IS NULL").select("n").count() == 3
    told = A.read_sound(spark, folder, seconds=0.5, speaker="ann", **{"from": 1.0, "to": 1.9})
    assert {(r.file_id.split("/")[-1], r.chunk) for r in told.collect()} == {("long.wav", 2), ("long.wav", 3), ("slow.wav", 2), ("slow.wav", 3)}
    # Without pushdown a frame may be used with different conditions in one query, as by halos.
    every = A.read_sound(spark, folder, seconds=0.5)
    both = every.where("chunk = 0 AND error IS NULL").select("file_id", "n").join(every.where("chunk > 0").groupBy("file_id").count(), "file_id", "left")
    assert {(r.file_id.split("/")[-1], r["count"]) for r in both.collect()} == {("long.wav", 12), ("slow.wav", 7), ("cd.flac", 3), ("none.wav", None)}
    with pytest.raises(Exception, match="FileNotFound"):
        A.read_sound(spark, f"{folder}/nothing").count()


def segments(spark, n=6):
    rows = [(f"/x/{k}.mp3", "ann" if k % 2 else "a/../b", 65.0 + k, 66.5 + k, 0.875, [0.5, -0.25, 0.125] * 50) for k in range(n)] + [("y", None, 0.0, 1.0, None, None)]
    return spark.createDataFrame(rows, "path string, speaker string, start double, end double, confidence double, samples array<float>")


def left(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.endswith(".crc"))


@pytest.mark.parametrize("encoding", ["wav", "flac"])
def test_segments_become_files_in_folders(spark, tmp_path, encoding):
    path = str(tmp_path / "out")
    A.write_sound(segments(spark), path, 8000, encoding, "overwrite")
    files = left(path)
    assert len(files) == 7 and {f.split("/")[0] for f in files} == {"ann", "a_.._b", "_"} and all(f.endswith(encoding) for f in files)
    A.write_sound(segments(spark), path, 8000, encoding, "append")
    assert left(path) == files  # equal names are one file
    back = A.read_sound(spark, path, 8000).where("speaker = 'ann'").collect()
    assert len(back) == 3 and all(np.allclose(r.samples, [0.5, -0.25, 0.125] * 50, atol=1e-4) for r in back)
    A.write_sound(segments(spark, 1), path, 8000, encoding, "overwrite")
    assert len(left(path)) == 2


def test_a_write_that_fails_leaves_nothing_and_what_was_there_stays(spark, tmp_path):
    path = str(tmp_path / "out")
    A.write_sound(segments(spark, 2), path)
    before = left(path)
    bad = segments(spark, 40).repartition(4).withColumn("samples", F.when(F.col("path") == "/x/33.mp3", F.raise_error(F.lit("no")).cast("array<float>")).otherwise(F.col("samples")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):  # noqa: B017
            A.write_sound(bad, path, mode=mode)
        assert [f for f in left(path) if not f.startswith("_staging")] == before
        assert A.read_sound(spark, path).where("error IS NULL").count() == 2


def test_attempts_that_are_repeated_give_no_doubles(tmp_path):
    writer = sound.SoundWriter({"path": str(tmp_path)}, False)
    rows = [{"speaker": "a", "file_name": f"n{k}", "samples": [0.1] * 9} for k in range(3)]

    def breaks():
        yield from rows[:2]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(breaks())
    assert left(tmp_path) == []
    first, again = writer.write(iter(rows)), writer.write(iter(rows))
    other = sound.SoundWriter({"path": str(tmp_path)}, False)
    others = other.write(iter([{"speaker": "b", "file_name": "m", "samples": None}]))
    writer.commit([again, None])
    assert first.files == again.files == 3 and not os.path.exists(first.folder) and os.path.exists(others.folder)
    other.commit([others])
    assert left(tmp_path) == ["a/n0.wav", "a/n1.wav", "a/n2.wav", "b/m.wav"]
