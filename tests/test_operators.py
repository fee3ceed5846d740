"""Single operators on small inputs with known results."""

import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import frames as R
from tessera.operators import segments as S
from tessera.operators import vectors as V
from tessera.sources import audio as A
from tessera.streaming.segments import collapse_stream

SEG = "file_id long, ord long, speaker string, start double, end double"


def segs(spark, rows):
    return spark.createDataFrame([(1, k, w, float(s), float(e)) for k, (s, e, w) in enumerate(rows)], SEG)


def test_collapse_equals_a_fold(spark):
    r = random.Random(4)
    rows = [(f, k, r.choice("ab"), s := float(r.randint(0, 60)), s + r.randint(0, 12)) for f in range(30) for k in range(12)]
    got = {(x.file_id, x.speaker, x.start, x.end, x.n) for x in S.collapse(spark.createDataFrame(rows, SEG), 1.0).collect()}
    want = set()
    for f in range(30):
        out = []
        for _, _, w, s, e in sorted((x for x in rows if x[0] == f), key=lambda x: (x[3], x[1])):
            if out and out[-1][0] == w and s - out[-1][2] <= 1.0:
                out[-1][2], out[-1][3] = max(out[-1][2], e), out[-1][3] + 1
            else:
                out.append([w, s, e, 1])
        want |= {(f, *x) for x in out}
    assert got == want
    once = S.collapse(spark.createDataFrame(rows, SEG), 0.0).select("file_id", "ord", "speaker", "start", "end")
    assert S.collapse(once, 0.0).count() == once.count()


def test_absorb_and_ghosts(spark):
    d = segs(spark, [(0, 20, "a"), (20, 20.5, "b"), (20.5, 40, "a"), (40, 60, "c"), (60, 61, "g")])
    assert [(r.speaker, r.start, r.end) for r in S.absorb_islands(d).orderBy("start").collect()] == [("a", 0, 40), ("c", 40, 60), ("g", 60, 61)]
    assert {r.speaker for r in S.drop_ghosts(d).collect()} == {"a", "c"}
    assert S.drop_ghosts(segs(spark, [(0, 1, "x"), (2, 3, "y")])).count() == 2


def test_identified_weights(spark):
    d = segs(spark, [(0, 2, "a"), (2.5, 3.5, "a")]).withColumn("confidence", F.when(F.col("ord") == 0, 1.0).otherwise(0.4))
    assert S.identified(d).first().confidence == pytest.approx((2 * 1.0 + 1 * 0.4) / 3)
    assert S.identified(d, legacy=True).first().confidence == pytest.approx((3.5 * 1.0 + 1 * 0.4) / 4.5)


def test_split_and_windows(spark):
    d = segs(spark, [(0, 60, "a"), (0, 30, "b")])
    assert S.split_even(d).where("ord = 0").count() == 3 and S.split_even(d).where("ord = 1").count() == 1
    w = spark.range(1).select(F.inline(R.windows(F.lit(200), 200, 75, 10))).collect()
    assert [(x.start, x.end) for x in w] == [(0, 200), (75, 200)]


def test_vectors(spark):
    d = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "k long, v array<double>")
    got = {r.k: r.n for r in d.select("k", V.normalised(F.col("v")).alias("n")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_clear_winner_and_match(spark):
    rows = [("c1", "a", 0.1, 0.1, 9.0), ("c1", "b", 0.3, 0.3, 9.0), ("c2", "a", 0.2, 0.2, 9.0), ("c2", "b", 0.21, 0.2, 9.0), ("c3", "a", 0.04, 0.04, 600.0), ("c3", "b", 0.05, 0.05, 60.0), ("c4", "a", 0.9, 0.9, 1.0)]
    d = spark.createDataFrame(rows, "cluster_id string, name string, combined double, emb_dist double, total_speech_sec double")
    assert {r.cluster_id: (r.clear, r.matched) for r in V.match_clusters(d).collect()} == {"c1": (True, True), "c2": (False, False), "c3": (True, True), "c4": (True, False)}


def test_clustering(spark):
    r = np.random.default_rng(0)
    base = np.eye(8)[:3]
    rows = [(0, k, (base[k % 3] + r.normal(0, 0.05, 8)).tolist()) for k in range(30)]
    d = spark.createDataFrame(rows, "file_id long, vec_id long, v array<double>")
    assert [x.cluster for x in V.clustered(d).orderBy("vec_id").collect()] == [k % 3 for k in range(30)]
    assert V.clustered(d, clusters=2).select("cluster").distinct().count() == 2
    assert V.clustered(d.limit(1)).first().cluster == 0


def test_signals(spark):
    t = np.arange(16000) / 16000
    rows = [("sine", np.sin(2 * np.pi * 200 * t).tolist()), ("zero", [0.0] * 16000), ("sign", [1.0, -1.0, 1.0, -1.0])]
    d = spark.createDataFrame(rows, "file_id string, samples array<double>")
    pitch = {r.file_id: r.pitch_hz for r in R.pitch(d).collect()}
    assert 180 < pitch["sine"] < 220 and pitch["zero"] == 0
    assert {r.file_id: r.e for r in d.select("file_id", R.rms(F.col("samples")).alias("e")).collect()}["sign"] == 1.0
    f = R.fbank(np.random.default_rng(1).normal(size=16000) * 0.1)
    assert f.shape[1] == 80 and abs((f - f.mean(axis=0)).mean(axis=0)).max() < 1e-3


def test_dip_split(spark):
    x = np.ones(1000)
    x[300:340] = 0.0
    d = spark.createDataFrame([(1, 0, 0.0, 10.0, x.tolist()), (1, 1, 20.0, 30.0, np.ones(1000).tolist()), (1, 2, 40.0, 44.0, x[:400].tolist())], "file_id long, ord long, start double, end double, samples array<double>")
    got = [(r.ord, r.start, r.end) for r in R.dip_split(d, 100).orderBy("ord", "piece").collect()]
    assert got[0][0] == 0 and 2.0 < got[0][2] < 5.5 and len([g for g in got if g[0] == 0]) == 2
    assert [g for g in got if g[0] > 0] == [(1, 20.0, 30.0), (2, 40.0, 44.0)]


def short_hash(stem):
    n, out = int(hashlib.md5(stem.encode()).hexdigest(), 16), ""
    for _ in range(6):
        n, k = divmod(n, 32)
        out += (string.ascii_uppercase + string.digits)[k]
    return out


def plain_loops(text):
    """The rule of clean_loops, searched from the beginning each time."""
    loop, tag = re.compile(r"(.{4,120}?)(?:\s+\1){2,}", re.IGNORECASE), "[inaudible]"
    while m := loop.search(text):
        left, right, words = text[: m.start()].rstrip(), text[m.end() :].lstrip(), m[1].lower().split()
        for k in range(len(words)):
            if left.lower().endswith(" ".join(words[k:])):
                left = left[: len(left) - len(" ".join(words[k:]))].rstrip()
                break
        for k in range(len(words), 0, -1):
            if right.lower().startswith(" ".join(words[:k])):
                right = right[len(" ".join(words[:k])) :].lstrip()
                break
        new = " ".join(x for x in (left, tag, right) if x)
        if new == text:
            break
        text = new
    text = re.sub(r"(\[inaudible\]\s*){2,}", tag + " ", text)
    return re.sub(r"\[inaudible\]\s+(?:\w[\w\s,']{0,80}?)\s+\[inaudible\]", tag, text).strip()


def test_loops_are_all_found_in_whole_texts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6)))
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 8)):
            unit = " ".join(word() for _ in range(r.randint(1, 4)))
            parts += [" ".join(word() for _ in range(r.randint(0, 5))), (r.choice([" ", "\n", "  "])).join([unit] * r.randint(1, 5)), unit[: r.randint(0, len(unit))]]
        texts.append(" ".join(parts))
    assert [T.clean_loops(t) for t in texts] == [plain_loops(t) for t in texts]
    sixty = ". ".join(f"part {k} " + f"say{k} again{k} " * 4 + f"unlike{k} words{k * k} that stand{k} between the loops and are too many, with signs; so they stay" for k in range(60))
    assert len(sixty) > 4000 and T.clean_loops(sixty) == plain_loops(sixty) and T.clean_loops(sixty).count("[inaudible]") == 60
    across = "word " * 790 + "".join(f"x{k} " for k in range(10)) + "over the edge " * 20 + "end"
    assert T.clean_loops(across) == plain_loops(across)
    odd = ["ΣΑΣ ΟΣ σας ος σασ οσ end", "İabc İabc iabc x", "a  b  a  b  a  b", "ab" + " " * 300 + "abcd abcd" + " " * 300 + "abcd", "x y z w " * 3 + "\ud83d\ude00" * 3, "STRASSE strasse StraSSe", "\n".join(["line of it"] * 4)]
    assert [T.clean_loops(t) for t in odd] == [plain_loops(t) for t in odd]
    assert T.clean_loops("the number 100000000000000 is big") == "the number 100000000000000 is big"
    d = spark.createDataFrame([(1, None), (2, ""), (3, "again and again " * 3)], "id long, text string")
    assert [r.t for r in d.select("id", T.loop_cleaned("text").alias("t")).orderBy("id").collect()] == [None, "", "[inaudible]"]
    assert d.limit(0).select(T.loop_cleaned("text")).count() == 0


def test_text(spark):
    assert T.clean_loops("start " + "thank you. " * 5 + "end") == "start [inaudible] end"
    assert T.clean_loops("nothing repeats here") == "nothing repeats here"
    assert T.punctuated(["hello", "world.", "again"], ["O", "PERIOD", "O"]) == "Hello world.. Again"
    assert T.word_labels([("▁he", "O"), ("llo", "PERIOD"), ("▁you", "COMMA")], 3) == ["O", "COMMA", "0"]
    one = spark.range(1)
    assert one.select(T.clock(F.lit(3661.9876), "srt").alias("t")).first().t == "01:01:01,987"
    assert one.select(T.parse_clock(F.lit("1:02:03.5")).alias("t")).first().t == 3723.5
    assert one.select(T.punctuation_cleaned(F.lit("<|a|> sooooo D D D good,, ,. yes!! , , , ")).alias("t")).first().t == "sooooo D good, ,. yes"
    assert one.select(T.short_hash(F.lit("meeting")).alias("t")).first().t == short_hash("meeting")
    assert one.select(T.tagged_tail(F.lit("[Speaker 1]: a b c [Speaker 2]:  [Speaker 3]: " + "w " * 15)).alias("t")).first().t == "[Speaker 1]: a b c [Speaker 3]: " + " ".join(["w"] * 10)
    assert one.select(T.tagged_tail(F.lit("no tags")).alias("t")).first().t == ""
    assert one.select(A.probed_duration(F.lit("  Duration: 01:00:10.50, start")).alias("t")).first().t == 3610.5


def test_audio_round_trip(spark, tmp_path):
    x = np.sin(np.arange(8000) / 10).astype(np.float32) * 0.5
    (tmp_path / "bob").mkdir()
    (tmp_path / "bob" / "a.WAV").write_bytes(A.encode_wav(x, 8000))
    (tmp_path / "bob" / "b.wav").write_bytes(b"broken")
    (tmp_path / "bob" / "c.txt").write_text("no")
    files = A.media_files(spark, str(tmp_path))
    assert {r.speaker for r in files.collect()} == {"bob"} and files.count() == 2
    got = {r.path[-5:]: r for r in A.decoded(files).collect()}
    assert len(got["a.WAV"].samples) == 16000 and got["b.wav"].error and got["b.wav"].samples is None


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, k, "ab"[k // 3 % 2], float(k * 10), float(k * 10 + 9)) for k in range(12)]
    d = spark.createDataFrame(rows, SEG).withColumn("ts", F.timestamp_seconds(F.col("start") + 1000))
    d.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    q = collapse_stream(stream, 1.0).writeStream.format("memory").queryName("collapsed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.speaker, r.start, r.end) for r in spark.table("collapsed").collect()}
    want = {(r.speaker, r.start, r.end) for r in S.collapse(d, 1.0).collect()}
    assert got <= want and len(want) - len(got) <= 1


def test_early_match_merges_a_split_known_speaker_before_segments_do(spark):
    from tessera.plans import pipelines as P

    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), 0.0]
    # Clusters 0 and 2 are 20 degrees to both sides of Ann; 1 is near nobody; 3 is within 0.1 of Ben, not 0.03.
    of = {0: at(-20), 1: [0.0, 0.0, 1.0], 2: at(20), 3: at(110)}
    rows = [(1, k, float(k), k + 1.0, of[k % 4]) for k in range(8)]
    windows = spark.createDataFrame(rows, "file_id long, ord long, start double, end double, v array<double>")
    labels = spark.createDataFrame([(1, k, k % 4) for k in range(8)], "file_id long, ord long, cluster int")
    prints = spark.createDataFrame([("Ann", at(0)), ("Ben", at(90))], "name string, v array<double>")
    match = lambda **k: {r.cluster: (r.head, r.final) for r in V.early_match(windows, labels, prints, **k).collect()}
    assert match(mutual=0.3) == {0: (0, "Ann"), 2: (0, "Ann"), 1: (1, "SPEAKER1"), 3: (3, "SPEAKER2")}
    assert match() == {0: (0, "SPEAKER1"), 1: (1, "SPEAKER2"), 2: (2, "SPEAKER3"), 3: (3, "SPEAKER4")}
    # 18 degrees to each side are less than 0.2 apart: by themselves neither is within 0.03 of Ann.
    near = spark.createDataFrame([(1, k, float(k), k + 1.0, at(-18 if k % 2 else 18)) for k in range(8)], windows.schema)
    assert {r.speaker for r in P.diarised(near, prints, far=0.01).collect()} == {"Ann"}


def test_nearest_label_has_no_frame_of_all_that_follows(spark):
    """Such a frame is quadratic in a file's rows."""
    r = random.Random(7)
    rows = [("f", k, float(r.randint(0, 300)), float(r.randint(0, 300)), r.choice([None, None, "a", "b"])) for k in range(400)]
    df = S.nearest_label(spark.createDataFrame(rows, "file_id string, ord long, start double, end double, label string"))
    assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    mid = {k: (a + b) / 2 for _, k, a, b, _ in rows}
    for got in df.collect():
        assert got.nearest == (got.label or min((abs(mid[k] - mid[got.ord]), k, x) for _, k, _, _, x in rows if x)[2])
