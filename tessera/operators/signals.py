"""Signals longer than a row: chunks (file_id, chunk, first, n, samples) of a file, n samples from its sample first on.

Chunks of a file are numbered from 0, hold SIZE samples each but for the last, and follow one another without gaps; a file without samples has one empty chunk. Every frame
belongs to the chunk in which it begins and takes what is missing from a halo, the first samples of the next chunk, so no frame is lost or counted twice at a cut, and no row or task ever holds a whole
file's samples. Runs, islands and medians across cuts are made from the frames' figures, which are small. The operators give what those of `frames` give for the file as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import frames as R

RATE = R.RATE
SIZE = 30 * RATE
#: Samples that a chunk borrows from the next for pieces: longer pieces are gathered from their chunks.
HALO = 2 * RATE


def is_chunked(df: DataFrame) -> bool:
    return {"file_id", "chunk", "first", "n", "samples"} <= set(df.columns)


def chunked(df: DataFrame, size: int = SIZE, samples: str = "samples") -> DataFrame:
    """Files (file_id, samples) that still fit a row, as chunks. Null samples are none."""
    x = F.coalesce(F.col(samples), F.array().cast(df.schema[samples].dataType))
    total = F.size(x)
    starts = F.sequence(F.lit(0), F.greatest(F.floor((total - 1) / size), F.lit(0)).cast("int"))
    part = lambda k: F.struct(k.alias("chunk"), (k.cast("long") * size).alias("first"), F.least(F.lit(size), total - k * size).alias("n"), F.slice(x, k * size + 1, size).alias("samples"))
    return df.select("file_id", F.inline(F.transform(starts, part)))


def lengths(chunks: DataFrame) -> DataFrame:
    """(file_id, n) of each file, its number of samples."""
    return chunks.groupBy("file_id").agg(F.max(F.col("first") + F.col("n")).alias("n"))


def haloed(chunks: DataFrame, after: int, before: int = 0) -> DataFrame:
    """chunks with samples that go on with the first after samples of the next chunk and begin with the last before samples of the one before; base is the place of the first of them. Only the halos are sent between rows.
    A chunk that isn't a file's last has at least as many samples as a halo."""
    none = F.array().cast(chunks.schema["samples"].dataType)
    edges = []
    if after:
        edges.append(chunks.where("chunk > 0").select("file_id", (F.col("chunk") - 1).alias("chunk"), F.slice("samples", 1, after).alias("_after")))
    if before:
        tail = F.slice("samples", F.greatest(F.col("n") - before + 1, F.lit(1)).cast("int"), before)
        edges.append(chunks.where("n > 0").select("file_id", (F.col("chunk") + 1).alias("chunk"), tail.alias("_before")))
    out = chunks
    for e in edges:
        out = out.join(e, ["file_id", "chunk"], "left")
    head = F.coalesce("_before", none) if before else none
    tail = F.coalesce("_after", none) if after else none
    return out.select("file_id", "chunk", "first", "n", (F.col("first") - F.size(head)).alias("base"), F.concat(head, "samples", tail).alias("samples"))


def frame_rms(chunks: DataFrame, frame: int, hop: int) -> DataFrame:
    """(file_id, frame, energy) of all full frames, as frames.frame_rms."""
    h = haloed(chunks, frame - 1)
    low = F.ceil(F.col("first") / hop)
    high = F.least(F.floor((F.col("first") + F.col("n") - 1) / hop), F.floor((F.col("first") + F.size("samples") - frame) / hop))
    h = h.withColumn("_k", low).where((F.col("n") > 0) & (high >= low))
    energies = F.transform(F.sequence("_k", high), lambda k: R.rms(F.slice("samples", (k * hop - F.col("first") + 1).cast("int"), frame)))
    return h.select("file_id", "_k", F.posexplode(energies).alias("_p", "energy")).select("file_id", (F.col("_k") + F.col("_p")).alias("frame"), "energy")


def energy_speech(chunks: DataFrame, rate: int = RATE, least: float = 0.01, gap: float = 0.5) -> DataFrame:
    """OP-54 on chunks."""
    frame, hop = int(0.03 * rate), int(0.01 * rate)
    return R.loud_speech(frame_rms(chunks, frame, hop), lengths(chunks), rate, frame, hop, least, gap)


def speech_segments(chunks: DataFrame, vad=energy_speech, gap: float = 0.5, least: float = 0.3) -> DataFrame:
    """OP-55 on chunks: vad is a function of chunks to (file_id, start, end)."""
    return R.joined_speech(vad(chunks).select("file_id", "start", "end"), lengths(chunks), gap, least)


def with_pieces(chunks: DataFrame, pieces: DataFrame, by_start: bool) -> DataFrame:
    """Rows of chunks with _w, the pieces (file_id, _a, _b, ...; samples from _a to _b) that begin in them (by_start) or overlap them. Samples aren't copied for each piece, and a chunk is found by the places alone."""
    keep = [c for c in pieces.columns if c != "file_id"]
    spans = chunks.select("file_id", "chunk", "first", "n")
    last = F.col("_a") if by_start else F.greatest(F.col("_b") - 1, F.col("_a"))
    bucket = F.explode(F.sequence(F.floor(F.col("_a") / SIZE), F.floor(last / SIZE)))
    dealt = pieces.select("file_id", F.struct(*keep).alias("_p"), "_a", last.alias("_z"), bucket.alias("_u"))
    span = spans.where("n > 0").select("file_id", "chunk", F.col("first").alias("_f"), (F.col("first") + F.col("n") - 1).alias("_l"))
    span = span.withColumn("_u", F.explode(F.sequence(F.floor(F.col("_f") / SIZE), F.floor(F.col("_l") / SIZE))))
    # A piece and a chunk meet in the bucket where their overlap begins.
    touch = (F.col("_a") <= F.col("_l")) & (F.col("_z") >= F.col("_f")) & (F.col("_u") == F.floor(F.greatest("_a", "_f") / SIZE))
    held = dealt.join(span, ["file_id", "_u"]).where(touch & (F.col("_a") >= F.col("_f")) if by_start else touch).groupBy("file_id", "chunk").agg(F.collect_list("_p").alias("_w"))
    return chunks.join(held, ["file_id", "chunk"])


def _places(chunks: DataFrame, pieces: DataFrame, rate: int) -> DataFrame:
    """pieces (file_id, start, end, ...) with _a and _b, their samples as audio.cut takes them."""
    total = lengths(chunks).withColumnRenamed("n", "_n")
    a = F.floor(F.col("start") * rate)
    return pieces.join(total, "file_id").withColumn("_a", a).withColumn("_b", F.greatest(F.col("_a"), F.least(F.floor(F.coalesce(F.col("end"), F.col("_n") / F.lit(rate)) * rate), F.col("_n")))).drop("_n")


def sliced(chunks: DataFrame, pieces: DataFrame, rate: int = RATE, halo: int = HALO) -> DataFrame:
    """pieces (file_id, start, end, ...) with their samples; of files without chunks they are left out. A piece of at most halo samples is cut from its chunk and the halo;
    the parts of a longer one are gathered."""
    names = pieces.columns
    kind = chunks.schema["samples"].dataType
    placed = _places(chunks, pieces, rate)
    short = placed.where(F.col("_b") - F.col("_a") <= halo)
    cut = lambda a, b: F.slice("samples", (a - F.col("first") + 1).cast("int"), (b - a).cast("int"))
    full = lambda w: F.when(w["_b"] <= F.col("first") + F.size("samples"), cut(w["_a"], w["_b"])).otherwise(F.raise_error(F.lit("a chunk is shorter than the halo")))
    one = lambda w: F.struct(*[w[c].alias(c) for c in names if c != "file_id"], full(w).alias("_x"))
    out = with_pieces(haloed(chunks, halo), short.where("_b > _a"), True).select("file_id", F.inline(F.transform("_w", one)))
    none = short.where("_b = _a").withColumn("_x", F.array().cast(kind)).select(*out.columns)
    # Equal pieces are one while they are gathered.
    long_ = placed.where(F.col("_b") - F.col("_a") > halo).groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("_m"))
    a, b = lambda w: F.greatest(w["_a"], F.col("first")), lambda w: F.least(w["_b"], F.col("first") + F.col("n"))
    part = lambda w: F.struct(w.alias("w"), cut(a(w), b(w)).alias("_x"))
    parts = with_pieces(chunks, long_, False).select("file_id", "chunk", F.inline(F.transform("_w", part)))
    whole = parts.groupBy("file_id", "w").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "_x"))), lambda s: s["_x"])).alias("_x"))
    again = whole.withColumn("_m", F.explode(F.array_repeat(F.lit(1), F.col("w._m").cast("int"))))
    again = again.select("file_id", *[F.col("w").getField(c).alias(c) for c in names if c != "file_id"], "_x")
    every = out.unionByName(none).unionByName(again)
    return every.select(*names, F.col("_x").alias("samples"))


def dip_split(chunks: DataFrame, segments: DataFrame, rate: int = RATE, longest: float = 5.0, ratio: float = 0.35, least_dip: float = 0.15, least_piece: float = 1.0) -> DataFrame:
    """OP-56 on chunks: segments (file_id, ord, start, end) cut at dips of the energy of their own frames."""
    hop = int(0.02 * rate)
    long_ = segments.select("file_id", "ord", "start", "end").where(F.col("end") - F.col("start") >= longest)
    placed = _places(chunks, long_, rate).select("file_id", "ord", "_a", "_b")
    held = with_pieces(haloed(chunks, hop - 1), placed, False)

    def own(w: Column) -> Column:
        """Frames of the piece that begin in the chunk; its last one is left out."""
        low = F.ceil(F.greatest(F.lit(0), F.col("first") - w["_a"]) / hop)
        high = F.least(F.floor((F.col("first") + F.col("n") - 1 - w["_a"]) / hop), F.floor((w["_b"] - w["_a"] - hop) / hop) - 1)
        at = F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))
        energy = lambda k: R.rms(F.slice("samples", (w["_a"] + k * hop - F.col("first") + 1).cast("int"), hop))
        return F.transform(at, lambda k: F.struct(F.struct(F.col("file_id").alias("file_id"), w["ord"].alias("ord")).alias("file_id"), k.alias("frame"), energy(k).alias("energy")))

    energy = held.select(F.inline(F.flatten(F.transform("_w", own))))
    return R.split_at_dips(segments.select("file_id", "ord", "start", "end"), energy, hop, rate, longest, ratio, least_dip, least_piece)


def pitch(chunks: DataFrame, rate: int = RATE, frame: int = 2048, hop: int = 512) -> DataFrame:
    """OP-57 on chunks."""
    kind = dict(chunks.dtypes)["file_id"]

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            files, found = [], []
            for f, first, n, x in zip(pdf["file_id"], pdf["first"], pdf["n"], pdf["samples"]):
                x = np.asarray(x, float)
                at = range(-first % hop, min(n, len(x) - frame + 1), hop)
                got = [p for i in at if 60 < (p := R.frame_pitch(x[i : i + frame], rate, int(rate / 300), int(rate / 80), 0.2)) < 400]
                files += [f] * len(got)
                found += got
            yield pd.DataFrame({"file_id": files, "p": found})

    voiced = haloed(chunks, frame - 1).select("file_id", "first", "n", "samples").mapInPandas(run, f"file_id {kind}, p double")
    figures = voiced.groupBy("file_id").agg(F.median("p").alias("pitch_hz"), F.stddev_pop("p").alias("pitch_std"))
    return lengths(chunks).select("file_id").join(figures, "file_id", "left").na.fill(0.0, ["pitch_hz", "pitch_std"])


def sliding_windows(chunks: DataFrame, win: int, stride: int, least_tail: int) -> DataFrame:
    """OP-51 on chunks: (file_id, start, end) in samples."""
    return lengths(chunks).select("file_id", F.inline(R.windows(F.col("n").cast("int"), win, stride, least_tail)))


def profiles(chunks: DataFrame, segments: DataFrame, rate: int = RATE, part: float = 30.0, halo: int = HALO) -> DataFrame:
    """OP-59 on chunks: segments (file_id, speaker, start, end). A long segment is looked at in parts, each with the samples of the frame that begins last in it."""
    frame, hop = int(0.03 * rate), int(0.01 * rate)
    size = int(part * rate) // hop * hop
    placed = _places(chunks, segments.select("file_id", "speaker", "start", "end"), rate)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("_b") - F.col("_a") - 1) / size), F.lit(0).cast("long"))))
    cut = placed.withColumn("_k", k).withColumn("_p", F.col("_a") + F.col("_k") * size)
    ends = F.least(F.col("_b"), F.col("_p") + size + frame)
    at = lambda c: ((c + 0.5) / rate)  # noqa: E731  in the middle of a sample, so that rounding can't move it
    raw = sliced(chunks, cut.select("file_id", "speaker", at(F.col("_p")).alias("start"), at(ends).alias("end")), rate, halo)
    w = Window.partitionBy("file_id", "speaker").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.withColumn("_at", F.coalesce(F.sum(F.col("_b") - F.col("_a")).over(w), F.lit(0))).where((F.col("_at") < R.PROFILE_SECONDS * rate) & (F.col("_b") > F.col("_a")))
    most = F.least(F.col("_b"), F.col("_a") + R.PROFILE_SECONDS * rate - F.col("_at"))
    first = sliced(chunks, before.select("file_id", "speaker", F.col("start").alias("_s"), "_at", at(F.col("_a")).alias("start"), at(most).alias("end")), rate, halo)
    first = first.select("file_id", "speaker", F.col("_s").alias("start"), "_at", F.col("samples").alias("_part"))
    base = segments.groupBy("file_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("total_speech_sec"))
    return R.profiled(base, raw, first, rate)


def resampled(chunks: DataFrame, rate: int, to: int = RATE) -> DataFrame:
    """OP-01, 05 on chunks: the same file at another rate, each chunk with the samples that begin in it."""
    from tessera.sources.resample import Resampler

    kind, width = dict(chunks.dtypes)["file_id"], Resampler(rate, to).reach

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_ = Resampler(rate, to)
        for pdf in rows:
            out = []
            for f, c, first, n, base, total, x in zip(*(pdf[k] for k in ("file_id", "chunk", "first", "n", "base", "total", "samples"))):
                a, b = filter_.place(first), filter_.place(first + n) if first + n < total else filter_.length(total)
                out.append((f, c, a, b - a, filter_.part(np.asarray(x, np.float32), base, a, b)))
            yield pd.DataFrame(out, columns=["file_id", "chunk", "first", "n", "samples"])

    rows = haloed(chunks, width, width).join(lengths(chunks).withColumnRenamed("n", "total"), "file_id")
    return rows.select("file_id", "chunk", "first", "n", "base", "total", "samples").mapInPandas(run, f"file_id {kind}, chunk int, first long, n int, samples array<float>")
