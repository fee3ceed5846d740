"""The reference's three flows as plans: diarised transcript, silence-split transcription, voiceprint refinement. Models are pluggable; a deterministic stand-in serves tests.

Audio is a frame (file_id, samples), or chunks of files of any length as in operators.signals; file ids have any type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as T
from tessera.operators import frames as R
from tessera.operators import segments as S
from tessera.operators import signals as G
from tessera.operators import vectors as V
from tessera.sources import audio as A
from tessera.storage import saved


def sliced(audio: DataFrame, pieces: DataFrame) -> DataFrame:
    """pieces (file_id, start, end, ...) with their samples. A file's pieces meet its audio in one row, or those of a chunk the chunk, so the audio isn't copied for each of them."""
    if G.is_chunked(audio):
        return G.sliced(audio, pieces)
    rest = [c for c in pieces.columns if c != "file_id"]
    held = pieces.groupBy("file_id").agg(F.collect_list(F.struct(*rest)).alias("_w")).join(audio.select("file_id", F.col("samples").alias("_x")), "file_id")
    cut = F.transform("_w", lambda w: F.struct(*[w[c].alias(c) for c in rest], A.cut(F.col("_x"), w["start"], w["end"]).alias("samples")))
    return held.select("file_id", F.inline(cut))


def embedded(audio: DataFrame, pieces: DataFrame, embed) -> DataFrame:
    """pieces (file_id, ..., start, end) with v, the embedding of their samples, null for those under 0.3 seconds. embed is a column function of the samples, such as a pandas UDF around a model."""
    return sliced(audio, pieces).withColumn("v", F.when(F.size("samples") >= int(0.3 * R.RATE), embed(F.col("samples")))).drop("samples")


def speech_windows(audio: DataFrame, vad=None, win: float = 1.5, stride: float = 0.75, least: float = 0.5) -> DataFrame:
    """Audio to windows (file_id, ord, start, end): speech by a VAD (a function of the audio, by energy if none is given), long segments cut at energy dips, sliding windows in each piece."""
    if G.is_chunked(audio):
        speech = saved(G.speech_segments(audio, vad or G.energy_speech))
        pieces = G.dip_split(audio, speech)
    else:
        speech = R.speech_segments(audio, vad or R.energy_vad)
        pieces = R.dip_split(sliced(audio, speech).select("file_id", "ord", "start", "end", "samples"))
    n = F.floor((F.col("end") - F.col("start")) * R.RATE).cast("int")
    inner = pieces.select("file_id", F.col("start").alias("_a"), F.inline(R.windows(n, int(win * R.RATE), int(stride * R.RATE), int(least * R.RATE))))
    out = inner.select("file_id", (F.col("_a") + F.col("start") / R.RATE).alias("start"), (F.col("_a") + F.col("end") / R.RATE).alias("end"))
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("file_id").orderBy("start", "end")).cast("long") - 1)


def clustered_windows(windows: DataFrame, prints: DataFrame | None = None, far: float = 0.35, most: int | None = 15, near: float | None = 0.25) -> DataFrame:
    """Windows (file_id, ord, start, end, v, null if too short) with cluster and label: average linkage with a cap and the merge of near centroids, windows without a vector by the nearest one; labels by known
    speakers (OP-64) or by first appearance."""
    keyed = windows.withColumn("vec_id", F.col("ord"))
    clusters = V.clustered(keyed, far=far, most=most, near=near).select("file_id", F.col("vec_id").alias("ord"), F.col("cluster").cast("string").alias("cluster"))
    clusters = saved(clusters)
    if prints is None:
        labels = clusters.withColumn("label", F.col("cluster"))
    else:
        early = V.early_match(windows, clusters, prints)
        labels = clusters.join(early, ["file_id", "cluster"]).select("file_id", "ord", F.col("head").alias("cluster"), F.col("final").alias("label"))
    every = windows.join(labels, ["file_id", "ord"], "left").withColumn("_both", F.when(F.col("label").isNotNull(), F.to_json(F.struct("cluster", "label"))))
    named = S.nearest_label(every, "_both").withColumn("_n", F.from_json("nearest", "cluster string, label string"))
    out = named.select("file_id", "ord", "start", "end", "v", F.col("_n.cluster").alias("cluster"), F.col("_n.label").alias("label"))
    if prints is None:
        out = S.first_appearance(out, "label").drop("label").withColumnRenamed("name", "label")
    return out.where("label IS NOT NULL").select("file_id", "ord", "start", "end", "v", "cluster", "label")


def diarised(windows: DataFrame, prints: DataFrame | None = None, far: float = 0.35, gap: float = 1.0, audio: DataFrame | None = None, embed=None, config: Config = Config()) -> DataFrame:
    """Windows (file_id, ord, start, end, v) to segments (file_id, ord, speaker, start, end, confidence, alternatives).

    Cluster, match known speakers early, merge, absorb islands; with audio (file_id, samples) and embed, boundaries are refined by sub-windows and speakers profiled and put in order of pitch.
    With voiceprints (name, v, pitch_hz, energy_rms, total_speech_sec and features, or name and v only) every speaker is matched by the composite distance; a clear winner within the threshold gives the name, the next three are the
    alternatives; speakers of one best name, and those of like distances, become one. Then ghosts go to an alternative or neighbour, and each segment gets its confidence.
    """
    labelled = saved(clustered_windows(windows, prints, far, config.get("diarization", "max_clusters"), config.get("diarization", "merge_threshold")))
    merged = S.merge_trim(labelled.select("file_id", "ord", "start", "end", F.col("label").alias("speaker")), gap).select("file_id", "ord", "start", "end", "speaker")
    seg = saved(S.absorb_islands(merged))
    some = labelled.where(F.col("v").isNotNull())
    if audio is not None:
        centre = V.centroids(some.select("file_id", F.col("label").alias("speaker"), "v"), ["file_id", "speaker"])
        sides = S.boundary_sides(embedded(audio, S.boundary_windows(seg), embed), centre)
        seg = saved(S.clamp_boundaries(seg, S.boundary_proposals(sides)))
        if G.is_chunked(audio):
            profiles = saved(G.profiles(audio, seg.select("file_id", "speaker", "start", "end")))
        else:
            profiles = saved(R.profiles(sliced(audio, seg).select("file_id", "speaker", "start", "end", "samples")))
        names = V.relabelled_by_pitch(profiles).select("file_id", "speaker", F.col("label").alias("_label"))
        keep = F.col("speaker").rlike("^SPEAKER[0-9]+$")
        seg = seg.join(names, ["file_id", "speaker"]).withColumn("speaker", F.when(keep, F.col("_label")).otherwise(F.col("speaker"))).drop("_label")
        profiles = profiles.join(names, ["file_id", "speaker"]).withColumn("speaker", F.when(keep, F.col("_label")).otherwise(F.col("speaker"))).drop("_label")
    if prints is not None:
        inside = S.contained(windows.select("file_id", "ord", "start", "end"), seg).join(seg.select("file_id", F.col("ord").alias("seg_ord"), "speaker"), ["file_id", "seg_ord"])
        heads = V.centroids(some, ["file_id", "cluster"])
        centre = V.centroids(inside.join(labelled.select("file_id", "ord", "cluster"), ["file_id", "ord"]).join(heads, ["file_id", "cluster"]), ["file_id", "speaker"])
        cluster = centre.withColumnRenamed("speaker", "cluster_id")
        if audio is not None:
            cluster = cluster.join(profiles.withColumnRenamed("speaker", "cluster_id"), ["file_id", "cluster_id"])
        zero = {c: F.lit(0.0) for c in ("pitch_hz", "energy_rms") if c not in cluster.columns}
        full = {c: F.lit(0.0) for c in ("pitch_hz", "energy_rms", "total_speech_sec") if c not in prints.columns}
        found = saved(V.scored_blocks(cluster.withColumns(zero) if zero else cluster, prints.withColumns(full) if full else prints, config, best=4))
        seg = saved(_named(seg, found))
    out = saved(S.drop_ghosts(seg, 10.0, 1.0))
    return _confident(out, labelled, prints).join(seg.select("file_id", "ord", *(["alternatives"] if prints is not None else [F.array().cast("array<struct<speaker:string,confidence:double>>").alias("alternatives")])), ["file_id", "ord"], "left")


def diarised_files(audio: DataFrame, embed, prints: DataFrame | None = None, vad=None, far: float = 0.35, config: Config = Config()) -> DataFrame:
    """Sound to named segments in one call: audio is what sources.sound reads from files, chunks (file_id, chunk, first, n, samples, ...), or (file_id, samples). Files that can't be read, which have an error and no samples, are left out."""
    names = [c for c in ("file_id", "chunk", "first", "n", "samples") if c in audio.columns]
    some = audio.where("samples IS NOT NULL").select(*names)
    windows = saved(embedded(some, speech_windows(some, vad), embed).select("file_id", "ord", "start", "end", "v"))
    return diarised(windows, prints, far, audio=some, embed=embed, config=config)


def _named(seg: DataFrame, blocks: DataFrame) -> DataFrame:
    """seg with names and alternatives by the scored blocks of voiceprints of its speakers."""
    found = V.best_of(blocks, 4)
    match = V.match_clusters(found, tight=V.LOOSE).select("file_id", "cluster_id", "name", "matched", "combined")
    near = match.where(F.col("combined") <= V.LOOSE)
    # Of speakers whose best name is the same, the first keeps its own match; the others take the name.
    first = near.withColumn("_r", F.row_number().over(Window.partitionBy("file_id", "name").orderBy("cluster_id"))).select("file_id", "cluster_id", (F.col("_r") > 1).alias("_later"))
    alike = V.similar_blocks(blocks).groupBy("file_id", F.col("b").alias("cluster_id")).agg(F.min("a").alias("_like"))
    named = match.join(first, ["file_id", "cluster_id"], "left").join(alike, ["file_id", "cluster_id"], "left")
    own = F.when(F.col("matched") | F.coalesce("_later", F.lit(False)), F.col("name"))
    named = named.select("file_id", "cluster_id", own.alias("_own"), "_like")
    of = named.select("file_id", F.col("cluster_id").alias("_like"), F.col("_own").alias("_theirs"))
    named = named.join(of, ["file_id", "_like"], "left").select("file_id", F.col("cluster_id").alias("speaker"), F.coalesce("_own", "_theirs", "_like").alias("_name"))
    other = V.alternatives(found).withColumnRenamed("cluster_id", "speaker")
    joined = seg.join(named, ["file_id", "speaker"], "left").join(other, ["file_id", "speaker"], "left")
    return joined.select("file_id", "ord", "start", "end", F.coalesce("_name", "speaker").alias("speaker"), "alternatives")


def _confident(seg: DataFrame, labelled: DataFrame, prints: DataFrame | None) -> DataFrame:
    """seg with the confidence of OP-74 from the windows inside each segment; 0.5 for parts that no window tells."""
    some = labelled.where(F.col("v").isNotNull())
    centre = V.centroids(some, ["file_id", "cluster"]).select("file_id", F.col("cluster").alias("cluster_id"), F.col("v").alias("_c"))
    window = F.struct("file_id", "ord").alias("window_id")
    dist = some.join(centre, "file_id").select(window, "cluster_id", "cluster", V.cosine_distance(F.col("v"), F.col("_c")).alias("dist"))
    each = dist.where("cluster = cluster_id").select("window_id", F.col("dist").alias("_d")).join(V.clarity(dist), "window_id").select("window_id.*", "_d", "clarity")
    inside = S.contained(labelled.select("file_id", "ord", "start", "end"), seg).join(each, ["file_id", "ord"], "left").join(labelled.select("file_id", "ord", "cluster"), ["file_id", "ord"])
    joined = inside.withColumnRenamed("seg_ord", "_o").join(seg.select("file_id", F.col("ord").alias("_o"), (F.col("end") - F.col("start")).alias("duration"), "speaker"), ["file_id", "_o"])
    known = prints.select(F.col("name").alias("speaker"), F.lit(True).alias("known")) if prints is not None else None
    joined = joined.withColumnRenamed("speaker", "_s")
    rows = joined.join(known, joined["_s"] == known["speaker"], "left").drop("speaker") if known is not None else joined.withColumn("known", F.lit(False))
    one = rows.select(F.struct("file_id", "_o").alias("seg_id"), F.col("cluster").alias("speaker"), F.coalesce("clarity", F.lit(0.5)).alias("clarity"), F.coalesce("_d", F.lit(0.25)).alias("dist"), "duration", F.coalesce("known", F.lit(False)).alias("known"))
    conf = V.segment_confidence(one).select("seg_id.file_id", F.col("seg_id._o").alias("ord"), F.round("confidence", 3).alias("confidence"))
    return seg.join(conf, ["file_id", "ord"], "left").select("file_id", "ord", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def silence_split(silences: DataFrame, durations: DataFrame, model, gap: float = 2.5, most: float = 30.0) -> DataFrame:
    """Silences to chunks to text: model is a column function of (file_id, start, end); result (file_id, text) with headers after gaps."""
    speech = S.silence_complement(silences, durations).withColumn("ord", F.row_number().over(S.Window.partitionBy("file_id").orderBy("start")).cast("long"))
    merged = S.islands(speech, gap, False).groupBy("file_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("ord").alias("ord"))
    chunks = S.split_even(merged, most).withColumn("text", model(F.col("file_id"), F.col("start"), F.col("end")))
    return T.transcript_gaps(chunks.withColumn("ord", F.col("ord") * 100000 + F.col("part")))


def refined_prints(segments: DataFrame, stored: DataFrame, embed, rate: int = R.RATE) -> DataFrame:
    """Segments (file_id, speaker, samples) to voiceprints blended into the stored ones; embed is a column function of the samples."""
    key = segments.withColumn("file_id", F.concat_ws("/", "speaker", "file_id"))
    pitch = R.pitch(key, rate)
    samples = key.join(pitch, "file_id").select(F.col("speaker").alias("name"), embed(F.col("samples")).alias("v"), "pitch_hz", R.rms(F.col("samples")).alias("energy_rms"), (F.size("samples") / rate).alias("duration"))
    return V.refined(samples, stored)
