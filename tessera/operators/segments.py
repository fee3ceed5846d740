"""Interval segments (file_id, ord, start, end, speaker, ...): merging, trimming, overlap, splitting, packing, relabelling.

A file is the unit of all of them; its id has any type. Order is by start and then ord, the original place. Window functions sort one file in one task; files
are hours of audio, thousands of segments at most. Joins within a file are dealt by file and time bucket, so they don't pair all of a file.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE = ("file_id",)


def in_order(keys: tuple[str, ...] = FILE) -> Window:
    return Window.partitionBy(*keys).orderBy("start", "ord")


def islands(df: DataFrame, gap: float, by_speaker: bool = True, keys: tuple[str, ...] = FILE, last_end: bool = False, strict: bool = False) -> DataFrame:
    """df with island, the number of the merged segment each row belongs to within its keys.

    A row starts an island if its speaker differs from the row before, or if it starts more than gap (strict: gap or more) after the greatest end so far of its
    speaker's run (last_end: after the end of the row before).
    """
    w = in_order(keys)
    run = F.lit(0)
    if by_speaker:
        df = df.withColumn("_new", F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1)))
        df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        df = df.withColumn("_run", run)
    inner = Window.partitionBy(*keys, "_run").orderBy("start", "ord")
    end = F.lag("end").over(inner) if last_end else F.max("end").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    far = (F.col("start") - end >= gap) if strict else (F.col("start") > end + gap)
    df = df.withColumn("_break", F.coalesce(far.cast("int"), F.lit(1)))
    return df.withColumn("island", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_run", "_break")


def collapse(df: DataFrame, gap: float = 0.0, keys: tuple[str, ...] = FILE) -> DataFrame:
    """OP-31: same-speaker segments at most gap apart become one, from the first start to the greatest end."""
    merged = islands(df, gap, True, keys).groupBy(*keys, "island")
    return merged.agg(F.min_by("speaker", "ord").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("ord", F.struct("start", "ord")).alias("ord"), F.count(F.lit(1)).alias("n"))


def merge_trim(df: DataFrame, gap: float = 1.0) -> DataFrame:
    """OP-32: as collapse; where a merged segment overlaps the next, both meet in the middle of the overlap."""
    m = collapse(df, gap)
    w = in_order()
    next_start, last_end = F.lead("start").over(w), F.lag("end").over(w)
    start = F.when(F.col("start") < last_end, (F.col("start") + last_end) / 2).otherwise(F.col("start"))
    end = F.when(next_start < F.col("end"), (next_start + F.col("end")) / 2).otherwise(F.col("end"))
    return m.select("file_id", "ord", "speaker", "n", start.alias("start"), end.alias("end"))


def merge_any(df: DataFrame, gap: float = 0.1) -> DataFrame:
    """OP-33: as collapse without regard to speakers."""
    return islands(df, gap, False).groupBy("file_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def refine(df: DataFrame, gap: float = 1.5, least: float = 0.3) -> DataFrame:
    """OP-34: collapse with a running pairwise mean of the confidences; merged segments shorter than least go."""
    held = islands(df, gap).groupBy("file_id", "island").agg(
        F.min_by("speaker", "ord").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("ord", F.struct("start", "ord")).alias("ord"), F.sort_array(F.collect_list(F.struct("start", "ord", "confidence"))).alias("_c")
    )
    mean = F.aggregate(F.slice("_c", 2, F.greatest(F.size("_c"), F.lit(1))), F.get("_c", F.lit(0))["confidence"], lambda a, x: (a + x["confidence"]) / 2)
    return held.select("file_id", "ord", "speaker", "start", "end", mean.alias("confidence")).where(F.col("end") - F.col("start") >= least)


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlaps(df: DataFrame, bucket: float = 3600.0) -> DataFrame:
    """OP-35: (file_id, ord_a, ord_b, speaker_a, speaker_b, start, end) of overlapping segments of different speakers. A pair is found in the time bucket where its overlap starts."""
    side = lambda s: df.select("file_id", *[F.col(c).alias(f"{c}_{s}") for c in ("ord", "speaker", "start", "end")], _buckets(F.col("start"), F.col("end"), bucket).alias("_bucket"))
    a, b = side("a"), side("b")
    before = (F.col("start_a") < F.col("start_b")) | ((F.col("start_a") == F.col("start_b")) & (F.col("ord_a") < F.col("ord_b")))
    start, end = F.greatest("start_a", "start_b"), F.least("end_a", "end_b")
    pairs = a.join(b, ["file_id", "_bucket"]).where(before & (F.col("speaker_a") != F.col("speaker_b")) & (start < end) & (F.floor(start / bucket) == F.col("_bucket")))
    return pairs.select("file_id", "ord_a", "ord_b", "speaker_a", "speaker_b", start.alias("start"), end.alias("end"))


def contained(windows: DataFrame, segments: DataFrame, slack: float = 0.1, bucket: float = 3600.0) -> DataFrame:
    """OP-41: windows inside a segment, give or take slack: (file_id, seg_ord, ord)."""
    w = windows.select("file_id", "ord", F.col("start").alias("_ws"), F.col("end").alias("_we"), F.floor(F.col("start") / bucket).alias("_bucket"))
    s = segments.select("file_id", F.col("ord").alias("seg_ord"), F.col("start").alias("_ss"), F.col("end").alias("_se"), _buckets(F.col("start") - slack, F.col("end") + slack, bucket).alias("_bucket"))
    return w.join(s, ["file_id", "_bucket"]).where((F.col("_ws") >= F.col("_ss") - slack) & (F.col("_we") <= F.col("_se") + slack)).select("file_id", "seg_ord", "ord")


def nearest_label(df: DataFrame, label: str = "label") -> DataFrame:
    """OP-40: rows without a label take that of the labelled row of the nearest midpoint; of two at one distance the earlier one."""
    mid = (F.col("start") + F.col("end")) / 2
    d = df.withColumn("_mid", mid)
    w = Window.partitionBy("file_id").orderBy("_mid", "ord")
    # What follows is what precedes in the other order; a frame of all that follows would be quadratic.
    back = Window.partitionBy("file_id").orderBy(F.desc("_mid"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    # Of labelled rows at one midpoint the first in order stands for all.
    tie = Window.partitionBy("file_id", "_mid", F.col(label).isNull()).orderBy("ord")
    at = F.when(F.col(label).isNotNull(), F.struct(F.col("_mid").alias("m"), F.first(label).over(tie).alias("l"), F.first("ord").over(tie).alias("o")))
    d = d.withColumn("_at", at)
    d = d.withColumn("_p", F.last("_at", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.last("_at", True).over(back))
    dp, dn = F.col("_mid") - F.col("_p")["m"], F.col("_n")["m"] - F.col("_mid")
    use_p = F.col("_n").isNull() | (F.col("_p").isNotNull() & ((dp < dn) | ((dp == dn) & (F.col("_p")["o"] <= F.col("_n")["o"]))))
    near = F.when(use_p, F.col("_p")["l"]).otherwise(F.col("_n")["l"])
    return d.select(*df.columns, F.coalesce(F.col(label), near).alias("nearest"))


def identified(df: DataFrame, gap: float = 1.0, legacy: bool = False) -> DataFrame:
    """OP-42: same speaker and start less than gap after the last end; confidences are weighted by duration. legacy: a new piece's duration also counts in the old one's weight."""
    held = islands(df, gap, True, FILE, last_end=True, strict=True).groupBy("file_id", "island").agg(
        F.min_by("speaker", "ord").alias("speaker"), F.min_by("ord", F.struct("start", "ord")).alias("ord"), F.sort_array(F.collect_list(F.struct("start", "ord", "end", "confidence"))).alias("_p")
    )
    first = F.get("_p", F.lit(0))

    def step(s: Column, x: Column) -> Column:
        old = (F.when(F.lit(legacy), x["end"]).otherwise(s["e"])) - s["s"]
        new = x["end"] - x["start"]
        total = old + new
        return F.struct(s["s"].alias("s"), x["end"].alias("e"), F.when(total > 0, (s["c"] * old + x["confidence"] * new) / total).otherwise(s["c"]).alias("c"))

    out = F.aggregate(F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), F.struct(first["start"].alias("s"), first["end"].alias("e"), first["confidence"].alias("c")), step)
    return held.withColumn("_o", out).select("file_id", "ord", "speaker", F.col("_o")["s"].alias("start"), F.col("_o")["e"].alias("end"), F.col("_o")["c"].alias("confidence"))


def silence_complement(silences: DataFrame, durations: DataFrame, least: float = 0.5, strict: bool = False) -> DataFrame:
    """OP-43: the speech between silences (file_id, ord, start, end) of files (file_id, duration); a file without silences is speech throughout. Lasting at least least (strict: more)."""
    w = in_order()
    gaps = silences.select("file_id", F.coalesce(F.lag("end").over(w), F.lit(0.0)).alias("_from"), F.col("start").alias("_to"))
    tail = durations.join(silences.groupBy("file_id").agg(F.max_by("end", F.struct("start", "ord")).alias("_from")), "file_id", "left").select("file_id", F.coalesce("_from", F.lit(0.0)).alias("_from"), F.col("duration").alias("_to"))
    long_ = F.col("_to") - F.col("_from")
    return gaps.unionByName(tail).where(long_ > least if strict else long_ >= least).select("file_id", F.col("_from").alias("start"), F.col("_to").alias("end"))


def split_even(df: DataFrame, most: float = 30.0) -> DataFrame:
    """OP-44: segments longer than most become int(duration / most) + 1 equal parts."""
    d = F.col("end") - F.col("start")
    n = F.when(d > most, F.floor(d / most) + 1).otherwise(1)
    parts = df.withColumn("_n", n.cast("long")).withColumn("_step", d / F.col("_n"))
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return parts.select("file_id", "ord", "part", (F.col("start") + F.col("part") * F.col("_step")).alias("start"), (F.col("start") + (F.col("part") + 1) * F.col("_step")).alias("end"))


def split_fixed(df: DataFrame, most: float = 30.0) -> DataFrame:
    """OP-45: pieces of most seconds, the last one shorter."""
    n = F.greatest(F.ceil((F.col("end") - F.col("start")) / most), F.lit(1).cast("long"))
    parts = df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("start") + F.col("part") * most
    return parts.select("file_id", "ord", "part", start.alias("_s"), F.least(start + most, F.col("end")).alias("end")).withColumnRenamed("_s", "start")


def chunk_padded(df: DataFrame, samples: str = "samples", size: int = 480_000) -> DataFrame:
    """OP-46: fixed chunks of a sample array, the last one padded with zeros."""
    n = F.greatest(F.ceil(F.size(samples) / size), F.lit(1).cast("long"))
    cut = df.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    part = F.slice(samples, (F.col("chunk") * size + 1).cast("int"), size)
    zero = F.lit(0).cast("float")
    return cut.withColumn(samples, F.concat(part.cast("array<float>"), F.array_repeat(zero, F.lit(size) - F.size(part))))


_FIELDS = ["file_id", "ord", "start", "end", "speaker"]


def _stateful(df: DataFrame, fold, columns: list[str], **more: str) -> DataFrame:
    """fold(rows of a file in order) -> rows, for steps that depend on the one before. The columns are of the types that they have in df, and more is added. Rows without a start or end are left out."""
    schema = ", ".join(f"`{c}` {more.get(c) or dict(df.dtypes)[c]}" for c in [*columns, *more])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf.sort_values(["start", "ord"], kind="stable").reset_index(drop=True))

    return df.where(F.col("start").isNotNull() & F.col("end").isNotNull()).groupBy("file_id").applyInPandas(run, schema)


def pack_greedy(df: DataFrame, most: float = 30.0) -> DataFrame:
    """OP-47: consecutive segments share a group until the next would exceed most; none is split."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        group, held, out = 0, 0.0, []
        for k, size in enumerate((p["end"] - p["start"]).tolist()):
            if k and held + size > most:
                group, held = group + 1, 0.0
            held += size
            out.append(group)
        return p.assign(group=out)[["file_id", "ord", "start", "end", "group"]]

    return _stateful(df, fold, ["file_id", "ord", "start", "end"], group="long")


def group_capped(df: DataFrame, gap: float = 1.5, most: float = 30.0) -> DataFrame:
    """OP-36: same speaker, gap at most, and the whole group no longer than most; a group ends where its last segment does."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for f, o, s, e, who in p[["file_id", "ord", "start", "end", "speaker"]].itertuples(index=False):
            if out and out[-1][4] == who and s - out[-1][3] <= gap and e - out[-1][2] <= most:
                out[-1][3] = e
            else:
                out.append([f, o, s, e, who])
        return pd.DataFrame(out, columns=["file_id", "ord", "start", "end", "speaker"])

    return _stateful(df, fold, _FIELDS)


def _collapsed(rows: list[list], gap: float) -> list[list]:
    out: list[list] = []
    for r in sorted(rows, key=lambda r: r[2]):
        if out and out[-1][4] == r[4] and r[2] - out[-1][3] <= gap:
            out[-1][3] = max(out[-1][3], r[3])
        else:
            out.append(list(r))
    return out


def absorb_islands(df: DataFrame, short: float = 1.0) -> DataFrame:
    """OP-37: a segment under short between two of one other speaker takes that speaker, from left to right; then equal neighbours collapse; until nothing changes."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        rows = p[_FIELDS].values.tolist()
        while True:
            changed = False
            for k in range(1, len(rows) - 1):
                left, here, right = rows[k - 1], rows[k], rows[k + 1]
                if here[3] - here[2] < short and left[4] == right[4] != here[4]:
                    here[4], changed = left[4], True
            if not changed:
                return pd.DataFrame(rows, columns=_FIELDS)
            rows = _collapsed(rows, 0.0)

    return _stateful(df, fold, _FIELDS)


def ghosts(df: DataFrame, least: float = 10.0) -> DataFrame:
    """First pass of OP-39: df with ghost, whether the speaker talks less than least seconds in the file."""
    total = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("file_id", "speaker"))
    return df.withColumn("ghost", total < least)


def drop_ghosts(df: DataFrame, least: float = 10.0, gap: float = 1.0) -> DataFrame:
    """OP-39: ghosts' segments go to the first alternative that is no ghost, else to the nearest segment's speaker by midpoint, in order; then segments collapse. Unchanged if all are ghosts."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        alternatives = [None if o is None else [a["speaker"] if isinstance(a, dict) else a for a in o] for o in p["alternatives"]] if "alternatives" in p else [None] * len(p)
        rows = p[_FIELDS].values.tolist()
        total: dict = {}
        for r in rows:
            total[r[4]] = total.get(r[4], 0.0) + r[3] - r[2]
        ghost = {s for s, t in total.items() if t < least}
        if ghost and len(ghost) < len(total):
            for r, other in zip(rows, alternatives):
                if r[4] in ghost:
                    named = [a for a in (other if other is not None else []) if a not in ghost]
                    if named:
                        r[4] = named[0]
                    else:
                        mid = (r[2] + r[3]) / 2
                        r[4] = min((x for x in rows if x[4] not in ghost), key=lambda x: abs((x[2] + x[3]) / 2 - mid))[4]
            rows = _collapsed(rows, gap)
        return pd.DataFrame(rows, columns=_FIELDS)

    return _stateful(df, fold, _FIELDS)


def clamp_boundaries(df: DataFrame, proposals: DataFrame, shift: float = 0.05, least: float = 0.3) -> DataFrame:
    """OP-38, the ordered part: boundaries proposed as (file_id, ord of the left segment, boundary) move if by more than shift and if both sides keep least seconds; then short segments go."""
    joined = df.join(proposals, ["file_id", "ord"], "left")

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        rows, to = p[_FIELDS].values.tolist(), p["boundary"].tolist()
        for k in range(len(rows) - 1):
            left, right, b = rows[k], rows[k + 1], to[k]
            if left[4] == right[4] or b is None or b != b:
                continue
            b = round(b, 4)
            if abs(b - left[3]) > shift and b - left[2] >= least and right[3] - b >= least:
                left[3] = right[2] = b
        return pd.DataFrame([r for r in rows if r[3] - r[2] >= least], columns=_FIELDS)

    return _stateful(joined, fold, _FIELDS)


def boundary_windows(df: DataFrame, rate: int = 16_000, search: float = 1.5, window: float = 0.5, stride: float = 0.1, least: float = 0.3) -> DataFrame:
    """OP-38, the sub-windows: of every change of speaker (file_id, ord of the left segment, left, right, k, start, end, t), windows every stride within search seconds of the left segment's end.

    A window that would pass the file's last segment ends there; one under least seconds is left out. t is its middle.
    """
    w = in_order()
    most = F.max("end").over(Window.partitionBy("file_id"))
    d = df.withColumn("right", F.lead("speaker").over(w)).withColumn("_m", F.floor(most * rate)).where(F.col("right") != F.col("speaker"))
    a, b = F.floor(F.greatest(F.lit(0.0), F.col("end") - search) * rate), F.floor(F.least(F.col("_m") / rate, F.col("end") + search) * rate)
    step, size, short = int(stride * rate), int(window * rate), int(least * rate)
    d = d.withColumn("_a", a).withColumn("_n", F.floor((b - F.col("_a") - short) / step)).where("_n >= 0")
    k = d.select("file_id", "ord", F.col("speaker").alias("left"), "right", "_a", "_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))).alias("k"))
    k = k.withColumn("_s", F.col("_a") + F.col("k") * step).withColumn("_e", F.least(F.col("_s") + size, F.col("_m"))).where(F.col("_e") - F.col("_s") >= short)
    return k.select("file_id", "ord", "left", "right", "k", (F.col("_s") / rate).alias("start"), (F.col("_e") / rate).alias("end"), ((F.col("_s") + F.col("_e")) / 2 / rate).alias("t"))


def boundary_sides(windows: DataFrame, centroids: DataFrame) -> DataFrame:
    """OP-38, the comparison: sub-windows (file_id, ord, left, right, t, v) to (file_id, ord, t, side): left or right if the nearest of the file's centroids (file_id, speaker, v) is that speaker's, else null."""
    from tessera.operators.vectors import cosine_distance

    some = windows.where(F.col("v").isNotNull())
    near = some.alias("w").join(centroids.select("file_id", "speaker", F.col("v").alias("_c")), "file_id")
    best = near.groupBy("file_id", "ord", "t").agg(F.min_by("speaker", F.struct(cosine_distance(F.col("v"), F.col("_c")), "speaker")).alias("_s"), F.first("left").alias("left"), F.first("right").alias("right"))
    return best.select("file_id", "ord", "t", F.when(F.col("_s") == F.col("left"), "left").when(F.col("_s") == F.col("right"), "right").alias("side"))


def boundary_proposals(samples: DataFrame) -> DataFrame:
    """OP-38, the vote: of sub-windows (file_id, ord, t, side) around a boundary, side left or right by nearest centroid, the mean of the last left and the first later right."""
    last = samples.groupBy("file_id", "ord").agg(F.max(F.when(F.col("side") == "left", F.col("t"))).alias("_l"))
    right = samples.where("side = 'right'").join(last, ["file_id", "ord"]).where(F.col("t") > F.col("_l")).groupBy("file_id", "ord").agg(F.min("t").alias("_r"), F.first("_l").alias("_l"))
    return right.select("file_id", "ord", F.round((F.col("_l") + F.col("_r")) / 2, 4).alias("boundary"))


def attach_turns(chunks: DataFrame, silences: DataFrame, size: float = 30.0) -> DataFrame:
    """OP-49: chunks (file_id, chunk, text) with turn_at, the first silence end in (chunk * size, (chunk + 1) * size], null if none or if the chunk has no text."""
    s = silences.select("file_id", (F.ceil(F.col("end") / size) - 1).alias("chunk"), "end").groupBy("file_id", "chunk").agg(F.min("end").alias("_at"))
    return chunks.join(s, ["file_id", "chunk"], "left").withColumn("turn_at", F.when(F.trim("text") != "", F.col("_at"))).drop("_at")


def batches(df: DataFrame, size: int = 4) -> DataFrame:
    """OP-50: number of the batch of size rows, in order within the file."""
    return df.withColumn("batch", F.floor((F.row_number().over(in_order()) - 1) / size))


def long_enough(df: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """OP-25: minimum duration."""
    d = F.col("end") - F.col("start")
    return df.where(d > least if strict else d >= least)


def speaker_totals(df: DataFrame) -> DataFrame:
    """OP-19, 97, 98, 100: segments, seconds and mean confidence of each speaker of a file."""
    d = F.col("end") - F.col("start")
    return df.groupBy("file_id", "speaker").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum(d), 1).alias("seconds"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


def job_totals(results: DataFrame, failed: Column) -> DataFrame:
    """OP-100, 104: of results, a row each: how many there are, how many have failed, and the distinct speakers, those of failed ones too."""
    return results.agg(F.count(F.lit(1)).alias("files"), F.count_if(failed).alias("failed"), F.countDistinct("speaker").alias("speakers"))


def review(df: DataFrame) -> DataFrame:
    """OP-19: (file_id, json) with each speaker's totals, by name, and all segments in order."""
    t = speaker_totals(df).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("speaker", "segments", "seconds", "mean_confidence"))).alias("speakers"))
    s = df.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start", "ord", "end", "speaker", "confidence"))).alias("_s"))
    rows = F.transform("_s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["speaker"].alias("speaker"), x["confidence"].alias("confidence")))
    return t.join(s, "file_id").select("file_id", F.to_json(F.struct("speakers", rows.alias("segments"))).alias("json"))


def talkative(df: DataFrame, least: float = 10.0) -> DataFrame:
    """OP-28: segments of speakers with least seconds or more in the file."""
    return df.withColumn("_t", F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("file_id", "speaker"))).where(F.col("_t") >= least).drop("_t")


def mode_ratio(df: DataFrame, keys: tuple[str, ...] = FILE, value: str = "speaker") -> DataFrame:
    """OP-99: the most frequent value and its share; of equals the least."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("a"), F.col(value).alias("b"))).alias("mode"), (F.max("_n") / F.sum("_n")).alias("ratio"), F.count(F.lit(1)).alias("n_distinct"))


def first_appearance(df: DataFrame, label: str = "speaker", prefix: str = "SPEAKER") -> DataFrame:
    """OP-63: labels renamed by first start."""
    first = df.groupBy("file_id", label).agg(F.min(F.struct("start", "ord")).alias("_f"))
    named = first.withColumn("name", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy("file_id").orderBy("_f"))))
    return df.join(named.drop("_f"), ["file_id", label])


def transcribe_carried(chunks: DataFrame, model, prefix) -> DataFrame:
    """OP-88: chunks (file_id, ord, text) in order; model(text, prefix) gives a chunk's text, prefix(text) what is carried to the next."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        carried, out = "", []
        for text in pdf.sort_values("ord")["text"]:
            got = model(text, carried)
            carried = prefix(got)
            if got:
                out.append(got)
        return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]], "text": [" ".join(out)]})

    return chunks.groupBy("file_id").applyInPandas(run, f"file_id {dict(chunks.dtypes)['file_id']}, text string")


def mapped_batches(df: DataFrame, model, schema: str, tries: int = 3, wait: float = 1.0, most: float = 30.0) -> DataFrame:
    """OP-96: model(pandas frame) -> frame with the columns of the schema, batch by batch. schema ends in "error string".

    A call that raises is repeated after wait * 2**k seconds, most at most; after tries calls the batch's rows come out with the error and nulls in what the model would have added,
    so there are as many rows as went in.
    """
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in range(tries):
                try:
                    yield model(pdf).assign(error=None)[names]
                    break
                except Exception as e:  # noqa: BLE001 - goes to the error column
                    if k + 1 == tries:
                        yield pdf.assign(**{c: None for c in names if c not in pdf.columns} | {"error": f"{type(e).__name__}: {e}"})[names]
                    else:
                        time.sleep(min(wait * 2**k, most))

    return df.mapInPandas(run, schema)
