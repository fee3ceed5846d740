"""Audio, vocabulary, voiceprint and progress sources, and the sinks of transcripts and segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import flac, sound
from tessera.sources.resample import resampled

RATE = 16_000
#: File name extensions of media files, by tool.
MEDIA = (".wav", ".mp3", ".flac", ".m4a", ".ogg", ".opus", ".aac", ".wma", ".mp4", ".mkv")
MAX_SECONDS = 600.0


def has_extension(path: Column, extensions: tuple[str, ...] = MEDIA) -> Column:
    """OP-22: the lower-cased suffix is in the set."""
    return F.lower(F.regexp_extract(path, r"\.[^.]+$", 0)).isin(*extensions)


def under(path: Column, folder: str) -> Column:
    """OP-23: the path is in the folder; a sibling whose name begins alike isn't."""
    return path.startswith(folder.rstrip("/") + "/")


def media_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = MEDIA) -> DataFrame:
    """OP-11, 12: (path, modificationTime, length, content) of media files below a folder or glob, with the sub-folder as speaker."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(has_extension(F.col("path"), extensions)).withColumn("speaker", F.element_at(F.split("path", "/"), -2))


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the rate of a WAV (PCM of 8, 16, 24 or 32 bits, or floats) or FLAC file."""
    return sound.decoded_bytes(content)


def encode_wav(x: np.ndarray, rate: int = RATE) -> bytes:
    return sound.wav(np.asarray(x, np.float32), rate)


def decoded(files: DataFrame, rate: int = RATE) -> DataFrame:
    """OP-01, 02, 05: (path, sr, samples, error) at the rate, mono; what can't be read has an error and no samples. For files longer than a row, see sources.sound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, content = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                try:
                    x, r = decode_wav(content)
                    x, sr, error = pa.array([resampled(x, r, rate)], pa.list_(pa.float32())), rate, None
                except Exception as e:  # noqa: BLE001 - goes to the error column
                    x, sr, error = pa.array([None], pa.list_(pa.float32())), None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([sr], pa.int32()), x, pa.array([error], pa.string())], ["path", "sr", "samples", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, sr int, samples array<float>, error string")


def not_converted(files: DataFrame, done: DataFrame) -> DataFrame:
    """OP-03: files without a result of the same stem yet."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.withColumn("_s", stem).join(done.select(stem.alias("_s")).distinct(), "_s", "left_anti").drop("_s")


def cut(samples: Column, start: Column, end: Column, rate: int = RATE) -> Column:
    """OP-04, 07, 48: samples from start to end seconds; a null end is the end of the file."""
    n = F.size(samples)
    i = F.floor(start * rate).cast("int")
    j = F.least(F.coalesce(F.floor(end * rate).cast("int"), n), n)
    return F.slice(samples, i + 1, F.greatest(j - i, F.lit(0)))


def duration(samples: Column, rate: int = RATE) -> Column:
    """OP-06: seconds; 0 without samples."""
    return F.coalesce(F.size(samples) / F.lit(float(rate)), F.lit(0.0))


def probed_duration(log: Column) -> Column:
    """OP-06: seconds of a line with "Duration: H:M:S.f"; 0 without one."""
    part = lambda k: F.regexp_extract(log, r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", k).try_cast("double")
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0.0))


def guarded(df: DataFrame, most: float = MAX_SECONDS) -> DataFrame:
    """OP-26: an error in the error column for audio of over most seconds; an error that is there stays."""
    had = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return df.withColumn("error", F.coalesce(had, F.when(duration(F.col("samples")) > most, F.lit("audio too long"))))


def parse_vocabulary(lines: DataFrame) -> DataFrame:
    """OP-10: (token, id) of lines, split at the last space; lines that end in no number are left out."""
    part = lambda k: F.regexp_extract("value", r"^(.*) (\d+)$", k)
    return lines.select(part(1).alias("token"), part(2).try_cast("int").alias("id")).where(F.col("id").isNotNull())


_PRINT = "name string, v array<double>, pitch_hz double, energy_rms double, total_speech_sec double"
_RESULT = "segments array<struct<start:double,end:double,speaker:string,confidence:double>>"


def read_voiceprints(spark: SparkSession, path: str) -> DataFrame:
    """OP-08: voiceprints of JSON lines."""
    return spark.read.schema(_PRINT).json(path)


def write_voiceprints(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_diarization(spark: SparkSession, path: str, speaker: str | None = None) -> DataFrame:
    """OP-09, 27: segments of result files, of one speaker if asked."""
    rows = spark.read.schema(_RESULT).option("multiLine", "true").json(path).selectExpr("inline(segments)")
    return rows.where(F.col("speaker") == speaker) if speaker else rows


def parse_progress(lines: DataFrame, *keep: str) -> DataFrame:
    """OP-20: progress and result events of JSON lines; lines that aren't JSON have a null type."""
    e = F.from_json("value", "type string, step string, completed bigint, total bigint, error string")
    return lines.select(*keep, e.alias("_e")).select(*keep, "_e.*")


def write_text(df: DataFrame, path: str, text: str = "text") -> None:
    """OP-13, 14: one text file a partition."""
    df.select(F.col(text).cast("string").alias("value")).write.mode("overwrite").text(path)


def named_segments(df: DataFrame) -> DataFrame:
    """OP-18: segments (path, speaker, start, end, confidence, samples) to (speaker, file_name, samples): named by hash of the stem, time, confidence and length, without an extension."""
    from tessera.functions.text import clock, short_hash

    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    name = F.concat_ws("_", short_hash(stem), clock(F.col("start"), "ms"), F.bround(100 * F.col("confidence")).cast("int").cast("string"), F.format_string("%.1fs", F.col("end") - F.col("start")))
    return df.select("speaker", name.alias("file_name"), "samples")


def segment_files(df: DataFrame, rate: int = RATE, encoding: str = "wav") -> DataFrame:
    """OP-18: segments (path, speaker, start, end, confidence, samples) to (speaker, file_name, content): PCM WAV or FLAC files. Null samples give an empty file."""

    @F.pandas_udf("binary")
    def content(samples: pd.Series) -> pd.Series:
        each = (np.asarray([] if x is None else x, np.float32) for x in samples)
        return pd.Series([encode_wav(x, rate) if encoding == "wav" else flac.encoded(sound.whole(x)[:, None], rate) for x in each], dtype=object)

    return named_segments(df).select("speaker", F.concat("file_name", F.lit(f".{encoding}")).alias("file_name"), content("samples").alias("content"))


def write_sound(df: DataFrame, path: str, rate: int = RATE, encoding: str = "wav", mode: str = "append") -> None:
    """OP-18: segments as files in a folder for each speaker; nothing is left of tasks that failed (see sources.sound)."""
    named = named_segments(df)
    sound.register(df.sparkSession)
    named.write.format("sound").option("path", path).option("rate", rate).option("encoding", encoding).mode(mode).save()


def read_sound(spark: SparkSession, path: str, rate: int = RATE, seconds: float = 30.0, **options: object) -> DataFrame:
    """OP-01, 02, 04, 05, 07: WAV and FLAC files of any length as chunks at the rate, mono. Options: see sources.sound; from and to read the parts of that time only."""
    sound.register(spark)
    return spark.read.format("sound").options(path=path, rate=rate, seconds=seconds, **options).load()


def concatenated(df: DataFrame, keys: list[str]) -> DataFrame:
    """OP-48: samples of the rows (ord, samples) of a group, one after the other. A group is a chunk of at most half a minute."""
    return df.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "samples"))), lambda s: F.coalesce(s["samples"], F.array().cast("array<float>")))).alias("samples"))


def write_segments(df: DataFrame, path: str, rate: int = RATE) -> None:
    """OP-18: the files of segment_files, a folder for each speaker; rows of Parquet, from which any store can be filled."""
    segment_files(df, rate).write.mode("overwrite").partitionBy("speaker").parquet(path)


def write_review(df: DataFrame, path: str) -> None:
    """OP-19: the review of each file (see segments.review), a line of JSON each."""
    from tessera.operators.segments import review

    review(df).select("json").write.mode("overwrite").text(path)
