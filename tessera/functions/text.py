"""Transcript text: column functions and the few that need a loop over the text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

INAUDIBLE = "[inaudible]"


def clock(s: Column, kind: str = "hms") -> Column:
    """OP-81: truncated HH:MM:SS, for srt with ,mmm; ms: MM-SS."""
    t = F.floor(s).cast("int")
    if kind == "ms":
        return F.format_string("%02d-%02d", F.floor(t / 60).cast("int"), t % 60)
    hms = F.format_string("%02d:%02d:%02d", F.floor(t / 3600).cast("int"), F.floor(t % 3600 / 60).cast("int"), t % 60)
    return hms if kind == "hms" else F.concat(hms, F.format_string(",%03d", F.floor((s - F.floor(s)) * 1000).cast("int")))


def parse_clock(t: Column) -> Column:
    """OP-82: H:M:S, M:S or seconds to seconds."""
    p = F.transform(F.split(t, ":"), lambda x: x.try_cast("double"))
    return F.aggregate(p, F.lit(0.0), lambda a, x: a * 60 + x)


def base64_of(content: Column) -> Column:
    """OP-93: bytes of a file as a model's request takes them, without line ends."""
    return F.regexp_replace(F.base64(content), r"\s", "")


def short_hash(stem: Column) -> Column:
    """OP-83: six letters for a file name: the low six base-32 digits of its MD5, the lowest first, in letters and digits."""
    n = F.conv(F.right(F.md5(stem.cast("binary")), F.lit(8)), 16, 10).cast("long")
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")  # fixed value
    return F.concat(*[F.substring(letters, (F.shiftright(n, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(6)])


def percent(c: Column) -> Column:
    """OP-94: whole percent, half to even."""
    return F.concat(F.bround(100 * c).cast("int").cast("string"), F.lit("%"))


def speaker_line(start: Column, name: Column, confidence: Column, others: Column, least: float = 0.5) -> Column:
    """OP-84: the header of a speaker's part; others is array<struct<speaker, confidence>>."""
    also = F.array_join(F.transform(F.filter(others, lambda o: o["confidence"] >= least), lambda o: F.concat(o["speaker"], F.lit(" "), percent(o["confidence"]))), ", ")
    return F.concat(F.lit("\n["), clock(start), F.lit("] "), name, F.lit(" ("), percent(confidence), F.lit(")"), F.when(also != "", F.concat(F.lit(" [also: "), also, F.lit("]"))).otherwise(""), F.lit(":\n"))


def without_dangling_header(text: Column) -> Column:
    """OP-85: text without a speaker header at its very end."""
    return F.regexp_replace(text, r"\n*\[\d{2}:\d{2}:\d{2}\] [^\n]*:\s*$", "")


def detokenised(tokens: Column) -> Column:
    """OP-86: tokens joined, without <|...; U+2581 is a space."""
    return F.trim(F.replace(F.array_join(F.filter(tokens, lambda t: ~t.startswith("<|")), ""), F.lit("▁"), F.lit(" ")))


def tagged_tail(text: Column, n: int = 10) -> Column:
    """OP-87: of every "[Speaker k]: ..." turn the last n words, joined; empty without tags."""
    bodies = F.regexp_extract_all(text, F.lit(r"\[Speaker \d+\]:\s*((?:(?!\[Speaker \d+\]:)[\s\S])*)"), F.lit(1))
    tags = F.regexp_extract_all(text, F.lit(r"(\[Speaker \d+\]:)"), F.lit(1))
    words = lambda b: F.filter(F.split(b, r"\s+"), lambda w: w != "")
    last = lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - (n - 1), F.lit(1)), n), " ")
    turns = F.zip_with(tags, F.transform(bodies, words), lambda t, w: F.when(F.size(w) > 0, F.concat(t, F.lit(" "), last(w))))
    return F.array_join(F.filter(turns, lambda x: x.isNotNull()), " ")


def punctuation_cleaned(text: Column) -> Column:
    """OP-91: no <|...|>; a letter or digit that stands alone three times or more, and a sign that repeats, once; none of " ,.!?" at the ends."""
    t = F.regexp_replace(text, r"<\|[^\n]*?\|>", "")
    t = F.regexp_replace(t, r"(?U)\b(\w)(?:\s+\1){2,}\b", "$1")
    t = F.regexp_replace(t, r"(?U)([,.!?])(?:\s+\1){2,}", "$1")
    t = F.regexp_replace(t, r"([,.!?])\1+", "$1")
    return F.regexp_replace(t, r"^[ ,.!?]+|[ ,.!?]+\z", "")


#: What counts as a loop, as a row of tags, and as the remains between two tags.
_LOOP = re.compile(r"(.{4,120}?)(?:\s+\1){2,}", re.IGNORECASE)
_TAGS = re.compile(r"(\[inaudible\]\s*){2,}")
_BETWEEN = re.compile(r"\[inaudible\]\s+(?:\w[\w\s,\']{0,80}?)\s+\[inaudible\]")
_LONGEST_UNIT = 120


def without_tail(left: str, unit: str) -> str:
    """OP-80: left without white space at its end and without the most of the unit's last words that it ends with."""
    left, words = left.rstrip(), unit.lower().split()
    low = left.lower()
    tail = next((t for k in range(len(words)) if low.endswith(t := " ".join(words[k:]))), "")
    return left[: len(left) - len(tail)].rstrip()


def without_head(right: str, unit: str) -> str:
    """OP-80: right without white space at its beginning and without the most of the unit's first words that it begins with."""
    right, words = right.lstrip(), unit.lower().split()
    low = right.lower()
    head = next((h for k in range(len(words), 0, -1) if low.startswith(h := " ".join(words[:k]))), "")
    return right[len(head) :].lstrip()


def _again(text: str, at: int) -> int:
    """A place from which to look for loops after a change at the given place: no loop that starts before it reaches that place."""
    need = 3 * _LONGEST_UNIT + 2
    while at > 0 and need > 0:
        at -= 1
        need -= not text[at].isspace()
    return at


def _candidates(piece: str, reach: int, most: int) -> list[int]:
    """The first most places of a piece whose next four characters, whatever their case, come again within reach and once more within twice reach: no loop begins elsewhere."""
    low = piece.lower().replace("ς", "σ")
    if len(low) != len(piece):
        low = "".join(c.lower()[0] for c in piece).replace("ς", "σ")
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - 3
    if n < 3:
        return []
    gram = (c[:n] | c[1 : n + 1] << np.uint64(21) | c[2 : n + 2] << np.uint64(42)) * np.uint64(0x9E3779B97F4A7C15) + c[3:]
    order = np.argsort(gram, kind="stable")
    again = gram[order[1:]] == gram[order[:-1]]
    after = np.full(2 * n + 2 * reach + 2, 2 * n + 2 * reach + 1)
    after[order[:-1][again]] = order[1:][again]
    at = np.arange(min(n, most))
    return at[(after[at] - at <= reach) & (after[after[at]] - at <= 2 * reach)].tolist()


def _next_loop(text: str, at: int, space: int) -> re.Match | None:
    """The first loop that starts at a place or later, looked for piece by piece; space is the longest run of white space."""
    reach = _LONGEST_UNIT + space
    step = max(8192, 4 * reach)
    for begin in range(at, len(text), step):
        for k in _candidates(text[begin : begin + step + 2 * reach + 4], reach, step):
            if m := _LOOP.match(text, begin + k):
                return m
    return None


def clean_loops(text: str) -> str:
    """OP-79: units of 4 to 120 characters within a line that follow each other three times or more, with white space between, become a tag, with the parts of the unit
    beside them; then tags in a row, and tags with a few words between them, become one. The whole text is searched, however long, until no loop is left."""
    at, space = 0, max(map(len, re.findall(r"\s+", text)), default=0)
    while m := _next_loop(text, at, space):
        left, right = without_tail(text[: m.start()], m[1]), without_head(text[m.end() :], m[1])
        new = " ".join(part for part in (left, INAUDIBLE, right) if part)
        if new == text:
            break
        text, at = new, _again(left, len(left))
    return _BETWEEN.sub(INAUDIBLE, _TAGS.sub(INAUDIBLE + " ", text)).strip()


def loop_cleaned(text: Column | str) -> Column:
    """clean_loops of a column; a null stays null."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else clean_loops(t) for t in texts], dtype=object)

    return run(text)


#: Labels of the punctuation model and their signs.
_SIGNS = {"PERIOD": ".", "COMMA": ",", "QUESTION": "?", "EXCLAMATION": "!"}
_SENTENCE = re.compile(r"([.?!]\s+)([a-z])")


def word_labels(pieces: list[tuple[str, str]], words: int) -> list[str]:
    """OP-89: of a model's sub-tokens (piece, label), of which those with U+2581 begin a word, the label of each word's first piece; "0" for words without any."""
    first = [label for k, (piece, label) in enumerate(pieces) if not k or piece.startswith("▁")]
    return (first + ["0"] * words)[:words]


def punctuated(words: list[str], labels: list[str]) -> str:
    """OP-89: words with the sign of their label appended, an upper-case letter at the beginning and for a-z after . ? ! and white space."""
    text = _SENTENCE.sub(lambda m: m[1] + m[2].upper(), " ".join(w + _SIGNS.get(label, "") for w, label in zip(words, labels)))
    return text[:1].upper() + text[1:]


def punctuation_udf(model, block: int = 200):
    """Text to punctuated text; model(words) gives the sub-tokens (piece, label) of a block of words. Null and blank texts stay as they are."""

    def one(text: str | None) -> str | None:
        words = (text or "").split()
        if not words:
            return text
        return punctuated(words, [x for i in range(0, len(words), block) for x in word_labels(model(words[i : i + block]), len(words[i : i + block]))])

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return run


HEADER = r"\[\d{2}:\d{2}:\d{2}\][^\n]*\n"


def blockwise(df: DataFrame, text: str, body) -> DataFrame:
    """OP-90: body(column) applied to the parts of each row's text between headers, which stay as they are, as do blank parts; a null text stays null."""
    heads = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(f"({HEADER})"), F.lit(1)))
    parts = F.arrays_zip(heads.alias("h"), F.split(text, HEADER, -1).alias("b"))
    joined = F.array_join(F.transform(parts, lambda p: F.concat(p["h"], F.when(p["b"].rlike(r"\S"), body(p["b"])).otherwise(p["b"]))), "")
    return df.withColumn(text, F.when(F.col(text).isNotNull(), joined))


def blockwise_texts(texts: pd.Series, body) -> pd.Series:
    """OP-90 for a body that is a function of a string, such as a model's; for use in a pandas UDF."""
    cut = re.compile(f"({HEADER})")
    parts = [None if t is None else cut.split(t) for t in texts]
    return pd.Series([None if p is None else "".join(x if k % 2 or not x.strip() else body(x) for k, x in enumerate(p)) for p in parts], dtype=object)


def joined_text(df: DataFrame, keys: list[str]) -> DataFrame:
    """OP-92: texts of a file in order, joined by spaces, with summed seconds and tokens where there are such columns."""
    sums = [F.sum(c).alias(c) for c in ("inference_time_sec", "tokens_generated") if c in df.columns]
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), " ").alias("text"), *sums)


def transcript_txt(df: DataFrame) -> DataFrame:
    """OP-13: (file_id, text): a header where the speaker changes, texts with a space after each, no dangling header."""
    w = Window.partitionBy("file_id").orderBy("ord")
    d = df.where(F.trim("text") != "")
    head = F.when(F.coalesce(F.lag("speaker").over(w) != F.col("speaker"), F.lit(True)), F.concat(F.lit("\n["), clock(F.col("start")), F.lit("] "), F.col("speaker"), F.lit(":\n"))).otherwise("")
    lines = d.withColumn("_l", F.concat(head, F.trim("text"), F.lit(" ")))
    return lines.groupBy("file_id").agg(without_dangling_header(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_l"))), lambda s: s["_l"]), "")).alias("text"))


def transcript_gaps(df: DataFrame, gap: float = 1.5) -> DataFrame:
    """OP-17: as transcript_txt, with a header at first and after more than gap seconds without text."""
    w = Window.partitionBy("file_id").orderBy("ord")
    d = df.where(F.trim("text") != "")
    new = F.coalesce(F.col("start") - F.lag("end").over(w) > gap, F.lit(True))
    d = d.withColumn("_l", F.concat(F.when(new, F.concat(F.lit("\n["), clock(F.col("start")), F.lit("]\n"))).otherwise(""), F.trim("text"), F.lit(" ")))
    return d.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_l"))), lambda s: s["_l"]), "").alias("text"))


def transcript_srt(df: DataFrame) -> DataFrame:
    """OP-14: (file_id, ord, cue) numbered cue blocks."""
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("ord"))
    return df.select("file_id", "ord", F.concat(n.cast("string"), F.lit("\n"), clock(F.col("start"), "srt"), F.lit(" --> "), clock(F.col("end"), "srt"), F.lit("\n"), F.col("speaker"), F.lit(": "), F.trim("text"), F.lit("\n\n")).alias("cue"))


def transcript_json(df: DataFrame) -> DataFrame:
    """OP-15: (file_id, json) with segments in order and the full text."""
    s = df.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text", "start", "end", "speaker"))).alias("_s"))
    segments = F.transform("_s", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), x["speaker"].alias("speaker")))
    return s.select("file_id", F.to_json(F.struct(segments.alias("segments"), F.array_join(F.transform("_s", lambda x: x["text"]), " ").alias("full_text"))).alias("json"))


def legend(profiles: DataFrame) -> DataFrame:
    """OP-16: (file_id, legend): a line for each speaker by name."""
    line = F.concat(F.col("speaker"), F.lit(": "), F.bround("pitch_hz").cast("int").cast("string"), F.lit(" Hz, "), F.format_string("%.1f", "total_speech_sec"), F.lit(" s"))
    return profiles.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("speaker").alias("s"), line.alias("l")))), lambda x: x["l"]), "\n").alias("legend"))
