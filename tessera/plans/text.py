"""Queries of the transcript text functions."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.adapters import SEG, TURNS, seg, turns
from tessera.session import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _hms(s: str) -> str:
    t = f"CAST(floor({s}) AS BIGINT)"
    return f"printf('%02d:%02d:%02d', {t} // 3600, {t} % 3600 // 60, {t} % 60)"


@query("fmt_timestamp", f"SELECT event_id, {_hms('value * 60')} AS hms, {_hms('value * 60')} || printf(',%03d', CAST(floor((value * 60 - floor(value * 60)) * 1000) AS BIGINT)) AS srt, printf('%02d-%02d', CAST(floor(value * 60) AS BIGINT) // 60, CAST(floor(value * 60) AS BIGINT) % 60) AS ms FROM events")
def fmt_timestamp(spark, d):
    s = F.col("value") * 60
    return table(spark, d, "events").select("event_id", T.clock(s).alias("hms"), T.clock(s, "srt").alias("srt"), T.clock(s, "ms").alias("ms"))


@query("parse_time", f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(floor(value * 60) AS DOUBLE) WHEN 1 THEN round(value, 2) WHEN 2 THEN event_id % 90 * 60 + event_id % 60 END AS seconds FROM events")
def parse_time(spark, d):
    """Whole clock times, plain seconds, minutes and seconds, and strings that are no time."""
    e, k = table(spark, d, "events"), F.col("event_id") % 4
    text = F.when(k == 0, T.clock(F.col("value") * 60)).when(k == 1, F.format_string("%.2f", F.round("value", 2))).when(k == 2, F.format_string("%d:%02d", F.col("event_id") % 90, F.col("event_id") % 60)).otherwise(F.concat(F.lit("at "), "event_type"))
    return e.select("event_id", T.parse_clock(text).alias("seconds"))


_DIGIT = "((('0x' || right(md5(url), 8))::BIGINT >> (5 * {k})) % 32)"
_LETTER = f"CASE WHEN {_DIGIT} < 26 THEN chr(CAST(65 + {_DIGIT} AS INTEGER)) ELSE CAST({_DIGIT} - 26 AS VARCHAR) END"


@query("name_hash", "SELECT page_id, concat(" + ", ".join(_LETTER.format(k=k) for k in range(6)) + ") AS hash FROM pages")
def name_hash(spark, d):
    return table(spark, d, "pages").select("page_id", T.short_hash(F.col("url")).alias("hash"))


@query("extension_filter", """SELECT page_id, name FROM (SELECT page_id, 'a/' || page_id || list_extract(['.wav', '.MP3', '.txt', '', '.flac', '.m4a', '.wav.bak'], CAST(page_id % 7 AS INTEGER) + 1) AS name FROM pages) WHERE name LIKE '%.wav' OR name LIKE '%.MP3' OR name LIKE '%.flac' OR name LIKE '%.m4a'""")
def extension_filter(spark, d):
    from tessera.sources.audio import has_extension

    ends = F.array(*[F.lit(x) for x in (".wav", ".MP3", ".txt", "", ".flac", ".m4a", ".wav.bak")])
    named = table(spark, d, "pages").select("page_id", F.concat(F.lit("a/"), F.col("page_id").cast("string"), F.get(ends, (F.col("page_id") % 7).cast("int"))).alias("name"))
    return named.where(has_extension(F.col("name")))


_ORDERED = "string_agg({x}, '{s}' ORDER BY ord)"
_TRIM = "trim(text)"


@query(
    "transcript_txt",
    f"""WITH {TURNS}, x AS (SELECT *, CASE WHEN coalesce(lag(speaker) OVER (PARTITION BY file_id ORDER BY ord) <> speaker, true) THEN chr(10) || '[' || {_hms('start')} || '] ' || speaker || ':' || chr(10) ELSE '' END AS head FROM turns WHERE trim(text) <> '')
    SELECT file_id, string_agg(head || trim(text) || ' ', '' ORDER BY ord) AS text FROM x GROUP BY file_id""",
)
def transcript_txt(spark, d):
    return T.transcript_txt(turns(spark, d))


@query(
    "transcript_gaps",
    f"""WITH {TURNS}, x AS (SELECT *, CASE WHEN coalesce(start - lag("end") OVER (PARTITION BY file_id ORDER BY ord) > 0.5, true) THEN chr(10) || '[' || {_hms('start')} || ']' || chr(10) ELSE '' END AS head FROM turns WHERE trim(text) <> '')
    SELECT file_id, string_agg(head || trim(text) || ' ', '' ORDER BY ord) AS text FROM x GROUP BY file_id""",
)
def transcript_gaps(spark, d):
    return T.transcript_gaps(turns(spark, d), 0.5)


@query("transcript_srt", f"""WITH {TURNS} SELECT file_id, ord, row_number() OVER (PARTITION BY file_id ORDER BY ord) || chr(10) || {_hms('start')} || ',000 --> ' || {_hms('"end"')} || ',000' || chr(10) || speaker || ': ' || trim(text) || chr(10) || chr(10) AS cue FROM turns""")
def transcript_srt(spark, d):
    return T.transcript_srt(turns(spark, d))


@query("transcript_json", f"""WITH {TURNS} SELECT file_id, string_agg(text, ' ' ORDER BY ord) AS full_text, list(text ORDER BY ord) AS texts, list(start::DOUBLE ORDER BY ord) AS starts, list("end"::DOUBLE ORDER BY ord) AS ends, list(speaker ORDER BY ord) AS speakers FROM turns GROUP BY file_id""")
def transcript_json(spark, d):
    j = T.transcript_json(turns(spark, d))
    got = F.from_json("json", "segments array<struct<text:string,start:double,end:double,speaker:string>>, full_text string")
    return j.withColumn("_j", got).select("file_id", F.col("_j.full_text").alias("full_text"), *[F.col(f"_j.segments.{c}").alias(f"{c}s") for c in ("text", "start", "end", "speaker")])


@query("dangling_header", f"""WITH {TURNS} SELECT file_id, ord, CASE WHEN ord % 3 = 1 THEN text || ' tail' ELSE regexp_replace(text, '\\n+$', '') END AS text FROM turns""")
def dangling_header(spark, d):
    """A header at the end of two texts of three, with a line feed before and white space behind it or not."""
    header = F.concat(F.lit("\n["), T.clock(F.col("start")), F.lit("] "), F.col("speaker"), F.when(F.col("ord") % 3 == 2, ": \n").otherwise(":"))
    made = F.when(F.col("ord") % 3 == 1, F.concat("text", F.lit(" tail"))).otherwise(F.concat("text", header))
    return turns(spark, d).select("file_id", "ord", T.without_dangling_header(made).alias("text"))


@query("joined_text", f"""WITH {TURNS} SELECT file_id, string_agg(text, ' ' ORDER BY ord) AS text FROM turns GROUP BY file_id""")
def joined_text(spark, d):
    return T.joined_text(turns(spark, d), ["file_id"])


@query("speaker_line", f"""WITH {SEG} SELECT ord, chr(10) || '[' || {_hms('value')} || '] ' || speaker || ' (' || CAST(round_even(100 * confidence, 0) AS INTEGER) || '%)' || CASE WHEN confidence >= 0.5 THEN ' [also: x ' || CAST(round_even(100 * confidence, 0) AS INTEGER) || '%]' ELSE '' END || ':' || chr(10) AS line FROM seg""")
def speaker_line(spark, d):
    others = F.array(F.struct(F.lit("x").alias("speaker"), F.col("confidence").alias("confidence")))
    return seg(spark, d).select("ord", T.speaker_line(F.col("value"), F.col("speaker"), F.col("confidence"), others).alias("line"))


@query(
    "tag_parse",
    """WITH l AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\\s\\v]+'), lambda x: x <> '') AS w FROM conversations)
    SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN '' ELSE concat('[Speaker 1]: ', array_to_string(w[greatest(len(w) - 9, 1):], ' '), ' [Speaker 22]: ', array_to_string(w[greatest(len(w) - 9, 1):], ' ')) END AS prefix FROM l""",
)
def tag_parse(spark, d):
    """Two turns with every text, and one without words."""
    twice = F.concat(F.lit("before [Speaker 1]: "), F.col("text"), F.lit("\n[Speaker 22]:"), F.col("text"), F.lit(" [Speaker 3]:  "))
    return table(spark, d, "conversations").select("conv_id", "turn", T.tagged_tail(twice).alias("prefix"))


@query("detokenise", """SELECT conv_id, turn, trim(replace(text, '▁', ' ')) AS text FROM conversations""")
def detokenise(spark, d):
    c = table(spark, d, "conversations")
    tokens = F.concat(F.array(F.lit("<|en|>")), F.split(F.replace("text", F.lit(" "), F.lit(" ▁")), " "), F.array(F.lit("<|end|>")))
    return c.select("conv_id", "turn", T.detokenised(tokens).alias("text"))


@query("loop_clean")
def loop_clean(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.loop_cleaned("text").alias("text"))


def _punct_sql(text: str) -> str:
    """The same rules without references to groups, letter by letter and sign by sign."""
    t = f"regexp_replace({text}, '<\\|[^\\n]*?\\|>', '', 'g')"
    for c in string.ascii_letters + string.digits + "_":
        t = f"regexp_replace({t}, '\\b{c}(?:\\s+{c}){{2,}}\\b', '{c}', 'g')"
    for c in map(chr, range(0xC0, 0x100)):
        t = f"regexp_replace({t}, '(^|[^\\pL\\pN_]){c}(?:\\s+{c}){{2,}}($|[^\\pL\\pN_])', '\\1{c}\\2', 'g')"
    for c in ",.!?":
        t = f"regexp_replace({t}, '[{c}](?:\\s+[{c}]){{2,}}', '{c}', 'g')"
    for c in ",.!?":
        t = f"regexp_replace({t}, '[{c}]{{2,}}', '{c}', 'g')"
    return f"trim({t}, ' ,.!?')"


_STUTTER = "'a a  a B B B B x B B 7 7 7. . . well, , , <|nospeech|> '"


@query("punct_cleanup", f"SELECT doc_id, {_punct_sql(f'{_STUTTER} || text')} AS text FROM documents")
def punct_cleanup(spark, d):
    return table(spark, d, "documents").select("doc_id", T.punctuation_cleaned(F.concat(F.lit(_STUTTER[1:-1]), F.col("text"))).alias("text"))


#: White space as Python's split() takes it.
_GAP = "[\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(
    "punctuate",
    f"""WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '{_GAP}'), lambda x: x <> '') AS w FROM conversations),
    s AS (SELECT *, list_transform(w, lambda x, i: concat(x, CASE ((i - 1) % 200) % 9 WHEN 8 THEN '.' WHEN 4 THEN ',' ELSE '' END)) AS p FROM w),
    u AS (SELECT *, list_transform(p, lambda x, i: CASE WHEN i = 1 THEN upper(x[1]) || x[2:] WHEN regexp_matches(p[i - 1], '[.?!]$') AND x[1] BETWEEN 'a' AND 'z' THEN upper(x[1]) || x[2:] ELSE x END) AS c FROM s)
    SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN text ELSE array_to_string(c, ' ') END AS text FROM u""",
)
def punctuate(spark, d):
    def model(words):
        """Two pieces a word: in nine words of a block the last ends a sentence, the fifth has a comma. The second piece's label is passed over."""
        return [x for k, w in enumerate(words) for x in (("▁" + w[:1], {8: "PERIOD", 4: "COMMA"}.get(k % 9, "0")), (w[1:], "QUESTION"))]

    return table(spark, d, "conversations").select("conv_id", "turn", T.punctuation_udf(model)("text").alias("text"))


@query(
    "blockwise_punct",
    f"""WITH {TURNS}, x AS (SELECT *, lead(ord) OVER w IS NULL AS last, coalesce(start - lag("end") OVER w > 0.5, true) AS new FROM turns WHERE trim(text) <> '' WINDOW w AS (PARTITION BY file_id ORDER BY ord))
    SELECT file_id, chr(10) || string_agg('[' || {_hms('start')} || ']' || chr(10) || '<' || trim(text) || ' ' || CASE WHEN last THEN '' ELSE chr(10) END || '>', '' ORDER BY ord) AS text FROM x GROUP BY file_id""",
)
def blockwise_punct(spark, d):
    """Every turn of the table is more than 0.5 s after the one before, so each has a header."""
    return T.blockwise(T.transcript_gaps(turns(spark, d), 0.5), "text", lambda c: F.concat(F.lit("<"), c, F.lit(">")))


@query("path_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://')")
def path_prefix(spark, d):
    from tessera.sources.audio import under

    return table(spark, d, "pages").where(under(F.col("url"), "https:/")).select("page_id")


@query("audio_base64", "SELECT page_id, base64(encode(url)) AS b64 FROM pages")
def audio_base64(spark, d):
    return table(spark, d, "pages").select("page_id", T.base64_of(F.col("url").cast("binary")).alias("b64"))


@query("legend", f"""WITH {SEG}, p AS (SELECT file_id, speaker, sum(CAST(value AS DECIMAL(18, 3)))::DOUBLE AS t FROM seg GROUP BY ALL) SELECT file_id, string_agg(speaker || ': 120 Hz, ' || printf('%.1f', floor(t)) || ' s', chr(10) ORDER BY speaker) AS legend FROM p GROUP BY file_id""")
def legend(spark, d):
    p = seg(spark, d).groupBy("file_id", "speaker").agg(F.floor(F.sum(F.col("value").cast("decimal(18,3)"))).cast("double").alias("total_speech_sec")).withColumn("pitch_hz", F.lit(120.0))
    return T.legend(p)


@query("vocabulary", "SELECT DISTINCT l_linestatus || ' x' AS token, l_linenumber AS id FROM lineitem")
def vocabulary(spark, d):
    from tessera.sources.audio import parse_vocabulary

    lines = table(spark, d, "lineitem").select(F.concat("l_linestatus", F.lit(" x "), "l_linenumber").alias("value")).distinct()
    return parse_vocabulary(lines).select("token", "id")


@query("progress_events", "SELECT event_id, event_type AS step, CAST(user_id AS BIGINT) AS completed FROM events WHERE event_type <> 'view'")
def progress_events(spark, d):
    from tessera.sources.audio import parse_progress

    lines = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.when(F.col("event_type") == "view", "result").otherwise("progress").alias("type"), F.col("event_type").alias("step"), F.col("user_id").alias("completed"), F.lit(9).alias("total"))).alias("value"))
    return parse_progress(lines, "event_id").where("type = 'progress'").select("event_id", "step", "completed")
