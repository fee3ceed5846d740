"""Queries of the segment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import segments as S
from tessera.plans.adapters import SCALE, SEG, TURNS, seg, turns
from tessera.session import table

GAP = 3600.0
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _r(*cols: str, n: int = 3):
    return [F.round(c, n).alias(c) for c in cols]


def _islands(gap: float, by_speaker: bool = True, source: str = "seg") -> str:
    run = "sum(nw) OVER (PARTITION BY file_id ORDER BY start, ord ROWS UNBOUNDED PRECEDING)" if by_speaker else "0"
    return f"""a AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS nw FROM {source} WINDOW w AS (PARTITION BY file_id ORDER BY start, ord)),
    b AS (SELECT *, {run} AS run FROM a),
    c AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY file_id, run ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS br FROM b),
    isl AS (SELECT *, sum(br) OVER (PARTITION BY file_id ORDER BY start, ord ROWS UNBOUNDED PRECEDING) AS island FROM c)"""


_MERGED = """m AS (SELECT file_id, island, arg_min(speaker, ord) AS speaker, min(start) AS start, max("end") AS "end", arg_min(ord, (start, ord)) AS ord, count(*) AS n FROM isl GROUP BY file_id, island)"""


@query("seg_collapse", f"""WITH {SEG}, {_islands(GAP)}, {_MERGED} SELECT file_id, ord, speaker, round(start, 3) AS start, round("end", 3) AS "end", n FROM m""")
def seg_collapse(spark, d):
    return S.collapse(seg(spark, d), GAP).select("file_id", "ord", "speaker", *_r("start", "end"), "n")


@query(
    "seg_merge_trim",
    f"""WITH {SEG}, {_islands(GAP)}, {_MERGED} SELECT file_id, ord, speaker, n,
    round(CASE WHEN start < lag("end") OVER w THEN (start + lag("end") OVER w) / 2 ELSE start END, 3) AS start,
    round(CASE WHEN lead(start) OVER w < "end" THEN (lead(start) OVER w + "end") / 2 ELSE "end" END, 3) AS "end" FROM m WINDOW w AS (PARTITION BY file_id ORDER BY start, ord)""",
)
def seg_merge_trim(spark, d):
    return S.merge_trim(seg(spark, d), GAP).select("file_id", "ord", "speaker", "n", *_r("start", "end"))


@query("vad_merge", f"""WITH {SEG}, {_islands(0.1, False)} SELECT file_id, round(min(start), 3) AS start, round(max("end"), 3) AS "end", count(*) AS n FROM isl GROUP BY file_id, island""")
def vad_merge(spark, d):
    return S.merge_any(seg(spark, d)).select("file_id", *_r("start", "end"), "n")


@query(
    "seg_refine_conf",
    f"""WITH {SEG}, {_islands(GAP)}, m AS (SELECT file_id, island, arg_min(speaker, ord) AS speaker, min(start) AS start, max("end") AS "end", arg_min(ord, (start, ord)) AS ord,
    list(confidence ORDER BY start, ord) AS cs FROM isl GROUP BY file_id, island)
    SELECT file_id, ord, speaker, round(start, 3) AS start, round("end", 3) AS "end", round(list_reduce(cs, lambda a, x: (a + x) / 2), 9) AS confidence FROM m WHERE "end" - start >= 300""",
)
def seg_refine_conf(spark, d):
    return S.refine(seg(spark, d), GAP, 300.0).select("file_id", "ord", "speaker", *_r("start", "end"), *_r("confidence", n=9))


@query(
    "seg_overlaps",
    f"""WITH {SEG} SELECT a.file_id, a.ord AS ord_a, b.ord AS ord_b, a.speaker AS speaker_a, b.speaker AS speaker_b, round(greatest(a.start, b.start), 3) AS start, round(least(a."end", b."end"), 3) AS "end"
    FROM seg a JOIN seg b ON a.file_id = b.file_id AND (a.start < b.start OR (a.start = b.start AND a.ord < b.ord)) AND a.speaker <> b.speaker AND greatest(a.start, b.start) < least(a."end", b."end")""",
)
def seg_overlaps(spark, d):
    return S.overlaps(seg(spark, d), 6 * 3600.0).select("file_id", "ord_a", "ord_b", "speaker_a", "speaker_b", *_r("start", "end"))


@query(
    "seg_contains",
    f"""WITH {SEG}, {_islands(GAP)}, {_MERGED} SELECT s.file_id, m.ord AS seg_ord, s.ord FROM seg s JOIN m ON s.file_id = m.file_id AND s.start >= m.start - 0.1 AND s."end" <= m."end" + 0.1""",
)
def seg_contains(spark, d):
    s = seg(spark, d)
    return S.contained(s, S.collapse(s, GAP), bucket=86400.0)


@query(
    "seg_nearest",
    f"""WITH {SEG}, k AS (SELECT *, (start + "end") / 2 AS mid, CASE WHEN value >= 50 THEN speaker END AS label FROM seg),
    j AS (SELECT a.file_id, a.ord, arg_min(b.label, (abs(a.mid - b.mid), b.ord)) AS nearest FROM k a JOIN k b ON a.file_id = b.file_id AND b.label IS NOT NULL WHERE a.label IS NULL GROUP BY a.file_id, a.ord)
    SELECT k.file_id, k.ord, k.label, coalesce(k.label, j.nearest) AS nearest FROM k LEFT JOIN j USING (file_id, ord)""",
)
def seg_nearest(spark, d):
    k = seg(spark, d).withColumn("label", F.when(F.col("value") >= 50, F.col("speaker")))
    return S.nearest_label(k).select("file_id", "ord", "label", "nearest")


def _silences(spark, d):
    s = seg(spark, d)
    first = s.groupBy("file_id").agg(F.min("start").alias("_0"))
    rel = s.join(first, "file_id").select("file_id", "ord", (F.col("start") - F.col("_0") + 10).alias("start"), (F.col("start") - F.col("_0") + 11).alias("end"))
    return rel, rel.groupBy("file_id").agg((F.max("end") + 5).alias("duration"))


_SIL = f"""{SEG}, rel AS (SELECT file_id, ord, start - min(start) OVER (PARTITION BY file_id) + 10 AS start, start - min(start) OVER (PARTITION BY file_id) + 11 AS "end" FROM seg)"""


@query(
    "silence_complement",
    f"""WITH {_SIL}, g AS (SELECT file_id, coalesce(lag("end") OVER (PARTITION BY file_id ORDER BY start, ord), 0.0) AS f, start AS t FROM rel
    UNION ALL SELECT file_id, arg_max("end", (start, ord)), max("end") + 5 FROM rel GROUP BY file_id) SELECT file_id, round(f, 3) AS start, round(t, 3) AS "end" FROM g WHERE t - f >= 0.5""",
)
def silence_complement(spark, d):
    s, n = _silences(spark, d)
    return S.silence_complement(s, n).select("file_id", *_r("start", "end"))


@query(
    "split_even",
    f"""WITH {SEG}, n AS (SELECT *, CASE WHEN "end" - start > 3000 THEN CAST(floor(("end" - start) / 3000) AS BIGINT) + 1 ELSE 1 END AS n FROM seg),
    p AS (SELECT *, unnest(range(n)) AS part FROM n) SELECT file_id, ord, part, round(start + part * (("end" - start) / n), 3) AS start, round(start + (part + 1) * (("end" - start) / n), 3) AS "end" FROM p""",
)
def split_even(spark, d):
    return S.split_even(seg(spark, d), 3000.0).select("file_id", "ord", "part", *_r("start", "end"))


@query(
    "split_fixed",
    f"""WITH {SEG}, p AS (SELECT *, unnest(range(CAST(greatest(ceil(("end" - start) / 3000), 1) AS BIGINT))) AS part FROM seg)
    SELECT file_id, ord, part, round(start + part * 3000, 3) AS start, round(least(start + part * 3000 + 3000, "end"), 3) AS "end" FROM p""",
)
def split_fixed(spark, d):
    return S.split_fixed(seg(spark, d), 3000.0).select("file_id", "ord", "part", *_r("start", "end"))


@query(
    "pack_greedy",
    f"""WITH RECURSIVE {SEG}, o AS (SELECT file_id, ord, "end" - start AS size, row_number() OVER (PARTITION BY file_id ORDER BY start, ord) AS k FROM seg),
    r AS (SELECT file_id, ord, k, size AS held, CAST(0 AS BIGINT) AS grp FROM o WHERE k = 1
      UNION ALL SELECT o.file_id, o.ord, o.k, CASE WHEN r.held + o.size > 90000 THEN o.size ELSE r.held + o.size END, CASE WHEN r.held + o.size > 90000 THEN r.grp + 1 ELSE r.grp END FROM r JOIN o ON o.file_id = r.file_id AND o.k = r.k + 1)
    SELECT file_id, ord, grp AS "group" FROM r""",
)
def pack_greedy(spark, d):
    return S.pack_greedy(seg(spark, d).select("file_id", "ord", "start", "end"), 90000.0).select("file_id", "ord", "group")


_ORDERED = f"""{SEG}, o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start, ord) AS k FROM seg)"""


@query(
    "group_capped",
    f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT file_id, k, ord, speaker, start AS s, "end" AS e, ord AS head FROM o WHERE k = 1
      UNION ALL SELECT file_id, k, ord, speaker, CASE WHEN j THEN s ELSE start END, "end", CASE WHEN j THEN head ELSE ord END
      FROM (SELECT o.*, r.s, r.head, r.speaker = o.speaker AND o.start - r.e <= {GAP} AND o."end" - r.s <= 90000 AS j FROM r JOIN o ON o.file_id = r.file_id AND o.k = r.k + 1))
    SELECT file_id, head AS ord, any_value(speaker) AS speaker, round(any_value(s), 3) AS start, round(arg_max(e, k), 3) AS "end" FROM r GROUP BY file_id, head""",
)
def group_capped(spark, d):
    return S.group_capped(seg(spark, d).select("file_id", "ord", "start", "end", "speaker"), GAP, 90000.0).select("file_id", "ord", "speaker", *_r("start", "end"))


@query(
    "identified_merge",
    f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT file_id, k, speaker, start AS s, "end" AS e, confidence AS c, ord AS head FROM o WHERE k = 1
      UNION ALL SELECT file_id, k, speaker, CASE WHEN j THEN s ELSE start END, "end", CASE WHEN NOT j THEN confidence WHEN e - s + "end" - start > 0 THEN (c * (e - s) + confidence * ("end" - start)) / (e - s + "end" - start) ELSE c END, CASE WHEN j THEN head ELSE ord END
      FROM (SELECT o.*, r.s, r.e, r.c, r.head, r.speaker = o.speaker AND o.start - r.e < {GAP} AS j FROM r JOIN o ON o.file_id = r.file_id AND o.k = r.k + 1))
    SELECT file_id, head AS ord, any_value(speaker) AS speaker, round(any_value(s), 3) AS start, round(arg_max(e, k), 3) AS "end", round(arg_max(c, k), 8) AS confidence FROM r GROUP BY file_id, head""",
)
def identified_merge(spark, d):
    return S.identified(seg(spark, d), GAP).select("file_id", "ord", "speaker", *_r("start", "end"), *_r("confidence", n=8))


# A round goes from left to right over a file's list of (start, end, speaker), each step seeing what the last has changed; then neighbours that touch become one. A file is done after a round without changes.
_ABSORB_SQL = f"""WITH RECURSIVE {SEG}, f AS (SELECT {{key}} AS file_id, list(struct_pack(s := start, e := "end", w := speaker, o := ord) ORDER BY start, ord) AS l FROM seg GROUP BY ALL),
    r AS (SELECT file_id, l, CAST(2 AS BIGINT) AS k, false AS changed, false AS done FROM f
      UNION ALL SELECT file_id, CASE WHEN k < len(l) THEN CASE WHEN hit THEN list_concat(list_concat(l[:k - 1], [struct_pack(s := l[k].s, e := l[k].e, w := l[k - 1].w, o := l[k].o)]), l[k + 1:]) ELSE l END
        WHEN changed THEN list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN a[-1].w = x[1].w AND x[1].s - a[-1].e <= 0
          THEN list_concat(a[:len(a) - 1], [struct_pack(s := a[-1].s, e := greatest(a[-1].e, x[1].e), w := a[-1].w, o := a[-1].o)]) ELSE list_concat(a, x) END) ELSE l END,
        CASE WHEN k < len(l) THEN k + 1 ELSE 2 END, CASE WHEN k < len(l) THEN changed OR hit ELSE false END, k >= len(l) AND NOT changed
      FROM (SELECT *, k < len(l) AND l[k].e - l[k].s < 6000 AND l[k - 1].w = l[k + 1].w AND l[k - 1].w <> l[k].w AS hit FROM r WHERE NOT done)),
    x AS (SELECT file_id, unnest(l) AS x FROM r WHERE done) SELECT file_id, x.o AS ord, x.w AS speaker, round(x.s, 3) AS start, round(x.e, 3) AS "end" FROM x"""


@query("island_absorb", _ABSORB_SQL.format(key="file_id"))
def island_absorb(spark, d):
    return S.absorb_islands(seg(spark, d).select("file_id", "ord", "start", "end", "speaker"), 6000.0).select("file_id", "ord", "speaker", *_r("start", "end"))


def _named(spark, d):
    return seg(spark, d).select(F.concat(F.lit("calls/"), F.col("file_id"), F.lit(".wav")).alias("file_id"), "ord", "start", "end", "speaker")


_NAME = "SELECT * REPLACE ('calls/' || file_id || '.wav' AS file_id) FROM"


@query("island_absorb_paths", _ABSORB_SQL.format(key="'calls/' || file_id || '.wav'"))
def island_absorb_paths(spark, d):
    """File ids that are paths, as the sources give them."""
    return S.absorb_islands(_named(spark, d), 6000.0).select("file_id", "ord", "speaker", *_r("start", "end"))


@query("pack_greedy_paths", f"{_NAME} ({ORACLE_SQL['pack_greedy']})")
def pack_greedy_paths(spark, d):
    return S.pack_greedy(_named(spark, d), 90000.0).select("file_id", "ord", "group")


@query("group_capped_paths", f"{_NAME} ({ORACLE_SQL['group_capped']})")
def group_capped_paths(spark, d):
    return S.group_capped(_named(spark, d), GAP, 90000.0).select("file_id", "ord", "speaker", *_r("start", "end"))


@query("ghost_flag", f"""WITH {SEG} SELECT file_id, ord, speaker, sum("end" - start) OVER (PARTITION BY file_id, speaker) < 200000 AS ghost FROM seg""")
def ghost_flag(spark, d):
    return S.ghosts(seg(spark, d), 200000.0).select("file_id", "ord", "speaker", "ghost")


@query(
    "ghost_full",
    f"""WITH RECURSIVE {SEG}, t AS (SELECT *, sum("end" - start) OVER (PARTITION BY file_id, speaker) < 200000 AS ghost FROM seg),
    f AS (SELECT file_id, bool_or(ghost) AND NOT bool_and(ghost) AS mixed, list(speaker ORDER BY start, ord) AS s, list((start + "end") / 2 ORDER BY start, ord) AS m, list(ghost ORDER BY start, ord) AS g FROM t GROUP BY file_id),
    r AS (SELECT f.*, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS a FROM f WHERE mixed
      UNION ALL SELECT file_id, mixed, s, m, g, k + 1, list_append(a, CASE WHEN g[k + 1] THEN list_sort(list_transform(list_filter(range(1, len(s) + 1), lambda j: j <> k + 1 AND (j <= k OR NOT g[j])), lambda j: struct_pack(d := abs(m[j] - m[k + 1]), j := j, who := CASE WHEN j <= k THEN a[j] ELSE s[j] END)))[1].who ELSE s[k + 1] END)
      FROM r WHERE k < len(s)),
    o AS (SELECT seg.*, row_number() OVER (PARTITION BY file_id ORDER BY start, ord) AS k FROM seg),
    x AS (SELECT o.file_id, o.ord, o.start, o."end", r.mixed, coalesce(r.a[o.k], o.speaker) AS speaker FROM o LEFT JOIN r ON o.file_id = r.file_id AND r.k = len(r.s)), {_islands(1.0, True, "x")}
    SELECT file_id, arg_min(ord, (start, ord)) AS ord, any_value(speaker) AS speaker, round(min(start), 3) AS start, round(max("end"), 3) AS "end" FROM isl GROUP BY file_id, CASE WHEN mixed THEN island ELSE -ord - 1 END""",
)
def ghost_full(spark, d):
    return S.drop_ghosts(seg(spark, d).select("file_id", "ord", "start", "end", "speaker"), 200000.0, 1.0).select("file_id", "ord", "speaker", *_r("start", "end"))


@query("ghost_full_paths", f"{_NAME} ({ORACLE_SQL['ghost_full']})")
def ghost_full_paths(spark, d):
    return S.drop_ghosts(_named(spark, d), 200000.0, 1.0).select("file_id", "ord", "speaker", *_r("start", "end"))


_VOTE = f"""{SEG}, t AS (SELECT speaker, ord, start, CASE WHEN value < 50 THEN 'left' ELSE 'right' END AS side, ord // 40 AS k FROM seg)"""


@query(
    "boundary_vote",
    f"""WITH {_VOTE}, l AS (SELECT k, max(start) AS l FROM t WHERE side = 'left' GROUP BY k), r AS (SELECT t.k, min(t.start) AS r, any_value(l.l) AS l FROM t JOIN l USING (k) WHERE side = 'right' AND start > l.l GROUP BY ALL)
    SELECT k AS ord, round(round((l + r) / 2, 4), 3) AS boundary FROM r""",
)
def boundary_vote(spark, d):
    """Forty events stand for the sub-windows around a boundary."""
    t = seg(spark, d).select(F.lit(0).alias("file_id"), F.floor(F.col("ord") / 40).alias("ord"), F.col("start").alias("t"), F.when(F.col("value") < 50, "left").otherwise("right").alias("side"))
    return S.boundary_proposals(t).select("ord", *_r("boundary"))


@query(
    "boundary_windows",
    f"""WITH {SEG}, x AS (SELECT *, lead(speaker) OVER w AS after, max("end") OVER (PARTITION BY file_id) AS most FROM seg WINDOW w AS (PARTITION BY file_id ORDER BY start, ord)),
    e AS (SELECT file_id, ord, speaker AS "left", after AS "right", greatest(0.0, "end" - 1800) AS a, least(most, "end" + 1800) AS b, most FROM x WHERE after <> speaker),
    p AS (SELECT *, unnest(range(CAST(floor((floor(b) - floor(a) - 400) / 300) AS BIGINT) + 1)) AS k FROM e WHERE floor(b) - floor(a) >= 400)
    SELECT file_id, ord, "left", "right", k, round(floor(a) + k * 300, 3) AS start, round(least(floor(a) + k * 300 + 600, floor(most)), 3) AS "end" FROM p WHERE least(floor(a) + k * 300 + 600, floor(most)) - (floor(a) + k * 300) >= 400""",
)
def boundary_windows(spark, d):
    w = S.boundary_windows(seg(spark, d), 1, 1800.0, 600.0, 300.0, 400.0)
    return w.select("file_id", "ord", "left", "right", "k", *_r("start", "end"))


@query(
    "boundary_refine",
    f"""WITH RECURSIVE {SEG}, {_islands(GAP)}, {_MERGED}, q AS (SELECT file_id, ord, speaker,
      CASE WHEN start < lag("end") OVER w THEN (start + lag("end") OVER w) / 2 ELSE start END AS start, CASE WHEN lead(start) OVER w < "end" THEN (lead(start) OVER w + "end") / 2 ELSE "end" END AS "end" FROM m WINDOW w AS (PARTITION BY file_id ORDER BY start, ord)),
    o AS (SELECT *, row_number() OVER w AS k, lead(speaker) OVER w AS next_speaker, lead("end") OVER w AS next_end, lead(start) OVER w AS next_start, round("end" + ord % 5 - 2, 4) AS b FROM q WINDOW w AS (PARTITION BY file_id ORDER BY start, ord)),
    r AS (SELECT *, start AS s, speaker <> next_speaker AND abs(b - "end") > 0.05 AND b - start >= 0.3 AND next_end - b >= 0.3 AS moved FROM o WHERE k = 1
      UNION ALL SELECT *, speaker <> next_speaker AND abs(b - "end") > 0.05 AND b - s >= 0.3 AND next_end - b >= 0.3 FROM (SELECT o.*, CASE WHEN coalesce(r.moved, false) THEN r.b ELSE o.start END AS s FROM r JOIN o ON o.file_id = r.file_id AND o.k = r.k + 1))
    SELECT file_id, ord, speaker, round(s, 2) AS start, round(CASE WHEN coalesce(moved, false) THEN b ELSE "end" END, 2) AS "end" FROM r WHERE CASE WHEN coalesce(moved, false) THEN b ELSE "end" END - s >= 0.3""",
)
def boundary_refine(spark, d):
    m = S.merge_trim(seg(spark, d), GAP).select("file_id", "ord", "start", "end", "speaker")
    p = m.select("file_id", "ord", (F.col("end") + F.pmod(F.col("ord"), F.lit(5)) - 2).alias("boundary"))
    return S.clamp_boundaries(m, p).select("file_id", "ord", "speaker", *_r("start", "end", n=2))


@query(
    "turn_attach",
    f"""WITH {TURNS}, s AS (SELECT file_id, CAST(ceil("end" / 30) - 1 AS BIGINT) AS chunk, min("end") AS at FROM turns GROUP BY ALL),
    c AS (SELECT file_id, ord AS chunk, text FROM turns) SELECT c.file_id, c.chunk, CASE WHEN trim(c.text) <> '' THEN s.at END AS turn_at FROM c LEFT JOIN s USING (file_id, chunk)""",
)
def turn_attach(spark, d):
    t = turns(spark, d)
    return S.attach_turns(t.select("file_id", F.col("ord").alias("chunk"), "text"), t.select("file_id", "end")).select("file_id", "chunk", "turn_at")


@query("seg_batches", f"""WITH {SEG} SELECT file_id, ord, CAST(floor((row_number() OVER (PARTITION BY file_id ORDER BY start, ord) - 1) / 4) AS BIGINT) AS batch FROM seg""")
def seg_batches(spark, d):
    return S.batches(seg(spark, d)).select("file_id", "ord", "batch")


@query("min_duration", f"""WITH {SEG} SELECT file_id, ord FROM seg WHERE "end" - start >= 1500""")
def min_duration(spark, d):
    return S.long_enough(seg(spark, d), 1500.0).select("file_id", "ord")


@query(
    "speaker_totals",
    f"""WITH {SEG} SELECT file_id, speaker, count(*) AS segments, round(sum("end" - start), 1) AS seconds, round(avg(confidence), 3) AS mean_confidence FROM seg GROUP BY ALL""",
)
def speaker_totals(spark, d):
    return S.speaker_totals(seg(spark, d)).select("file_id", "speaker", "segments", "seconds", "mean_confidence")


@query(
    "review_json",
    f"""WITH {SEG}, t AS (SELECT file_id, speaker, count(*) AS segments, round(sum("end" - start), 1) AS seconds, round(avg(confidence), 3) AS mean_confidence FROM seg GROUP BY ALL)
    SELECT t.file_id, t.speaker, segments, seconds, mean_confidence, len(l) AS listed, round(l[1], 3) AS first_start FROM t JOIN (SELECT file_id, speaker, list(start ORDER BY start, ord) AS l FROM seg GROUP BY ALL) USING (file_id, speaker)""",
)
def review_json(spark, d):
    """The review of each file, written as JSON and parsed again."""
    s = seg(spark, d)
    got = F.from_json("json", "speakers array<struct<speaker:string,segments:bigint,seconds:double,mean_confidence:double>>, segments array<struct<start:double,end:double,speaker:string,confidence:double>>")
    j = S.review(s).withColumn("_j", got).select("file_id", F.explode("_j.speakers").alias("s"), F.col("_j.segments").alias("l"))
    mine = F.filter("l", lambda x: x["speaker"] == F.col("s.speaker"))
    return j.select("file_id", "s.*", F.size(mine).cast("long").alias("listed"), F.round(mine[0]["start"], 3).alias("first_start"))


@query("talkative", f"""WITH {SEG} SELECT file_id, ord FROM seg QUALIFY sum("end" - start) OVER (PARTITION BY file_id, speaker) >= 300000""")
def talkative(spark, d):
    return S.talkative(seg(spark, d), 300000.0).select("file_id", "ord")


@query(
    "mode_ratio",
    f"""WITH {SEG}, n AS (SELECT file_id, speaker, count(*) AS n FROM seg GROUP BY ALL) SELECT file_id, arg_min(speaker, (-n, speaker)) AS mode, round(max(n) / sum(n), 6) AS ratio, count(*) AS n_distinct FROM n GROUP BY file_id""",
)
def mode_ratio(spark, d):
    return S.mode_ratio(seg(spark, d)).select("file_id", "mode", *_r("ratio", n=6), "n_distinct")


@query(
    "first_appearance",
    f"""WITH {SEG}, f AS (SELECT file_id, speaker, min((start, ord)) AS f FROM seg GROUP BY ALL), n AS (SELECT file_id, speaker, 'SPEAKER' || row_number() OVER (PARTITION BY file_id ORDER BY f) AS name FROM f)
    SELECT seg.file_id, seg.ord, n.name FROM seg JOIN n USING (file_id, speaker)""",
)
def first_appearance(spark, d):
    return S.first_appearance(seg(spark, d)).select("file_id", "ord", "name")


@query(
    "carried_context",
    f"""WITH RECURSIVE {TURNS}, o AS (SELECT file_id, ord, text, row_number() OVER (PARTITION BY file_id ORDER BY ord) AS k FROM turns),
    r AS (SELECT file_id, k, CASE WHEN text = '' THEN '' ELSE '0:' || text END AS got FROM o WHERE k = 1
      UNION ALL SELECT o.file_id, o.k, CASE WHEN o.text = '' THEN '' ELSE length(right(r.got, 20)) || ':' || right(r.got, 3) || o.text END FROM r JOIN o ON o.file_id = r.file_id AND o.k = r.k + 1)
    SELECT file_id, coalesce(string_agg(got, ' ' ORDER BY k) FILTER (WHERE got <> ''), '') AS text FROM r GROUP BY file_id""",
)
def carried_context(spark, d):
    """A stand-in for a model whose text shows what it was given: the length and the last three characters of the carried context."""
    t = turns(spark, d).select("file_id", "ord", "text")
    return S.transcribe_carried(t, lambda text, before: f"{len(before)}:{before[-3:]}{text}" if text else "", lambda text: text[-20:])


@query("job_totals", f"""WITH {SEG} SELECT count(*) AS files, count(*) FILTER (WHERE confidence < 0.5) AS failed, count(DISTINCT speaker) AS speakers FROM seg""")
def job_totals(spark, d):
    return S.job_totals(seg(spark, d), F.col("confidence") < 0.5)
