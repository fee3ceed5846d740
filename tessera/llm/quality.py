"""Operator 9: quality rules by distribution divergence. DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with those of its language
by the Jensen-Shannon distance (base 2, 0 to 1). Every language with REFERENCE_CHARS characters in all documents has a reference, counted over all of them; null is a language
of its own. Documents of other languages aren't judged by their distribution, for there is nothing to compare them with. A word is common if its share
of the language's words is at least WORD_SHARE, so a language has at most 1/WORD_SHARE of them. References are broadcast up to BROADCAST languages
and joined by language beyond. Guards: the classes count from MIN_CHARS characters on, the words from MIN_WORDS words on;
a shorter document is not judged by that histogram.

Texts are whole. A null or empty text has no words and so fails the base rule; repeated rows are judged alike; extra columns are
not read but for those asked for, of any names; one that is named like a result is left out. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fixed, let, saved, shared_dir, table, words

WORD_SHARE = 0.004
REFERENCE_CHARS = 20_000
BROADCAST = 1000
MIN_CHARS = 200
MIN_WORDS = 40
MAX_CLASS_DISTANCE = 0.20
#: Short texts stray further by chance: this over the root of the characters is added to the limit.
CLASS_SLACK = 1.5
MAX_WORD_DISTANCE = 0.45
WINDOW = 5
CLASSES = ("lower", "upper", "digit", "point", "symbol", "space")
_CLASS = {"upper": r"\p{Lu}", "digit": r"\p{N}", "point": r"[.,;:?'()-]", "symbol": r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:?'()-]"}
#: Runs of these make up most of a text and are in no counted class; what is left is short.
_PLAIN = r"[a-z\x20\n\p{Ll}]+"
SLOTS = 4096
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def repeated_words(tokens: Column, n: int = WINDOW) -> Column:
    """Number of words inside n-word windows whose words occur twice or more in the text."""

    def covered(grams: Column) -> Column:
        marked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        firsts = let(marked, lambda m: F.sort_array(F.filter(F.transform(m, lambda x, k: F.when(((k > 0) & (F.get(m, k - 1)["g"] == x["g"])) | F.coalesce(F.get(m, k + 1)["g"] == x["g"], F.lit(False)), x["i"])), lambda i: i.isNotNull())))
        step = lambda s, i: F.struct(i.alias("p"), (s["t"] + F.least(F.lit(n), i - s["p"])).alias("t"))
        return F.aggregate(firsts, F.struct(F.lit(-n).alias("p"), F.lit(0).alias("t")), step, lambda s: s["t"].cast("long"))

    at = F.sequence(F.lit(0), F.size(tokens) - n)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]))
    grams = F.transform(at, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))
    none = F.lit(0).cast("long")
    # Distinct hashes prove distinct windows; only a text with equal hashes has its windows compared as strings.
    return F.when(F.size(tokens) <= n, none).when(F.size(F.array_distinct(hashes)) == F.size(tokens) - (n - 1), none).otherwise(let(grams, covered))


def _share(p: Column, q: Column) -> Column:
    """What one bin adds to the divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) / 2


def _counted(rest: Column) -> dict[str, Column]:
    return {c: (F.length(rest) - F.length(F.regexp_replace(rest, p, ""))).cast("long") for c, p in _CLASS.items()}


def measured(df: DataFrame, text: str = "text", language: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each document: one pass, no shuffle."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = df.select(*[F.col(f"`{c}`").alias(i) for i, c in keep], F.coalesce(F.col(f"`{language}`"), F.lit("")).alias("_lang"), body.alias("_body"))
    keep = [i for i, _ in keep]
    out = fixed(named, [*keep, "_lang", "_body"], words(F.col("_body")).alias("_words"), F.regexp_replace("_body", _PLAIN, "").alias("_rest"))
    lines = F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines).select(
        *keep,
        "_lang",
        "_words",
        F.length("_body").cast("long").alias("_chars"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_rest") - F.length(F.regexp_replace("_rest", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        *[v.alias(f"_{c}") for c, v in _counted(F.col("_rest")).items()],
    )
    return out.withColumn("_space", F.col("_chars") - F.col("word_chars")).withColumn("_lower", F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("_point") - F.col("_symbol"))


def references(df: DataFrame, where: str, text: str = "text", language: str = "lang", word_share: float = WORD_SHARE) -> DataFrame:
    """(_lang, _index map word -> bin, _mask of the slots of their hashes, _q share of each bin, the last for all other words, _qc share of each class) of every language with enough text.

    One pass over the documents: a row for each word, and one without a word that carries the document's sums, aggregated together and written to where.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = df.select(F.coalesce(F.col(f"`{language}`"), F.lit("")).alias("_lang"), body.alias("_body"), words(body).alias("_words"), F.regexp_replace(body, _PLAIN, "").alias("_rest"))
    count = _counted(F.col("_rest"))
    named = base.select("_lang", F.length("_body").cast("long").alias("_chars"), F.length(F.array_join("_words", "")).cast("long").alias("_solid"), *[v.alias(k) for k, v in count.items()], "_words")
    sums = ["_chars", "_solid", *count]
    rows = named.select("_lang", *sums, F.explode(F.concat(F.array(F.lit(None).cast("string")), F.transform("_words", F.lower))).alias("_w"))
    seen = rows.groupBy("_lang", "_w").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.when(F.col("_w").isNull(), F.col(c))).alias(c) for c in sums])
    seen = saved(seen, where)
    kept = seen.where(F.col("_w").isNull() & (F.col("_chars") >= REFERENCE_CHARS))
    total = F.greatest(F.col("_chars"), F.lit(1)).cast("double")
    part = {c: F.col(c) for c in count} | {"space": F.col("_chars") - F.col("_solid"), "lower": F.col("_solid") - sum(F.col(c) for c in count)}
    classes = kept.select("_lang", F.array(*[part[c] / total for c in CLASSES]).alias("_qc"))

    both = seen.where("_w IS NOT NULL").select("_lang", "_w", "_n")
    sizes = both.groupBy("_lang").agg(F.sum("_n").cast("double").alias("_all")).join(classes.select("_lang"), "_lang")
    few = classes.limit(BROADCAST + 1).count() <= BROADCAST  # a row each of known languages; without a broadcast, a language's words would meet in one task
    common = both.join(F.broadcast(sizes) if few else sizes, "_lang").where(F.col("_n") >= word_share * F.col("_all"))
    bins = common.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_w").alias("w"), (F.col("_n") / F.col("_all")).alias("q")))).alias("_bins"))
    q = F.transform("_bins", lambda b: b["q"])
    slots = F.transform("_bins", lambda b: F.pmod(F.hash(b["w"]), F.lit(SLOTS)))
    known = bins.select(
        "_lang",
        F.map_from_arrays(F.transform("_bins", lambda b: b["w"]), F.sequence(F.lit(0), F.size("_bins") - 1)).alias("_index"),
        let(slots, lambda taken: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.array_contains(taken, k))).alias("_mask"),
        F.concat(q, F.array(1.0 - F.aggregate(q, F.lit(0.0), lambda a, x: a + x))).alias("_q"),
    )
    return classes.join(known, "_lang", "left")


def word_distance(tokens: Column, index: Column, mask: Column, q: Column, n: Column) -> Column:
    """Distance of the common-word histograms; null where the language has no common words."""
    likely = F.filter(F.transform(tokens, F.lower), lambda w: F.get(mask, F.pmod(F.hash(w), F.lit(SLOTS))))
    bins = F.sort_array(F.filter(F.transform(likely, lambda w: F.element_at(index, w)), lambda k: k.isNotNull()))
    zero = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("r"), F.lit(0).alias("seen"), F.lit(0.0).alias("d"), F.lit(0.0).alias("qs"))
    of = lambda s: F.when(s["k"] >= 0, _share(s["r"] / n, F.get(q, s["k"]))).otherwise(0.0)
    qk = lambda s: F.when(s["k"] >= 0, F.get(q, s["k"])).otherwise(0.0)

    def step(s: Column, k: Column) -> Column:
        same = s["k"] == k
        return F.struct(k.alias("k"), F.when(same, s["r"] + 1).otherwise(1).alias("r"), (s["seen"] + 1).alias("seen"), F.when(same, s["d"]).otherwise(s["d"] + of(s)).alias("d"), F.when(same, s["qs"]).otherwise(s["qs"] + qk(s)).alias("qs"))

    def end(s: Column) -> Column:
        other = F.element_at(q, -1)
        unseen = 1.0 - other - s["qs"] - qk(s)
        return F.sqrt(F.greatest(F.lit(0.0), s["d"] + of(s) + unseen / 2 + _share((n - s["seen"]) / n, other)))

    return F.aggregate(bins, zero, step, end)


def quality(df: DataFrame, text: str = "text", language: str = "lang", keep: tuple[str, ...] = ("doc_id",), refs: DataFrame | None = None) -> DataFrame:
    """keep, the counts, base_failed, class_distance, word_distance (null where a guard holds) and kept."""
    where = f"{shared_dir(df.sparkSession)}/quality"
    if refs is None:
        refs = saved(references(df, f"{where}/words", text, language), f"{where}/references")
    few = refs.limit(BROADCAST + 1).count() <= BROADCAST
    keep = tuple(c for c in keep if c not in RESULTS)
    d = measured(df, text, language, [(f"_in{k}", c) for k, c in enumerate(keep)]).join(F.broadcast(refs) if few else refs, "_lang", "left")
    chars = F.greatest(F.col("_chars"), F.lit(1)).cast("double")
    classes = sum(_share(F.col(f"_{c}") / chars, F.get("_qc", F.lit(k))) for k, c in enumerate(CLASSES))
    d = d.withColumns(
        {
            "class_distance": F.when((F.col("_chars") >= MIN_CHARS) & F.col("_qc").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), classes))),
            "word_distance": F.when((F.col("n_words") >= MIN_WORDS) & F.col("_index").isNotNull(), word_distance(F.col("_words"), F.col("_index"), F.col("_mask"), F.col("_q"), F.col("n_words").cast("double"))),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )
    good = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= MAX_CLASS_DISTANCE + CLASS_SLACK / F.sqrt(chars)) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE)
    d = d.withColumn("kept", ~F.col("base_failed") & good)
    out = fixed(d, [f"_in{k}" for k in range(len(keep))], *[F.col(c) for c in RESULTS])
    return out.select(*[F.col(f"_in{k}").alias(c) for k, c in enumerate(keep)], *RESULTS)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("class_distance", "word_distance")


def oracle_sql() -> str:
    """The whole operator in SQL."""
    gap = r"[\x20\x09-\x0D]"
    n = {c: f"length(body) - length(regexp_replace(body, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for c, p in _CLASS.items()}
    bins = {c: f"_{c}" for c in CLASSES}
    part = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body, coalesce(lang, '') AS lang FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(body, '{gap}+'), lambda x: x <> '') AS words FROM d),
    g AS (SELECT rid, i, words[i:i + {WINDOW - 1}] AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
    dup AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
    rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, range({WINDOW}) AS t(k) GROUP BY rid),
    m AS (SELECT w.*, length(body) AS _chars, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(rep.n, 0) AS n_repeat_words, {", ".join(f"{v} AS _{c}" for c, v in n.items())} FROM w LEFT JOIN rep USING (rid)),
    c AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, _chars - word_chars AS _space, word_chars - _upper - _digit - _point - _symbol AS _lower FROM m),
    both_ AS (SELECT lang AS k, * FROM c),
    r AS (SELECT k, greatest(sum(_chars), 1)::DOUBLE AS t, count(*) AS docs, {", ".join(f"sum({v})::DOUBLE AS q_{x}" for x, v in bins.items())} FROM both_ GROUP BY k),
    known AS (SELECT * FROM r WHERE t >= {REFERENCE_CHARS}),
    x AS (SELECT k, rid, lower(unnest(words)) AS word FROM both_), nw AS (SELECT k, word, count(*) AS n FROM x GROUP BY ALL), tw AS (SELECT k, sum(n)::DOUBLE AS t FROM nw GROUP BY k),
    common AS (SELECT nw.k, word, n / tw.t AS q FROM nw JOIN tw USING (k) JOIN known USING (k) WHERE n >= {WORD_SHARE} * tw.t), rest AS (SELECT k, 1 - sum(q) AS q FROM common GROUP BY k),
    c2 AS (SELECT c.*, lang AS k FROM c),
    cd AS (SELECT rid, sqrt(greatest(0.0, {" + ".join(part(f"({v} / greatest(_chars, 1)::DOUBLE)", f"(q_{x} / t)") for x, v in bins.items())})) AS d FROM c2 JOIN known USING (k)),
    dw AS (SELECT c2.rid, c2.k, x.word, count(*) AS n FROM c2 JOIN x ON x.rid = c2.rid AND x.k = c2.k GROUP BY ALL),
    hit AS (SELECT dw.rid, dw.k, dw.n, common.q, c2.n_words FROM dw JOIN common ON common.k = dw.k AND common.word = dw.word JOIN c2 ON c2.rid = dw.rid),
    s AS (SELECT rid, sum({part("(n / n_words::DOUBLE)", "q")}) AS d, sum(n) AS seen, sum(q) AS qs FROM hit GROUP BY rid),
    wd AS (SELECT c2.rid, sqrt(greatest(0.0, coalesce(s.d, 0) + (1 - rest.q - coalesce(s.qs, 0)) / 2 + {part("((n_words - coalesce(s.seen, 0)) / n_words::DOUBLE)", "rest.q")})) AS d FROM c2 LEFT JOIN s USING (rid) JOIN rest ON rest.k = c2.k WHERE n_words >= {MIN_WORDS})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
      NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(_chars < {MIN_CHARS} OR cd.d <= {MAX_CLASS_DISTANCE} + {CLASS_SLACK} / sqrt(greatest(_chars, 1)::DOUBLE), true) AND coalesce(wd.d <= {MAX_WORD_DISTANCE}, true) AS kept
    FROM c2 LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid)
    """
