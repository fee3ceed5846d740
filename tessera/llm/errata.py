"""Operator 12: spelling variants by merging errata tries.

Words are counted in one pass: every document's distinct words are summed in the task before the shuffle. Two words one edit apart agree before
and after the edit, so for a shorter length m they share their first m // 2 characters, or else their last m - m // 2. Each word goes to the
groups of its length and of the length below by either half; a pair belongs to the group of its first half if it shares that, else to that of its last
half, so it is found once. A group of over LIMIT words is halved again in the same way inside what is left between the agreed ends, until one
character is left; its size is then bounded by the alphabet.

A group becomes a trie. From every node the largest child continues the heavy path; the subtrees of the others are merged with the edge's character
replaced, into a copy that is then walked together with the heavy child. With the edge's character skipped a child's subtree is walked together
with the node itself. A walk ends where either side does, so each costs no more than the light side. Terminals that coincide are one edit apart;
the words of one place and replaced character are counted as a class, without pairs.

Null and empty texts have no words. Rows that repeat count as often as they occur; a null doc_id stands as an empty string in the sum that
decides on deletions. Other columns are not read. An empty table gives no rows. Ties of n go to the smaller word. Words of any length are
whole keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import saved, shared_dir, table

LEAST_CHARS, LEAST_N, RATIO, DROP = 5, 3, 2, 97
LIMIT = 20_000
HELD = 200_000
_ALWAYS = 1 << 30
_RUNS = re.compile("[a-zÀ-ÿ]+").findall
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_GROUP = ["m", "head", "tail", "under", "pre", "suf"]


def altered(text: str, doc_id: object, drop: int = DROP) -> dict[str, int]:
    """Lower-cased runs of letters with their counts, those whose sum with the document's id is divisible by drop less one character."""
    out: dict[str, int] = {}
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    counts: dict[str, int] = {}
    for w in _RUNS(text.encode().translate(_LOWER).decode()):
        counts[w] = counts.get(w, 0) + 1
    for w, n in counts.items():
        h = crc32(w.encode(), start)
        if not h % drop:
            k = h % len(w)
            w = w[:k] + w[k + 1 :]
        out[w] = out.get(w, 0) + n
    return out


def vocabulary(df: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, drop: int = DROP) -> DataFrame:
    """(word, n) of the altered runs of at least least_chars code points and least_n occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for w, n in altered(t or "", i, drop).items():
                        if len(w) >= least_chars:
                            held[w] = held.get(w, 0) + n
                    if len(held) > HELD:
                        yield batch(held)
                        held = {}
        yield batch(held)

    def batch(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    counts = df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _halved(rows: DataFrame) -> DataFrame:
    """Rows (m, head, tail, under, word, n) in both groups that they go to when what lies between the agreed ends is halved. Pairs of a group have fewer than under characters in common from the start."""
    half = F.floor((F.col("m") - F.col("head") - F.col("tail")) / 2).cast("int")
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("under").alias("under"))
    second = F.struct(F.col("head").alias("head"), (F.col("m") - F.col("head") - half).alias("tail"), F.least("under", F.col("head") + half).alias("under"))
    out = rows.select("m", "word", "n", F.explode(F.array(first, second)).alias("g")).select("m", "g.*", "word", "n")
    return out.withColumn("pre", F.expr("left(word, head)")).withColumn("suf", F.expr("right(word, tail)"))


def grouped(words: DataFrame, where: str, least_chars: int = LEAST_CHARS, limit: int = LIMIT) -> DataFrame:
    """Words (word, n) in groups of at most limit words, but for those that can't be halved."""
    size = F.length("word")
    m = F.explode(F.filter(F.array(size, size - 1), lambda x: x >= least_chars))
    rows = _halved(words.select("word", "n", m.alias("m"), F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit(_ALWAYS).alias("under")))
    for k in range(64):
        sizes = rows.groupBy(*_GROUP).count().where((F.col("count") > limit) & (F.col("m") - F.col("head") - F.col("tail") >= 2))
        hot = saved(sizes.drop("count"), f"{where}/hot{k}")
        if hot.isEmpty():
            return rows
        rows = saved(rows.join(hot, _GROUP, "left_anti").unionByName(_halved(rows.join(hot, _GROUP, "left_semi").drop("pre", "suf"))), f"{where}/rows{k}")
    return rows


class Node:
    __slots__ = ("below", "word", "size")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        self.word = -1
        self.size = 0


class Merged:
    """A node of light subtrees that have been merged with one character replaced."""

    __slots__ = ("below", "words")

    def __init__(self) -> None:
        self.below: dict[str, Merged] = {}
        self.words: list[int] = []

    def take(self, node: Node) -> None:
        stack = [(self, node)]
        while stack:
            to, n = stack.pop()
            if n.word >= 0:
                to.words.append(n.word)
            for c, x in n.below.items():
                if c not in to.below:
                    to.below[c] = Merged()
                stack.append((to.below[c], x))


def meetings(a: Node, b: Node) -> Iterator[tuple[int, int]]:
    """Words of a and b whose ends coincide."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a.word >= 0 and b.word >= 0:
            yield a.word, b.word
        few, many = a.below, b.below
        if len(few) <= len(many):
            stack += [(x, many[c]) for c, x in few.items() if c in many]
        else:
            stack += [(few[c], x) for c, x in many.items() if c in few]


def planted(words: list[str], head: int) -> Node:
    """The trie of distinct words of one beginning of head characters, from there on."""
    root = Node()
    for k, w in enumerate(words):
        at = root
        at.size += 1
        for c in w[head:]:
            to = at.below.get(c)
            if to is None:
                to = at.below[c] = Node()
            to.size += 1
            at = to
        at.word = k
    return root


def classes(words: list[str], m: int, head: int, under: int) -> Iterator[list[int]]:
    """Classes of places in words: the words of a class are one edit apart, each from all others, and every pair is in one class. Pairs of length m and of m and m + 1 whose common beginning is of head to under - 1 characters."""
    stack = [(planted(words, head), head)]
    while stack:
        x, depth = stack.pop()
        below = x.below
        if below and depth < under:
            if len(below) > 1:
                heavy = max(below.values(), key=lambda n: n.size)
                light = [n for n in below.values() if n is not heavy]
                if len(light) == 1:
                    yield from ([i, j] for i, j in meetings(light[0], heavy) if len(words[i]) == m)
                else:
                    merged = Merged()
                    for n in sorted(light, key=lambda n: -n.size):  # the smaller into the larger
                        merged.take(n)
                    walk = [(merged, heavy)]
                    while walk:
                        a, b = walk.pop()
                        ends = a.words if b is None or b.word < 0 else [*a.words, b.word]
                        if len(ends) > 1 and len(words[ends[0]]) == m:
                            yield ends
                        walk += [(y, b.below.get(c) if b is not None else None) for c, y in a.below.items()]
            for c, skipped in below.items():
                if skipped.word >= 0 and x.word >= 0:
                    yield [skipped.word, x.word]
                few = skipped.below if len(skipped.below) <= len(below) else below
                for d in few:
                    if d != c and d in skipped.below and d in below:
                        yield from map(list, meetings(skipped.below[d], below[d]))
        if depth + 1 < under:
            stack += [(n, depth + 1) for n in below.values() if n.size > 1]


def near_counts(words: list[str], n: list[int], m: int, head: int, under: int) -> tuple[list[int], list[tuple[int, str] | None]]:
    """For each word the number of its near words in the group, and of the best of them its negative n and itself."""
    count, best = [0] * len(words), [None] * len(words)
    for c in classes(words, m, head, under):
        order = sorted((-n[k], words[k], k) for k in c)
        for at, (_, _, k) in enumerate(order):
            count[k] += len(c) - 1
            other = order[1 if at == 0 else 0][:2]
            if best[k] is None or other < best[k]:
                best[k] = other
    return count, best


def near(groups: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of groups: near words found there, and the best of them. A word may come from several groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for k in range(0, b.num_rows, 2000) for r in zip(*(c.to_pylist() for c in b.slice(k, 2000).columns)))
        out: list[tuple] = []
        for key, members in groupby(rows, key=lambda r: r[:6]):
            got = [r[6:] for r in members]
            if len(got) > 1:
                words = [w for w, _ in got]
                count, best = near_counts(words, [k for _, k in got], key[0], key[1], key[3])
                out += [(w, c, -b[0], b[1]) for w, c, b in zip(words, count, best) if c]
            if len(out) > 10_000:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "form_n", "form"])

    dealt = groups.select(*_GROUP, "word", "n").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "word")
    return dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")


def rooted(forms: DataFrame, where: str) -> DataFrame:
    """forms (word, form, ...) with root, the last word that is reached by following forms: the steps known double in every round, until none is longer."""
    links = saved(forms.where("form IS NOT NULL").withColumn("root", F.col("form")), f"{where}/links")
    for k in range(64):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = links.join(on, "root", "left")
        links = saved(longer.select(*[F.col(c) for c in links.columns if c != "root"], F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), f"{where}/links{k}")
        last = links.where("_moved").isEmpty()
        links = links.drop("_moved")
        if last:
            break
    return links.unionByName(forms.where("form IS NULL").withColumn("root", F.col("word")))


def variants(df: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, ratio: int = RATIO, drop: int = DROP, limit: int = LIMIT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts."""
    where = shared_dir(df.sparkSession)
    words = saved(vocabulary(df, text, key, least_chars, least_n, drop), f"{where}/words")
    found = near(grouped(words, where, least_chars, limit))
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<m:bigint,form:string>").alias("b"))
    found = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("form_n")).alias("m"), "form").alias("b"))
    best = every.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("b").alias("b"))
    form_n = F.when(-F.col("b.m") >= ratio * F.col("n"), -F.col("b.m"))
    forms = best.select("word", "n", "n_near", form_n.alias("form_n"), "b").select("word", F.when(F.col("form_n").isNotNull(), F.col("b.form")).alias("form"), "n", "n_near", "form_n")
    out = rooted(saved(forms, f"{where}/forms"), where)
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_errata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same with a table of the checksum's steps, the strings with one character left out or replaced as join keys, and a recursion for the roots."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table_ = f"WITH RECURSIVE b(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, {step} FROM b WHERE k < 8) SELECT list(c ORDER BY i) FROM b WHERE k = 8"
    code = "unicode(c)"
    utf8 = f"flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN {code} < 128 THEN [{code}] ELSE [192 + ({code} >> 6), 128 + ({code} & 63)] END))"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT ({table_}) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, {utf8}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, crc),
altered AS (SELECT CASE WHEN h % {DROP} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_N}),
cuts AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS u, b.word AS v, b.n FROM cuts a JOIN cuts b USING (i, less) WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.less = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.less = b.word),
best AS (SELECT u, count(*) AS n_near, min(struct_pack(m := -n, v := v)) AS b FROM pairs GROUP BY u),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= {RATIO} * n THEN b.v END AS form, CASE WHEN -b.m >= {RATIO} * n THEN -b.m END AS form_n FROM words LEFT JOIN best ON u = word),
follow(word, tip) AS (SELECT word, word FROM forms UNION ALL SELECT f.word, g.form FROM follow f JOIN forms g ON g.word = f.tip WHERE g.form IS NOT NULL)
SELECT f.word, f.form, r.tip AS root, f.n, f.n_near, f.form_n FROM forms f JOIN follow r USING (word) JOIN forms g ON g.word = r.tip WHERE g.form IS NULL
"""
