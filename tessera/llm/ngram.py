"""Operator 1: an interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped files.

Counting: every task counts the words and word pairs of its documents as sorted hash arrays and sends them, packed, to parts:
words by hash range, pairs by the hash of the first word and SALT classes of the second, so that no frequent word is in one part
alone. A part adds up its arrays, writes its pairs as one sorted array file and hands on what the words need (as first word: sum
and counts of counts; as second: distinct first words). The ranges of words gather that into sorted array files of their own.
Sums of a few numbers over all parts give the discounts.

Scoring maps the files and looks up the distinct words and pairs of a block of texts in sorted order. What is in memory is a
block of texts and the pages touched; the files grow with the corpus and are on disk.

p(w|v) = (c(vw) - D(c)) / c(v.) + g(v) pc(w);  pc(w) = (n(.w) - D'(n)) / n(..) + g' / (V + 1), which also is what an unknown
word gets, less the first term; after an unknown word p is pc. A text starts after a mark that is no token and ends with the end token.

Words are told apart by 64 bits of hash, in pairs by 48 of them. Null and empty texts are the end token alone. A null doc_id trains and is
not held out. Repeated rows count as often as they come. Without training documents every token has c = 0 and pc = 1. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import arrays, textvec
from tessera.llm.common import saved, shared_dir, table

HELD_OUT = (7, 2)
SALT = 16
FLUSH = 3_000_000
END = np.uint64(0xE5D0000000000001)
START = np.uint64(0x57A2000000000001)
_48 = np.uint64(16)
WORD, PAIR, FIRST, SECOND = 0, 1, 2, 3


def sequences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end each, the word before each, and the number of each text."""
    _, _, row, h = textvec.tokens(data, off)
    rows = len(off) - 1
    n = np.bincount(row, minlength=rows)
    seq = np.empty(len(h) + rows, np.uint64)
    seq[np.arange(len(h)) + row] = h
    ends = np.cumsum(n) + np.arange(rows)
    seq[ends] = END
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[ends - n] = START
    return seq, before, n + 1


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textvec.mix(v * textvec.BASE + w)


def pair_part(v: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((textvec.mix(v) >> np.uint64(20)) + (w % np.uint64(SALT)) * np.uint64(7919)) % np.uint64(parts)).astype(np.int64)


def word_part(w: np.ndarray, parts: int) -> np.ndarray:
    return (((w >> np.uint64(48)) * np.uint64(parts)) >> np.uint64(16)).astype(np.int64)


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def _runs(labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edge = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]))
    for i, j in zip(edge[:-1], edge[1:]):
        if j > i:
            yield int(labels[i]), int(i), int(j)


def _counted(seq: np.ndarray, before: np.ndarray, parts: int, ranges: int) -> Iterator[tuple[int, int, bytes]]:
    w, c = summed(seq, np.ones(len(seq), np.uint64))
    for p, i, j in _runs(word_part(w, ranges)):
        yield parts + p, WORD, arrays.packed((w[i:j], True), (c[i:j], False))
    v, w = before >> _48, seq >> _48
    _, at, n = np.unique(pair_key(v, w), return_index=True, return_counts=True)
    v, w = v[at], w[at]
    part = pair_part(v, w, parts)
    order = np.lexsort((v, part))
    v, w, n, part = v[order], w[order], n[order], part[order]
    for p, i, j in _runs(part):
        yield p, PAIR, arrays.packed((v[i:j], True), (w[i:j], False), (n[i:j], False))


class Model:
    """Mapped files of a model and its constants."""

    def __init__(self, where: str, parts: int, ranges: int, sums: dict[str, int]):
        self.where, self.parts, self.ranges, self.sums = where, parts, ranges, sums
        self.files: dict[str, list[np.ndarray]] = {}
        self.pair_discount = self.discounts(*(sums[f"p{k}"] for k in range(1, 5)))
        self.word_discount = self.discounts(*(sums[f"w{k}"] for k in range(1, 5)))
        d = self.word_discount
        self.pairs = max(1, sums["pairs"])
        left = d[1] * sums["w1"] + d[2] * sums["w2"] + d[3] * (sums["pair_words"] - sums["w1"] - sums["w2"])
        self.floor = left / self.pairs / (sums["words"] + 1) if sums["pairs"] else 1.0

    @staticmethod
    def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
        """D of counts 0, 1, 2 and from 3 on; plain values where too few counts are seen to estimate them."""
        if not (n1 and n2 and n3):
            return np.array([0.0, 0.5, 0.75, 0.9])
        y = n1 / (n1 + 2 * n2)
        raw = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        return np.clip(raw, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])

    def file(self, name: str) -> list[np.ndarray]:
        if name not in self.files:
            self.files[name] = arrays.mapped(f"{self.where}/{name}")
        return self.files[name]

    def words(self, w: np.ndarray) -> list[np.ndarray]:
        """Count, distinct words before, and as a first word sum and counts of counts, of sorted distinct words."""
        out = [np.zeros(len(w), np.float64) for _ in range(6)]
        for p, i, j in _runs(word_part(w, self.ranges)):
            keys, *columns = self.file(f"words-{p}")
            at, there = arrays.found(keys, w[i:j])
            for o, column in zip(out, columns):
                o[i:j][there] = column[at[there]]
        return out

    def pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        part = pair_part(v, w, self.parts)
        key = (part.astype(np.uint64) << np.uint64(48)) | (pair_key(v, w) >> _48)
        key, back = np.unique(key, return_inverse=True)
        out = np.zeros(len(key), np.float64)
        for p, i, j in _runs((key >> np.uint64(48)).astype(np.int64)):
            keys, small, at_large, large = self.file(f"pairs-{p}")
            at, there = arrays.found(keys, key[i:j])
            got = np.zeros(j - i, np.float64)
            got[there] = small[at[there]]
            big = np.flatnonzero(got == 255)
            if len(big):
                got[big] = large[np.searchsorted(at_large, at[big])]
            out[i:j] = got
        return out[back]

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text of a block."""
        seq, before, n = sequences(data, off)
        known, back = np.unique(np.append(seq, START), return_inverse=True)
        count, ways, total, one, two, more = self.words(known)
        w, d, e = back[:-1], self.pair_discount, self.word_discount
        lower = np.maximum(0.0, ways - e[np.minimum(ways, 3).astype(int)]) / self.pairs + self.floor
        firsts = np.cumsum(n) - n
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[firsts] = back[-1]
        c = self.pair_counts(before >> _48, seq >> _48)
        some = np.maximum(total, 1.0)
        left = (d[1] * one + d[2] * two + d[3] * more) / some
        p = np.where(total[v] > 0, np.maximum(0.0, c - d[np.minimum(c, 3).astype(int)]) / some[v] + left[v] * lower[w], lower[w])
        base = np.log10((count[w] + 1) / (self.sums["tokens"] + self.sums["words"] + 1))
        add = lambda x: np.add.reduceat(x, firsts)
        return n, add((count[w] > 0).astype(np.int64)), add(base), add(np.log10(p))


def train(df: DataFrame, where: str, text: str = "text") -> Model:
    """Counts the texts of df and writes a model to the folder where."""
    spark = df.sparkSession
    parts = min(65_535, max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    ranges = max(1, parts // 4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            rows = [*zip(*_counted(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), parts, ranges))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], ["part", "kind", "data"])

        for b in batches:
            for _, _, data, off in textvec.blocks(b.column(0)):
                held.append(sequences(data, off)[:2])
                if sum(len(h[0]) for h in held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    names = ["part", "kind", "data", "pairs", "p1", "p2", "p3", "p4", "tokens", "words", "pair_words", "w1", "w2", "w3", "w4"]
    schema = "part int, kind int, data binary, " + ", ".join(f"{c} long" for c in names[3:])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = [*zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[3:])], names)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[list[np.ndarray]]]]]:
        part, got = None, {}
        for b in batches:
            for p, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if p != part:
                    if part is not None:
                        yield part, got
                    part, got = p, {}
                got.setdefault(kind, []).append(arrays.unpacked(data.as_buffer()))
        if part is not None:
            yield part, got

    def add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in groups(batches):
            if WORD in got:
                w, c = summed(*(np.concatenate(x) for x in zip(*got[WORD])))
                yield rows_of([(part - parts, WORD, arrays.packed((w, True), (c, False)), *[0] * 12)])
                continue
            v, w, n = (np.concatenate(x) for x in zip(*got[PAIR]))
            key = pair_key(v, w) >> _48
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else order
            n = np.add.reduceat(n[order], first) if len(key) else n
            key, v, w = key[first], v[order][first], w[order][first]
            large = np.flatnonzero(n >= 255)
            arrays.put(f"{where}/pairs-{part}", [key | (np.uint64(part) << np.uint64(48)), np.minimum(n, 255).astype(np.uint8), large, n[large]])
            out = []
            is_ = lambda k: (n == k).astype(np.uint64)
            a, *sums = summed(v, n, is_(1), is_(2), (n > 2).astype(np.uint64))
            for p, i, j in _runs(word_part(a << _48, ranges)):
                out.append((p, FIRST, arrays.packed((a[i:j], True), *((s[i:j], False) for s in sums)), *[0] * 12))
            a, ways = summed(w, np.ones(len(w), np.uint64))
            for p, i, j in _runs(word_part(a << _48, ranges)):
                out.append((p, SECOND, arrays.packed((a[i:j], True), (ways[i:j], False)), *[0] * 12))
            out.append((0, -1, b"", len(n), *(int((n == k).sum()) for k in range(1, 5)), *[0] * 7))
            yield rows_of(out)

    def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in groups(batches):
            nothing = [np.zeros(0, np.uint64)]
            w, c = (np.concatenate(x) for x in zip(*got.get(WORD, [nothing * 2])))
            start = word_part(np.array([START]), ranges)[0] == part
            if start:
                at = int(np.searchsorted(w, START))
                w, c = np.insert(w, at, START), np.insert(c, at, np.uint64(0))
            seconds, ways = summed(*(np.concatenate(x) for x in zip(*got.get(SECOND, [nothing * 2]))))
            firsts = summed(*(np.concatenate(x) for x in zip(*got.get(FIRST, [nothing * 5]))))
            short = w >> _48
            at, there = arrays.found(seconds, short)
            before = np.where(there, ways[at] if len(ways) else 0, 0)
            at, there = arrays.found(firsts[0], short)
            stats = [np.where(there, s[at] if len(s) else 0, 0) for s in firsts[1:]]
            arrays.put(f"{where}/words-{part}", [w, c.astype(np.float64), before.astype(np.float32), stats[0].astype(np.float64), *(s.astype(np.float32) for s in stats[1:])])
            yield rows_of([(part, 0, b"", 0, 0, 0, 0, 0, int(c.sum()), len(w) - int(start), int((before > 0).sum()), *(int((before == k).sum()) for k in range(1, 5)))])

    counted = df.select(text).mapInArrow(count, "part int, kind int, data binary")
    nothing = np.zeros(0, np.uint64)
    # Every part and range has an empty row, so that each has a file.
    empty = lambda n, at, kind, k: spark.range(n).select((F.col("id") + at).cast("int").alias("part"), F.lit(kind).alias("kind"), F.lit(arrays.packed(*[(nothing, False)] * k)).alias("data"))
    every = counted.unionByName(empty(parts, 0, PAIR, 3)).unionByName(empty(ranges, parts, WORD, 2))
    gathered = saved(every.repartition("part").sortWithinPartitions("part").mapInArrow(add_pairs, schema), f"{where}/gathered")
    rows = gathered.where("kind >= 0").select("part", "kind", "data")
    words = saved(rows.repartition("part").sortWithinPartitions("part").mapInArrow(add_words, schema), f"{where}/sums")
    total = words.unionByName(gathered).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names[3:]]).first().asDict()
    return Model(where, parts, ranges, total)


def scored(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, n_known, base_score and score of every row. Columns of keep may have any names; one that is named like a result is left out."""
    where, parts, ranges, sums = model.where, model.parts, model.ranges, model.sums
    names = ["n_tokens", "n_known", "base_score", "score"]
    keep = tuple(c for c in keep if c not in names)
    inner = [f"_in{k}" for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(where, parts, ranges, sums)
        for b in batches:
            for i, j, data, off in textvec.blocks(b.column(len(keep))):
                n, known, base, score = m.score(data, off)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(len(keep))), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], [*inner, *names])

    out = "".join(f"{k} {df.schema[c].dataType.simpleString()}, " for k, c in zip(inner, keep))
    rows = df.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(inner, keep)], F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, f"{out}n_tokens long, n_known long, base_score double, score double").select(*[F.col(k).alias(c) for k, c in zip(inner, keep)], *names)


def held_out(key: Column) -> Column:
    """Whether the key is in the class that doesn't train; a null isn't."""
    divisor, rest = HELD_OUT
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % divisor == rest, F.lit(False))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")), f"{shared_dir(spark)}/ngrams")
    return scored(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.sums["tokens"])).cast("long").alias("train_tokens"), "base_score", "score")
